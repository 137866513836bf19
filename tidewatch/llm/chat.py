"""Chat formatting from event logs: deltas, edits and regenerations are folded into messages, which are rendered with a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, CLOSE, END = "[", "]", "</s>"
# Control strings hold ``[``, ``]`` or ``<``.  In texts these and the escape sign itself are written as the sign and a digit.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("]", "\\3"))
DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"
RUN = 256                 # events of a message or turns of a conversation that are first joined among themselves


def escaped(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _joined(parts: DataFrame, keys: list[str], place: str, text: str) -> DataFrame:
    """The texts of each key in order of ``place``, as one: runs of RUN places first, so that a long log is joined by many tasks."""
    in_run = (parts.groupBy(*keys, F.floor(F.col(place) / RUN).alias("_run")).agg(F.sort_array(F.collect_list(F.struct(place, F.col(text).alias("_t")))).alias("_p"))
              .select(*keys, "_run", F.array_join(F.col("_p._t"), "").alias("_t")))
    return (in_run.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_run", "_t"))).alias("_p")).select(*keys, F.array_join(F.col("_p._t"), "").alias(text)))


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys of which null equals null; the keys come back once."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(other, on).drop(*[f"_{k}" for k in keys])


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of an event log: ``conv_id, message, role, text`` from ``conv_id, seq, message, kind, role, text``.

    Inside a message, by ``seq``: a ``delta`` appends its text, an ``edit`` puts its text in place of all before it, and a ``regenerate``
    drops all before it and begins with its own text.  Null text counts as empty and any other kind as a delta.  Events that tie in
    ``seq`` are taken by kind and text.  The role is the latest one that is not null.  A null conversation or message is one of its own;
    null ``seq`` comes first; further columns are ignored; no events give no messages."""
    keys = ["conv_id", "message"]
    e = events.select("conv_id", "message", "seq", F.coalesce("kind", F.lit(DELTA)).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "kind", "text", "role")))
    heads = e.groupBy(*keys).agg(F.max(F.when(F.col("kind").isin(EDIT, REGENERATE), F.col("place"))).alias("reset"),
                                 F.max(F.when(F.col("role").isNotNull(), F.struct("place", "role"))).alias("last"))
    kept = _meet(e, heads.select(*keys, "reset"), keys).where("place >= coalesce(reset, 1)").select(*keys, "place", "text")
    return _meet(_joined(kept, keys, "place", "text"), heads, keys).select(*keys, F.col("last.role").alias("role"), "text")


def render(messages: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, spans`` from messages in order of ``message``.

    A turn is written ``[role]text</s>``, with the signs of these marks escaped in role and text.  ``spans`` is the loss mask, a struct
    per turn of code-point offsets: ``turn`` where the turn begins, ``begin`` and ``size`` of the text that is learned from (size null
    if none is).  A null role is written empty.  Messages that tie are taken by role and text."""
    text, role = escaped(F.coalesce("text", F.lit(""))), escaped(F.coalesce("role", F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.lit(CLOSE))
    turns = (messages.select("conv_id", "message", "role", F.concat(head, text, F.lit(END)).alias("piece"), F.length(head).cast("bigint").alias("lead"),
                             F.when(F.col("role").isin(*learn_from), F.length(text).cast("bigint")).alias("size")))
    order = Window.partitionBy("conv_id").orderBy("message", "role", "piece")
    turns = (turns.withColumn("place", F.row_number().over(order))
             .withColumn("turn", F.sum(F.length("piece").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece")))
    spans = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", (F.col("turn") + F.col("lead")).alias("begin"), "size", "place"))).alias("spans"))
    formatted = _joined(turns, ["conv_id"], "place", "piece").withColumnRenamed("piece", "formatted")
    return _meet(formatted, spans, ["conv_id"]).select("conv_id", "formatted", "spans")


def read_back(chats: DataFrame) -> DataFrame:
    """What a formatted conversation says: ``conv_id, turns`` (array of role and text, unescaped) and ``learned``, the texts under the mask."""
    pieces = F.split("formatted", END, -1)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescaped(F.substring_index(F.substr(p, F.lit(2)), CLOSE, 1)).alias("role"), unescaped(F.substr(p, F.instr(p, F.lit(CLOSE)) + 1)).alias("text")))
    masked = F.filter(F.arrays_zip(F.slice(pieces, 1, F.size(pieces) - 1).alias("piece"), F.col("spans").alias("span")), lambda x: x["span"]["size"].isNotNull())
    learned = F.transform(masked, lambda x: unescaped(F.substr(x["piece"], (x["span"]["begin"] - x["span"]["turn"] + 1).cast("int"), x["span"]["size"].cast("int"))))
    return chats.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))


def digests(chats: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return read_back(chats).select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                                   F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                                   F.length("formatted").cast("bigint").alias("formatted_chars"))


def as_events(turns: DataFrame, piece: int = 512) -> DataFrame:
    """Finished turns (``conv_id, turn, role, text``) as the log that streamed them: texts in deltas of ``piece`` characters.

    Turns that share a number stay turns of their own, in order of role and text."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    t = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("message", place.cast("bigint"))
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / piece) - 1, F.lit(0)))
    return (t.select("conv_id", "message", "role", "text", F.explode(cuts).alias("seq"))
            .select("conv_id", "seq", "message", F.lit(DELTA).alias("kind"), "role", F.substr("text", (F.col("seq") * piece + 1).cast("int"), F.lit(piece)).alias("text")))
