"""Repair of the structure of conversations by weighted interval parsing.

A repaired conversation's role initials are ``(s?(ua)+)?``.  The grammar is in Chomsky normal form over pairs of states of that pattern:
``[p,q] -> [p,r] [r,q]``, and lexical rules for keeping, reroling or deleting one row, closed under insertions on both sides.  The cell of
a span holds the least (cost, audit) of each ``[p,q]``.  Any derivation passes a state at every inner border of a span, so one split of a
span gives its cell and only aligned spans are filled, bottom-up, each twice as long as those below."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, discard, spread_lookup

SPAN = 256             # rows in a stored span at most
SPAN_BYTES = 4 << 20   # and bytes of text
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NONE, BLANK, DUPLICATE, CUT = range(4)
START, S, U, A = range(4)
STEPS = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
ENDS = (START, A)
ROLES = {"u": "user", "a": "assistant"}
LAWFUL = {"su", "ua", "au"}
SPANS = ("conv_id BIGINT, part INT, seq INT, rows INT, blank BIGINT, duplicate BIGINT, truncated BIGINT, illegal BIGINT, initials STRING, turns BIGINT, low BIGINT, high BIGINT, "
         "cells ARRAY<STRUCT<cost: BIGINT, audit: STRING>>, items ARRAY<STRUCT<turn: BIGINT, role: STRING, text: STRING>>")
REPORT = ("conv_id BIGINT, gaps BIGINT, blank BIGINT, duplicate BIGINT, truncated BIGINT, illegal BIGINT, cost BIGINT, audit STRING, "
          "path ARRAY<STRUCT<part: INT, seq: INT, p: INT, q: INT>>")
TURNS = "conv_id BIGINT, part INT, seq INT, at INT, edit STRING, turn BIGINT, role STRING, text STRING"
Cell = tuple            # 16 entries [p * 4 + q], each None or (cost, audit)


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out = []
    for p in range(4):
        ways = [(r, left[p * 4 + r]) for r in range(4) if left[p * 4 + r]]
        for q in range(4):
            out.append(min(((x[0] + y[0], x[1] + y[1]) for r, x in ways if (y := right[r * 4 + q])), default=None))
    return tuple(out)


def _insertions() -> Cell:
    """Fewest insertions from each state to each other: the closure of the single ones."""
    steps = [(p, q) for (p, c), q in STEPS.items() if c in ROLES]
    best = [(0, "") if p == q else None for p in range(4) for q in range(4)]
    for _ in range(4):
        for p in range(4):
            for r, q in steps:
                if way := best[p * 4 + r]:
                    new = (way[0] + INSERT, way[1] + "I")
                    best[p * 4 + q] = min(best[p * 4 + q] or new, new)
    return tuple(best)


INSERTIONS = _insertions()


@lru_cache(None)
def lexical(symbol: str) -> Cell:
    """The cell of one row; ``symbol``: ``X`` must go, else the role's initial (``o``: none of s, u, a), a capital if the text is cut short."""
    best = [(DELETE, "D") if p == q else None for p in range(4) for q in range(4)]
    if symbol != "X":
        more = TRUNCATED * symbol.isupper()
        for (p, c), q in STEPS.items():
            for cost, audit in [(KEEP, "K")] * (c == symbol.lower()) + [(REROLE, "R")] * (c in ROLES):
                new = (cost + more, audit)
                best[p * 4 + q] = min(best[p * 4 + q] or new, new)
    return combined(combined(INSERTIONS, tuple(best)), INSERTIONS)


@lru_cache(1 << 14)
def parsed(symbols: str) -> Cell:
    """The cell of a run of rows, from the cells of aligned spans of half its length."""
    if len(symbols) == 1:
        return lexical(symbols)
    half = 1 << (len(symbols) - 1).bit_length() - 1
    return combined(parsed(symbols[:half]), parsed(symbols[half:]))


def best_path(cells: list[Cell]) -> tuple[int, str, list[tuple[int, int]]]:
    """Least (cost, audit) of consecutive spans, and the states between which each of them is parsed."""
    levels = [cells]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([combined(*below[i:i + 2]) if i + 1 < len(below) else below[i] for i in range(0, len(below), 2)])
    (cost, audit), q = min((levels[-1][0][q], q) for q in ENDS if levels[-1][0][q])
    ways = [(START, q)]
    for below in reversed(levels[:-1]):
        split = []
        for i, (p, q) in enumerate(ways):
            if 2 * i + 1 == len(below):
                split.append((p, q))
                continue
            left, right = below[2 * i:2 * i + 2]
            r = min((x[0] + y[0], x[1] + y[1], r) for r in range(4) if (x := left[p * 4 + r]) and (y := right[r * 4 + q]))[2]
            split += [(p, r), (r, q)]
        ways = split
    return cost, audit, ways


def applied(audit: str, state: int, items: list[dict]) -> Iterator[tuple[str, int | None, str, str]]:
    """Edited rows (edit, turn, role, text) of a span that starts in ``state``."""
    rows = iter(items)
    for edit in audit:
        row = {"turn": None, "role": None, "text": ""} if edit == "I" else next(rows)
        role = row["role"]
        if edit in "IR":
            role = ROLES["a" if state == U else "u"]
        if edit != "D":
            state = STEPS[state, role[0]]
        yield edit, row["turn"], role, row["text"]


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


SPAN_TYPE = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("rows", pa.int32()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")],
                       ("initials", pa.string()), ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("cells", pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))),
                       ("items", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])))])
REPORT_TYPE = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()),
                         ("path", pa.list_(pa.struct([(c, pa.int32()) for c in ("part", "seq", "p", "q")])))])
TURN_TYPE = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("at", pa.int32()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
DIGEST_TYPE = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _span(rows: list[dict], part: int, seq: int) -> dict:
    faults = [r["fault"] for r in rows]
    initials = "".join(r["role"][:1] or " " for r in rows)
    symbols = "".join("X" if f in (BLANK, DUPLICATE) else (c if c in "sua" else "o").upper() if f == CUT else c if c in "sua" else "o" for f, c in zip(faults, initials, strict=True))
    turns = sorted({r["turn"] for r in rows if r["turn"] is not None})
    return {"conv_id": rows[0]["conv_id"], "part": part, "seq": seq, "rows": len(rows), "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT),
            "illegal": sum(initials[i:i + 2] not in LAWFUL for i in range(len(initials) - 1)), "initials": initials[0] + initials[-1], "turns": len(turns), "low": turns[0] if turns else None,
            "high": turns[-1] if turns else None, "cells": [x and {"cost": x[0], "audit": x[1]} for x in parsed(symbols)], "items": [{k: r[k] for k in ("turn", "role", "text")} for r in rows]}


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as spans of one conversation each, numbered in order."""
    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
    for b in batches:
        out = []
        for r in b.to_pylist():
            if held and (r["conv_id"] != held[0]["conv_id"] or len(held) == SPAN or size > SPAN_BYTES):
                out.append(_span(held, part, seq))
                held, size, seq = [], 0, seq + 1
            held.append(r)
            size += len(r["text"])
        if out:
            yield _batch(out, SPAN_TYPE)
    if held:
        yield _batch([_span(held, part, seq)], SPAN_TYPE)


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and r["conv_id"] != held[0]["conv_id"]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans, without texts, as a row for each conversation."""
    out = []
    for spans in _by_conversation(batches):
        cost, audit, path = best_path([tuple(x and (x["cost"], x["audit"]) for x in s["cells"]) for s in spans])
        turns, last = 0, None
        for s in spans:                                    # a turn that two spans share counts once
            turns += s["turns"] - (s["turns"] > 0 and s["low"] == last)
            last = s["high"] if s["turns"] else last
        first = next((s["low"] for s in spans if s["turns"]), None)
        illegal = sum(s["illegal"] for s in spans) + sum(x["initials"][1] + y["initials"][0] not in LAWFUL for x, y in zip(spans, spans[1:], strict=False))
        out.append({"conv_id": spans[0]["conv_id"], "gaps": last - first + 1 - turns if turns else 0, **{c: sum(s[c] for s in spans) for c in ("blank", "duplicate", "truncated")},
                    "illegal": illegal, "cost": cost, "audit": audit, "path": [{"part": s["part"], "seq": s["seq"], "p": p, "q": q} for s, (p, q) in zip(spans, path, strict=True)]})
        if len(out) == 1000:
            yield _batch(out, REPORT_TYPE)
            out = []
    if out:
        yield _batch(out, REPORT_TYPE)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in b.to_pylist():
            rows = applied(s["cells"][s["p"] * 4 + s["q"]]["audit"], s["p"], s["items"])
            yield _batch([{"conv_id": s["conv_id"], "part": s["part"], "seq": s["seq"], "at": i, "edit": e, "turn": turn, "role": role, "text": text} for i, (e, turn, role, text) in enumerate(rows)], TURN_TYPE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted repaired rows as a digest for each conversation; no conversation is held whole."""
    now, digest = None, None
    for b in batches:
        out = []
        for r in b.to_pylist():
            if digest is None or r["conv_id"] != now:
                if digest is not None:
                    out.append({"conv_id": now, "repaired_sha256": digest.hexdigest()})
                now, digest = r["conv_id"], hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{r['role']}:{r['text']}".encode())
        if out:
            yield _batch(out, DIGEST_TYPE)
    if digest is not None:
        yield _batch([{"conv_id": now, "repaired_sha256": digest.hexdigest()}], DIGEST_TYPE)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of each conversation: ``(reports, turns)``.

    ``reports`` has a row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, path`` (``path``: the stored
    spans and the states they are parsed between).  ``turns`` has a row per edit: ``conv_id, part, seq, at`` (their order), ``edit`` (K kept,
    R reroled, D deleted, I inserted), ``turn, role, text``.  Costs are the constants above; of equal costs the ASCII-least audit is taken.

    Rows are taken by turn, nulls first; ties by role, then by a hash of the text.  A row's first fault counts: blank, duplicate (role and
    text seen earlier), truncated (the last character that is not blank is none of ``.!?``).  Blank and duplicate rows must go.  A null role
    or text counts as one space; rows with a null conversation are one conversation; a repeated row is a duplicate; other roles than
    system, user and assistant must be reroled or go; further columns are ignored; an empty table gives no rows.

    Rows are range-partitioned by conversation and order, so a long conversation is many tasks, and stored as spans with their cells; then
    only the cells of a conversation (16 short entries for each span of SPAN rows) meet to be combined.  The first of equal texts is found
    by an aggregate and joined back with hot texts dealt out; equal texts are those of one SHA-256."""
    conv, role, text = F.col(conv_col).cast("bigint"), F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    key = F.concat(F.coalesce(conv.cast("string"), F.lit("none")), F.lit(":"), F.length(role).cast("string"), F.lit(":"), role, text)
    base = cut(turns.select(conv.alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), blank.alias("blank"),
                            (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"), F.unhex(F.sha2(key, 256)).alias("h"), F.monotonically_increasing_id().alias("salt")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("salt"))
    repeated = (base.where(~F.col("blank")).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first") != place, DUPLICATE).when(F.col("truncated"), CUT).otherwise(NONE)
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("h"), F.col("salt")]
    rows = (spread_lookup(base, repeated, ["h"], "n", F.col("salt"), "left").withColumn("fault", fault)
            .repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault"))
    spans = cut(rows.mapInArrow(_spans, SPANS), "spans")
    discard(base)
    reports = cut(spans.drop("items").repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", "seq").mapInArrow(_reports, REPORT), "reports")
    path = reports.select(F.explode("path").alias("s")).select("s.part", "s.seq", "s.p", "s.q")
    edited = spans.select("conv_id", "part", "seq", "cells", "items").join(path, ["part", "seq"]).mapInArrow(_edited, TURNS)
    return reports, edited


def repair_digests(conversations: DataFrame, reports: DataFrame, edited: DataFrame) -> DataFrame:
    """A row per id in ``conversations``: its report and ``repaired_sha256`` over ``role:text`` lines; zeros where no row is left.

    The digest reads a conversation in order, so one task streams it, row by row."""
    kept = (edited.where("edit <> 'D'").select("conv_id", "part", "seq", "at", "role", "text").repartition("conv_id")
            .sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", "seq", "at").mapInArrow(_digests, "conv_id BIGINT, repaired_sha256 STRING"))
    ids, r, d = conversations.distinct().alias("i"), reports.alias("r"), kept.alias("d")
    both = ids.join(r, F.col("i.conv_id").eqNullSafe(F.col("r.conv_id")), "left").join(d, F.col("i.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    counts = [F.coalesce(F.col(f"r.{c}"), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(F.col("i.conv_id").alias("conv_id"), *counts, F.coalesce("r.audit", F.lit("")).alias("audit"),
                       F.coalesce("d.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def damaged(turns: DataFrame, key: Column | None = None) -> DataFrame:
    """Turns with planted faults by ``crc32('conv_id:turn') % 20``: 0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it a user's."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)) if key is None else key
    text, d = F.coalesce("text", blank), F.col("_damage")
    return (turns.select("conv_id", "turn", "role", "text", (F.crc32(name.cast("binary")) % 20).alias("_damage")).where("_damage <> 0")
            .select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
                    F.when(d == 1, "").when(d == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                    F.explode(F.when(d == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy"))
