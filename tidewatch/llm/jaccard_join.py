"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters; every candidate pair is verified once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bytes_of, cut, discard, release, spread_lookup
from tidewatch.llm.components import components
from tidewatch.llm.wordhash import mix, shingle_sets, slices

SKETCH_BITS = 20        # n-gram frequencies are kept in 2^20 counters, 8 MB at any input size
SKETCH_BLOCKS = 64
PARTS = 64              # hash ranges of the suffix filter
NONE = np.zeros(0, np.int64)


def _full_name(node: np.ndarray, check: np.ndarray, shared: np.ndarray) -> np.ndarray:
    both = mix(mix(node.view(np.uint64)) + check.view(np.uint64)).view(np.int64)
    return np.where(np.isin(node, shared), both, node)


class Sets:
    """Shingle sets of a slice of texts, one after the other, with sizes and two digests that do not depend on the order of a set.

    ``node`` names a set.  Where ``shared`` says that sets of different ``check`` have one node, the check goes into it too, so names
    are as good as 128 bits; ``bits`` of the first digest are used."""

    def __init__(self, texts: list[bytes], words: int, shared: np.ndarray = NONE, bits: int = 64):
        self.each = shingle_sets(texts, words)
        self.n = np.fromiter(map(len, self.each), np.int64, len(self.each))
        self.grams = np.concatenate(self.each) if self.each else np.zeros(0, np.uint64)
        self.node, self.check = np.zeros(len(self.n), np.int64), np.zeros(len(self.n), np.int64)
        full = np.flatnonzero(self.n)
        if len(full):
            starts = (np.cumsum(self.n) - self.n)[full]
            size = self.n[full].astype(np.uint64)
            self.mixed = mix(self.grams)
            self.node[full] = (mix(np.add.reduceat(self.mixed, starts) + size) >> np.uint64(64 - bits)).view(np.int64)
            self.check[full] = mix(np.bitwise_xor.reduceat(self.mixed * np.uint64(0xDA942042E4DD58B5), starts) ^ size).view(np.int64)
            self.node[full] = _full_name(self.node[full], self.check[full], shared)

    def histograms(self) -> list[bytes]:
        """How many shingles of each set lie in each of PARTS hash ranges, as unsigned shorts."""
        if not len(self.grams):
            return [b"\0" * 2 * PARTS] * len(self.n)
        cell = np.repeat(np.arange(len(self.n)), self.n) * PARTS + (self.mixed >> np.uint64(58)).astype(np.int64)
        counts = np.minimum(np.bincount(cell, minlength=len(self.n) * PARTS), 65535).astype("<u2").reshape(-1, PARTS)
        return [row.tobytes() for row in counts]


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _describe(rows: DataFrame, words: int, bits: int) -> DataFrame:
    """One pass over all texts: a row per text (set size, digests, hash-range histogram), and the tasks' n-gram counters in blocks."""
    names = ["doc_id", "n", "node", "check", "hist", "block", "counts"]

    def scan(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            texts = bytes_of(batch["text"])
            for lo, hi in slices(texts):
                s = Sets(texts[lo:hi], words, bits=bits)
                counts += np.bincount(_slot(s.grams), minlength=1 << SKETCH_BITS).astype(np.uint32)
                none, empty = pa.nulls(hi - lo), s.n == 0
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi].cast(pa.int64()), pa.array(s.n.astype(np.int32)), pa.array(s.node, mask=empty), pa.array(s.check, mask=empty),
                                                  pa.array(s.histograms(), pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        if counts.any():
            none = pa.nulls(SKETCH_BLOCKS)
            yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()),
                                              pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([p.tobytes() for p in counts.reshape(SKETCH_BLOCKS, -1)], pa.binary())], names)
    return rows.mapInArrow(scan, "doc_id BIGINT, n INT, node BIGINT, check BIGINT, hist BINARY, block INT, counts BINARY")


def _frequencies(described: DataFrame) -> np.ndarray:
    """The counters of all tasks added up: streamed sums of fixed-size blocks, 8 MB in all."""
    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                part = np.frombuffer(c, "<u4").astype(np.int64)
                sums[b] = sums[b] + part if b in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["block", "counts"])
    blocks = (described.where(F.col("block").isNotNull()).select("block", "counts").repartition(SKETCH_BLOCKS // 4, "block")
              .mapInArrow(add, "block INT, counts BINARY").collect())
    out = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.int64)
    for r in blocks:
        out[r["block"]] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out.ravel(), 2**32 - 1).astype(np.uint32)


def _sets(described: DataFrame) -> DataFrame:
    """A row per set; ``clash`` where its name has different checks: of n sets, n^2 / 2^65 are to be expected."""
    return cut(described.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node")
               .agg(F.first("n").alias("n"), F.first("hist").alias("hist"), F.min("doc_id").alias("doc_id"), (F.min("check") != F.max("check")).alias("clash")), "sets")


def _renamed(described: DataFrame, shared: np.ndarray) -> DataFrame:
    """``described`` with the check in the names that are shared."""
    def scan(batches):
        for batch in batches:
            none = batch["node"].is_null().to_numpy(zero_copy_only=False)
            name = _full_name(*(batch[c].fill_null(0).to_numpy() for c in ("node", "check")), shared)
            yield batch.set_column(batch.schema.get_field_index("node"), "node", pa.array(name, mask=none))
    return described.mapInArrow(scan, described.schema)


def _prefixes(rows: DataFrame, freq, words: int, percent: int, names: tuple) -> DataFrame:
    """(gram, node, pos): the n-grams of each set's prefix, the rarest first.  A set met again in the same task is not repeated."""
    def scan(batches):
        seen: set[int] = set()
        table = freq.value
        for batch in batches:
            texts = bytes_of(batch["text"])
            for lo, hi in slices(texts):
                s = Sets(texts[lo:hi], words, *names)
                often = table[_slot(s.grams)]
                starts = np.cumsum(s.n) - s.n
                keep = s.n - (percent * s.n + 99) // 100 + 1
                grams, nodes, places = [], [], []
                for i, node in enumerate(s.node.tolist()):
                    if not s.n[i] or node in seen:
                        continue
                    if len(seen) < 1_000_000:                      # past that, copies go to the shuffle as they are
                        seen.add(node)
                    order = np.argsort(often[starts[i]:starts[i] + s.n[i]], kind="stable")[:keep[i]]      # ties stand in the order of the n-grams
                    grams.append(s.each[i][order])
                    nodes.append(np.full(len(order), node))
                    places.append(np.arange(len(order), dtype=np.int32))
                if grams:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(places))],
                                                     ["gram", "node", "pos"])
    return rows.mapInArrow(scan, "gram BIGINT, node BIGINT, pos INT")


def _with_node(rows: DataFrame, words: int, names: tuple) -> DataFrame:
    """(node, text) of texts fetched by id."""
    def scan(batches):
        for batch in batches:
            texts = bytes_of(batch["text"])
            for lo, hi in slices(texts):
                yield pa.RecordBatch.from_arrays([pa.array(Sets(texts[lo:hi], words, *names).node), batch["text"][lo:hi]], ["node", "text"])
    return rows.select("text").mapInArrow(scan, "node BIGINT, text STRING")


def _need(na: Column, nb: Column, percent: int) -> Column:
    """Shared n-grams without which two sets of these sizes do not link."""
    return F.ceil(F.lit(percent) * (na + nb) / F.lit(100 + percent))


def _may_link(na: Column, nb: Column, pa: Column, pb: Column, percent: int) -> Column:
    """Length filter, and positional filter: what lies behind the first shared n-gram must be able to reach the overlap.

    For a later shared n-gram the second may be false for sets that link, but then it holds for their first one."""
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (F.least(na - pa, nb - pb) >= _need(na, nb, percent))


def _filtered(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may link, each once, from shared n-grams ``a, b, pa, pb`` with their places in both prefixes.

    Length filter: sizes must not differ too much.  Positional filter: what lies behind the first shared n-gram must be able to reach the
    overlap.  Suffix filter: divided by hash range, two sets share at most the lesser count of each range."""
    def bound(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch["ha"].to_pylist()), "<u2").reshape(-1, PARTS)
            y = np.frombuffer(b"".join(batch["hb"].to_pylist()), "<u2").reshape(-1, PARTS)
            need = batch["need"].to_numpy(zero_copy_only=False)
            full = (x == 65535).any(1) | (y == 65535).any(1)         # counters at their end bound nothing
            ok = pa.array(full | (np.minimum(x, y).sum(1, dtype=np.int64) >= need))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(ok), batch["b"].filter(ok)], ["a", "b"])

    def one(s):
        return sets.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("hist").alias(f"h{s}"))
    pairs = found.groupBy("a", "b").agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    pairs = pairs.join(one("b"), "b").join(one("a"), "a").withColumn("need", _need(F.col("na"), F.col("nb"), percent))
    return pairs.where(_may_link(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"), percent)).select("a", "b", "need", "ha", "hb").mapInArrow(bound, "a BIGINT, b BIGINT")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs that link: the whole sets of both texts are built and compared."""
    def compare(batches):
        for batch in batches:
            left, right, ok = bytes_of(batch["ta"]), bytes_of(batch["tb"]), []
            for lo, hi in slices(left):
                for x, y in zip(shingle_sets(left[lo:hi], words), shingle_sets(right[lo:hi], words), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(ok, pa.bool_())), batch["b"].filter(pa.array(ok, pa.bool_()))], ["a", "b"])
    one = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"t{s}"))
    return pairs.join(one("b"), "b").join(one("a"), "a").select("a", "b", "ta", "tb").mapInArrow(compare, "a BIGINT, b BIGINT")


def _links(docs: DataFrame, described: DataFrame, sets: DataFrame, words: int, percent: int, names: tuple) -> DataFrame:
    """Enough verified links between sets (by node) that every component of the whole link relation is one of theirs.

    A pair needs no look once both of its sets are in one component.  So the sets of an n-gram are first held against one of them, in
    whose prefix it comes first, that is, which has fewest rare n-grams of its own.  What that links is contracted, and then only
    pairs across components are candidates, all of them.  A large group of near copies thus costs about one pair a member."""
    spark = docs.sparkSession
    freq = spark.sparkContext.broadcast(_frequencies(described))
    prefix = _prefixes(docs, freq, words, percent, names)
    shared = cut(prefix.groupBy("gram").agg(F.count(F.lit(1)).alias("many"), F.min_by("node", "pos").alias("pivot"), F.min("pos").alias("at"))
                 .where(F.col("many") > 1).drop("many"), "shared")
    rows = cut(prefix.join(shared, "gram"), "prefixes")      # both sides are shuffled for the join, so Spark may divide a hot n-gram
    wanted = rows.select("node").distinct().join(sets.select("node", "doc_id"), "node").select("doc_id").distinct()
    texts = cut(_with_node(docs.join(wanted, "doc_id"), words, names), "texts")
    release(spark)

    def verified(found):
        a_first = F.col("x") < F.col("y")
        pairs = found.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(a_first, F.col("px")).otherwise(F.col("py")).alias("pa"),
                                                             F.when(a_first, F.col("py")).otherwise(F.col("px")).alias("pb"))
        return cut(_verified(_filtered(pairs, sets, percent), texts, words, percent), "links")
    near = verified(rows.select(F.col("node").alias("x"), F.col("pos").alias("px"), F.col("pivot").alias("y"), F.col("at").alias("py")))
    root = cut(components(near), "roots")
    rooted = rows.select("gram", "node", "pos").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = (rooted.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by("root", "pos").alias("main"))
             .where(F.col("lo") != F.col("hi")).select("gram", "main"))
    mixed = cut(rooted.join(cut(split, "split"), "gram").join(sets.select("node", "n"), "node"), "mixed")
    here = mixed.select("gram", F.col("root").alias("rx"), "main", F.col("node").alias("x"), F.col("pos").alias("px"), F.col("n").alias("nx"))
    there = mixed.where(F.col("root") != F.col("main")).select("gram", F.col("root").alias("ry"), F.col("node").alias("y"), F.col("pos").alias("py"), F.col("n").alias("ny"))
    once = (F.col("rx") != F.col("ry")) & ((F.col("rx") == F.col("main")) | (F.col("x") < F.col("y")))
    across = here.join(there, "gram").where(once & _may_link(F.col("nx"), F.col("ny"), F.col("px"), F.col("py"), percent))
    far = verified(across)
    out = root if far.isEmpty() else cut(components(near.unionByName(far)), "roots")
    for old in (shared, rows, texts, sets, mixed):
        discard(old)
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
                digest_bits: int = 64) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``, the least id that can be reached over links.

    Two texts link when 100 * shared >= ``percent`` * all of their distinct ``words``-word shingles (A-Z lower-cased, words between
    blanks).  A text of fewer words counts as one shingle; null, empty and blank texts have none and link with nothing.  Equal sets
    always link, so they are looked at once.  Rows repeated with one id keep their own sizes and link by their own texts; a row without
    an id cannot be named, so it links with nothing and has a null component.  Sets go by ``digest_bits`` of a digest; those that share it
    with another set go by two digests together.  Further columns are ignored; an empty table gives no
    rows."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    described = cut(_describe(rows, words, digest_bits), "described")
    sets = _sets(described)
    shared = np.array(sorted(r["node"] for r in sets.where("clash").select("node").collect()), np.int64)
    if len(shared):
        described = cut(_renamed(described, shared), "described")
        sets = _sets(described)
    root = _links(rows.where(F.col("doc_id").isNotNull()), described, sets, words, percent, (shared, digest_bits))
    plain = described.where(F.col("n").isNotNull()).withColumn("node", F.when(F.col("doc_id").isNotNull(), F.col("node")))
    least = plain.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    named = least.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    named = spread_lookup(named, of_root, ["root"], "members", F.col("node")).select("node", "copies", "component_id")
    linked = spread_lookup(plain.where(F.col("node").isNotNull()).select("doc_id", "n", "node"), named, ["node"], "copies", F.col("doc_id"))
    alone = plain.where(F.col("node").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return (linked.select("doc_id", "n", "component_id").unionByName(alone)
            .select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the least of their component; rows that have no id stay.

    Rows repeated with an id that stays all stay: exact dedup is the stage that drops those."""
    found = near_copies(docs, id_col, text_col, words, percent)
    keep = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(id_col)).distinct()
    stay = docs.join(keep, id_col, "left_semi")
    return stay.unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)
