"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source is due ``target / source_size`` copies.  The whole part is taken; the fractions are rounded in pairs: one of two
open documents hands words to the other until one of them has none or all of its extra copy, the direction drawn so that each keeps its
expected number of copies.  A pair keeps its words, so a source misses its target by at
most half the one document left open at the end."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, spread_lookup

LEAF = 4096            # units in a leaf of the reduction tree, on average
FAN = 256              # open documents that meet in an inner node
COPIES = 1024          # rows with the same id and size travel as units of at most so many
NEAR = 1e-9            # a fraction this close to 0 or 1 is whole
UNITS = "src INT, leaf BIGINT, doc_id BIGINT, size BIGINT, source_size BIGINT, target DOUBLE, taken BIGINT, n BIGINT, p DOUBLE"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df`` with ``name`` counting up from 0 in the order of its unique column ``by``: ranges are numbered apart, then shifted."""
    ranged = cut(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect())     # a row a partition
    before = {part: sum(n for _, n in sizes[:i]) for i, (part, _) in enumerate(sizes)}
    shift = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(by)) - 1
    return ranged.withColumn(name, (shift[F.col("_range")] + inside).cast("int")).drop("_range")


def targets(sources: DataFrame, limit: int = 3) -> DataFrame:
    """``sources`` (key, source_size, weight) with ``target``: all words shared by weight, at most ``limit`` times a source's own.

    The share of a unit of weight, ``level``, rises until the capped shares sum to all words.  The sum is concave and piecewise linear in
    it, so these are Newton steps from below: few, and each one aggregate over the sources."""
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return sources.withColumn("target", F.lit(0.0))
    level, capped = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") >= limit * F.col("source_size")
        n, held, free = sources.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, limit * F.col("source_size"))), F.lit(0)),
                                    F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == capped or not free:
            break
        capped, level = n, (total - held) / free
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), (limit * F.col("source_size")).cast("double")))


def _pivot(rows: pd.DataFrame, level: int, seed: int) -> Iterator[tuple]:
    """Rounds the open units of one node, the largest first; gives (row, taken, copies, p), all decided (p 0) but at most one."""
    first = rows.iloc[0]
    key = f"{seed}:{level}:{first.src}:{first.leaf}".encode()
    draws = np.random.Generator(np.random.Philox(int.from_bytes(hashlib.sha256(key).digest()[:8], "little"))).random(len(rows) + 1)
    held = None                                            # the open document: [place, p]
    ids, sizes, taken, counts, ps = (rows[c].tolist() for c in ("doc_id", "size", "taken", "n", "p"))
    for i, (size, n, p) in enumerate(zip(sizes, counts, ps, strict=True)):
        whole = 0
        if n > 1:                                          # equal documents: pairs among them leave one open at most
            whole, p = divmod(n * p, 1.0)
            whole = int(whole)
        if p < NEAR or p > 1 - NEAR:
            p = 1.0 if p > 0.5 else 0.0
        if whole:
            yield i, taken[i] + size, whole, 0.0
        if n - whole > 1:
            yield i, taken[i], n - whole - 1, 0.0
        if n == whole:
            continue
        if p in (0.0, 1.0):
            yield i, taken[i] + int(p) * size, 1, 0.0
            continue
        if held is None:
            held = [i, p]
            continue
        j, q = held
        up = min((1 - q) * sizes[j], p * size)              # words the held one can take from this one
        down = min(q * sizes[j], (1 - p) * size)            # and give to it
        moved = up if draws[i] * (up + down) < down else -down
        held = None
        for k, x in ((j, q + moved / sizes[j]), (i, p - moved / size)):
            if x < NEAR or x > 1 - NEAR:
                yield k, taken[k] + (sizes[k] if x > 0.5 else 0), 1, 0.0
            else:
                held = [k, x]
    if held:
        yield held[0], taken[held[0]], 1, held[1]


def _node(level: int, seed: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.astype({"doc_id": "Int64"})
        ordered = rows.sort_values(["size", "doc_id", "n", "p"], ascending=[False, True, True, True], na_position="first", kind="stable").reset_index(drop=True)
        out = pd.DataFrame(list(_pivot(ordered, level, seed)), columns=["i", "taken", "n", "p"])
        got = ordered.iloc[out["i"]].reset_index(drop=True).assign(taken=out["taken"].astype("int64"), n=out["n"].astype("int64"), p=out["p"])
        if last:                                           # the one document left open in a source goes to the nearer side of its target
            got["taken"] += np.where(got["p"] > 0.5, got["size"], 0)
            got["p"] = 0.0
        return got
    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", limit: int = 3, seed: int = 13) -> DataFrame:
    """Per row of ``docs``: ``doc_id, size, source_size, target, taken``.

    ``size`` is the number of words; sources in code point order, null last, weigh 1, 2, 3, 1, ...; ``target`` is the source's share of all
    words (``targets``) and ``taken`` a whole multiple of ``size``, at most ``limit`` times: the copies below or above
    ``target / source_size``.  Null and empty texts have size 0 and nothing taken; a null source is one source; a null id comes back as it
    is; repeated rows are rounded each for themselves; further columns are ignored; an empty table gives no rows.  Draws hang on ids,
    sizes and ``seed`` alone, so reruns agree.

    Only (id, source, size) leaves the scan.  Units are dealt by hash over leaves of LEAF, so a source of any size is many tasks; one open
    document of each leaf goes up, FAN to a node, until a source has one node."""
    key = F.when(F.col(source_col).isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col(source_col).cast("string")))     # null sorts last
    units = cut(docs.groupBy(F.col(id_col).cast("bigint").alias("doc_id"), key.alias("key"), word_count(F.col(text_col)).alias("size"))
                .agg(F.count(F.lit(1)).alias("n")), "units")
    sources = numbered(units.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("units")), "key", "src")
    sources = cut(targets(sources.withColumn("weight", F.col("src") % 3 + 1), limit), "sources")

    copies = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    chunk = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / COPIES).cast("int") - 1)).alias("chunk")
    dealt = (spread_lookup(units, sources, ["key"], "units", F.col("doc_id"))
             .select("*", copies.alias("copies"), chunk)
             .withColumn("n", F.least(F.lit(COPIES), F.col("n") - F.col("chunk") * COPIES))
             .withColumn("whole", F.floor(F.col("copies") + F.lit(NEAR)))
             .withColumn("leaf", F.pmod(F.xxhash64("doc_id", "size", "chunk"), F.ceil(F.col("units") / LEAF)))
             .select("src", "leaf", "doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size")).alias("taken"), "n",
                     F.greatest(F.col("copies") - F.col("whole"), F.lit(0.0)).alias("p")))
    leaves = sources.agg(F.coalesce(F.max(F.ceil(F.col("units") / LEAF)), F.lit(1))).first()[0]
    done, level = None, 0
    while True:
        last = leaves <= 1
        nodes = cut(dealt.groupBy("src", "leaf").applyInPandas(_node(level, seed, last), UNITS), f"node{level}")
        closed = nodes.where(F.col("p") == 0)
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        dealt = nodes.where(F.col("p") > 0).withColumn("leaf", F.floor(F.col("leaf") / FAN))
        leaves, level = -(-leaves // FAN), level + 1
    return done.select("doc_id", "size", "source_size", "target", "taken", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_copy")).drop("_copy")
