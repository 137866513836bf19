"""Time-ordered operators that survive hot keys.

A plain ``Window.partitionBy(entity)`` puts every row of one entity in one task.  Here an entity is always cut into
time buckets first, so a task holds one (entity, bucket); what has to cross a bucket border is carried either by a
small halo of rows repeated in the next bucket (bounded look-back) or by one summary row per bucket (unbounded
look-back).  No row is dropped or capped on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000
BUCKET_S = 3600


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row: a one-element explode, which Catalyst does not inline into the
    filters and expressions that read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def bucket_width(limit_s: float, least_s: float = BUCKET_S) -> int:
    """Bucket width in microseconds: at most one eighth of the rows fall in the halo."""
    return int(max(least_s, 8 * limit_s) * MICROS)


def _order(order) -> list[Column]:
    return [F.col(c).asc() if isinstance(c, str) else c for c in order]


def with_halo(df: DataFrame, limit_s: float, us: str = "ts_us") -> DataFrame:
    """Adds ``_bucket`` and ``_halo``; rows within ``limit_s`` of a bucket's end are repeated in the next bucket."""
    width, limit = bucket_width(limit_s), int(limit_s * MICROS)
    at = F.floor(F.col(us) / F.lit(width)).cast("bigint")
    own = F.struct(at.alias("b"), F.lit(False).alias("h"))
    near_end = F.col(us) >= (at + 1) * F.lit(width) - F.lit(limit)
    copy = F.struct((at + 1).alias("b"), F.lit(True).alias("h"))
    return (df.withColumn("_c", F.explode(F.when(near_end, F.array(own, copy)).otherwise(F.array(own))))
            .withColumn("_bucket", F.col("_c.b")).withColumn("_halo", F.col("_c.h")).drop("_c"))


def near_prev(df: DataFrame, keys, limit_s: float, carry, us: str = "ts_us", order=("ts_us", "event_id"),
              keep_bucket: bool = False) -> DataFrame:
    """Adds ``prev`` = STRUCT(carry…) of the previous row of the key if it is at most ``limit_s`` older, else NULL."""
    w = Window.partitionBy(*keys, "_bucket").orderBy(*_order(order))
    lagged = F.lag(F.struct(F.col(us).alias("_us"), *[F.col(c) for c in carry])).over(w)
    d = with_halo(df, limit_s, us).withColumn("_p", lagged).where(~F.col("_halo")).drop("_halo")
    near = (F.col(us) - F.col("_p._us")) <= F.lit(int(limit_s * MICROS))
    d = d.withColumn("prev", F.when(near, F.col("_p"))).drop("_p")
    return d if keep_bucket else d.drop("_bucket")


def split_runs(df: DataFrame, keys, gap_s: float, us: str = "ts_us", order=("ts_us", "event_id"),
               same=(), id_col: str = "event_id", limit_us: Column | None = None) -> DataFrame:
    """Gaps and islands.  Adds ``run_us`` and ``run_event``: time and id of the first row of the run.

    Successive rows of a key stay in one run while the gap is at most ``gap_s`` and all ``same`` columns are equal
    (null-safe); ``limit_us`` may narrow the gap per row.  Runs may span any number of buckets: bucket-local pieces are numbered first, and only one row per
    piece takes part in the carry over bucket borders.
    """
    d = near_prev(df, keys, gap_s, list(same), us, order, keep_bucket=True)
    joined = F.col("prev").isNotNull()
    if limit_us is not None:
        joined = joined & (F.col(us) - F.col("prev._us") <= limit_us)
    for c in same:
        joined = joined & F.col(c).eqNullSafe(F.col(f"prev.{c}"))
    w = Window.partitionBy(*keys, "_bucket").orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    start = F.when(~joined, F.struct(F.col(us).alias("us"), F.col(id_col).alias("id")))
    d = d.withColumn("_start", F.last(start, ignorenulls=True).over(w)).drop("prev")
    # the last start of every bucket, carried to the following buckets of the key
    heads = d.groupBy(*keys, "_bucket").agg(F.max("_start").alias("_start"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = heads.select(*keys, "_bucket", F.max("_start").over(before).alias("_carry"))
    d = d.join(carry, [*keys, "_bucket"], "left")
    first = F.coalesce("_start", "_carry")
    return (d.withColumn("run_us", first["us"]).withColumn("run_event", first["id"])
            .drop("_start", "_carry", "_bucket"))


def prev_row(df: DataFrame, keys, carry, us: str = "ts_us", order=("ts_us", "event_id"),
             bucket_s: float = BUCKET_S) -> DataFrame:
    """Adds ``prev`` = STRUCT(carry…) of the previous row of the key, however old it is (NULL for the first row)."""
    d = df.withColumn("_bucket", F.floor(F.col(us) / F.lit(int(bucket_s * MICROS))).cast("bigint"))
    value = F.struct(*[F.col(c) for c in carry])
    local = Window.partitionBy(*keys, "_bucket").orderBy(*_order(order))
    tails = d.groupBy(*keys, "_bucket").agg(F.max_by(value, F.struct(*[F.col(c) for c in order])).alias("_tail"))
    tails = tails.select(*keys, "_bucket", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_tail"))
    d = d.withColumn("prev", F.lag(value).over(local)).withColumn("_rn", F.row_number().over(local))
    d = d.join(tails, [*keys, "_bucket"], "left")
    return d.withColumn("prev", F.when(F.col("_rn") == 1, F.col("_tail")).otherwise(F.col("prev"))).drop(
        "_bucket", "_tail", "_rn")


def number_rows(df: DataFrame, keys, us: str = "ts_us", order=("ts_us", "event_id"), out: str = "rn",
                bucket_s: float = BUCKET_S, bucket: Column | None = None) -> DataFrame:
    """``row_number`` over the key in time order: bucket-local numbers plus the count of all earlier buckets.
    ``bucket`` may give another bucketing that is monotone in ``order``."""
    at = F.floor(F.col(us) / F.lit(int(bucket_s * MICROS))).cast("bigint") if bucket is None else bucket
    d = df.withColumn("_bucket", at)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(*_order(order))
    d = d.withColumn(out, F.row_number().over(local)).join(sizes, [*keys, "_bucket"], "left")
    return d.withColumn(out, F.col(out) + F.col("_off")).drop("_bucket", "_off")


SLICED_FROM = 64


def top_k(df: DataFrame, keys, order, k: int, spread: str, out: str = "rank", spread_n: int = 64) -> DataFrame:
    """The first ``k`` rows of each key, ranked.  No task sorts a whole hot key: up to ``SLICED_FROM`` rows a key, Spark cuts every key
    to ``k`` in each task before the shuffle; for larger ``k`` each of ``spread_n`` slices of a key is cut to ``k`` first (the first ``k``
    of the whole are among the first ``k`` of their slice), which shuffles the rows that are left a second time."""
    if k > SLICED_FROM:
        df = df.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(spread_n)))
        first = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = df.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r", "_slice")
    final = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(final)).where(F.col(out) <= k)


def repeated(df: DataFrame, n: int) -> DataFrame:
    """Every row once for each ``_slice`` from 0 to ``n`` - 1.

    Spark counts the repeats of an unpivot in a table's size, but not those of an exploded array: it would take the table for ``n`` times
    smaller than it is, make it a broadcast, and build all of it on the driver."""
    slices = [F.expr(f"{i}L").alias(f"_slice{i}") for i in range(n)]
    return df.unpivot([F.col(c) for c in df.columns], slices, "_name", "_slice").drop("_name")


SPLIT = 2          # slices that make Spark shuffle both sides for the join itself, so that it may divide the rows of a hot key as it runs


def spread_join(big: DataFrame, small: DataFrame, keys, how: str = "inner", spread: str = "event_id", n: int = 16) -> DataFrame:
    """Join on keys that may be hot on the ``big`` side: its rows are spread over ``n`` slices of the key and the small
    side (few rows per key) is repeated in every slice.

    A ``small`` side with about as many rows as the big one is better repeated ``SPLIT`` times: there adaptive execution divides what is hot."""
    left = big.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(n)))
    return left.join(repeated(small, n), [*keys, "_slice"], how).drop("_slice")


def first_ids(df: DataFrame, keys, k: int, order=("ts_us", "event_id"), id_col: str = "event_id",
              out: str = "event_ids") -> DataFrame:
    """One row per key with the first ``k`` ids in order; the list never holds more than ``k`` items."""
    d = top_k(df, keys, _order(order), k, id_col, "_rank")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("_rank", F.col(id_col).cast("string").alias("id")))),
                      lambda x: x["id"])
    return d.groupBy(*keys).agg(ids.alias(out))


def count_in_window(df: DataFrame, keys, window_s: float, us: str = "ts_us") -> DataFrame:
    """Adds ``in_window``: rows of the key in ``[us - window_s, us]`` (bound inclusive, equal times counted)."""
    w = Window.partitionBy(*keys, "_bucket").orderBy(us).rangeBetween(-int(window_s * MICROS), 0)
    return (with_halo(df, window_s, us).withColumn("in_window", F.count(F.lit(1)).over(w))
            .where(~F.col("_halo")).drop("_halo", "_bucket"))


def peak_in_window(df: DataFrame, keys, window_s: float, us: str = "ts_us", id_col: str = "event_id") -> DataFrame:
    """Per key the most rows in any window of ``window_s`` and the last row of the earliest such window."""
    best = F.max(F.struct(F.col("in_window").alias("n"), (-F.col(us)).alias("neg_us"), F.col(id_col).alias("id")))
    return (count_in_window(df, keys, window_s, us).groupBy(*keys).agg(best.alias("_b"))
            .select(*keys, F.col("_b.n").alias("peak"), (-F.col("_b.neg_us")).alias("peak_us"),
                    F.col("_b.id").alias("peak_event")))


def _value_bucket(v: Column) -> Column:
    """Monotone bucket of a double: 64 steps per octave on both sides of zero (bounded number of buckets)."""
    size = F.floor(F.log2(F.abs(v) * 1024 + 1) * 64)
    return F.when(v < 0, -size).otherwise(size).cast("bigint")


def exact_quantiles(df: DataFrame, keys, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key, one column per entry of ``probs``.

    Equal values are collapsed first; then the value bucket holding each wanted rank is found from bucket counts, and
    only rows of those buckets are ranked.  Nothing holds all values of a key in one task.
    """
    vals = (df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
            .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_vb", _value_bucket(F.col("_v"))))
    per_bucket = vals.groupBy(*keys, "_vb").agg(F.sum("_n").alias("_bn"))
    ordered = Window.partitionBy(*keys).orderBy("_vb")
    per_bucket = (per_bucket
                  .withColumn("_before", F.sum("_bn").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bn"))
                  .withColumn("_total", F.sum("_bn").over(Window.partitionBy(*keys))))
    ranks = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        ranks += [F.struct(F.lit(name).alias("q"), F.lit(s).alias("side"), fn(pos).cast("bigint").alias("r"),
                           (pos - F.floor(pos)).alias("frac")) for s, fn in (("lo", F.floor), ("hi", F.ceil))]
    wanted = (per_bucket.withColumn("_t", F.explode(F.array(*ranks)))
              .where((F.col("_t.r") >= F.col("_before")) & (F.col("_t.r") < F.col("_before") + F.col("_bn")))
              .groupBy(*keys, "_vb").agg(F.first("_before").alias("_before"), F.collect_list("_t").alias("_ts")))
    inside = vals.join(wanted, [*keys, "_vb"])
    by_value = Window.partitionBy(*keys, "_vb").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_cum", F.col("_before") + F.sum("_n").over(by_value))
    hit = inside.withColumn("_t", F.explode("_ts")).where(
        (F.col("_t.r") < F.col("_cum")) & (F.col("_t.r") >= F.col("_cum") - F.col("_n")))

    def pick(name, side, col):
        return F.max(F.when((F.col("_t.q") == name) & (F.col("_t.side") == side), col))
    out = []
    for name in probs:
        lo, hi = pick(name, "lo", F.col("_v")), pick(name, "hi", F.col("_v"))
        out.append((lo + (hi - lo) * pick(name, "lo", F.col("_t.frac"))).alias(name))
    return hit.groupBy(*keys).agg(*out)
