"""Hard-negative mining by threshold joins with norm bounds.

Anchors are held against all rows, block by block.  A block keeps an inverted index: postings of eight dimensions at a time, the
dimensions of most energy first, and a row's weak last dimensions are left out when its remaining norm times the anchors' cannot lift it
over the lowest threshold.  Scores add up along the postings, rows that the remaining norms rule out are dropped, and what is left is
scored whole, in integers.  An anchor starts with a high threshold; while a window is not full the threshold is lowered."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, discard

ROWS = 32_768          # rows in a block at most
ANCHORS = 2_048        # anchors in a block at most
BATCH = 64             # anchors scored against a block at once
DIMS = 8               # dimensions of a posting
PAIRS = 65_536         # candidates verified at once
PROBE = 16             # the first look reads one of so many blocks
START = 95             # a window's first threshold, in hundredths of its positive's score
SCALE = 256            # components become whole numbers of 1/SCALE
MOST = 2.0**26         # larger components are cut to this size, so that scores of up to 2,048 dimensions fit 64 bits


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have only finite components, and those as rows of whole numbers; shorter vectors end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts, flat = column.offsets.to_numpy().astype(np.int64), column.values
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    sizes, good = np.diff(starts), bad[starts[1:]] == bad[starts[:-1]]
    out = np.zeros((int(good.sum()), int(sizes[good].max(initial=0))), np.int32)
    at = np.arange(out.shape[1])
    inside = at < sizes[good, None]
    places = (starts[:-1][good, None] + at)[inside]
    out[inside] = np.clip(np.floor(SCALE * x[places]), -MOST, MOST)
    return good, out


def _packed(x: np.ndarray) -> bytes:
    """The rows in the narrowest whole numbers that hold them."""
    kind = np.int16 if not x.size or abs(x).max() < 2**15 else np.int32
    return x.astype(kind).tobytes()


def _unpacked(data: bytes, rows: int, width: int) -> np.ndarray:
    kind = np.int16 if len(data) == 2 * rows * width else np.int32
    return np.frombuffer(data, kind).reshape(rows, width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vid, label, vec) of a partition as block rows of at most ROWS."""
    slot = TaskContext.get().partitionId()
    for b in _lots(batches, ROWS):
        good, x = _matrix(b.column("vec"))
        ids, labels = b.column("vid").filter(pa.array(good)), b.column("label").filter(pa.array(good)).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_pydict({"slot": [slot], "n": pa.array([len(x)], pa.int32()), "width": pa.array([x.shape[1]], pa.int32()),
                                          "ids": [ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes()], "no_id": [np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes()],
                                          "labels": [labels.tobytes()], "data": [_packed(x)]}, schema=BLOCK)


def _lots(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        while n >= most:
            t = pa.Table.from_batches(held).combine_chunks()
            yield t.slice(0, most).combine_chunks().to_batches()[0]
            held, n = t.slice(most).to_batches(), n - most
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


BLOCK = pa.schema([("slot", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("no_id", pa.binary()), ("labels", pa.binary()), ("data", pa.binary())])
ONE = pa.schema([("akey", pa.int64()), ("anchor_id", pa.int64()), ("label", pa.int64()), ("width", pa.int32()), ("data", pa.binary())])
GROUP = pa.schema([("anchors", pa.int32()), ("a_width", pa.int32()), ("akeys", pa.binary()), ("a_ids", pa.binary()), ("a_labels", pa.binary()), ("a_data", pa.binary()), ("bounds", pa.binary())])
MATCH = pa.schema([("akey", pa.int64()), ("w", pa.int32()), ("vid", pa.int64()), ("score", pa.int64())])
KINDS = {pa.int32(): "INT", pa.int64(): "BIGINT", pa.binary(): "BINARY"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {KINDS[f.type]}" for f in schema)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good, x = _matrix(b.column("vec"))
        kept = [b.column(c).filter(pa.array(good)) for c in ("akey", "vid", "label")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array([x.shape[1]] * len(x), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], schema=ONE)


def _groups(windows: int):
    """Anchor rows with ``lows`` and ``highs`` as rows of at most ANCHORS."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _lots(batches, ANCHORS):
            width = max(b.column("width").to_pylist())
            x = np.zeros((b.num_rows, width), np.int32)
            for row, data in zip(x, b.column("data").to_pylist(), strict=True):
                v = np.frombuffer(data, np.int32)
                row[:len(v)] = v
            bounds = np.zeros((b.num_rows, windows, 2), np.int64)
            bounds[:, :, 0] = 1                             # an absent window is empty
            for i, (low, high) in enumerate(zip(b.column("lows").to_pylist(), b.column("highs").to_pylist(), strict=True)):
                for w, value in low:
                    bounds[i, w, 0] = value
                for w, value in high:
                    bounds[i, w, 1] = value
            raw = [b.column(c).to_numpy(zero_copy_only=False).tobytes() for c in ("akey", "anchor_id", "label")]
            yield pa.RecordBatch.from_pydict({"anchors": pa.array([len(x)], pa.int32()), "a_width": pa.array([width], pa.int32()), "akeys": [raw[0]], "a_ids": [raw[1]],
                                              "a_labels": [raw[2]], "a_data": [_packed(x)], "bounds": [bounds.tobytes()]}, schema=GROUP)
    return run


def _rest_norms(x: np.ndarray) -> np.ndarray:
    """Norms of what remains after 0, 1, 2, ... postings."""
    squares = np.add.reduceat(x * x, np.arange(0, x.shape[1], DIMS), axis=1)
    return np.sqrt(np.concatenate([np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1))


def candidates(x: np.ndarray, rest: np.ndarray, q: np.ndarray, q_rest: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) whose score may reach the anchor's ``least``; dimensions in order of energy."""
    slack = 1e-6 + 1e-9 * q_rest[:, 0].max() * rest[:, 0].max(initial=0)
    reach = rest * q_rest.max(axis=0) + slack >= least.min()             # does what remains after c postings matter?
    indexed = np.where(reach[:, :-1], np.arange(1, reach.shape[1]), 0).max(axis=1)
    order = np.argsort(-indexed, kind="stable")
    order = order[:np.count_nonzero(indexed)] if least.min() > 0 else order
    sums = np.zeros((len(q), len(order)))
    steps = reach.shape[1] - 1
    for c in range(steps):
        n = np.count_nonzero(indexed[order] > c)
        if not n:
            break
        dims = slice(c * DIMS, (c + 1) * DIMS)
        sums[:, :n] += q[:, dims] @ x[order[:n], dims].T
        if c + 1 in (steps // 2, 3 * steps // 4):                        # rows that no anchor can still reach go
            alive = np.ones(len(order), bool)
            alive[:n] = (sums[:, :n] + q_rest[:, c + 1, None] * rest[order[:n], c + 1] + slack >= least[:, None]).any(axis=0)
            if alive.sum() < 0.8 * len(alive):
                order, sums = order[alive], sums[:, alive]
    ends = indexed[order]
    a, r = np.nonzero(sums + q_rest[:, ends] * rest[order, ends] + slack >= least[:, None])
    return a, order[r]


def _tops(a: np.ndarray, ids: np.ndarray, no_id: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each anchor's first ``k`` matches: higher scores, then smaller ids, null last."""
    order = np.lexsort((ids, no_id, -scores, a))
    s = a[order]
    rank = np.arange(len(s)) - np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], np.arange(len(s)), 0)) if len(s) else np.zeros(0, int)
    return order[rank < k]


def _search(same: bool, k: int, windows: int):
    """For joined (block, anchor group) rows: the first ``k`` rows of each anchor's windows, of its label (``same``) or of another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield from one(row)

    def one(r: dict) -> Iterator[pa.RecordBatch]:
        xs, qs = _unpacked(r["data"], r["n"], r["width"]), _unpacked(r["a_data"], r["anchors"], r["a_width"])
        if not len(xs) or not len(qs):
            return
        d = max(DIMS, -(-max(xs.shape[1], qs.shape[1]) // DIMS) * DIMS)
        xs, qs = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (xs, qs))
        ids, labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
        no_id = np.unpackbits(np.frombuffer(r["no_id"], np.uint8), count=len(ids)).astype(bool)
        akeys, a_ids, a_labels = (np.frombuffer(r[c], np.int64) for c in ("akeys", "a_ids", "a_labels"))
        bounds = np.frombuffer(r["bounds"], np.int64).reshape(len(qs), windows, 2)
        open_ = bounds[:, :, 0] <= bounds[:, :, 1]
        least = np.where(open_, bounds[:, :, 0], np.iinfo(np.int64).max).min(axis=1)
        xf = xs.astype(np.float64)
        energy = np.argsort(-(xf * xf).sum(axis=0), kind="stable")
        xf, qf = xf[:, energy], qs[:, energy].astype(np.float64)
        rest, q_rest = _rest_norms(xf), _rest_norms(qf)
        live = np.flatnonzero(open_.any(axis=1))
        if same:
            live = live[np.argsort(a_labels[live], kind="stable")]
            parts = np.split(live, np.flatnonzero(np.diff(a_labels[live])) + 1)
            by_label = np.argsort(labels, kind="stable")
            inside = [by_label[np.searchsorted(labels[by_label], a_labels[p[0]], "left"):np.searchsorted(labels[by_label], a_labels[p[0]], "right")] if len(p) else p for p in parts]
        else:
            parts, inside = [live[np.argsort(least[live], kind="stable")]], [np.arange(len(xs))]
        for part, rows in zip(parts, inside, strict=True):
            if not len(rows):
                continue
            x, x_rest = (xf, rest) if len(rows) == len(xf) and not same else (xf[rows], rest[rows])
            for at in range(0, len(part), BATCH):
                some = part[at:at + BATCH]
                a, p = candidates(x, x_rest, qf[some], q_rest[some], least[some].astype(np.float64))
                a, p = some[a], rows[p]
                keep = (no_id[p] | (ids[p] != a_ids[a])) if same else labels[p] != a_labels[a]
                a, p = a[keep], p[keep]
                scores = np.concatenate([np.einsum("ij,ij->i", qs[a[i:i + PAIRS]], xs[p[i:i + PAIRS]], dtype=np.int64) for i in range(0, len(a), PAIRS)] or [np.zeros(0, np.int64)])
                for w in range(windows):
                    hit = np.flatnonzero((scores >= bounds[a, w, 0]) & (scores <= bounds[a, w, 1]))
                    hit = hit[_tops(a[hit], ids[p[hit]], no_id[p[hit]], scores[hit], k)]
                    if len(hit):
                        yield pa.RecordBatch.from_arrays([pa.array(akeys[a[hit]]), pa.array(np.full(len(hit), w, np.int32)), pa.array(ids[p[hit]], mask=no_id[p[hit]]),
                                                          pa.array(scores[hit])], schema=MATCH)
    return run


def _pass(blocks: DataFrame, slots: int, anchors: DataFrame, bounds: DataFrame, same: bool, k: int, windows: int) -> DataFrame:
    """The first ``k`` matches of each window in ``bounds`` (akey, w, low, high), written."""
    held = bounds.groupBy("akey").agg(F.collect_list(F.struct("w", "low")).alias("lows"), F.collect_list(F.struct("w", "high")).alias("highs"))
    pairs = F.transform("lows", lambda s: F.array(s["w"].cast("bigint"), s["low"])), F.transform("highs", lambda s: F.array(s["w"].cast("bigint"), s["high"]))
    groups = (anchors.join(held, "akey").select("akey", "anchor_id", "label", "width", "data", pairs[0].alias("lows"), pairs[1].alias("highs"))
              .mapInArrow(_groups(windows), _ddl(GROUP)))
    dealt = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")).repartition(slots, "slot")
    found = blocks.repartition(slots, "slot").join(dealt, "slot").mapInArrow(_search(same, k, windows), _ddl(MATCH))
    first = F.row_number().over(Window.partitionBy("akey", "w").orderBy(F.desc("score"), F.asc_nulls_last("vid")))
    return cut(found.withColumn("rank", first).where(F.col("rank") <= k), "matches")


def mine(rows: DataFrame, id_col: str, label: Column, vec_col: str, is_anchor: Column, positives: int = 5, negatives: int = 5,
         low: int = 80) -> DataFrame:
    """Per anchor and positive: the first ``negatives`` rows of another label that score ``low`` to 100 hundredths of the positive:
    ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the inner product of components ``floor(SCALE * x)``, cut to MOST in size.  Rows of most score come first, ties go to the
    smaller id, a null id comes last.  An anchor's positives are its first ``positives`` rows of its label, without rows of its own id.
    Rows with a null label or vector or with a null or non-finite component take no part; a shorter vector ends in zeros; a null id is no
    anchor; a repeated row counts each time, also as an anchor; further columns are ignored; an empty table gives no rows.  Labels are
    whole numbers.  Positives below zero have an empty window, so no threshold goes below zero.

    The thresholds: a look at one of PROBE blocks gives each anchor a guess, the best score of its label there; anchors that do not find
    all their positives above it are searched again from the score of their last positive in that look, or from zero.  A window is first
    searched down to START hundredths of its positive's score, and down to ``low`` if that does not fill it.  Every pass pairs each
    block of rows with each group of anchors as one row of a join by block, so no task and no driver holds the anchors or the rows."""
    r = rows.select(F.col(id_col).cast("bigint").alias("vid"), label.cast("bigint").alias("label"), F.col(vec_col).alias("vec"),
                    F.coalesce(is_anchor & F.col(id_col).isNotNull(), F.lit(False)).alias("anchor")).where("label IS NOT NULL AND vec IS NOT NULL")
    slots = max(-(-r.count() // ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = cut(r.select("vid", "label", "vec").repartition(slots).mapInArrow(_blocks, _ddl(BLOCK)), "blocks")
    anchors = cut(r.where("anchor").select(F.monotonically_increasing_id().alias("akey"), "vid", "label", "vec").mapInArrow(_anchor_rows, _ddl(ONE)), "anchors")
    top = F.lit(2**62)

    def bounds(least: Column) -> tuple[Column, ...]:
        return F.col("akey"), F.lit(0).alias("w"), least.cast("bigint").alias("low"), top.alias("high")
    look = _pass(blocks.where(F.col("slot") % PROBE == 0), slots, anchors, anchors.select(*bounds(F.lit(0))), True, positives, 1)
    guess = anchors.select("akey").join(look.groupBy("akey").agg(F.max("score").alias("best"), F.min(F.when(F.col("rank") == positives, F.col("score"))).alias("last")), "akey", "left")
    guess = cut(guess.select("akey", F.coalesce("best", F.lit(0)).alias("best"), F.coalesce("last", F.lit(0)).alias("last")), "guess")
    first = _pass(blocks, slots, anchors, guess.select(*bounds(F.col("best"))), True, positives, 1)
    short = guess.where("best > last").join(first.where(F.col("rank") == positives), "akey", "left_anti")
    second = _pass(blocks, slots, anchors, short.select(*bounds(F.col("last"))), True, positives, 1)
    found = first.join(second.select("akey").distinct(), "akey", "left_anti").unionByName(second)
    chosen = cut(found.select("akey", (F.col("rank") - 1).alias("w"), F.col("vid").alias("positive_id"), F.col("score").alias("positive_score"),
                              F.ceil(F.col("score") * low / 100).alias("low")), "positives")

    start = F.greatest(F.col("low"), F.ceil(F.col("positive_score") * START / 100))
    near = _pass(blocks, slots, anchors, chosen.select("akey", "w", start.alias("low"), F.col("positive_score").alias("high")), False, negatives, positives)
    unfilled = chosen.where(start > F.col("low")).join(near.where(F.col("rank") == negatives), ["akey", "w"], "left_anti")
    far = _pass(blocks, slots, anchors, unfilled.select("akey", "w", "low", F.col("positive_score").alias("high")), False, negatives, positives)
    hits = near.join(far.select("akey", "w").distinct(), ["akey", "w"], "left_anti").unionByName(far)
    out = cut(hits.join(chosen.drop("low"), ["akey", "w"]).join(anchors.select("akey", "anchor_id"), "akey")
              .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vid").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    for t in (blocks, anchors, look, guess, first, second, chosen, near, far):
        discard(t)
    return out
