"""Isolation forest per tenant, fitted and scored as grouped Arrow jobs of bounded size.

Fit: every tree draws its own sessions from all of its tenant's by hash, in one pass; a tree is built from at most 256 rows, one
group per (tenant, tree).  Score: a tenant's sessions are cut into slices of a few ten thousand rows and every slice meets
the tenant's forest in a co-group, so neither a forest nor a tenant is ever broadcast or collected as a whole.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import spread_join, top_k
from tidewatch.params import ANOMALY_FEATURES, Anomaly
from tidewatch.session import checkpointed

FEATURES = list(ANOMALY_FEATURES)
KEY = ["website_id", "session_key"]
SLICE_ROWS = 50_000
TREE = ("website_id STRING, tree INT, samples INT, feature ARRAY<INT>, threshold ARRAY<DOUBLE>, `left` ARRAY<INT>, `right` ARRAY<INT>, "
        "size ARRAY<INT>")


def mean_path(n):
    """Mean path length of an unsuccessful search among n items (the published normaliser)."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _hash(*parts) -> str:
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def grow(x: np.ndarray, *seed) -> tuple[list, list, list, list, list]:
    """One isolation tree over the rows of ``x`` as flat node arrays; a leaf has feature -1.

    A node's feature and cut come from the MD5 of ``seed`` and its path (``1`` for the root, then 0 and 1 for left and right), so a
    tree hangs on its rows and seed alone."""
    feature, threshold, left, right, size = [], [], [], [], []
    depth_limit = int(np.ceil(np.log2(max(len(x), 2))))

    def node(rows: np.ndarray, path: str) -> int:
        at = len(feature)
        for column, value in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (size, len(rows))):
            column.append(value)
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if len(path) > depth_limit or len(rows) <= 1 or len(usable) == 0:
            return at
        h = _hash(*seed, path)
        f = int(usable[int(h[:8], 16) % len(usable)])
        cut = float(lo[f] + int(h[8:16], 16) / 2**32 * (hi[f] - lo[f]))
        below = x[rows, f] <= cut
        feature[at], threshold[at] = f, cut
        left[at] = node(rows[below], path + "0")
        right[at] = node(rows[~below], path + "1")
        return at
    node(np.arange(len(x)), "1")
    return feature, threshold, left, right, size


def drawn(matrix: DataFrame, p: Anomaly = Anomaly()) -> DataFrame:
    """For each tree of a tenant the ``max_samples`` sessions of least hash among all its sessions, and some of the next: (.., tree, draw).

    A hash below ``2 * max_samples / sessions`` is drawn in the scan, so about twice the sample leaves it and no pool is needed.  Should a
    tree get too few that way (practically never), its sessions are all offered."""
    count = matrix.groupBy("website_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = checkpointed(spread_join(matrix, count, ["website_id"], spread="session_key"))
    trees = F.sequence(F.lit(0), F.lit(p.trees - 1))

    def draw(tree: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(p.seed), "website_id", tree.cast("string"), "session_key"))
    limit = F.lpad(F.lower(F.hex(F.floor(F.lit(2.0 * p.max_samples * 2**32) / F.col("_n")).cast("bigint"))), 8, "0")
    offered = F.filter(trees, lambda t: (F.col("_n") <= 2 * p.max_samples) | (F.left(draw(t), F.lit(8)) < limit))
    first = checkpointed(rows.withColumn("tree", F.explode(offered)).withColumn("draw", draw(F.col("tree"))))
    got = first.groupBy("website_id", "tree").agg(F.count(F.lit(1)).alias("_got"))
    short = (count.withColumn("tree", F.explode(trees)).join(got, ["website_id", "tree"], "left")
             .where(F.coalesce("_got", F.lit(0)) < F.least(F.col("_n"), F.lit(p.max_samples))).select("website_id", "tree"))
    every = spread_join(rows, short.groupBy("website_id").agg(F.collect_set("tree").alias("_short")), ["website_id"], spread="session_key")
    again = every.withColumn("tree", F.explode("_short")).drop("_short").withColumn("draw", draw(F.col("tree")))
    again = top_k(again, ["website_id", "tree"], [F.asc("draw"), F.asc("session_key")], p.max_samples, "session_key", "_p").drop("_p")
    return first.join(short, ["website_id", "tree"], "left_anti").unionByName(again)


def fit_forest(matrix: DataFrame, p: Anomaly = Anomaly()) -> DataFrame:
    """One row per (tenant, tree).  ``matrix`` holds imputed features (no NULL)."""
    seed, most = p.seed, p.max_samples

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "session_key"]).head(most)
        site, tree = pdf["website_id"].iloc[0], int(pdf["tree"].iloc[0])
        parts = grow(pdf[FEATURES].to_numpy(dtype=float), seed, site, tree)
        return pd.DataFrame([(site, tree, len(pdf), *parts)], columns=["website_id", "tree", "samples", "feature", "threshold", "left", "right", "size"])
    return drawn(matrix, p).select("website_id", "tree", "draw", "session_key", *FEATURES).groupBy("website_id", "tree").applyInPandas(build, TREE)


def _depths(x: np.ndarray, feature, threshold, left, right, size) -> np.ndarray:
    """Path length of every row of ``x`` in one tree, level by level."""
    at = np.zeros(len(x), dtype=int)
    depth = np.zeros(len(x))
    live = np.arange(len(x))
    while len(live):
        node = at[live]
        inner = feature[node] >= 0
        live, node = live[inner], node[inner]
        if not len(live):
            break
        below = x[live, feature[node]] <= threshold[node]
        at[live] = np.where(below, left[node], right[node])
        depth[live] += 1
    return depth + mean_path(size[at])


def score_forest(matrix: DataFrame, forest: DataFrame) -> DataFrame:
    """(tenant, session, anomaly_score) for all sessions; the score is in (0, 1), higher is rarer."""
    count = matrix.groupBy("website_id").agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("_slices"))
    rows = spread_join(matrix, count, ["website_id"], spread="session_key")
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("session_key"), F.col("_slices")).cast("int")).drop("_slices")
    trees = forest.join(count, "website_id").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"website_id": [], "session_key": [], "anomaly_score": []})
        x = left[FEATURES].to_numpy(dtype=float)
        total = np.zeros(len(x))
        for t in right.sort_values("tree").itertuples(index=False):
            total += _depths(x, *[np.asarray(v) for v in (t.feature, t.threshold, t.left, t.right, t.size)])
        norm = float(mean_path(int(right["samples"].max())))
        s = 2.0 ** (-(total / len(right)) / norm) if norm > 0 else np.full(len(x), 0.5)
        return pd.DataFrame({"website_id": left["website_id"], "session_key": left["session_key"], "anomaly_score": s})
    a = rows.select("website_id", "slice", "session_key", *FEATURES).groupBy("website_id", "slice")
    return a.cogroup(trees.groupBy("website_id", "slice")).applyInPandas(score, "website_id STRING, session_key STRING, anomaly_score DOUBLE")
