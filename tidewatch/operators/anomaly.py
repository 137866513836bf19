"""Session anomaly model: robust baseline, directional deviations, isolation forest, findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.citations import Citations
from tidewatch.operators.forest import fit_forest, score_forest
from tidewatch.operators.ordered import exact_quantiles, first_ids, spread_join
from tidewatch.operators.sessions import SESSION, with_session_key
from tidewatch.params import ANOMALY_FEATURES, ANOMALY_RULE, MAX_CITED, MODEL_AGENT, Anomaly
from tidewatch.session import checkpointed

FEATURES = list(ANOMALY_FEATURES)
MAD_SIGMA = 1.4826
IQR_SIGMA = 1.349


def session_matrix(summary: DataFrame) -> DataFrame:
    """Ten numeric features per session; undefined values are NULL."""
    n = F.greatest(F.col("event_count"), F.lit(1))
    made = {"error_ratio": F.col("error_events") / n, "median_page_gap_s": F.col("median_page_gap_s"),
            "interaction_per_page": F.when(F.col("page_views") > 0, F.col("interaction_total") / F.col("page_views"))}
    return summary.select(*SESSION, *[made.get(f, F.col(f) if f not in made else None).cast("double").alias(f) for f in FEATURES])


def _long(matrix: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])
    return matrix.select(*SESSION, F.explode(rows).alias("r")).select(*SESSION, "r.*")


def robust_baseline(matrix: DataFrame) -> DataFrame:
    """(tenant, feature, median, scale): exact quantiles; the scale is the largest of MAD, IQR and the feature's floor."""
    key = ["website_id", "feature"]
    long = _long(matrix)
    med = exact_quantiles(long, key, "value", {"median": 0.5})
    every = long.select(*key).distinct().join(med, key, "left").withColumn("median", F.coalesce("median", F.lit(0.0)))
    filled = spread_join(long, every, key, spread="session_key").withColumn("x", F.coalesce("value", "median")).withColumn("dev", F.abs(F.col("x") - F.col("median")))
    quart = exact_quantiles(filled, key, "x", {"q1": 0.25, "q3": 0.75})
    mad = exact_quantiles(filled, key, "dev", {"mad": 0.5})
    floor = F.coalesce(*[F.when(F.col("feature") == f, F.lit(v[1])) for f, v in ANOMALY_FEATURES.items()])
    return (every.join(quart, key).join(mad, key)
            .select(*key, "median", F.greatest(MAD_SIGMA * F.col("mad"), (F.col("q3") - F.col("q1")) / IQR_SIGMA, floor).alias("scale")))


def _wide(baseline: DataFrame) -> DataFrame:
    """One row per tenant with all medians and scales."""
    def of(f, c):
        return F.max(F.when(F.col("feature") == f, F.col(c)))
    return baseline.groupBy("website_id").agg(*[of(f, "median").alias(f"m_{f}") for f in FEATURES], *[of(f, "scale").alias(f"s_{f}") for f in FEATURES])


def with_baseline(matrix: DataFrame, baseline: DataFrame) -> DataFrame:
    return spread_join(matrix, _wide(baseline), ["website_id"], spread="session_key")


def directional_z(matrix: DataFrame, baseline: DataFrame) -> DataFrame:
    """Robust z of every feature on its unusual side (columns ``z_<feature>``), 0 where undefined or on the other side."""
    d = with_baseline(matrix, baseline)
    out = []
    for f, (side, _) in ANOMALY_FEATURES.items():
        z = (F.coalesce(F.col(f), F.col(f"m_{f}")) - F.col(f"m_{f}")) / F.col(f"s_{f}")
        out.append(F.greatest(z if side == "high" else -z, F.lit(0.0)).alias(f"z_{f}"))
    return d.select("*", *out).withColumn("max_z", F.greatest(*[F.col(f"z_{f}") for f in FEATURES]))


def imputed(matrix: DataFrame, baseline: DataFrame) -> DataFrame:
    d = with_baseline(matrix, baseline)
    return d.select(*SESSION, *[F.coalesce(F.col(f), F.col(f"m_{f}"), F.lit(0.0)).alias(f) for f in FEATURES])


def isolation_forest(matrix: DataFrame, baseline: DataFrame, p: Anomaly = Anomaly()) -> DataFrame:
    """Anomaly score of every session against its tenant's own sessions.  The fit is checkpointed: it is read again for scoring."""
    x = checkpointed(imputed(matrix, baseline))
    return score_forest(x, checkpointed(fit_forest(x, p)))


def anomaly_confidence(score: Column, p: Anomaly = Anomaly()) -> Column:
    share = F.least(F.greatest((score - p.score_threshold) / (1 - p.score_threshold), F.lit(0.0)), F.lit(1.0))
    return F.round(p.confidence_min + share * (p.confidence_max - p.confidence_min), 3)


def flag_anomalies(scores: DataFrame, z: DataFrame, p: Anomaly = Anomaly()) -> DataFrame:
    """Flag where score and deviation agree."""
    d = scores.join(z.select(*SESSION, "max_z"), SESSION)
    return d.withColumn("flagged", (F.col("anomaly_score") >= p.score_threshold) & (F.col("max_z") >= p.min_z))


def notable_deviations(z: DataFrame, p: Anomaly = Anomaly()) -> DataFrame:
    """Features with z at or over the limit, strongest first, at most five per session (ten candidates per row, so the
    ranking is an array sort inside the row, not a shuffle)."""
    rows = F.array(*[F.struct((-F.round(F.col(f"z_{f}"), 2)).alias("o"), F.lit(f).alias("feature"), F.col(f"z_{f}").alias("z"), F.col(f).alias("value"),
                              F.col(f"m_{f}").alias("median")) for f in FEATURES])
    best = F.slice(F.array_sort(F.filter(rows, lambda r: r["z"] >= p.notable_z)), 1, p.notable_max)
    return z.select(*SESSION, F.posexplode(best).alias("position", "d")).select(
        *SESSION, (F.col("position") + 1).alias("position"), F.col("d.feature").alias("feature"), F.round("d.z", 2).alias("deviation_z"),
        F.round("d.value", 3).alias("value"), F.round("d.median", 3).alias("baseline_median"))


def model_status(matrix: DataFrame, p: Anomaly = Anomaly()) -> DataFrame:
    """(tenant, sessions, status): ``disabled``, ``insufficient_baseline`` or ``ok``."""
    g = matrix.groupBy("website_id").agg(F.count(F.lit(1)).alias("sessions"))
    if not p.enabled:
        return g.withColumn("status", F.lit("disabled"))
    return g.withColumn("status", F.when(F.col("sessions") < max(p.min_sessions, 2), "insufficient_baseline").otherwise("ok"))


def anomaly_findings(events: DataFrame, summary: DataFrame, p: Anomaly = Anomaly()) -> DataFrame:
    """Findings of flagged sessions, anchored on the session's first event, for tenants with enough sessions."""
    matrix = session_matrix(summary)
    ready = model_status(matrix, p).where("status = 'ok'").select("website_id")
    matrix = checkpointed(spread_join(matrix, ready, ["website_id"], "left_semi", "session_key"))
    baseline = checkpointed(robust_baseline(matrix))
    z = directional_z(matrix, baseline)
    flags = flag_anomalies(isolation_forest(matrix, baseline, p), z, p).where("flagged")
    flags = flags.join(summary.select(*SESSION, "first_event_id", "event_count", "inferred"), SESSION)
    own = with_session_key(events).select(*SESSION, "event_id", "ts_us").join(flags.select(*SESSION), SESSION, "left_semi")
    ids = first_ids(own, SESSION, MAX_CITED)
    rule, title, kind, category = ANOMALY_RULE
    key = F.concat_ws("|", "website_id", F.lit(rule), "session_key")
    values = F.map_from_arrays(F.array(F.lit("anomaly_score"), F.lit("max_deviation_z")), F.array(F.round("anomaly_score", 4), F.round("max_z", 2)))
    seen = F.create_map(F.lit("session_key"), F.col("session_key"), F.lit("session_inferred_from_ip"), F.col("inferred").cast("string"),
                        F.lit("event_count"), F.col("event_count").cast("string"))
    limits = F.create_map(*[x for k, v in (("score_threshold", p.score_threshold), ("min_deviation_z", p.min_z), ("notable_feature_z", p.notable_z))
                            for x in (F.lit(k), F.lit(float(v)))])
    return flags.join(ids, SESSION, "left").select(
        F.concat(F.lit("fnd_"), F.left(F.sha2(key, 256), F.lit(32))).alias("finding_id"), "website_id", F.lit(MODEL_AGENT).alias("agent_name"),
        F.lit(rule).alias("rule_id"), F.lit(title).alias("title"), F.lit(kind).alias("finding_type"), F.lit(category).alias("category"),
        F.lit(None).cast("string").alias("technique_id"), F.col("first_event_id").alias("event_id"), F.col("session_key").alias("subject"),
        anomaly_confidence(F.col("anomaly_score"), p).alias("confidence"), seen.alias("observed"), values.alias("derived"), limits.alias("thresholds"),
        "event_ids", F.col("event_count").alias("cited_events"), (F.col("event_count") > MAX_CITED).alias("event_ids_truncated"))


def anomaly_citations(events: DataFrame, found: DataFrame) -> Citations:
    """All events of the sessions that ``anomaly_findings`` flagged."""
    of = found.select("website_id", F.col("subject").alias("session_key"), "finding_id")
    own = spread_join(with_session_key(events).select(*SESSION, "event_id"), of, SESSION)
    return Citations.of(own.select("website_id", "finding_id", "event_id"))


__all__ = [n for n in dir() if not n.startswith("_") and n != "reduce"]
