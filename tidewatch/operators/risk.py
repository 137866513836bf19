"""Risk of incidents: weighted factors, each from one aggregate of findings, links, stages, resources or enrichment.

An incident without evidence for a factor gets 0 points for it, never fewer.  Every sum is a partial aggregate per
(tenant, incident), so an incident may hold any share of the findings or links.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordered import top_k
from tidewatch.params import MODEL_AGENT, STAGES, Risk

INCIDENT = ["website_id", "incident_id"]
KINDS = ("auth_anomaly", "behavior_anomaly", "attack_indicator", "ml_anomaly")
COUNTED = ("ip", "domain", "cve")
FAILED_RUNS = ("not_run", "disabled", "error")


def clamp(c: Column) -> Column:
    """``c`` cut to [0, 1]; NULL stays NULL (``least`` and ``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


# ------------------------------------------------------------------------------------------------ inputs
def finding_inputs(findings: DataFrame, p: Risk = Risk()) -> DataFrame:
    kind = F.col("finding_type")
    auth = F.coalesce(*[F.when(F.col("category") == k, F.lit(float(v))) for k, v in p.auth_values.items()], F.lit(float(p.auth_default)))
    attack = kind == "attack_indicator"
    g = findings.groupBy(*INCIDENT).agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.max(F.when((kind == "behavior_anomaly") & (F.col("agent_name") != MODEL_AGENT), F.col("confidence"))).alias("behavior_max"),
        F.max(F.when(kind == "ml_anomaly", F.col("anomaly_score"))).alias("anomaly_max"),
        F.max(F.when(attack, F.col("confidence"))).alias("attack_max"),
        F.count_distinct(F.when(attack, F.col("category"))).alias("attack_categories"),
        F.max(F.when(kind == "auth_anomaly", auth)).alias("auth_max"),
        *[F.bool_or(kind == k).alias(f"has_{k}") for k in KINDS])
    best = (top_k(findings, INCIDENT, [F.desc("confidence"), F.asc("finding_id")], p.top_findings, "finding_id", "r")
            .groupBy(*INCIDENT).agg((F.sum("confidence") / F.count(F.lit(1))).alias("top_confidence")))
    g = g.withColumn("kinds", reduce(lambda a, b: a + b, [F.col(f"has_{k}").cast("int") for k in KINDS]))
    return g.drop(*[f"has_{k}" for k in KINDS]).join(best, INCIDENT, "left")


def stage_counts(stages: DataFrame) -> DataFrame:
    """Map of stage counts per incident (six stages at most)."""
    counts = F.map_from_arrays(F.array(*[F.lit(s) for s in STAGES]), F.array(*[F.count_if(F.col("stage") == s) for s in STAGES]))
    return stages.groupBy(*INCIDENT).agg(counts.alias("stages"))


def intel_inputs(intel: DataFrame, p: Risk = Risk()) -> DataFrame:
    found = (F.col("status") == "evidence_found") & F.col("indicator_type").isin(*COUNTED)
    return intel.groupBy(*INCIDENT).agg(
        F.lit(True).alias("intel_run"), F.count_if(found & ~F.col("synthetic")).alias("intel_real"),
        F.count_if(found & F.col("synthetic")).alias("intel_synthetic"))


def risk_inputs(incidents: DataFrame, findings: DataFrame, links: DataFrame, stages: DataFrame, resources: DataFrame,
                intel: DataFrame | None = None, events: DataFrame | None = None, p: Risk = Risk()) -> DataFrame:
    """One row per incident.  ``incidents`` needs event_count and may have ``truncated``; ``resources`` is (incident,
    affected_resources); ``events`` (incident, is_synthetic) gives the all-synthetic flag."""
    per_link = links.groupBy(*INCIDENT).agg(F.count(F.lit(1)).alias("link_count"), F.avg("strength").alias("mean_strength"))
    d = (incidents.join(finding_inputs(findings, p), INCIDENT, "left").join(per_link, INCIDENT, "left")
         .join(stage_counts(stages), INCIDENT, "left").join(resources, INCIDENT, "left"))
    if intel is not None:
        d = d.join(intel_inputs(intel, p), INCIDENT, "left")
    else:
        d = d.withColumn("intel_run", F.lit(False)).withColumn("intel_real", F.lit(0)).withColumn("intel_synthetic", F.lit(0))
    if events is not None:
        d = d.join(events.groupBy(*INCIDENT).agg(F.bool_and("is_synthetic").alias("all_synthetic")), INCIDENT, "left")
    else:
        d = d.withColumn("all_synthetic", F.lit(False))
    if "truncated" not in incidents.columns:
        d = d.withColumn("truncated", F.lit(False))
    return d.withColumn("intel_run", F.coalesce("intel_run", F.lit(False))).withColumn("link_count", F.coalesce("link_count", F.lit(0)))


# ------------------------------------------------------------------------------------------------ factors: (value, status)
Factor = tuple[Column, Column]


def _seen(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "observed").otherwise("not_observed")


def f_behavior(p: Risk = Risk()) -> Factor:
    v = F.col("behavior_max")
    return F.coalesce(v, F.lit(0.0)), _seen(v.isNotNull())


def f_anomaly(p: Risk = Risk()) -> Factor:
    s = F.col("anomaly_max")
    return F.coalesce(clamp((s - p.score_floor) / (1 - p.score_floor)), F.lit(0.0)), _seen(s.isNotNull())


def f_attack(p: Risk = Risk()) -> Factor:
    v = F.col("attack_max")
    return F.coalesce(clamp(v + p.breadth_bonus * (F.col("attack_categories") - 1)), F.lit(0.0)), _seen(v.isNotNull())


def f_authentication(p: Risk = Risk()) -> Factor:
    v = F.col("auth_max")
    return F.coalesce(v, F.lit(0.0)), _seen(v.isNotNull())


def _stage(name: str) -> Column:
    return F.coalesce(F.try_element_at("stages", F.lit(name)), F.lit(0))


def f_sensitive(p: Risk = Risk()) -> Factor:
    hit = _stage("sensitive_access") > 0
    login = _stage("authentication_success") > 0
    return F.when(hit & login, p.sensitive_login_value).when(hit, p.sensitive_value).otherwise(0.0), _seen(hit)


def f_correlation(p: Risk = Risk()) -> Factor:
    present = reduce(lambda a, b: a + b, [(_stage(s) > 0).cast("int") for s in STAGES])
    n = F.coalesce("event_count", F.lit(0))
    size = clamp(F.log1p(n.cast("double")) / F.log1p(F.lit(float(p.size_saturation))))
    strength = clamp(F.coalesce("mean_strength", F.lit(0.0)))
    total = p.stage_weight + p.size_weight + p.strength_weight
    v = (p.stage_weight * present / len(STAGES) + p.size_weight * size + p.strength_weight * strength) / total
    return v, _seen(n > 0)


def asset_value(path: Column, p: Risk = Risk()) -> Column:
    """Value of the longest configured prefix of the path (at a segment boundary), else the default."""
    low = F.lower(F.substring_index(path, "?", 1))
    longest = sorted(p.asset_values.items(), key=lambda kv: -len(kv[0].rstrip("/")))
    hits = [F.when((low == k.lower().rstrip("/")) | low.startswith(k.lower().rstrip("/") + "/"), F.lit(float(v))) for k, v in longest]
    return F.coalesce(*hits, F.lit(float(p.asset_default)))


def f_asset(p: Risk = Risk()) -> Factor:
    paths = F.filter(F.col("affected_resources"), lambda x: x != "")
    v = F.array_max(F.transform(paths, lambda x: asset_value(x, p)))
    return F.coalesce(v, F.lit(0.0)), _seen(v.isNotNull())


def f_threat_intel(p: Risk = Risk()) -> Factor:
    real, synth = F.coalesce("intel_real", F.lit(0)), F.coalesce("intel_synthetic", F.lit(0))
    used = real + synth if p.intel_count_synthetic else real
    v = F.when(used > 0, clamp(p.intel_first + p.intel_each * (used - 1))).otherwise(0.0)
    status = (F.when(~F.col("intel_run"), "not_assessed").when(used > 0, "observed").when(synth > 0, "excluded").otherwise("no_evidence"))
    return F.when(F.col("intel_run"), v).otherwise(0.0), status


FACTORS = {"behavior": f_behavior, "anomaly": f_anomaly, "attack_indicators": f_attack, "authentication": f_authentication,
           "sensitive_endpoint": f_sensitive, "correlation": f_correlation, "asset_impact": f_asset, "threat_intel": f_threat_intel}


def risk_factors(inputs: DataFrame, p: Risk = Risk()) -> DataFrame:
    """Long table (incident, factor, weight, value, status, points): eight rows per incident."""
    total = float(sum(p.weights.get(k, 0) for k in FACTORS))
    rows = []
    for name, make in FACTORS.items():
        value, status = make(p)
        rows.append(F.struct(F.lit(name).alias("factor"), F.lit(float(p.weights.get(name, 0))).alias("weight"),
                             F.round(clamp(value.cast("double")), 4).alias("value"), status.alias("status")))
    d = inputs.select(*INCIDENT, F.explode(F.array(*rows)).alias("f")).select(*INCIDENT, "f.*")
    return d.withColumn("points", F.round(100.0 * F.col("weight") * F.col("value") / total, 2))


def risk_level(score: Column, p: Risk = Risk()) -> Column:
    return (F.when(score >= p.critical, "CRITICAL").when(score >= p.high, "HIGH").when(score >= p.medium, "MEDIUM").otherwise("LOW"))


def risk_score(factors: DataFrame, p: Risk = Risk()) -> DataFrame:
    """Score (0–100, one decimal) and level per incident."""
    score = F.round(100.0 * F.sum(F.col("weight") * F.col("value")) / F.sum("weight"), 1)
    return factors.groupBy(*INCIDENT).agg(score.alias("risk_score")).withColumn("risk_level", risk_level(F.col("risk_score"), p))


def risk_confidence(inputs: DataFrame, p: Risk = Risk()) -> DataFrame:
    """Evidence-support index: signal diversity, mean confidence of the best findings, link strength."""
    _, intel = f_threat_intel(p)
    kinds = F.coalesce("kinds", F.lit(0)) + (intel == "observed").cast("int")
    diversity = clamp(kinds / F.lit(float(p.diversity_saturation)))
    found, strength = clamp(F.coalesce("top_confidence", F.lit(0.0))), clamp(F.coalesce("mean_strength", F.lit(0.0)))
    total = p.conf_diversity + p.conf_findings + p.conf_strength
    raw = (p.conf_diversity * diversity + p.conf_findings * found + p.conf_strength * strength) / total
    penalty = F.when(F.coalesce("truncated", F.lit(False)), p.truncation_penalty).otherwise(0.0)
    return inputs.select(*INCIDENT, kinds.alias("signal_kinds"), F.round(clamp(raw - penalty), 2).alias("confidence"))


def evidence_gaps(inputs: DataFrame, p: Risk = Risk()) -> DataFrame:
    """(incident, position, gap): named gaps in a fixed order."""
    _, intel = f_threat_intel(p)
    _, anomaly = f_anomaly(p)
    gaps = F.array_compact(F.array(
        F.when(intel == "not_assessed", "threat_intel_not_run").when(intel.isin("no_evidence", "excluded"), "no_threat_intel_evidence"),
        F.when(anomaly == "not_observed", "no_ml_anomaly"), F.lit("no_asset_context"),
        F.when(F.coalesce("truncated", F.lit(False)), "truncated_evidence"),
        F.when(F.coalesce("all_synthetic", F.lit(False)), "synthetic_data")))
    return inputs.select(*INCIDENT, F.posexplode(gaps).alias("position", "gap"))


def supporting_findings(findings: DataFrame, k: int = 10) -> DataFrame:
    cols = [*INCIDENT, "finding_id", "agent_name", "category", "rule_id", F.round("confidence", 4).alias("confidence")]
    best = top_k(findings, INCIDENT, [F.desc("confidence"), F.asc("finding_id")], k, "finding_id")
    return best.select(*cols, "rank")


def score_incidents(inputs: DataFrame, p: Risk = Risk()) -> DataFrame:
    """Stored risk per incident: score, level, confidence, ordered factors and the parameter fingerprint."""
    factors = risk_factors(inputs, p)
    listed = factors.groupBy(*INCIDENT).agg(F.transform(F.sort_array(F.collect_list(F.struct(
        (-F.col("points")).alias("o"), "factor", "weight", "value", "status", "points"))),
        lambda x: x.dropFields("o")).alias("factors"))                                    # eight rows per incident
    gaps = evidence_gaps(inputs, p).groupBy(*INCIDENT).agg(F.array_sort(F.collect_list(F.struct("position", "gap"))).alias("g"))
    gaps = gaps.select(*INCIDENT, F.transform("g", lambda x: x["gap"]).alias("evidence_gaps"))
    return (inputs.select(*INCIDENT, F.col("event_count").alias("scored_event_count"))
            .join(risk_score(factors, p), INCIDENT).join(risk_confidence(inputs, p), INCIDENT).join(listed, INCIDENT).join(gaps, INCIDENT)
            .withColumn("config_fingerprint", F.lit(p.fingerprint())))


def risk_staleness(current: DataFrame) -> DataFrame:
    """Flags scores whose inputs changed: (event_count, intel_at) against (scored_event_count, scored_intel_at)."""
    reasons = F.array_compact(F.array(
        F.when(~F.col("event_count").eqNullSafe(F.col("scored_event_count")), "events_changed"),
        F.when(~F.col("intel_at").eqNullSafe(F.col("scored_intel_at")), "threat_intel_changed")))
    return current.select(*INCIDENT, (F.size(reasons) > 0).alias("stale"), reasons.alias("stale_reasons"))


def risk_rollup(scored: DataFrame) -> DataFrame:
    """Per tenant: incidents, counts by level and the number of high-risk incidents."""
    level = F.col("risk_level")
    return scored.groupBy("website_id").agg(
        F.count(F.lit(1)).alias("incidents"), F.count(level).alias("scored"),
        *[F.count_if(level == x).alias(x.lower()) for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
        F.count_if(level.isin("HIGH", "CRITICAL")).alias("high_risk"))


def funnel(events: DataFrame, findings: DataFrame, incidents: DataFrame) -> DataFrame:
    """(website_id, step, stage, n): events, events with findings, incidents, high-risk incidents."""
    def counted(df, step, name):
        return df.groupBy("website_id").agg(F.count(F.lit(1)).alias("n")).select(
            "website_id", F.lit(step).alias("step"), F.lit(name).alias("stage"), "n")
    parts = [counted(events, 1, "events"), counted(findings.select("website_id", "event_id").distinct(), 2, "events_with_findings"),
             counted(incidents, 3, "incidents"),
             counted(incidents.where(F.col("risk_level").isin("HIGH", "CRITICAL")), 4, "high_risk_incidents")]
    return reduce(DataFrame.unionByName, parts)


def factor_points(factors: DataFrame) -> DataFrame:
    """Points of each factor as columns, one row per incident."""
    return factors.groupBy(*INCIDENT).pivot("factor", list(FACTORS)).agg(F.first("points"))


def ranked(scored: DataFrame) -> DataFrame:
    """Incidents of each tenant by score, unscored last; a global sort, which Spark does by range partitioning."""
    return scored.orderBy("website_id", F.desc_nulls_last("risk_score"), "incident_id")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Window",)]
