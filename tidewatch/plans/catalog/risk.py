"""Risk scoring and evaluation."""

import json
from dataclasses import asdict

from pyspark.sql import functions as F

from tidewatch.operators import evaluate as E
from tidewatch.operators import risk as R
from tidewatch.operators import sessions as S
from tidewatch.params import Risk
from tidewatch.plans.catalog.base import ORACLE_VIEWS, events, fx, joined, query, stored, table
from tidewatch.plans.catalog.correlate import cited

P = Risk()


def resources(spark, sf):
    e = events(spark, sf).where(F.col("event_type").isin("sensitive_endpoint_access", "waf_alert"))
    paths = e.select("website_id", F.col("user_id").alias("incident_id"), F.col("features.path").alias("path")).distinct()
    first = R.top_k(paths, R.INCIDENT, [F.asc("path")], 5, "path", "r")
    return first.groupBy(*R.INCIDENT).agg(F.sort_array(F.collect_list("path")).alias("affected_resources"))


def incidents(spark, sf):
    return fx(spark, sf, "fx_incidents").withColumn("truncated", F.col("event_count") > 75)


def inputs(spark, sf):
    syn = events(spark, sf).select("website_id", F.col("user_id").alias("incident_id"), (F.col("source_ip").isNull()).alias("is_synthetic"))
    return stored(spark, sf, "risk_inputs", lambda: R.risk_inputs(
        incidents(spark, sf), fx(spark, sf, "fx_findings"), fx(spark, sf, "fx_links"), fx(spark, sf, "fx_stages"), resources(spark, sf),
        fx(spark, sf, "fx_intel"), syn, P))


@query
def risk_inputs(spark, sf):
    return inputs(spark, sf).select(*R.INCIDENT, "event_count", "finding_count", "kinds", "link_count",
                                    F.round("mean_strength", 6).alias("mean_strength"), F.col("stages")["sensitive_access"].alias("sensitive"),
                                    joined("affected_resources", "|").alias("resources"), "truncated", "intel_real", "intel_synthetic", "all_synthetic")


def _factor(name):
    def run(spark, sf):
        value, status = R.FACTORS[name](P)
        return inputs(spark, sf).select(*R.INCIDENT, F.round(R.clamp(value.cast("double")), 4).alias("value"), status.alias("status"))
    run.__name__ = name
    return query(run)


@query
def risk_score(spark, sf):
    return R.risk_score(R.risk_factors(inputs(spark, sf), P), P)


@query
def risk_factors(spark, sf):
    return R.risk_factors(inputs(spark, sf), P).select(*R.INCIDENT, "factor", "weight", "value", "status")


@query
def risk_confidence(spark, sf):
    return R.risk_confidence(inputs(spark, sf), P)


@query
def risk_level(spark, sf):
    return fx(spark, sf, "fx_incidents").select(*R.INCIDENT, R.risk_level(F.col("risk_score"), P).alias("risk_level"))


@query
def evidence_gaps(spark, sf):
    return R.evidence_gaps(inputs(spark, sf), P)


@query
def supporting_findings(spark, sf):
    return R.supporting_findings(fx(spark, sf, "fx_findings"))


@query
def config_fingerprint(spark, sf):
    return R.score_incidents(inputs(spark, sf), P).select(*R.INCIDENT, "risk_score", "config_fingerprint", F.size("factors").alias("n_factors"))


@query
def risk_staleness(spark, sf):
    i = fx(spark, sf, "fx_incidents")
    d = i.select(*R.INCIDENT, "event_count", (F.col("event_count") - F.col("created_seq") % 2).alias("scored_event_count"),
                 F.when(F.col("created_seq") % 3 == 0, F.col("created_seq")).alias("intel_at"),
                 F.when(F.col("created_seq") % 6 == 0, F.col("created_seq")).alias("scored_intel_at"))
    return R.risk_staleness(d).select(*R.INCIDENT, "stale", joined("stale_reasons").alias("reasons"))


@query
def risk_rollup(spark, sf):
    return R.risk_rollup(fx(spark, sf, "fx_incidents"))


@query
def funnel(spark, sf):
    return R.funnel(events(spark, sf), fx(spark, sf, "fx_findings"), fx(spark, sf, "fx_incidents"))


@query
def factor_points(spark, sf):
    return R.factor_points(R.risk_factors(inputs(spark, sf), P))


# ------------------------------------------------------------------------------------------------ evaluation
def _labels(spark, sf):
    return events(spark, sf).select("website_id", "event_id", F.col("event_type").alias("scenario"),
                                    F.when(F.col("status_code") >= 400, "malicious").otherwise("benign").alias("label"))


@query
def evaluate_events(spark, sf):
    return E.evaluate_events(fx(spark, sf, "fx_findings"), _labels(spark, sf), cited(spark, sf))


@query
def scenario_report(spark, sf):
    return E.scenario_report(fx(spark, sf, "fx_findings"), _labels(spark, sf), cited(spark, sf))


@query
def false_positive_examples(spark, sf):
    return E.false_positive_examples(fx(spark, sf, "fx_findings"), _labels(spark, sf), cited(spark, sf), 5).select("event_id", joined("rules").alias("rules"))


@query
def session_truth(spark, sf):
    return E.session_truth(S.with_session_key(events(spark, sf)), _labels(spark, sf))


def _flags_and_truth(spark, sf, kind="waf_alert"):
    e = S.with_session_key(events(spark, sf))
    flags = e.groupBy("website_id", "session_key").agg(F.bool_or(F.col("event_type") == kind).alias("flagged"))
    return flags, E.session_truth(e, _labels(spark, sf))


@query
def evaluate_sessions(spark, sf):
    return E.evaluate_sessions(*_flags_and_truth(spark, sf))


@query
def session_scenarios(spark, sf):
    return E.session_scenarios(*_flags_and_truth(spark, sf))


@query
def missed_sessions(spark, sf):
    return E.missed_sessions(*_flags_and_truth(spark, sf))


@query
def false_positive_sessions(spark, sf):
    return E.false_positive_sessions(*_flags_and_truth(spark, sf, "session_created"))


@query
def evaluate_labels(spark, sf):
    """The same measures on the label table: toxic as truth, low quality as prediction."""
    lab = table(spark, sf, "labels")
    d = lab.select((F.col("quality") == 0).alias("flagged"), (F.col("toxic") == 1).alias("malicious"))
    return E.scores(d.agg(*E.confusion()))


QUERIES = {f.__name__: f for f in (
    risk_inputs, risk_score, risk_factors, risk_confidence, risk_level, evidence_gaps, supporting_findings, config_fingerprint,
    risk_staleness, risk_rollup, funnel, factor_points, evaluate_events, scenario_report, false_positive_examples, session_truth,
    evaluate_sessions, session_scenarios, missed_sessions, false_positive_sessions, evaluate_labels)}
NAMES = {"f_behavior": "behavior", "f_anomaly": "anomaly", "f_attack": "attack_indicators", "f_authentication": "authentication",
         "f_sensitive": "sensitive_endpoint", "f_correlation": "correlation", "f_asset": "asset_impact", "f_threat_intel": "threat_intel"}
QUERIES.update({k: _factor(v) for k, v in NAMES.items()})

V = ORACLE_VIEWS
V["rres"] = """
SELECT website_id, incident_id, string_agg(path, '|' ORDER BY path) AS resources, max(CASE WHEN path IN ('/admin', '/api/admin', '/api/account/payment-methods')
  OR path LIKE '/admin/%' OR path LIKE '/api/admin/%' OR path LIKE '/api/account/payment-methods/%' THEN CAST(1.0 AS DOUBLE)
  WHEN path = '/api/account' OR path LIKE '/api/account/%' THEN 0.7 WHEN path IN ('/login', '/api/login') THEN 0.5
  WHEN path = '/api' OR path LIKE '/api/%' THEN 0.4 ELSE 0.2 END) AS asset
FROM (SELECT *, row_number() OVER (PARTITION BY website_id, incident_id ORDER BY path) AS r FROM (
  SELECT DISTINCT website_id, user_id AS incident_id, path FROM ev WHERE event_type IN ('sensitive_endpoint_access', 'waf_alert')) d) x WHERE r <= 5 GROUP BY 1, 2"""
V["rin"] = """
SELECT i.website_id, i.incident_id, i.event_count, i.event_count > 75 AS truncated, f.* EXCLUDE (website_id, incident_id), COALESCE(l.link_count, 0) AS link_count,
  l.mean_strength, s.* EXCLUDE (website_id, incident_id), r.resources, r.asset, t.intel_real, t.intel_synthetic, t.incident_id IS NOT NULL AS intel_run, y.all_synthetic, k.top_confidence
FROM fx_incidents i
LEFT JOIN (SELECT website_id, incident_id, count(*) AS finding_count, count(DISTINCT finding_type) AS kinds,
  max(confidence) FILTER (finding_type = 'behavior_anomaly' AND agent_name <> 'anomaly_model') AS behavior_max, max(anomaly_score) FILTER (finding_type = 'ml_anomaly') AS anomaly_max,
  max(confidence) FILTER (finding_type = 'attack_indicator') AS attack_max, count(DISTINCT category) FILTER (finding_type = 'attack_indicator') AS attack_categories,
  max(CASE category WHEN 'brute_force_indicator' THEN CAST(0.5 AS DOUBLE) WHEN 'multi_account_auth_failures' THEN 0.6 WHEN 'login_success_after_failure_burst' THEN 1.0 ELSE 0.5 END)
    FILTER (finding_type = 'auth_anomaly') AS auth_max FROM fx_findings GROUP BY 1, 2) f USING (website_id, incident_id)
LEFT JOIN (SELECT website_id, incident_id, count(*) AS link_count, avg(strength) AS mean_strength FROM fx_links GROUP BY 1, 2) l USING (website_id, incident_id)
LEFT JOIN (SELECT website_id, incident_id, count(*) FILTER (stage = 'sensitive_access') AS sensitive, count(*) FILTER (stage = 'authentication_success') AS logins,
  count(DISTINCT stage) AS n_stages FROM fx_stages GROUP BY 1, 2) s USING (website_id, incident_id)
LEFT JOIN rres r USING (website_id, incident_id)
LEFT JOIN (SELECT website_id, incident_id, count(*) FILTER (status = 'evidence_found' AND indicator_type <> 'attack_technique' AND NOT synthetic) AS intel_real,
  count(*) FILTER (status = 'evidence_found' AND indicator_type <> 'attack_technique' AND synthetic) AS intel_synthetic FROM fx_intel GROUP BY 1, 2) t USING (website_id, incident_id)
LEFT JOIN (SELECT website_id, user_id AS incident_id, bool_and(source_ip IS NULL) AS all_synthetic FROM ev GROUP BY 1, 2) y USING (website_id, incident_id)
LEFT JOIN (SELECT website_id, incident_id, avg(confidence) AS top_confidence FROM (SELECT *, row_number() OVER (PARTITION BY website_id, incident_id
  ORDER BY confidence DESC, finding_id) AS r FROM fx_findings) q WHERE r <= 3 GROUP BY 1, 2) k USING (website_id, incident_id)"""


def _status(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 'observed' ELSE 'not_observed' END"


_F = {
    "behavior": ("COALESCE(behavior_max, 0)", _status("behavior_max IS NOT NULL")),
    "anomaly": ("CASE WHEN anomaly_max IS NULL THEN 0 ELSE greatest(0, least(1, (anomaly_max - 0.5) / 0.5)) END", _status("anomaly_max IS NOT NULL")),
    "attack_indicators": ("CASE WHEN attack_max IS NULL THEN 0 ELSE greatest(0, least(1, attack_max + CAST(0.1 AS DOUBLE) * (attack_categories - 1))) END", _status("attack_max IS NOT NULL")),
    "authentication": ("COALESCE(auth_max, 0)", _status("auth_max IS NOT NULL")),
    "sensitive_endpoint": ("CASE WHEN sensitive > 0 AND logins > 0 THEN 1.0 WHEN sensitive > 0 THEN 0.7 ELSE 0 END", _status("sensitive > 0")),
    "correlation": ("CAST(0.4 AS DOUBLE) * COALESCE(n_stages, 0) / 6 + CAST(0.3 AS DOUBLE) * least(1, ln(1 + event_count) / ln(101)) + CAST(0.3 AS DOUBLE) * COALESCE(mean_strength, 0)", _status("event_count > 0")),
    "asset_impact": ("COALESCE(asset, 0)", _status("asset IS NOT NULL")),
    "threat_intel": ("CASE WHEN intel_real > 0 THEN least(1, CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE) * (intel_real - 1)) ELSE 0 END",
                     "CASE WHEN NOT intel_run THEN 'not_assessed' WHEN intel_real > 0 THEN 'observed' WHEN intel_synthetic > 0 THEN 'excluded' ELSE 'no_evidence' END"),
}


def _f(name):
    v, s = _F[name]
    return f"SELECT website_id, incident_id, round(CAST({v} AS DOUBLE), 4) AS value, {s} AS status FROM rin"


V["rfac"] = " UNION ALL ".join(f"SELECT website_id, incident_id, '{k}' AS factor, CAST({P.weights[k]} AS DOUBLE) AS weight, value, status FROM ({_f(k)}) x" for k in _F)
V["evl"] = """
SELECT event_id, event_type AS scenario, CASE WHEN status_code >= 400 THEN 'malicious' ELSE 'benign' END AS label, website_id, session_key, us,
  event_id IN (SELECT event_id FROM fx_findings) AS anchor,
  event_id IN (SELECT event_id FROM fx_findings UNION SELECT cited_id FROM fx_cited) AS flagged FROM ev"""


def _scores(src: str) -> str:
    return f"""SELECT *, round(COALESCE(2 * p * r / NULLIF(p + r, 0), 0), 4) AS f1, round(p, 4) AS precision, round(r, 4) AS recall FROM (
  SELECT *, COALESCE(true_positive / NULLIF(true_positive + false_positive, 0), 0) AS p, COALESCE(true_positive / NULLIF(true_positive + false_negative, 0), 0) AS r FROM (
  SELECT count(*) AS evaluated, count(*) FILTER (malicious) AS malicious, count(*) FILTER (NOT malicious) AS benign, count(*) FILTER (flagged AND malicious) AS true_positive,
    count(*) FILTER (flagged AND NOT malicious) AS false_positive, count(*) FILTER (NOT flagged AND malicious) AS false_negative FROM ({src}) a) b) c"""


V["struth"] = """
SELECT website_id, session_key, CASE WHEN bool_or(label = 'malicious') THEN 'malicious' ELSE 'benign' END AS label,
  arg_min(scenario, (label <> 'malicious', us, event_id)) AS scenario FROM evl GROUP BY 1, 2"""
V["sjudged"] = """
SELECT t.website_id, t.session_key, scenario, label = 'malicious' AS malicious, flagged FROM struth t
JOIN (SELECT website_id, session_key, bool_or(event_type = 'waf_alert') AS flagged FROM ev GROUP BY 1, 2) f USING (website_id, session_key)"""
_PARAMS = json.dumps(asdict(P), sort_keys=True, default=str).replace("'", "''")
ORACLES = {
    "risk_inputs": """
SELECT website_id, incident_id, event_count, finding_count, CAST(kinds AS INTEGER) AS kinds, link_count, round(mean_strength, 6) AS mean_strength, sensitive, resources,
  truncated, intel_real, intel_synthetic, all_synthetic FROM rin""",
    **{k: _f(v) for k, v in NAMES.items()},
    "risk_factors": "SELECT * FROM rfac",
    "risk_score": """
SELECT *, CASE WHEN risk_score >= 85 THEN 'CRITICAL' WHEN risk_score >= 65 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM (
  SELECT website_id, incident_id, round(100.0 * sum(weight * value) / sum(weight), 1) AS risk_score FROM rfac GROUP BY 1, 2) x""",
    "risk_confidence": """
SELECT website_id, incident_id, CAST(COALESCE(kinds, 0) + CASE WHEN intel_real > 0 THEN 1 ELSE 0 END AS INTEGER) AS signal_kinds,
  round(greatest(0, CAST(0.4 AS DOUBLE) * least(1, (COALESCE(kinds, 0) + CASE WHEN intel_real > 0 THEN 1 ELSE 0 END) / 4.0) + CAST(0.35 AS DOUBLE) * COALESCE(top_confidence, 0)
    + CAST(0.25 AS DOUBLE) * COALESCE(mean_strength, 0) - CASE WHEN truncated THEN CAST(0.1 AS DOUBLE) ELSE 0 END), 2) AS confidence FROM rin""",
    "risk_level": """
SELECT website_id, incident_id, CASE WHEN risk_score >= 85 THEN 'CRITICAL' WHEN risk_score >= 65 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level
FROM fx_incidents""",
    "evidence_gaps": """
SELECT website_id, incident_id, CAST(row_number() OVER (PARTITION BY website_id, incident_id ORDER BY o) - 1 AS INTEGER) AS position, gap FROM (
  SELECT website_id, incident_id, 1 AS o, CASE WHEN NOT intel_run THEN 'threat_intel_not_run' WHEN intel_real > 0 THEN NULL ELSE 'no_threat_intel_evidence' END AS gap FROM rin
  UNION ALL SELECT website_id, incident_id, 2, CASE WHEN anomaly_max IS NULL THEN 'no_ml_anomaly' END FROM rin
  UNION ALL SELECT website_id, incident_id, 3, 'no_asset_context' FROM rin
  UNION ALL SELECT website_id, incident_id, 4, CASE WHEN truncated THEN 'truncated_evidence' END FROM rin
  UNION ALL SELECT website_id, incident_id, 5, CASE WHEN all_synthetic THEN 'synthetic_data' END FROM rin) x WHERE gap IS NOT NULL""",
    "supporting_findings": """
SELECT website_id, incident_id, finding_id, agent_name, category, rule_id, round(confidence, 4) AS confidence, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY website_id, incident_id ORDER BY confidence DESC, finding_id) AS r FROM fx_findings) x WHERE r <= 10""",
    "config_fingerprint": f"""
SELECT website_id, incident_id, round(100.0 * sum(weight * value) / sum(weight), 1) AS risk_score, left(sha256('{_PARAMS}'), 12) AS config_fingerprint, CAST(count(*) AS INTEGER) AS n_factors
FROM rfac GROUP BY 1, 2""",
    "risk_staleness": """
SELECT website_id, incident_id, created_seq % 2 = 1 OR (created_seq % 3 = 0 AND created_seq % 6 <> 0) AS stale,
  concat_ws(',', CASE WHEN created_seq % 2 = 1 THEN 'events_changed' END, CASE WHEN created_seq % 3 = 0 AND created_seq % 6 <> 0 THEN 'threat_intel_changed' END) AS reasons
FROM fx_incidents""",
    "risk_rollup": """
SELECT website_id, count(*) AS incidents, count(risk_level) AS scored, count(*) FILTER (risk_level = 'CRITICAL') AS critical, count(*) FILTER (risk_level = 'HIGH') AS high,
  count(*) FILTER (risk_level = 'MEDIUM') AS medium, count(*) FILTER (risk_level = 'LOW') AS low, count(*) FILTER (risk_level IN ('HIGH', 'CRITICAL')) AS high_risk
FROM fx_incidents GROUP BY 1""",
    "funnel": """
SELECT website_id, 1 AS step, 'events' AS stage, count(*) AS n FROM ev GROUP BY 1
UNION ALL SELECT website_id, 2, 'events_with_findings', count(DISTINCT event_id) FROM fx_findings GROUP BY 1
UNION ALL SELECT website_id, 3, 'incidents', count(*) FROM fx_incidents GROUP BY 1
UNION ALL SELECT website_id, 4, 'high_risk_incidents', count(*) FROM fx_incidents WHERE risk_level IN ('HIGH', 'CRITICAL') GROUP BY 1""",
    "factor_points": "SELECT website_id, incident_id, " + ", ".join(
        f"max(round(100.0 * weight * value / 100.0, 2)) FILTER (factor = '{k}') AS {k}" for k in _F) + " FROM rfac GROUP BY 1, 2",
    "evaluate_events": "SELECT * EXCLUDE (p, r) FROM (" + _scores("SELECT flagged, label = 'malicious' AS malicious FROM evl") + ") z",
    "scenario_report": """
SELECT scenario, count(*) AS events, count(*) FILTER (flagged) AS flagged, bool_or(anchor) AS has_finding FROM evl GROUP BY 1""",
    "false_positive_examples": """
SELECT CAST(e.event_id AS VARCHAR) AS event_id, COALESCE(rule_id, '') AS rules FROM evl e LEFT JOIN fx_findings f ON f.event_id = e.event_id
WHERE label = 'benign' AND flagged ORDER BY CAST(e.event_id AS VARCHAR) LIMIT 5""",
    "session_truth": "SELECT * FROM struth",
    "evaluate_sessions": "SELECT * EXCLUDE (p, r) FROM (" + _scores("SELECT malicious, flagged FROM sjudged") + """) z,
  (SELECT count(*) AS sessions_evaluated, count(*) FILTER (malicious) AS malicious_sessions, count(*) FILTER (NOT malicious) AS benign_sessions FROM sjudged) c""",
    "session_scenarios": "SELECT scenario, count(*) AS sessions, count(*) FILTER (flagged) AS flagged FROM sjudged WHERE malicious GROUP BY 1",
    "missed_sessions": "SELECT website_id, session_key, scenario FROM sjudged WHERE malicious AND NOT flagged",
    "false_positive_sessions": """
SELECT website_id, session_key, scenario FROM struth WHERE label <> 'malicious'
  AND (website_id, session_key) IN (SELECT (website_id, session_key) FROM ev WHERE event_type = 'session_created') ORDER BY session_key, website_id LIMIT 5""",
    "evaluate_labels": "SELECT * EXCLUDE (p, r) FROM (" + _scores("SELECT quality = 0 AS flagged, toxic = 1 AS malicious FROM labels") + ") z",
}
