"""Enrichment and the query surface."""

from pyspark.sql import functions as F

from tidewatch.operators import enrich as E
from tidewatch.operators import risk as R
from tidewatch.operators import views as Q
from tidewatch.params import Enrichment
from tidewatch.plans.catalog import risk as RC
from tidewatch.plans.catalog import timeline as TC
from tidewatch.plans.catalog.base import ORACLE_VIEWS, events, fx, joined, query, stored

PE = Enrichment(max_per_incident=2, context_ids=3)
def address():
    return F.concat_ws(".", (F.length("user_id") * 50 + F.col("event_id") % 40).cast("string"), F.lit("0.113"), (F.col("event_id") % 4).cast("string"))


def incident_events(spark, sf):
    """Adapter events with an incident and a varied address."""
    return events(spark, sf).withColumn("incident_id", F.col("user_id")).withColumn("source_ip", F.when(F.col("event_type") == "waf_alert", address()))


def indicators(spark, sf):
    return stored(spark, sf, "indicators", lambda: E.extract_indicators(incident_events(spark, sf), fx(spark, sf, "fx_findings"), PE))


def feed(spark, sf):
    """Reputation feed derived from the addresses: every second value of the last octet is listed."""
    ips = indicators(spark, sf).where(F.col("indicator_type") == "ip").select("indicator").distinct()
    last = F.element_at(F.split("indicator", r"\."), -1).cast("int")
    return ips.select("indicator", (last % 2 * 7).cast("bigint").alias("pulse_count"), F.array(F.lit("list a"), F.lit("list b")).alias("names"),
                      (last == 3).alias("synthetic"))


def found(spark, sf):
    hits = feed(spark, sf).where("pulse_count > 0").select(F.lit("ip").alias("indicator_type"), "indicator", "synthetic")
    tech = E.technique_table(spark).select(F.lit("attack_technique").alias("indicator_type"), F.col("technique_id").alias("indicator"), F.lit(False).alias("synthetic"))
    return hits.unionByName(tech)


def results(spark, sf):
    return stored(spark, sf, "intel_results", lambda: E.lookup_status(E.cap_indicators(indicators(spark, sf), PE.max_per_incident)[0],
                                                                       found(spark, sf)))


@query
def extract_indicators(spark, sf):
    return E.extract_indicators(incident_events(spark, sf), fx(spark, sf, "fx_findings"), PE).select(*E.KEY, joined("source_ids").alias("source_ids"))


@query
def cap_indicators(spark, sf):
    return E.cap_indicators(indicators(spark, sf), PE.max_per_incident)[0].select(*E.KEY)


@query
def dropped_indicators(spark, sf):
    return E.cap_indicators(indicators(spark, sf), PE.max_per_incident)[1]


@query
def enrich_technique(spark, sf):
    return E.enrich_technique(indicators(spark, sf), E.technique_table(spark)).select(*E.KEY, "status", "name", joined("tactics", "|").alias("tactics"))


@query
def enrich_reputation(spark, sf):
    return E.enrich_reputation(indicators(spark, sf), feed(spark, sf)).select(*E.KEY, "status", "pulse_count", joined("example_names").alias("names"), "synthetic")


@query
def enrich_cve(spark, sf):
    ids = indicators(spark, sf).where(F.col("indicator_type") == "cve").select("indicator").distinct()
    doc = ids.select(F.concat(F.lit('{"vulnerabilities":[{"cve":{"id":"'), "indicator", F.lit(
        '","published":"2021-12-10","descriptions":[{"lang":"es","value":"x"},{"lang":"en","value":"Remote lookup"}],"metrics":{"cvssMetricV31":'
        '[{"cvssData":{"baseScore":10.0,"baseSeverity":"CRITICAL"}}],"cvssMetricV2":[{"cvssData":{"baseScore":9.3},"baseSeverity":"HIGH"}]},'
        '"weaknesses":[{"description":[{"value":"CWE-502"},{"value":"CWE-20"},{"value":"NVD-other"}]}]}}]}')).alias("value"))
    d = E.enrich_cve(indicators(spark, sf), E.parse_cve_feed(doc))
    return d.select(*E.KEY, "status", "description", F.col("cvss.version").alias("version"), F.col("cvss.base_score").alias("score"),
                    joined("weaknesses").alias("weaknesses"))


@query
def lookup_status(spark, sf):
    return E.lookup_status(indicators(spark, sf), found(spark, sf))


@query
def enrichment_report(spark, sf):
    dropped = E.cap_indicators(indicators(spark, sf), PE.max_per_incident)[1]
    return E.enrichment_report(fx(spark, sf, "fx_incidents"), results(spark, sf), dropped).select(
        *E.INCIDENT, "indicators_checked", "evidence_found", "no_evidence", "not_configured", "not_applicable", "contains_synthetic", "dropped", "status")


@query
def enrichment_rollup(spark, sf):
    reports = E.enrichment_report(fx(spark, sf, "fx_incidents"), results(spark, sf)).select(*E.INCIDENT, "status", "evidence_found")
    return E.enrichment_rollup(fx(spark, sf, "fx_incidents"), reports, 20, "created_seq")


# ------------------------------------------------------------------------------------------------ lists
def alerts(spark, sf):
    i = fx(spark, sf, "fx_incidents").where(F.col("risk_level").isin("HIGH", "CRITICAL"))
    return i.select(*Q.INCIDENT, F.when(F.col("risk_level") == "CRITICAL", "P1").otherwise("P2").alias("priority"), "risk_score",
                    F.when(F.col("created_seq") % 2 == 0, "open").otherwise("closed").alias("status"))


def cited(spark, sf):
    from tidewatch.plans.catalog.correlate import findings
    return findings(spark, sf)


def citations(spark, sf):
    from tidewatch.plans.catalog.correlate import cited as by_reference
    return by_reference(spark, sf)


@query
def list_events(spark, sf):
    return Q.list_events(events(spark, sf), "web_a", event_type="waf_alert", limit=20, offset=5).select("event_id", "ts_us", "session_id", "endpoint")


@query
def ingest_status(spark, sf):
    sites = events(spark, sf).select("website_id").distinct().unionByName(
        events(spark, sf).select(F.concat("website_id", F.lit("_new")).alias("website_id")).distinct())
    return Q.ingest_status(sites, events(spark, sf), "ts_us")


@query
def list_findings(spark, sf):
    return Q.list_findings(fx(spark, sf, "fx_findings"), events(spark, sf), "web_b", "auth_anomaly", min_confidence=0.6, limit=50, offset=10).select(
        "finding_id", "event_id", "ts_us", "confidence")


@query
def list_anomalies(spark, sf):
    return Q.list_anomalies(fx(spark, sf, "fx_findings"), events(spark, sf), "web_a", 0.5, 40, 4).select("finding_id", "ts_us", "confidence")


@query
def list_incidents(spark, sf):
    return Q.list_incidents(fx(spark, sf, "fx_incidents"), "web_a", sort="risk", created="created_seq").select("incident_id", "risk_score", "risk_level", "created_seq")


@query
def count_findings(spark, sf):
    return Q.count_findings(fx(spark, sf, "fx_findings"), events(spark, sf))


@query
def suspicious_event_count(spark, sf):
    return Q.suspicious_event_count(fx(spark, sf, "fx_findings"), citations(spark, sf))


@query
def kpis(spark, sf):
    return Q.kpis(events(spark, sf), fx(spark, sf, "fx_findings"), fx(spark, sf, "fx_incidents"), alerts(spark, sf), citations(spark, sf))


@query
def funnel_rows(spark, sf):
    return Q.funnel_rows(Q.kpis(events(spark, sf), fx(spark, sf, "fx_findings"), fx(spark, sf, "fx_incidents"), alerts(spark, sf), citations(spark, sf)))


@query
def incident_cards(spark, sf):
    return Q.incident_cards(fx(spark, sf, "fx_incidents"), alerts(spark, sf)).select(*Q.INCIDENT, "title", "risk_level", "risk_score", "status", "priority", "has_alert")


@query
def factor_rows(spark, sf):
    return Q.factor_rows(R.risk_factors(RC.inputs(spark, sf))).select(*Q.INCIDENT, "factor", "points", "status")


@query
def gap_rows(spark, sf):
    missing = fx(spark, sf, "fx_incidents").select(*Q.INCIDENT, F.concat(F.lit("no logs of "), "incident_id").alias("description"),
                                                   F.when(F.col("created_seq") % 2 == 0, "scope").otherwise("").alias("why_it_matters"))
    return Q.gap_rows(R.evidence_gaps(RC.inputs(spark, sf)), missing)


@query
def timeline_rows(spark, sf):
    from tidewatch.operators import timeline as T
    t = T.timeline(TC.incident_events(spark, sf), cited(spark, sf), None, TC.P)
    return Q.timeline_rows(t).select(*Q.INCIDENT, "entry_id", "evidence_label", "event_ids_short")


@query
def indicator_rows(spark, sf):
    return Q.indicator_rows(fx(spark, sf, "fx_intel"))


@query
def history_rows(spark, sf):
    return Q.history_rows(fx(spark, sf, "fx_transitions"), ["incident_id"], limit=3).select("incident_id", "seq", "new_state", "actor", "position")


@query
def next_states(spark, sf):
    return Q.next_states(fx(spark, sf, "fx_incidents"))


@query
def investigation_view(spark, sf):
    c = fx(spark, sf, "fx_claims").groupBy(F.lit("web_a").alias("website_id"), "incident_id").agg(F.sort_array(F.collect_list("claim")).alias("claims"))
    inv = c.withColumn("status", F.when(F.col("incident_id") % 5 == 0, "not_run").otherwise("ok")).withColumn("facts", F.array(F.size("claims").cast("string"))).withColumn(
        "hypothesis", F.when(F.col("incident_id") % 2 == 0, F.get("claims", F.lit(0)))).withColumn("missing", F.array().cast("array<string>"))
    return Q.investigation_view(inv)


QUERIES = {f.__name__: f for f in (
    extract_indicators, cap_indicators, dropped_indicators, enrich_technique, enrich_reputation, enrich_cve, lookup_status, enrichment_report,
    enrichment_rollup, list_events, ingest_status, list_findings, list_anomalies, list_incidents, count_findings, suspicious_event_count, kpis,
    funnel_rows, incident_cards, factor_rows, gap_rows, timeline_rows, indicator_rows, history_rows, next_states, investigation_view)}

V = ORACLE_VIEWS
V["iev"] = """
SELECT website_id, user_id AS incident_id, event_id, us, endpoint, CASE WHEN event_type = 'waf_alert' THEN
  concat(length(user_id) * 50 + event_id % 40, '.0.113.', event_id % 4) END AS ip FROM ev"""
V["ind"] = """
SELECT DISTINCT website_id, incident_id, 'ip' AS indicator_type, ip AS indicator, '' AS source_ids FROM iev WHERE ip IS NOT NULL
UNION ALL SELECT website_id, incident_id, 'cve', 'CVE-2021-44228', array_to_string(list_slice(list(event_id ORDER BY us, CAST(event_id AS VARCHAR)), 1, 3), ',')
FROM iev WHERE contains(endpoint, 'CVE-2021-44228') GROUP BY 1, 2
UNION ALL SELECT website_id, incident_id, 'attack_technique', technique_id, array_to_string(list_slice(list(finding_id ORDER BY finding_id), 1, 3), ',')
FROM fx_findings WHERE technique_id IS NOT NULL GROUP BY 1, 2, 4"""
V["indr"] = "SELECT *, row_number() OVER (PARTITION BY website_id, incident_id, indicator_type ORDER BY indicator) AS r FROM ind"
V["indk"] = "SELECT * FROM indr WHERE r <= 2 OR indicator_type = 'attack_technique'"
V["indd"] = """
SELECT website_id, incident_id, indicator_type, count(*) - 2 AS dropped FROM ind WHERE indicator_type <> 'attack_technique' GROUP BY 1, 2, 3 HAVING count(*) > 2"""
_LAST = "TRY_CAST(split_part(indicator, '.', 4) AS INT)"


def _lookup(src: str) -> str:
    return f"""SELECT website_id, incident_id, indicator_type, indicator, status, COALESCE(status = 'evidence_found' AND indicator_type = 'ip' AND {_LAST} = 3, FALSE) AS synthetic FROM (
  SELECT *, CASE WHEN indicator_type = 'ip' AND starts_with(indicator, '100.') THEN 'not_a' WHEN indicator_type = 'attack_technique' THEN 'evidence_found'
    WHEN indicator_type = 'cve' THEN 'no_evidence' WHEN {_LAST} % 2 = 1 THEN 'evidence_found' ELSE 'no_evidence' END AS s0,
    CASE WHEN indicator_type = 'attack_technique' THEN 'evidence_found' WHEN indicator_type = 'cve' THEN 'no_evidence'
      WHEN TRY_CAST(split_part(indicator, '.', 1) AS INT) IN (10, 127) OR TRY_CAST(split_part(indicator, '.', 1) AS INT) >= 240 THEN 'not_applicable'
      WHEN {_LAST} % 2 = 1 THEN 'evidence_found' ELSE 'no_evidence' END AS status FROM {src}) x"""


V["alr"] = """
SELECT website_id, incident_id, CASE risk_level WHEN 'CRITICAL' THEN 'P1' ELSE 'P2' END AS priority, risk_score,
  CASE WHEN created_seq % 2 = 0 THEN 'open' ELSE 'closed' END AS status FROM fx_incidents WHERE risk_level IN ('HIGH', 'CRITICAL')"""
V["figs"] = """
SELECT e.website_id, e.total_events, s.suspicious_events, i.active_incidents, i.high_risk_incidents, a.open_alerts FROM
  (SELECT website_id, count(*) AS total_events FROM ev GROUP BY 1) e JOIN (SELECT website_id, count(DISTINCT cited_id) AS suspicious_events FROM fx_cited GROUP BY 1) s USING (website_id)
  JOIN (SELECT website_id, count(*) FILTER (status NOT IN ('RESOLVED', 'FALSE_POSITIVE')) AS active_incidents,
    count(*) FILTER (status NOT IN ('RESOLVED', 'FALSE_POSITIVE') AND risk_level IN ('HIGH', 'CRITICAL')) AS high_risk_incidents FROM fx_incidents GROUP BY 1) i USING (website_id)
  JOIN (SELECT website_id, count(*) FILTER (status = 'open') AS open_alerts FROM alr GROUP BY 1) a USING (website_id)"""
_NEXT = """(VALUES ('DETECTED', ['INVESTIGATING', 'CONFIRMED', 'FALSE_POSITIVE', 'NEEDS_INVESTIGATION']), ('INVESTIGATING', ['CONFIRMED', 'FALSE_POSITIVE', 'NEEDS_INVESTIGATION']),
  ('NEEDS_INVESTIGATION', ['INVESTIGATING', 'CONFIRMED', 'FALSE_POSITIVE']), ('CONFIRMED', ['RESPONSE_RECOMMENDED', 'FALSE_POSITIVE', 'NEEDS_INVESTIGATION']),
  ('FALSE_POSITIVE', ['RESOLVED', 'CONFIRMED', 'NEEDS_INVESTIGATION']), ('RESPONSE_RECOMMENDED', ['ACTION_TAKEN', 'RESOLVED', 'NEEDS_INVESTIGATION']),
  ('ACTION_TAKEN', ['RESOLVED']), ('RESOLVED', ['INVESTIGATING'])) t(status, nxt)"""
_K = "website_id, incident_id, indicator_type, indicator"
ORACLES = {
    "extract_indicators": "SELECT * FROM ind",
    "cap_indicators": f"SELECT {_K} FROM indk",
    "dropped_indicators": "SELECT * FROM indd",
    "enrich_technique": f"""
SELECT {_K}, 'evidence_found' AS status, CASE indicator WHEN 'T1110' THEN 'Brute Force' WHEN 'T1078' THEN 'Valid Accounts' ELSE 'Exploit Public-Facing Application' END AS name,
  CASE indicator WHEN 'T1110' THEN 'Credential Access' WHEN 'T1078' THEN 'Defense Evasion|Persistence|Privilege Escalation|Initial Access' ELSE 'Initial Access' END AS tactics
FROM ind WHERE indicator_type = 'attack_technique'""",
    "enrich_reputation": f"""
SELECT {_K}, CASE WHEN {_LAST} % 2 = 1 THEN 'evidence_found' ELSE 'no_evidence' END AS status, CAST({_LAST} % 2 * 7 AS BIGINT) AS pulse_count, 'list a,list b' AS names,
  {_LAST} = 3 AS synthetic FROM ind WHERE indicator_type = 'ip'""",
    "enrich_cve": f"""
SELECT {_K}, 'evidence_found' AS status, 'Remote lookup' AS description, '3.1' AS version, CAST(10.0 AS DOUBLE) AS score, 'CWE-20,CWE-502' AS weaknesses
FROM ind WHERE indicator_type = 'cve'""",
    "lookup_status": _lookup("ind"),
    "enrichment_report": f"""
SELECT i.website_id, i.incident_id, count(r.status) AS indicators_checked, count(*) FILTER (r.status = 'evidence_found') AS evidence_found,
  count(*) FILTER (r.status = 'no_evidence') AS no_evidence, count(*) FILTER (r.status = 'not_configured') AS not_configured,
  count(*) FILTER (r.status = 'not_applicable') AS not_applicable, COALESCE(bool_or(r.synthetic), FALSE) AS contains_synthetic,
  CAST(COALESCE(any_value(d.dropped), 0) AS BIGINT) AS dropped, CASE WHEN count(r.status) = 0 THEN 'no_indicators' ELSE 'ok' END AS status
FROM fx_incidents i LEFT JOIN ({_lookup('indk')}) r USING (website_id, incident_id)
LEFT JOIN (SELECT website_id, incident_id, sum(dropped) AS dropped FROM indd GROUP BY 1, 2) d USING (website_id, incident_id) GROUP BY 1, 2""",
    "enrichment_rollup": f"""
SELECT i.website_id, i.incident_id, CAST(position AS INTEGER) AS position, CASE WHEN count(r.status) = 0 THEN 'no_indicators' ELSE 'ok' END AS status,
  count(*) FILTER (r.status = 'evidence_found') AS evidence_found FROM (SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY created_seq DESC, incident_id) AS position
  FROM fx_incidents) i LEFT JOIN ({_lookup('indk')}) r USING (website_id, incident_id) WHERE position <= 20 GROUP BY 1, 2, 3""",
    "list_events": """
SELECT event_id, us AS ts_us, session_id, endpoint FROM ev WHERE website_id = 'web_a' AND event_type = 'waf_alert' ORDER BY us DESC, event_id LIMIT 20 OFFSET 5""",
    "ingest_status": """
SELECT website_id, count(*) AS events_received, max(us) AS last_received, 'active' AS status FROM ev GROUP BY 1
UNION ALL SELECT DISTINCT concat(website_id, '_new'), 0, CAST(NULL AS BIGINT), 'waiting_for_telemetry' FROM ev""",
    "list_findings": """
SELECT finding_id, f.event_id, us AS ts_us, confidence FROM fx_findings f JOIN ev e ON e.event_id = f.event_id WHERE f.website_id = 'web_b' AND finding_type = 'auth_anomaly'
  AND confidence >= 0.6 ORDER BY us DESC, finding_id LIMIT 50 OFFSET 10""",
    "list_anomalies": """
SELECT finding_id, us AS ts_us, confidence FROM fx_findings f JOIN ev e ON e.event_id = f.event_id WHERE f.website_id = 'web_a' AND agent_name = 'anomaly_model'
  AND confidence >= 0.5 ORDER BY confidence DESC, finding_id LIMIT 40 OFFSET 4""",
    "list_incidents": "SELECT incident_id, risk_score, risk_level, created_seq FROM fx_incidents WHERE website_id = 'web_a'",
    "count_findings": "SELECT website_id, count(*) AS findings FROM fx_findings GROUP BY 1",
    "suspicious_event_count": "SELECT website_id, count(DISTINCT cited_id) AS suspicious_events FROM fx_cited GROUP BY 1",
    "kpis": "SELECT * FROM figs",
    "funnel_rows": """
SELECT website_id, 1 AS step, 'Events ingested' AS stage, total_events AS count FROM figs UNION ALL SELECT website_id, 2, 'Suspicious events', suspicious_events FROM figs
UNION ALL SELECT website_id, 3, 'Incidents', active_incidents FROM figs UNION ALL SELECT website_id, 4, 'High-risk incidents', high_risk_incidents FROM figs""",
    "incident_cards": """
SELECT i.website_id, i.incident_id, title, COALESCE(risk_level, 'NOT SCORED') AS risk_level, i.risk_score, i.status, priority, priority IS NOT NULL AS has_alert
FROM fx_incidents i LEFT JOIN alr a USING (website_id, incident_id)""",
    "factor_rows": "SELECT website_id, incident_id, factor, round(100.0 * weight * value / 100.0, 2) AS points, status FROM rfac",
    "gap_rows": f"""
SELECT website_id, incident_id, 'deterministic' AS source, 'missing_evidence' AS evidence_type, gap AS text FROM ({RC.ORACLES['evidence_gaps']}) g
UNION ALL SELECT website_id, incident_id, 'ai_agent', 'missing_evidence', concat('no logs of ', incident_id, CASE WHEN created_seq % 2 = 0 THEN ' Why it matters: scope' ELSE '' END) FROM fx_incidents""",
    "timeline_rows": """
SELECT website_id, incident_id, concat('tl_', CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END) AS entry_id,
  CASE evidence_type WHEN 'observed' THEN 'Observed fact' ELSE 'Derived indicator' END AS evidence_label, replace(event_ids, ',', ', ') AS event_ids_short FROM tl1""",
    "indicator_rows": """
SELECT *, count(*) FILTER (status = 'evidence_found') OVER (PARTITION BY website_id, incident_id) AS evidence_count,
  bool_or(synthetic) OVER (PARTITION BY website_id, incident_id) AS has_synthetic FROM fx_intel""",
    "history_rows": """
SELECT incident_id, seq, new_state, actor, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY seq DESC) AS position
  FROM fx_transitions) x WHERE position <= 3""",
    "next_states": f"""
SELECT website_id, incident_id, next_state, next_state NOT IN ('CONFIRMED', 'FALSE_POSITIVE', 'NEEDS_INVESTIGATION') AS step_option FROM (
  SELECT website_id, incident_id, unnest(nxt) AS next_state FROM fx_incidents i JOIN {_NEXT} ON t.status = i.status) x""",
}
