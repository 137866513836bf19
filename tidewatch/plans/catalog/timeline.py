"""Timeline and attack graph; incidents are users of the adapter events."""

from pyspark.sql import functions as F

from tidewatch.operators import timeline as T
from tidewatch.params import Correlation
from tidewatch.plans.catalog.base import ORACLE_VIEWS, events, fx, joined, query, stored
from tidewatch.plans.catalog.correlate import findings as cited_findings

P = Correlation(group_gap_s=12 * 3600, entry_ids=2)


def incident_events(spark, sf):
    return events(spark, sf).select("website_id", F.col("user_id").alias("incident_id"), "event_id", "ts_us", "event_type", "session_id",
                                    "source_ip", "user_id", F.col("features.path").alias("path"), "status_code")


def rows(spark, sf):
    return stored(spark, sf, "group_rows", lambda: T.grouped(incident_events(spark, sf), P))


def groups(spark, sf):
    return stored(spark, sf, "groups", lambda: T.group_table(rows(spark, sf)))


def incidents(spark, sf):
    return fx(spark, sf, "fx_incidents").withColumn("created_us", F.col("created_seq")).withColumn("indicators_checked", F.col("created_seq") % 3).withColumn(
        "enriched_us", F.when(F.col("created_seq") % 2 == 0, F.col("created_seq") + 1))


def nodes(spark, sf):
    return stored(spark, sf, "nodes", lambda: T.graph_nodes(
        incident_events(spark, sf), groups(spark, sf), rows(spark, sf), incidents(spark, sf), cited_findings(spark, sf), P))


def edges(spark, sf):
    return stored(spark, sf, "edges", lambda: T.graph_edges(
        incident_events(spark, sf), groups(spark, sf), rows(spark, sf), fx(spark, sf, "fx_links"), cited_findings(spark, sf)))


@query
def group_label(spark, sf):
    return groups(spark, sf).select(*T.INCIDENT, "group_no", "group_event", "n", "label")


@query
def timeline(spark, sf):
    t = T.timeline(incident_events(spark, sf), cited_findings(spark, sf), incidents(spark, sf), P)
    return t.select(*T.INCIDENT, "entry_id", "evidence_type", "ts_us", "label", "event_count", joined("event_ids").alias("event_ids"))


@query
def graph_nodes(spark, sf):
    n = T.graph_nodes(incident_events(spark, sf), groups(spark, sf), rows(spark, sf), incidents(spark, sf), cited_findings(spark, sf), P)
    return n.select(*T.INCIDENT, "node_id", "node_type", "label", "event_count", "layer", "finding_count", joined("event_ids").alias("event_ids"))


@query
def graph_edges(spark, sf):
    return edges(spark, sf).select(*T.INCIDENT, "edge_id", "source", "target", "relationship", "correlation_type", "strength", "evidence_type", "event_count")


@query
def best_relationship(spark, sf):
    return T.best_relationship(groups(spark, sf), rows(spark, sf), fx(spark, sf, "fx_links"))


@query
def group_stages(spark, sf):
    return T.group_stages(rows(spark, sf), fx(spark, sf, "fx_stages")).select(*T.GROUP, joined("stages").alias("stages"))


@query
def graph_layout(spark, sf):
    placed, _ = T.graph_layout(nodes(spark, sf), edges(spark, sf))
    return placed.select(*T.INCIDENT, "node_id", "x", "y")


@query
def graph_layout_edges(spark, sf):
    known = nodes(spark, sf).where(F.col("node_type") != "source_ip")
    _, kept = T.graph_layout(known, edges(spark, sf))
    return kept.select(*T.INCIDENT, "edge_id", "source", "target")


@query
def graph_summary(spark, sf):
    s = T.graph_summary(nodes(spark, sf), edges(spark, sf))
    return s.withColumn("layered_path", joined("layered_path", "|"))


QUERIES = {f.__name__: f for f in (group_label, timeline, graph_nodes, graph_edges, best_relationship, group_stages, graph_layout,
                                   graph_layout_edges, graph_summary)}

V = ORACLE_VIEWS
V["ie"] = "SELECT *, user_id AS incident_id FROM ev"
V["grow"] = """
SELECT *, first_value(event_id) OVER (PARTITION BY website_id, incident_id, group_no ORDER BY us, event_id) AS group_event FROM (
SELECT *, sum(CASE WHEN us - p <= 43200000000 AND event_type = pt AND session_id IS NOT DISTINCT FROM ps AND source_ip IS NOT DISTINCT FROM pi
  THEN 0 ELSE 1 END) OVER (PARTITION BY website_id, incident_id ORDER BY us, event_id) AS group_no
FROM (SELECT *, lag(us) OVER w AS p, lag(event_type) OVER w AS pt, lag(session_id) OVER w AS ps, lag(source_ip) OVER w AS pi
  FROM ie WINDOW w AS (PARTITION BY website_id, incident_id ORDER BY us, event_id)) x) y"""
V["gtab"] = """
SELECT *, CASE event_type WHEN 'login_failure' THEN concat(n, CASE n WHEN 1 THEN ' failed login attempt' ELSE ' failed login attempts' END, ' in ', span, ', 1 distinct account')
  WHEN 'login_success' THEN concat('Successful login for account ', incident_id, times) WHEN 'session_created' THEN concat('New session created', times)
  WHEN 'page_view' THEN concat(n, CASE n WHEN 1 THEN ' page view' ELSE ' page views' END, ' in ', span)
  WHEN 'interaction' THEN concat(n, CASE n WHEN 1 THEN ' interaction summary event' ELSE ' interaction summary events' END)
  ELSE concat(CASE WHEN n > 1 THEN concat(n, ' × ') ELSE '' END, CASE event_type WHEN 'sensitive_endpoint_access' THEN 'Sensitive endpoint accessed'
    WHEN 'api_access' THEN 'API access' WHEN 'http_request' THEN 'HTTP request' ELSE 'WAF alert reported' END, ': ', path,
    CASE WHEN event_type IN ('http_request', 'api_access') THEN concat(' (status ', status_code, ')') ELSE '' END) END AS label FROM (
  SELECT *, CASE WHEN sec >= 1 THEN printf('%.0f s', sec) ELSE '<1 s' END AS span, CASE WHEN n > 1 THEN concat(' (x', n, ')') ELSE '' END AS times FROM (
    SELECT website_id, incident_id, CAST(group_no AS BIGINT) AS group_no, group_event, event_type, session_id, source_ip, count(*) AS n, min(us) AS g_us, (max(us) - min(us)) / 1e6 AS sec,
      arg_min(path, (us, event_id)) AS path, arg_min(status_code, (us, event_id)) AS status_code,
      array_to_string(list_slice(list(event_id ORDER BY us, event_id), 1, 2), ',') AS event_ids FROM grow GROUP BY 1, 2, 3, 4, 5, 6, 7) x) y"""
V["cin"] = """
SELECT c.website_id, c.incident_id, c.finding_id, c.cited_id AS event_id, e.us, c.cited_id <> f.event_id AS later, f.rule_id, f.title, f.event_id AS anchor
FROM fx_cited c JOIN fx_findings f USING (finding_id) JOIN ev e ON e.event_id = c.cited_id"""
V["tl0"] = """
SELECT website_id, incident_id, 'observed' AS evidence_type, g_us AS ts_us, label, 0 AS o, '' AS finding_id, n AS event_count, event_ids FROM gtab
UNION ALL SELECT website_id, incident_id, 'derived_indicator', min(us) FILTER (NOT later), concat('Detection ', rule_id, ': ', title), 1, finding_id, count(*),
  string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY later, event_id) FROM cin GROUP BY website_id, incident_id, finding_id, rule_id, title"""
V["tl1"] = "SELECT *, row_number() OVER (PARTITION BY website_id, incident_id ORDER BY ts_us, o, finding_id, label) AS no FROM tl0"
V["gf"] = "SELECT g.website_id, g.incident_id, g.group_event, count(DISTINCT finding_id) AS finding_count FROM cin c JOIN grow g ON g.event_id = c.event_id GROUP BY 1, 2, 3"
V["nod"] = """
SELECT website_id, incident_id, concat('ip:', source_ip) AS node_id, 'source_ip' AS node_type, source_ip AS label, count(*) AS event_count, CAST(0 AS BIGINT) AS layer,
  CAST(0 AS BIGINT) AS finding_count, array_to_string(list_slice(list(event_id ORDER BY us, event_id), 1, 2), ',') AS event_ids FROM ie WHERE source_ip IS NOT NULL GROUP BY 1, 2, source_ip
UNION ALL SELECT website_id, incident_id, concat('sess:', session_id), 'session', session_id, count(*), 1, 0,
  array_to_string(list_slice(list(event_id ORDER BY us, event_id), 1, 2), ',') FROM ie WHERE session_id IS NOT NULL GROUP BY 1, 2, session_id
UNION ALL SELECT website_id, incident_id, concat('g', CASE WHEN group_no < 1000 THEN lpad(CAST(group_no AS VARCHAR), 3, '0') ELSE CAST(group_no AS VARCHAR) END), 'event_group', label, n, group_no + 1,
  COALESCE(finding_count, 0), event_ids FROM gtab LEFT JOIN gf USING (website_id, incident_id, group_event)
UNION ALL SELECT website_id, incident_id, concat('inc:', incident_id), 'incident', concat('Incident of ', incident_id), count(*), CAST(max(group_no) + 2 AS BIGINT), 0,
  array_to_string(list_slice(list(event_id ORDER BY us, event_id), 1, 2), ',') FROM grow GROUP BY 1, 2"""
V["rnk"] = """
SELECT *, row_number() OVER (PARTITION BY website_id, incident_id, group_no ORDER BY us, event_id) AS h,
  row_number() OVER (PARTITION BY website_id, incident_id, group_no ORDER BY us DESC, event_id DESC) AS t FROM grow"""
V["brel"] = """
SELECT a.website_id, a.incident_id, CAST(a.group_no AS BIGINT) AS group_no, arg_min(relationship_type, (pr, -strength)) AS relationship_type, arg_min(strength, (pr, -strength)) AS strength FROM (
  SELECT *, list_position(['attack_sequence', 'same_session', 'same_user', 'same_ip', 'same_endpoint', 'similar_behavior'], relationship_type) AS pr FROM fx_links) l
JOIN rnk a ON a.event_id = l.event_id AND a.t <= 25 JOIN rnk b ON b.event_id = l.related_event_id AND b.h <= 25 AND b.group_no = a.group_no + 1 GROUP BY 1, 2, 3"""


def _g(no: str) -> str:
    return f"concat('g', CASE WHEN {no} < 1000 THEN lpad(CAST({no} AS VARCHAR), 3, '0') ELSE CAST({no} AS VARCHAR) END)"


V["edg0"] = f"""
SELECT website_id, incident_id, 0 AS ph, min(us) AS pos, concat('ip:', source_ip) AS source, concat('sess:', session_id) AS target, 'used_session' AS relationship,
  CAST(NULL AS VARCHAR) AS correlation_type, CAST(NULL AS DOUBLE) AS strength, 'observed' AS evidence_type, count(*) AS event_count
FROM ie WHERE source_ip IS NOT NULL AND session_id IS NOT NULL GROUP BY website_id, incident_id, source_ip, session_id
UNION ALL SELECT website_id, incident_id, 1, min(group_no), who, {_g('min(group_no)')}, 'began_with', NULL, NULL, 'observed', arg_min(n, group_no)
FROM (SELECT *, CASE WHEN session_id IS NOT NULL THEN concat('sess:', session_id) WHEN source_ip IS NOT NULL THEN concat('ip:', source_ip) END AS who FROM gtab) q
WHERE who IS NOT NULL GROUP BY website_id, incident_id, who
UNION ALL SELECT a.website_id, a.incident_id, 2, a.group_no, {_g('a.group_no')}, {_g('b.group_no')}, 'followed_by', COALESCE(r.relationship_type, 'temporal'), r.strength,
  CASE WHEN r.relationship_type IS NULL THEN 'observed' ELSE 'derived_correlation' END, 2
FROM gtab a JOIN gtab b ON b.website_id = a.website_id AND b.incident_id = a.incident_id AND b.group_no = a.group_no + 1
LEFT JOIN brel r ON r.website_id = a.website_id AND r.incident_id = a.incident_id AND r.group_no = a.group_no
UNION ALL SELECT website_id, incident_id, 3, group_no, {_g('group_no')}, concat('inc:', incident_id), 'evidence_for', NULL, NULL, 'derived_indicator', n
FROM gtab WHERE (website_id, incident_id, group_event) IN (SELECT (website_id, incident_id, group_event) FROM gf)"""
V["edg"] = """
SELECT *, concat('e', CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END) AS edge_id FROM (
  SELECT *, row_number() OVER (PARTITION BY website_id, incident_id ORDER BY ph, pos, source, target) AS no FROM edg0) x"""

ORACLES = {
    "group_label": "SELECT website_id, incident_id, group_no, group_event, n, label FROM gtab",
    "timeline": """
SELECT website_id, incident_id, concat('tl_', CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 3, '0') ELSE CAST(no AS VARCHAR) END) AS entry_id, evidence_type, ts_us, label, event_count, event_ids FROM (
  SELECT website_id, incident_id, no, evidence_type, ts_us, label, event_count, event_ids FROM tl1
  UNION ALL SELECT i.website_id, i.incident_id, n + 1, 'system', created_seq, 'Incident correlated', 0, '' FROM fx_incidents i
    JOIN (SELECT website_id, incident_id, max(no) AS n FROM tl1 GROUP BY 1, 2) c USING (website_id, incident_id)
  UNION ALL SELECT i.website_id, i.incident_id, n + 2, 'system', created_seq + 1, concat('Threat intelligence enrichment: ', created_seq % 3,
    CASE created_seq % 3 WHEN 1 THEN ' indicator' ELSE ' indicators' END, ' checked'), 0, '' FROM fx_incidents i
    JOIN (SELECT website_id, incident_id, max(no) AS n FROM tl1 GROUP BY 1, 2) c USING (website_id, incident_id) WHERE created_seq % 2 = 0) x""",
    "graph_nodes": "SELECT * FROM nod",
    "graph_edges": "SELECT website_id, incident_id, edge_id, source, target, relationship, correlation_type, strength, evidence_type, event_count FROM edg",
    "best_relationship": "SELECT * FROM brel",
    "group_stages": """
SELECT website_id, incident_id, group_event, string_agg(stage, ',' ORDER BY k) AS stages FROM (SELECT DISTINCT g.website_id, g.incident_id, g.group_event, stage,
  list_position(['abnormal_navigation', 'credential_attack', 'authentication_success', 'new_session', 'sensitive_access', 'attack_indicator'], stage) AS k
  FROM grow g JOIN fx_stages s ON s.event_id = g.event_id) x GROUP BY 1, 2, 3""",
    "graph_layout": """
SELECT website_id, incident_id, node_id, CAST(layer AS DOUBLE) AS x, row_number() OVER (PARTITION BY website_id, incident_id, layer ORDER BY node_type, node_id) - 1
  - (count(*) OVER (PARTITION BY website_id, incident_id, layer) - 1) / 2.0 AS y FROM nod""",
    "graph_layout_edges": "SELECT website_id, incident_id, edge_id, source, target FROM edg WHERE NOT starts_with(source, 'ip:')",
    "graph_summary": """
SELECT n.*, e.* EXCLUDE (website_id, incident_id), p.layered_path FROM (SELECT website_id, incident_id, count(*) AS node_count, count(*) FILTER (node_type = 'source_ip') AS source_ip_nodes,
  count(*) FILTER (node_type = 'session') AS session_nodes, count(*) FILTER (node_type = 'event_group') AS event_group_nodes,
  count(*) FILTER (node_type = 'incident') AS incident_nodes FROM nod GROUP BY 1, 2) n
JOIN (SELECT website_id, incident_id, count(*) AS edge_count, count(*) FILTER (relationship = 'used_session') AS used_session, count(*) FILTER (relationship = 'began_with') AS began_with,
  count(*) FILTER (relationship = 'followed_by') AS followed_by, count(*) FILTER (relationship = 'evidence_for') AS evidence_for FROM edg GROUP BY 1, 2) e USING (website_id, incident_id)
JOIN (SELECT website_id, incident_id, string_agg(label, '|' ORDER BY r) AS layered_path FROM (SELECT *, row_number() OVER (PARTITION BY website_id, incident_id ORDER BY layer, node_id) AS r
  FROM nod) x WHERE r <= 12 GROUP BY 1, 2) p USING (website_id, incident_id)""",
}
