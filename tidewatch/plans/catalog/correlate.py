"""Correlation."""

from pyspark.sql import functions as F

from tidewatch.operators import correlate as C
from tidewatch.params import Correlation
from tidewatch.plans.catalog.base import ORACLE_VIEWS, events, fx, joined, query, stored

P = Correlation(max_gap_s={"same_ip": 3600, "same_session": 21600, "same_user": 10800, "same_endpoint": 7200, "similar_behavior": 14400},
                max_links=12)


def findings(spark, sf):
    """Fixture findings with cited event ids (the anchor and the user's event before it), stored as detection stores them."""
    def build():
        ids = fixture_citations(spark, sf).groupBy("finding_id").agg(F.sort_array(F.collect_list(F.col("event_id").cast("string"))).alias("event_ids"))
        return fx(spark, sf, "fx_findings").join(ids, "finding_id")
    return stored(spark, sf, "fixture_findings", build)


def fixture_citations(spark, sf):
    return stored(spark, sf, "fixture_citations", lambda: fx(spark, sf, "fx_cited").select("website_id", "finding_id", F.col("cited_id").alias("event_id")))


def cited(spark, sf):
    """The same citations by reference."""
    return C.Citations.of(fixture_citations(spark, sf))


def seeds(spark, sf):
    return stored(spark, sf, "seeds", lambda: C.seed_events(findings(spark, sf), events(spark, sf), cited(spark, sf)))


def groups(spark, sf):
    return stored(spark, sf, "entity_groups", lambda: C.entity_groups(events(spark, sf), seeds(spark, sf)))


def found_clusters(spark, sf):
    return C.clusters(events(spark, sf), findings(spark, sf), cited(spark, sf), P, seeds(spark, sf), groups(spark, sf))


def members(spark, sf):
    return stored(spark, sf, "members", lambda: C.cluster_events(found_clusters(spark, sf), events(spark, sf)))


def stages(spark, sf):
    return stored(spark, sf, "stages", lambda: C.detect_stages(members(spark, sf), findings(spark, sf), cited(spark, sf)))


def links(spark, sf):
    return stored(spark, sf, "cluster_links", lambda: C.cluster_links(
        members(spark, sf), findings(spark, sf), C.chain_links(groups(spark, sf), P), stages(spark, sf), P))


def summaries(spark, sf):
    return stored(spark, sf, "summaries", lambda: C.cluster_summary(
        members(spark, sf), findings(spark, sf), links(spark, sf), stages(spark, sf), P))


@query
def seed_events(spark, sf):
    return seeds(spark, sf)


@query
def entity_groups(spark, sf):
    return groups(spark, sf)


@query
def chain_links(spark, sf):
    return C.chain_links(groups(spark, sf), P)


@query
def clusters(spark, sf):
    return found_clusters(spark, sf)


@query
def cited_categories(spark, sf):
    return C.cited_categories(findings(spark, sf), events(spark, sf), cited(spark, sf)).select("website_id", "event_id", joined("categories").alias("categories"))


@query
def stage_of(spark, sf):
    cats = C.cited_categories(findings(spark, sf), events(spark, sf), cited(spark, sf))
    e = events(spark, sf).withColumn("is_sensitive", F.col("features.is_sensitive_endpoint"))
    return e.join(cats, ["website_id", "event_id"], "left").select("event_id", C.stage_of().alias("stage"))


@query
def detect_stages(spark, sf):
    return C.detect_stages(members(spark, sf), findings(spark, sf), cited(spark, sf)).select("website_id", "cluster_event", "event_id", "stage", "stage_no")


@query
def sequence_links(spark, sf):
    return C.sequence_links(stages(spark, sf), P)


@query
def same_endpoint_links(spark, sf):
    return C.same_endpoint_links(members(spark, sf), P)


@query
def similar_behavior_links(spark, sf):
    return C.similar_behavior_links(members(spark, sf), findings(spark, sf), P)


@query
def cluster_links(spark, sf):
    m, s = members(spark, sf), stages(spark, sf)
    return C.cluster_links(m, findings(spark, sf), C.chain_links(groups(spark, sf), P), s, P)


@query
def cap_links(spark, sf):
    return C.cap_links(links(spark, sf), P.max_links)


@query
def cluster_entities(spark, sf):
    return C.cluster_entities(members(spark, sf))


@query
def affected_resources(spark, sf):
    return C.affected_resources(members(spark, sf), stages(spark, sf), findings(spark, sf)).select(
        *C.CLUSTER, joined("affected_resources", "|").alias("affected_resources"))


@query
def cluster_summary(spark, sf):
    s = C.cluster_summary(members(spark, sf), findings(spark, sf), links(spark, sf), stages(spark, sf), P)
    kinds = F.transform(F.array_sort(F.map_entries("link_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return s.select("website_id", "cluster_event", "cluster_id", "event_count", "seed_event_count", "first_us", "last_us", "source_ip_count",
                    "session_count", "user_count", "finding_count", "max_confidence", joined("categories").alias("categories"), "link_count",
                    "links_truncated", joined("stages").alias("stages"), F.coalesce(F.array_join(kinds, ","), F.lit("")).alias("link_counts"),
                    "is_candidate")


@query
def incident_candidates(spark, sf):
    return C.incident_candidates(summaries(spark, sf), P).select("website_id", "cluster_event", "max_confidence", F.size("categories").alias("n_categories"))


@query
def incident_title(spark, sf):
    return summaries(spark, sf).select("website_id", "cluster_event", C.incident_title().alias("title"))


@query
def incident_details(spark, sf):
    d = C.incident_details(summaries(spark, sf), members(spark, sf), stages(spark, sf), P)
    return d.select(*C.CLUSTER, "title", F.col("details.event_count").alias("event_count"), joined("details.event_ids").alias("event_ids"),
                    joined("details.entities.source_ips").alias("source_ips"), joined("details.entities.user_ids").alias("user_ids"),
                    joined("details.rule_ids").alias("rule_ids"))


def existing(spark, sf):
    """Incidents of an earlier run: the candidate clusters' events by session, as if sessions had been the incidents."""
    m = members(spark, sf).where(F.col("session_id").isNotNull())
    return m.select("website_id", F.col("session_id").alias("incident_id"), "event_id")


@query
def match_incidents(spark, sf):
    cand = C.incident_candidates(summaries(spark, sf), P)
    return C.match_incidents(cand, members(spark, sf), existing(spark, sf))


def reconciled(spark, sf):
    cand = C.incident_candidates(summaries(spark, sf), P)
    old = existing(spark, sf).groupBy("website_id", "incident_id").agg(F.max("event_id").alias("e"))
    old = old.select("website_id", "incident_id", F.when(F.col("e") % 3 == 0, "CONFIRMED").otherwise("DETECTED").alias("status"),
                     F.lit("deterministic_correlation").alias("basis"), (F.col("e") % 5 == 0).alias("stale"), "e")
    matched = C.match_incidents(cand, members(spark, sf), existing(spark, sf))
    judged = old.where(F.col("e") % 4 == 0).select("website_id", "incident_id")
    return C.reconcile_incidents(cand, matched, old.drop("e"), judged)


@query
def reconcile_incidents(spark, sf):
    return reconciled(spark, sf).select("website_id", "cluster_event", "incident_id", "action")


@query
def list_links(spark, sf):
    return C.list_links(fx(spark, sf, "fx_links"), events(spark, sf), "same_ip")


@query
def list_cluster_summaries(spark, sf):
    return C.list_cluster_summaries(summaries(spark, sf), 100).select("website_id", "cluster_event", "cluster_id", "max_confidence", "first_us")


QUERIES = {f.__name__: f for f in (
    seed_events, entity_groups, chain_links, clusters, cited_categories, stage_of, detect_stages, sequence_links, same_endpoint_links,
    similar_behavior_links, cluster_links, cap_links, cluster_entities, affected_resources, cluster_summary, incident_candidates,
    incident_title, incident_details, match_incidents, reconcile_incidents, list_links, list_cluster_summaries)}

V = ORACLE_VIEWS
V["seeds"] = "SELECT DISTINCT website_id, cited_id AS event_id FROM fx_cited"
V["ents"] = """
SELECT website_id, event_id, us AS ts_us, 'same_ip' AS relationship_type, source_ip AS entity FROM ev WHERE source_ip IS NOT NULL
UNION ALL SELECT website_id, event_id, us, 'same_session', session_id FROM ev WHERE session_id IS NOT NULL
UNION ALL SELECT website_id, event_id, us, 'same_user', user_id FROM ev WHERE user_id IS NOT NULL AND event_type <> 'login_failure'"""
V["grps"] = """
SELECT * FROM ents WHERE (website_id, relationship_type, entity) IN (
  SELECT (e.website_id, e.relationship_type, e.entity) FROM ents e JOIN seeds s ON e.event_id = s.event_id)"""


def strength(rel: str, gap: str, limit: str, base: str) -> str:
    return f"round({base} * (1 - CAST(0.5 AS DOUBLE) * least(({gap}) / 1e6 / {limit}, 1.0)), 3)"


V["chn"] = f"""
SELECT website_id, p AS event_id, event_id AS related_event_id, relationship_type,
  {strength('', 'g', 'lim', 'base')} AS strength FROM (
  SELECT *, ts_us - lag(ts_us) OVER w AS g, lag(event_id) OVER w AS p,
    CASE relationship_type WHEN 'same_ip' THEN 3600 WHEN 'same_session' THEN 21600 ELSE 10800 END AS lim,
    CASE relationship_type WHEN 'same_ip' THEN CAST(0.6 AS DOUBLE) WHEN 'same_session' THEN 0.9 ELSE 0.8 END AS base
  FROM grps WINDOW w AS (PARTITION BY website_id, relationship_type, entity ORDER BY ts_us, event_id)) x WHERE g <= lim * CAST(1000000 AS BIGINT)"""
V["und"] = "SELECT DISTINCT event_id AS a, related_event_id AS b FROM chn UNION SELECT DISTINCT related_event_id, event_id FROM chn"
V["nodes"] = "SELECT event_id FROM seeds UNION SELECT a FROM und"
V["reach"] = "SELECT event_id AS a, event_id AS b FROM nodes UNION SELECT r.a, u.b FROM reach r JOIN und u ON u.a = r.b"
V["comp"] = "SELECT a AS event_id, min(b) AS comp FROM reach GROUP BY 1"
V["mem"] = """
SELECT e.*, h.cluster_event, h.live FROM (SELECT c.comp, ev.*, s.event_id IS NOT NULL AS is_seed FROM comp c JOIN ev USING (event_id)
  LEFT JOIN seeds s USING (event_id)) e JOIN (
  SELECT comp, arg_min(c.event_id, (us, c.event_id)) AS cluster_event, bool_or(s.event_id IS NOT NULL) AS live FROM comp c JOIN ev USING (event_id)
  LEFT JOIN seeds s USING (event_id) GROUP BY 1) h USING (comp) WHERE h.live"""
_CID = "concat('clu_', substr(sha256(CAST(cluster_event AS VARCHAR)), 1, 32))"
V["cats"] = """
SELECT DISTINCT c.cited_id AS event_id, unnest(CASE WHEN f.finding_type = 'attack_indicator' THEN [f.category, 'attack_indicator_cat'] ELSE [f.category] END) AS cat
FROM fx_cited c JOIN fx_findings f USING (finding_id)"""
V["incats"] = """
SELECT DISTINCT b.cluster_event, b.event_id, unnest(CASE WHEN f.finding_type = 'attack_indicator' THEN [f.category, 'attack_indicator_cat'] ELSE [f.category] END) AS cat
FROM fx_cited c JOIN fx_findings f USING (finding_id) JOIN mem a ON a.event_id = f.event_id JOIN mem b ON b.event_id = c.cited_id AND b.cluster_event = a.cluster_event"""


def stage(cats: str) -> str:
    def has(*names):
        return f"COALESCE(list_has_any({cats}, [{', '.join(repr(n) for n in names)}]), FALSE)"
    return f"""CASE WHEN event_type = 'waf_alert' OR {has('attack_indicator_cat')} THEN 'attack_indicator' WHEN is_sensitive THEN 'sensitive_access'
  WHEN event_type = 'session_created' THEN 'new_session' WHEN event_type = 'login_success' THEN 'authentication_success'
  WHEN event_type = 'login_failure' AND {has('brute_force_indicator', 'multi_account_auth_failures')} THEN 'credential_attack'
  WHEN event_type = 'page_view' AND {has('non_human_navigation', 'recon_path_probing', 'automation_indicator', 'high_request_rate')} THEN 'abnormal_navigation' END"""


V["stg0"] = f"""
SELECT m.*, {stage('l.cats')} AS stage FROM mem m LEFT JOIN (SELECT cluster_event, event_id, list(cat) AS cats FROM incats GROUP BY 1, 2) l
USING (cluster_event, event_id)"""
V["stg"] = """
SELECT *, list_position(['abnormal_navigation', 'credential_attack', 'authentication_success', 'new_session', 'sensitive_access', 'attack_indicator'], stage) AS stage_no
FROM stg0 WHERE stage IS NOT NULL AND cluster_event IN (SELECT cluster_event FROM stg0 WHERE stage IN ('credential_attack', 'abnormal_navigation', 'attack_indicator'))"""
V["stsum"] = """
SELECT *, lead(stage) OVER w AS next_stage, lead(f_us) OVER w AS n_us, lead(f_id) OVER w AS n_id FROM (
  SELECT website_id, cluster_event, stage, stage_no, count(*) AS n, min(us) AS f_us, arg_min(event_id, (us, event_id)) AS f_id FROM stg GROUP BY 1, 2, 3, 4) x
WINDOW w AS (PARTITION BY website_id, cluster_event ORDER BY stage_no)"""
V["lseq"] = f"""
SELECT website_id, cluster_event, a_id AS event_id, n_id AS related_event_id, 'attack_sequence' AS relationship_type,
  {strength('', 'n_us - a_us', '1', 'CAST(0.9 AS DOUBLE)')} AS strength FROM (
  SELECT s.website_id, s.cluster_event, s.n_us, s.n_id, arg_max(g.event_id, (g.us, g.event_id)) AS a_id, max(g.us) AS a_us
  FROM stsum s JOIN stg g ON g.cluster_event = s.cluster_event AND g.stage = s.stage AND g.us <= s.n_us WHERE s.next_stage IS NOT NULL GROUP BY 1, 2, 3, 4) x
JOIN ev a ON a.event_id = a_id JOIN ev b ON b.event_id = n_id WHERE a.source_ip = b.source_ip OR a.user_id = b.user_id"""
V["lseq"] = V["lseq"].replace("SELECT website_id, cluster_event, a_id", "SELECT x.website_id, x.cluster_event, a_id")
V["lep"] = f"""
SELECT website_id, cluster_event, p AS event_id, event_id AS related_event_id, 'same_endpoint' AS relationship_type,
  {strength('', 'g', '7200', 'CAST(0.4 AS DOUBLE)')} AS strength FROM (
  SELECT *, us - lag(us) OVER w AS g, lag(event_id) OVER w AS p, lag(event_type) OVER w AS pt, lag(session_id) OVER w AS ps FROM mem WHERE path IS NOT NULL
  WINDOW w AS (PARTITION BY cluster_event, path ORDER BY us, event_id)) x
WHERE g <= 7200000000 AND NOT (event_type = pt AND session_id IS NOT DISTINCT FROM ps)"""
V["lsim"] = f"""
SELECT website_id, cluster_event, p AS event_id, event_id AS related_event_id, 'similar_behavior' AS relationship_type,
  {strength('', 'g', '14400', 'CAST(0.3 AS DOUBLE)')} AS strength FROM (
  SELECT *, us - lag(us) OVER w AS g, lag(event_id) OVER w AS p, lag(session_id) OVER w AS ps FROM (
    SELECT DISTINCT m.website_id, cluster_event, m.event_id, us, session_id, f.category FROM mem m JOIN fx_findings f USING (event_id)) d
  WINDOW w AS (PARTITION BY cluster_event, category ORDER BY us, event_id)) x WHERE g <= 14400000000 AND session_id IS DISTINCT FROM ps"""
V["lall"] = """
SELECT c.website_id, m.cluster_event, c.event_id, related_event_id, relationship_type, strength FROM chn c JOIN mem m ON m.event_id = c.event_id
UNION SELECT * FROM lseq UNION SELECT * FROM lep UNION SELECT * FROM lsim"""
V["lcap"] = """
SELECT website_id, cluster_event, event_id, related_event_id, relationship_type, strength FROM lall QUALIFY row_number() OVER (PARTITION BY cluster_event
  ORDER BY relationship_type <> 'attack_sequence', strength DESC, event_id, related_event_id, relationship_type) <= 12"""
V["cfind"] = """
SELECT m.website_id, m.cluster_event, count(DISTINCT finding_id) AS finding_count, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
  count(DISTINCT category) AS n_categories, max(confidence) AS max_confidence, arg_max(title, (confidence, rule_id)) AS best_title
FROM mem m JOIN fx_findings f USING (event_id) GROUP BY 1, 2"""
V["cstg"] = """
SELECT cluster_event, string_agg(stage, ',' ORDER BY stage_no) AS stages, count(*) AS n_stages, string_agg(CASE stage WHEN 'abnormal_navigation' THEN 'abnormal navigation'
  WHEN 'credential_attack' THEN 'failed-login burst' WHEN 'authentication_success' THEN 'successful login' WHEN 'new_session' THEN 'new session'
  WHEN 'sensitive_access' THEN 'sensitive endpoint access' ELSE 'attack-indicator request' END, ' → ' ORDER BY stage_no) AS stage_text FROM stsum GROUP BY 1"""
V["csum"] = f"""
SELECT b.*, {_CID} AS cluster_id, COALESCE(f.finding_count, 0) AS finding_count, COALESCE(f.max_confidence, 0) AS max_confidence, COALESCE(f.categories, '') AS categories,
  COALESCE(f.n_categories, 0) AS n_categories, f.best_title, COALESCE(s.stages, '') AS stages, COALESCE(s.n_stages, 0) AS n_stages, s.stage_text,
  COALESCE(l.link_count, 0) AS link_count, COALESCE(l.link_counts, '') AS link_counts, COALESCE(t.links_truncated, FALSE) AS links_truncated
FROM (SELECT website_id, cluster_event, count(*) AS event_count, count(*) FILTER (is_seed) AS seed_event_count, min(us) AS first_us, max(us) AS last_us,
  count(DISTINCT source_ip) AS source_ip_count, min(source_ip) AS one_ip, count(DISTINCT session_id) AS session_count,
  count(DISTINCT CASE WHEN event_type <> 'login_failure' THEN user_id END) AS user_count FROM mem GROUP BY 1, 2) b
LEFT JOIN cfind f USING (website_id, cluster_event) LEFT JOIN cstg s USING (cluster_event)
LEFT JOIN (SELECT cluster_event, CAST(sum(n) AS BIGINT) AS link_count, string_agg(concat(relationship_type, '=', n), ',' ORDER BY relationship_type) AS link_counts
  FROM (SELECT cluster_event, relationship_type, count(*) AS n FROM lcap GROUP BY 1, 2) q GROUP BY 1) l USING (cluster_event)
LEFT JOIN (SELECT cluster_event, count(*) > 12 AS links_truncated FROM lall GROUP BY 1) t USING (cluster_event)"""
V["cand"] = "SELECT * FROM csum WHERE finding_count > 0 AND (max_confidence >= 0.6 OR n_categories >= 2)"
V["res"] = """
SELECT website_id, cluster_event, string_agg(path, '|' ORDER BY r) AS affected_resources FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_event ORDER BY a, b, c) AS r FROM (
    SELECT website_id, cluster_event, path, min((stage_no, us, event_id)) AS a, 0 AS b, '' AS c FROM stg
    WHERE stage IN ('sensitive_access', 'attack_indicator') AND path IS NOT NULL GROUP BY 1, 2, 3) x) y WHERE r <= 5 GROUP BY 1, 2"""
V["resf"] = """
SELECT website_id, cluster_event, string_agg(path, '|' ORDER BY r) AS affected_resources FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_event ORDER BY n DESC, f) AS r FROM (
    SELECT m.website_id, cluster_event, path, count(DISTINCT finding_id) AS n, min(finding_id) AS f FROM mem m JOIN fx_findings USING (event_id)
    WHERE path IS NOT NULL GROUP BY 1, 2, 3) x) y WHERE r <= 5 AND cluster_event NOT IN (SELECT cluster_event FROM res) GROUP BY 1, 2"""
V["old"] = "SELECT website_id, session_id AS incident_id, max(event_id) AS e FROM mem WHERE session_id IS NOT NULL GROUP BY 1, 2"
# one cluster after the other takes the free incident it shares most events with
V["mm_shared"] = """
SELECT m.website_id, m.cluster_event, o.session_id AS incident_id, count(*) AS overlap FROM mem m JOIN cand c USING (website_id, cluster_event)
JOIN mem o ON o.website_id = m.website_id AND o.event_id = m.event_id WHERE o.session_id IS NOT NULL GROUP BY 1, 2, 3"""
V["mm_rank"] = """
SELECT website_id, cluster_event, row_number() OVER (PARTITION BY website_id ORDER BY event_count DESC, max_confidence DESC, first_us, cluster_id) AS k
FROM cand WHERE (website_id, cluster_event) IN (SELECT (website_id, cluster_event) FROM mm_shared)"""
V["mm_step"] = """
SELECT DISTINCT website_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS BIGINT) AS cluster_event, CAST(NULL AS VARCHAR) AS incident_id FROM mm_rank
UNION ALL SELECT website_id, k, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick) END, cluster_event, pick FROM (
  SELECT g.website_id, r.k, any_value(g.taken) AS taken, r.cluster_event, arg_max(s.incident_id, (s.overlap, s.incident_id)) FILTER (NOT list_contains(g.taken, s.incident_id)) AS pick
  FROM mm_step g JOIN mm_rank r ON r.website_id = g.website_id AND r.k = g.k + 1
  JOIN mm_shared s ON s.website_id = r.website_id AND s.cluster_event = r.cluster_event GROUP BY g.website_id, r.k, r.cluster_event) x"""
V["mat"] = "SELECT website_id, incident_id, cluster_event FROM mm_step WHERE incident_id IS NOT NULL"

ORACLES = {
    "seed_events": "SELECT * FROM seeds",
    "entity_groups": "SELECT * FROM grps",
    "chain_links": "SELECT * FROM chn",
    "clusters": f"SELECT website_id, cluster_event, {_CID} AS cluster_id, event_id, us AS ts_us, is_seed FROM mem",
    "cited_categories": """
SELECT website_id, event_id, string_agg(cat, ',' ORDER BY cat) AS categories FROM cats JOIN ev USING (event_id) GROUP BY 1, 2""",
    "stage_of": f"SELECT e.event_id, {stage('l.cats')} AS stage FROM ev e LEFT JOIN (SELECT event_id, list(cat) AS cats FROM cats GROUP BY 1) l USING (event_id)",
    "detect_stages": "SELECT website_id, cluster_event, event_id, stage, stage_no FROM stg",
    "sequence_links": "SELECT * FROM lseq",
    "same_endpoint_links": "SELECT * FROM lep",
    "similar_behavior_links": "SELECT * FROM lsim",
    "cluster_links": "SELECT * FROM lall",
    "cap_links": "SELECT * FROM lcap",
    "cluster_entities": """
SELECT DISTINCT website_id, cluster_event, kind, value FROM (SELECT website_id, cluster_event, 'source_ip' AS kind, source_ip AS value FROM mem
  UNION ALL SELECT website_id, cluster_event, 'session_id', session_id FROM mem
  UNION ALL SELECT website_id, cluster_event, 'user_id', CASE WHEN event_type <> 'login_failure' THEN user_id END FROM mem) x WHERE value IS NOT NULL""",
    "affected_resources": "SELECT * FROM res UNION ALL SELECT * FROM resf",
    "cluster_summary": """
SELECT website_id, cluster_event, cluster_id, event_count, seed_event_count, first_us, last_us, source_ip_count, session_count, user_count, finding_count,
  max_confidence, categories, link_count, links_truncated, stages, link_counts,
  finding_count > 0 AND (max_confidence >= 0.6 OR n_categories >= 2) AS is_candidate FROM csum""",
    "incident_candidates": "SELECT website_id, cluster_event, max_confidence, CAST(n_categories AS INTEGER) AS n_categories FROM cand",
    "incident_title": """
SELECT website_id, cluster_event, CASE WHEN n_stages >= 2 THEN concat('Suspicious activity chain from ', src, ': ', stage_text)
  ELSE concat(COALESCE(best_title, 'Suspicious activity'), ' from ', src) END AS title FROM (
  SELECT *, CASE WHEN source_ip_count = 1 THEN one_ip WHEN source_ip_count > 1 THEN concat(source_ip_count, ' sources') ELSE 'an unidentified source' END AS src FROM csum) x""",
    "match_incidents": "SELECT website_id, cluster_event, incident_id FROM mat",
    "reconcile_incidents": """
SELECT c.website_id, CAST(c.cluster_event AS VARCHAR) AS cluster_event, m.incident_id, CASE WHEN m.cluster_event IS NULL THEN 'created' ELSE 'updated' END AS action
FROM cand c LEFT JOIN mat m USING (website_id, cluster_event)
UNION ALL SELECT o.website_id, NULL, o.incident_id, CASE WHEN e % 3 <> 0 AND e % 4 <> 0 THEN 'removed' WHEN e % 5 = 0 THEN 'kept_stale' ELSE 'stale' END
FROM old o WHERE (o.website_id, o.incident_id) NOT IN (SELECT (website_id, incident_id) FROM mat)""",
    "list_links": """
SELECT l.*, us AS ts_us FROM fx_links l JOIN ev e ON e.event_id = l.event_id WHERE relationship_type = 'same_ip'""",
    "list_cluster_summaries": """
SELECT website_id, cluster_event, cluster_id, max_confidence, first_us FROM csum
QUALIFY row_number() OVER (PARTITION BY website_id ORDER BY max_confidence DESC, first_us, cluster_id) <= 100""",
}
