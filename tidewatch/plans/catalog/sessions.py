"""Sessions and window analytics."""

from pyspark.sql import functions as F

from tidewatch.operators import sessions as S
from tidewatch.plans.catalog.base import ORACLE_VIEWS, events, fx, joined, query

SUMMARY = ["website_id", "session_key", "inferred", "first_us", "last_us", "event_count", "source_ip_count", "user_count",
           "page_views", "interaction_events", "interaction_total", "request_events", "distinct_paths", "login_failures",
           "login_successes", "distinct_failed_users", "sensitive_accesses", "error_events", "waf_alerts", "webdriver_seen",
           "requests_per_min", "peak_requests_10s", "median_page_gap_us"]


@query
def session_key(spark, sf):
    return S.with_session_key(events(spark, sf)).select("event_id", "website_id", "session_key", "inferred")


@query
def session_summary(spark, sf):
    types = F.transform(F.array_sort(F.map_entries("event_types")),
                        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return S.session_summary(events(spark, sf)).select(
        *SUMMARY, joined("ua_classes").alias("ua_classes"), F.array_join(types, ",").alias("event_types"))


@query
def session_entities(spark, sf):
    return S.session_entities(events(spark, sf))


@query
def peak_in_window(spark, sf):
    return S.request_peak(S.with_session_key(events(spark, sf)), 6 * 3600)


@query
def median_gap(spark, sf):
    return S.median_gap(S.with_session_key(events(spark, sf)))


@query
def split_runs(spark, sf):
    return (S.entity_runs(events(spark, sf), 3 * 3600).groupBy("website_id", "entity", "run_us", "run_event")
            .agg(F.count("*").alias("n"), F.max("ts_us").alias("last_us")))


@query
def group_events(spark, sf):
    e = events(spark, sf)
    return (S.group_events(e, ["website_id", "user_id"], 6 * 3600)
            .groupBy("website_id", "user_id", "group_us", "group_event", "event_type", "session_id", "source_ip")
            .agg(F.count("*").alias("n"), F.max("ts_us").alias("last_us")))


@query
def list_sessions(spark, sf):
    return (S.list_sessions(events(spark, sf), fx(spark, sf, "fx_findings"), suspicious_only=True, sort="findings", limit=100,
                            offset=20)
            .select("website_id", "session_key", "event_count", "last_us", "finding_count", joined("rule_ids").alias("rule_ids"),
                    "max_finding_confidence"))


@query
def session_detail(spark, sf):
    return S.session_detail(events(spark, sf), fx(spark, sf, "fx_findings"), "ip:203.0.113.0")


QUERIES = {f.__name__: f for f in (session_key, session_summary, session_entities, peak_in_window, median_gap, split_runs,
                                   group_events, list_sessions, session_detail)}

ORACLE_VIEWS["runs"] = """
SELECT website_id, entity, event_id, us, user_id, event_type,
  sum(CASE WHEN us - p <= 10800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY website_id, entity ORDER BY us, event_id) AS run
FROM (SELECT *, lag(us) OVER (PARTITION BY website_id, entity ORDER BY us, event_id) AS p FROM ev WHERE entity IS NOT NULL) x"""
ORACLE_VIEWS["med"] = """
SELECT website_id, session_key, median(CAST(g AS DOUBLE)) AS median_gap_us FROM (
  SELECT website_id, session_key, us - lag(us) OVER (PARTITION BY website_id, session_key ORDER BY us, event_id) AS g
  FROM ev WHERE event_type = 'page_view') x WHERE g IS NOT NULL GROUP BY 1, 2"""
ORACLE_VIEWS["peak10"] = """
SELECT website_id, session_key, max(n) AS peak FROM (
  SELECT website_id, session_key, count(*) OVER (PARTITION BY website_id, session_key ORDER BY us
    RANGE BETWEEN 10000000 PRECEDING AND CURRENT ROW) AS n FROM ev WHERE is_request) x GROUP BY 1, 2"""
ORACLE_VIEWS["summ"] = """
SELECT website_id, session_key, any_value(inferred) AS inferred, min(us) AS first_us, max(us) AS last_us, count(*) AS event_count,
  arg_min(event_id, (us, event_id)) AS first_event_id,
  count(DISTINCT source_ip) AS source_ip_count, count(DISTINCT user_id) AS user_count,
  count(*) FILTER (event_type = 'page_view') AS page_views, count(*) FILTER (event_type = 'interaction') AS interaction_events,
  CAST(COALESCE(sum(interaction_total), 0) AS BIGINT) AS interaction_total, count(*) FILTER (is_request) AS request_events,
  count(DISTINCT CASE WHEN is_request THEN path END) AS distinct_paths,
  count(*) FILTER (event_type = 'login_failure') AS login_failures, count(*) FILTER (event_type = 'login_success') AS login_successes,
  count(DISTINCT CASE WHEN event_type = 'login_failure' THEN user_id END) AS distinct_failed_users,
  count(*) FILTER (is_sensitive) AS sensitive_accesses, count(*) FILTER (is_error) AS error_events,
  count(*) FILTER (event_type = 'waf_alert') AS waf_alerts, FALSE AS webdriver_seen,
  CASE WHEN max(us) FILTER (is_request) - min(us) FILTER (is_request) >= 1000000 THEN
    round(count(*) FILTER (is_request) / ((max(us) FILTER (is_request) - min(us) FILTER (is_request)) / 1e6) * 60, 2) END AS requests_per_min,
  string_agg(DISTINCT ua_class, ',' ORDER BY ua_class) AS ua_classes
FROM ev GROUP BY 1, 2"""
ORACLE_VIEWS["types"] = """
SELECT website_id, session_key, string_agg(concat(event_type, '=', n), ',' ORDER BY event_type) AS event_types FROM (
  SELECT website_id, session_key, event_type, count(*) AS n FROM ev GROUP BY 1, 2, 3) x GROUP BY 1, 2"""

ORACLES = {
    "session_key": "SELECT event_id, website_id, session_key, inferred FROM ev",
    "session_summary": """
SELECT s.* EXCLUDE (first_event_id), COALESCE(p.peak, 0) AS peak_requests_10s, m.median_gap_us AS median_page_gap_us, t.event_types
FROM summ s LEFT JOIN peak10 p USING (website_id, session_key) LEFT JOIN med m USING (website_id, session_key)
LEFT JOIN types t USING (website_id, session_key)""",
    "session_entities": """
SELECT DISTINCT website_id, session_key, kind, value FROM (
  SELECT website_id, session_key, 'source_ip' AS kind, source_ip AS value FROM ev UNION ALL
  SELECT website_id, session_key, 'user_id', user_id FROM ev UNION ALL
  SELECT website_id, session_key, 'ua_class', ua_class FROM ev) x WHERE value IS NOT NULL""",
    "peak_in_window": """
SELECT website_id, session_key, max(n) AS peak, arg_min(us, (-n, us)) AS peak_us, arg_min(event_id, (-n, us, -event_id)) AS peak_event FROM (
  SELECT website_id, session_key, us, event_id, count(*) OVER (PARTITION BY website_id, session_key ORDER BY us
    RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS n FROM ev WHERE is_request) x GROUP BY 1, 2""",
    "median_gap": "SELECT * FROM med",
    "split_runs": """
SELECT website_id, entity, min(us) AS run_us, arg_min(event_id, (us, event_id)) AS run_event, count(*) AS n, max(us) AS last_us
FROM runs GROUP BY website_id, entity, run""",
    "group_events": """
SELECT website_id, user_id, min(us) AS group_us, arg_min(event_id, (us, event_id)) AS group_event, event_type, session_id, source_ip,
  count(*) AS n, max(us) AS last_us
FROM (SELECT *, sum(CASE WHEN us - p <= 21600000000 AND event_type = pt AND session_id IS NOT DISTINCT FROM ps AND source_ip IS NOT DISTINCT FROM pi
    THEN 0 ELSE 1 END) OVER (PARTITION BY website_id, user_id ORDER BY us, event_id) AS grp
  FROM (SELECT *, lag(us) OVER w AS p, lag(event_type) OVER w AS pt, lag(session_id) OVER w AS ps, lag(source_ip) OVER w AS pi
    FROM ev WINDOW w AS (PARTITION BY website_id, user_id ORDER BY us, event_id)) x) y
GROUP BY website_id, user_id, grp, event_type, session_id, source_ip""",
    "list_sessions": """
SELECT s.website_id, s.session_key, s.event_count, s.last_us, f.finding_count, f.rule_ids, f.max_finding_confidence
FROM summ s JOIN (SELECT e.website_id, e.session_key, count(*) AS finding_count,
  string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rule_ids, max(confidence) AS max_finding_confidence
  FROM fx_findings f JOIN ev e ON e.event_id = f.event_id GROUP BY 1, 2) f USING (website_id, session_key)
ORDER BY f.finding_count DESC, s.last_us DESC, s.website_id, s.session_key LIMIT 100 OFFSET 20""",
    "session_detail": """
SELECT e.website_id, e.session_key, e.event_id, us AS ts_us, e.event_type, finding_id, rule_id, confidence
FROM ev e LEFT JOIN fx_findings f ON e.event_id = f.event_id WHERE session_key = 'ip:203.0.113.0'""",
}
