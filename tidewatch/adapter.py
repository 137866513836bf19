"""Web-event views on the driver's tables.  The SQL texts run unchanged in Spark SQL and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.features import extract_features

VIEWS = {
    "web_events": """
SELECT CAST(event_id AS BIGINT) AS event_id,
  CASE WHEN user_id % 2 = 0 THEN 'web_a' ELSE 'web_b' END AS website_id,
  ts AS timestamp,
  CASE WHEN user_id % 25 = 24 OR user_id % 30 = 10 THEN NULL ELSE concat('203.0.113.', CAST(user_id % 40 AS STRING)) END AS source_ip,
  concat('u-', CAST(user_id AS STRING)) AS user_id,
  CASE WHEN user_id % 10 = 0 THEN NULL
       ELSE concat('s-', CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) END AS session_id,
  CASE WHEN event_type = 'view' THEN 'page_view' WHEN event_type = 'click' THEN 'interaction'
       WHEN event_type = 'error' THEN 'login_failure'
       WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'login_success' WHEN event_type = 'signup' THEN 'session_created'
       WHEN value < 20 THEN 'api_access' WHEN value < 60 THEN 'http_request'
       WHEN value < 150 THEN 'sensitive_endpoint_access' ELSE 'waf_alert' END AS event_type,
  CASE WHEN event_type IN ('click', 'signup') THEN NULL
    ELSE CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 21
    WHEN 0 THEN '/products?id=1'' OR ''1''=''1'
    WHEN 1 THEN '/products?id=1 UNION SELECT NULL,NULL--'
    WHEN 2 THEN '/search?q=<script>alert(1)</script>'
    WHEN 3 THEN '/search?q=%22%3E%3Cimg+src=x+onerror=alert(1)%3E'
    WHEN 4 THEN '/download?file=..%2F..%2Fwindows%2Fwin.ini'
    WHEN 5 THEN '/fetch?url=http%3A%2F%2F169.254.169.254%2Flatest'
    WHEN 6 THEN '/api/admin/customers/export?format=csv'
    WHEN 7 THEN '/admin'
    WHEN 8 THEN '/robots.txt'
    WHEN 9 THEN '/api/docs'
    WHEN 10 THEN '/.env'
    WHEN 11 THEN '/login'
    WHEN 12 THEN '/api/login'
    WHEN 13 THEN '/api/account/me'
    WHEN 14 THEN '/api/account/payment-methods'
    WHEN 15 THEN '/search?q=black+or+white'
    WHEN 16 THEN '/contact?name=O''Brien'
    WHEN 17 THEN '/'
    WHEN 18 THEN '/products/12'
    WHEN 19 THEN '/cart?promo=SAVE-10--now&email=bob@corp.com&token=abc123'
    WHEN 20 THEN '/blog/9?ref=CVE-2021-44228' END END AS endpoint,
  CASE WHEN event_type IN ('click', 'signup') THEN NULL WHEN event_type = 'error' THEN 401
       WHEN value > 150 THEN 500 ELSE 200 END AS status_code,
  CASE user_id % 8 WHEN 0 THEN 'Scrapy/2.11.0' WHEN 1 THEN 'Mozilla/5.0 HeadlessChrome/118.0'
       WHEN 2 THEN NULL ELSE 'Mozilla/5.0 Chrome/118.0' END AS user_agent,
  CASE WHEN event_type = 'click' THEN CAST(event_id % 5 AS INT) END AS interaction_total
FROM events""",
    "fx_findings": """
SELECT concat('f-', CAST(event_id AS STRING)) AS finding_id, event_id, website_id, user_id AS incident_id, event_type AS event_type_of,
  CASE WHEN event_id % 7 = 0 THEN 'anomaly_model' ELSE 'rule_engine' END AS agent_name,
  CASE WHEN event_type = 'waf_alert' THEN 'attack_indicator' WHEN event_id % 7 = 0 THEN 'ml_anomaly' WHEN event_id % 4 = 3 THEN 'behavior_anomaly'
       ELSE 'auth_anomaly' END AS finding_type,
  CASE WHEN event_type = 'waf_alert' AND event_id % 2 = 0 THEN 'sql_injection_indicator' WHEN event_type = 'waf_alert' THEN 'xss_indicator'
       WHEN event_id % 4 = 0 THEN 'brute_force_indicator' WHEN event_id % 4 = 1 THEN 'multi_account_auth_failures'
       WHEN event_id % 4 = 2 THEN 'login_success_after_failure_burst' ELSE 'automation_indicator' END AS category,
  concat('Title ', CAST(event_id % 13 AS STRING)) AS title,
  concat('R-', CAST(event_id % 13 AS STRING)) AS rule_id,
  CASE WHEN event_type <> 'waf_alert' AND event_id % 7 = 0 THEN CAST(45 + event_id % 50 AS DOUBLE) / 100 END AS anomaly_score,
  CASE WHEN event_type = 'waf_alert' THEN 'T1190' WHEN event_id % 4 < 2 THEN 'T1110' WHEN event_id % 4 = 2 THEN 'T1078' END AS technique_id,
  CAST(40 + event_id % 56 AS DOUBLE) / 100 AS confidence
FROM web_events WHERE event_type IN ('login_failure', 'login_success', 'waf_alert')""",
    "fx_cited": """
SELECT f.finding_id, f.website_id, f.incident_id, f.event_id AS cited_id FROM fx_findings f
UNION ALL
SELECT f.finding_id, f.website_id, f.incident_id, p.prev_id AS cited_id FROM fx_findings f JOIN (
  SELECT website_id, event_id, lag(event_id) OVER (PARTITION BY website_id, user_id ORDER BY timestamp, event_id) AS prev_id
  FROM web_events) p ON f.website_id = p.website_id AND f.event_id = p.event_id WHERE p.prev_id IS NOT NULL""",
    "fx_links": """
SELECT website_id, incident_id, event_id, related_event_id, relationship_type, strength FROM (
  SELECT website_id, user_id AS incident_id, event_id,
    lead(event_id) OVER (PARTITION BY website_id, user_id ORDER BY timestamp, event_id) AS related_event_id,
    CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'same_ip' WHEN 1 THEN 'same_session' WHEN 2 THEN 'same_user' ELSE 'attack_sequence' END AS relationship_type,
    CAST(30 + event_id % 61 AS DOUBLE) / 100 AS strength
  FROM web_events) x WHERE related_event_id IS NOT NULL""",
    "fx_incidents": """
SELECT website_id, incident_id, event_count, created_seq, concat('Incident of ', incident_id) AS title,
  CASE created_seq % 8 WHEN 0 THEN 'DETECTED' WHEN 1 THEN 'INVESTIGATING' WHEN 2 THEN 'CONFIRMED' WHEN 3 THEN 'FALSE_POSITIVE'
    WHEN 4 THEN 'NEEDS_INVESTIGATION' WHEN 5 THEN 'RESPONSE_RECOMMENDED' WHEN 6 THEN 'ACTION_TAKEN' ELSE 'RESOLVED' END AS status,
  CASE WHEN created_seq % 9 = 0 THEN NULL ELSE CAST(created_seq % 1000 AS DOUBLE) / 10 END AS risk_score,
  CASE WHEN created_seq % 9 = 0 THEN NULL WHEN created_seq % 1000 >= 850 THEN 'CRITICAL' WHEN created_seq % 1000 >= 650 THEN 'HIGH'
    WHEN created_seq % 1000 >= 400 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CAST(created_seq % 100 AS DOUBLE) / 100 AS confidence
FROM (SELECT website_id, user_id AS incident_id, count(*) AS event_count, max(event_id) AS created_seq FROM web_events GROUP BY website_id, user_id) x""",
    "fx_intel": """
SELECT DISTINCT website_id, user_id AS incident_id, 'ip' AS indicator_type, source_ip AS indicator,
  CASE WHEN source_ip LIKE '%5' OR source_ip LIKE '%7' THEN 'evidence_found' ELSE 'no_evidence' END AS status, source_ip LIKE '%5' AS synthetic
FROM web_events WHERE source_ip IS NOT NULL AND event_type = 'waf_alert'
UNION ALL SELECT DISTINCT website_id, user_id, 'cve', 'CVE-2021-44228', 'evidence_found', FALSE FROM web_events
WHERE endpoint LIKE '%CVE-%' AND event_type = 'sensitive_endpoint_access'
UNION ALL SELECT DISTINCT website_id, incident_id, 'attack_technique', technique_id, 'evidence_found', FALSE FROM fx_findings
WHERE technique_id IS NOT NULL AND event_type_of = 'waf_alert'""",
    "fx_stages": """
SELECT website_id, user_id AS incident_id, event_id, timestamp, stage FROM (SELECT *, CASE WHEN event_type = 'waf_alert' THEN 'attack_indicator'
  WHEN event_type = 'sensitive_endpoint_access' THEN 'sensitive_access' WHEN event_type = 'session_created' THEN 'new_session'
  WHEN event_type = 'login_success' THEN 'authentication_success' WHEN event_type = 'login_failure' THEN 'credential_attack' END AS stage FROM web_events) x
WHERE stage IS NOT NULL""",
    "fx_transitions": """
SELECT conv_id AS incident_id, turn AS seq,
  CASE CAST((conv_id * 7 + turn * 3) % 8 AS INT) WHEN 0 THEN 'DETECTED' WHEN 1 THEN 'INVESTIGATING' WHEN 2 THEN 'CONFIRMED'
    WHEN 3 THEN 'FALSE_POSITIVE' WHEN 4 THEN 'NEEDS_INVESTIGATION' WHEN 5 THEN 'RESPONSE_RECOMMENDED'
    WHEN 6 THEN 'ACTION_TAKEN' ELSE 'RESOLVED' END AS new_state,
  role AS actor, text AS comment
FROM conversations""",
    "fx_claims": """
SELECT conv_id AS incident_id, turn AS claim_no, text AS claim,
  concat('F', CAST(turn % 9 AS STRING), ',T', CAST(conv_id % 15 AS STRING)) AS refs
FROM conversations""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")


def _needed(text: str, names) -> list[str]:
    import re
    return [n for n in names if re.search(rf"\b{n}\b", text)]


def with_ctes(body: str, views: dict[str, str]) -> str:
    """``WITH`` clause holding the views that ``body`` uses, directly or through other views, in order."""
    used, todo = set(), [body]
    while todo:
        text = todo.pop()
        for n in _needed(text, views):
            if n not in used:
                used.add(n)
                todo.append(views[n])
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in views if n in used)
    recursive = any(_needed(views[n], [n]) for n in used)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}" if ctes else body


def view(spark: SparkSession, sf_dir: str, name: str, views: dict[str, str] = VIEWS, stored: dict[str, str] | None = None) -> DataFrame:
    """A named view over the parquet tables of ``sf_dir``; ``stored`` gives the folders of views already written."""
    import re
    stored = stored or {}
    text = with_ctes(f"SELECT * FROM {name}", {k: v for k, v in views.items() if k not in stored})
    for t, path in {**{t: f"{sf_dir}/{t}.parquet" for t in TABLES}, **stored}.items():
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 parquet.`{path}`", text)
    return spark.sql(text)


def micros(c):
    """Microseconds of a timestamp without zone, whatever the session time zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def web_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter events with ``ts_us`` and ``features``."""
    e = view(spark, sf_dir, "web_events").withColumn("ts_us", micros(F.col("timestamp")))
    return extract_features(e)
