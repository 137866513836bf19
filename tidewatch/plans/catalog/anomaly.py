"""Session anomaly model and streaming forms."""

from pyspark.sql import functions as F

from tidewatch.operators import anomaly as A
from tidewatch.operators import sessions as S
from tidewatch.params import ANOMALY_FEATURES, ANOMALY_RULE, Anomaly, Detection
from tidewatch.plans.catalog import ingest as IC
from tidewatch.plans.catalog.base import ORACLE_VIEWS, events, query, stored
from tidewatch.session import scratch_path
from tidewatch.streaming import jobs as J
from tidewatch.streaming.bursts import burst_state as burst_runs

P = Anomaly(min_z=3.0, notable_z=1.0, score_threshold=0.6)


def summary(spark, sf):
    return stored(spark, sf, "session_summary", lambda: S.session_summary(events(spark, sf)))


def matrix(spark, sf):
    return A.session_matrix(summary(spark, sf).withColumn("median_page_gap_s", F.col("median_page_gap_us") / 1e6))


def baseline(spark, sf):
    return stored(spark, sf, "baseline", lambda: A.robust_baseline(matrix(spark, sf)))


def deviations(spark, sf):
    return A.directional_z(matrix(spark, sf), baseline(spark, sf))


@query
def session_matrix(spark, sf):
    return matrix(spark, sf).select(*S.SESSION, *A.FEATURES)


@query
def robust_baseline(spark, sf):
    return A.robust_baseline(matrix(spark, sf)).select("website_id", "feature", F.round("median", 5).alias("median"), F.round("scale", 5).alias("scale"))


@query
def directional_z(spark, sf):
    return deviations(spark, sf).select(*S.SESSION, *[F.round(f"z_{f}", 7).alias(f"z_{f}") for f in A.FEATURES])


@query
def flag_deviations(spark, sf):
    return deviations(spark, sf).where(F.col("max_z") >= P.min_z).select(*S.SESSION, F.round("max_z", 7).alias("max_z"))


@query
def notable_deviations(spark, sf):
    return A.notable_deviations(deviations(spark, sf), P).select(*S.SESSION, "position", "feature", "deviation_z")


def scores(spark, sf):
    return stored(spark, sf, "anomaly_scores", lambda: A.isolation_forest(matrix(spark, sf), baseline(spark, sf), P))


@query
def isolation_forest(spark, sf):
    return A.isolation_forest(matrix(spark, sf), baseline(spark, sf), P).select(*S.SESSION, F.round("anomaly_score", 7).alias("anomaly_score"))


@query
def flag_anomalies(spark, sf):
    flags = A.flag_anomalies(scores(spark, sf), deviations(spark, sf), P)
    return flags.select(*S.SESSION, F.round("anomaly_score", 7).alias("anomaly_score"), F.round("max_z", 7).alias("max_z"), "flagged")


@query
def anomaly_confidence(spark, sf):
    e = events(spark, sf)
    return e.select("event_id", A.anomaly_confidence((F.col("event_id") % 101) / 100, Anomaly()).alias("confidence"))


@query
def anomaly_findings(spark, sf):
    return A.anomaly_findings(events(spark, sf), summary(spark, sf), P).select("finding_id", "website_id", "event_id", "subject", "confidence", "cited_events")


@query
def model_status(spark, sf):
    return A.model_status(matrix(spark, sf), Anomaly(min_sessions=1800))


# ------------------------------------------------------------------------------------------------ streaming
def _envelopes(spark, sf):
    rows = IC.raw_events(spark, sf).withColumn("b", F.floor(F.col("event_id") / 100).cast("bigint"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "raw"))), lambda x: x["raw"])
    path = scratch_path(spark, "stream-in")
    # one file per envelope: whole-file JSON is what the reader expects; each task moves its own files into place
    (rows.groupBy("b").agg(F.concat(F.lit('{"events":['), F.array_join(texts, ","), F.lit("]}")).alias("value"))
     .select("value").write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path))
    return path


@query
def ingest_stream(spark, sf):
    ev, bad, ck = (scratch_path(spark, n) for n in ("stream-events", "stream-rejects", "stream-state"))
    J.ingest_stream(spark, _envelopes(spark, sf), ev, bad, ck, "web_s", once=True, per_trigger=100_000).awaitTermination()
    good = spark.read.parquet(ev).select(F.lit("accepted").alias("outcome"), F.get_json_object("attributes", "$.page_seq").cast("bigint").alias("event_id"))
    rejected = spark.read.parquet(bad).select(F.lit("rejected").alias("outcome"), F.lit(None).cast("bigint").alias("event_id"))
    return good.unionByName(rejected)


@query
def detect_stream(spark, sf):
    """Six lots of shuffled events, two a micro-batch: what is current after the last batch is what one run over all events finds.

    A lot is one file up to 200,000 events and more files beyond, so no task reads or writes a fixed share of a table of any size."""
    from tidewatch.plans.catalog.rules import P as RP
    src, found, seen, ck = (scratch_path(spark, n) for n in ("detect-in", "detect-findings", "detect-analysed", "detect-state"))
    e = events(spark, sf)
    files = max(1, -(-e.count() // 1_200_000))
    e.repartition(6 * files, F.xxhash64("event_id")).write.parquet(f"{src}/batch=0")
    J.detect_stream(spark, src, e.schema, found, seen, ck, Detection(**{**RP.__dict__, "lookback_hours": None}), once=True, per_trigger=2 * files).awaitTermination()
    return J.current_findings(spark, found, seen).select("website_id", "rule_id", "subject", "event_id", "confidence")


DAY_US = 86_400_000_000


def _timed_files(spark, rows, parts):
    """Rows as one file for each value of ``parts``, 0 to 3, in this order, to be read a file a micro-batch."""
    path = scratch_path(spark, "timed-in")
    for i in range(4):
        rows.where(parts == i).coalesce(1).write.parquet(f"{path}/file={i}")
    return path


def _stamped(spark, sf):
    e = events(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return (e, *e.agg(F.min("ts_us"), F.max("ts_us")).first())


@query
def late_and_future_policy(spark, sf):
    """Three files by time and a last one with every tenth event: most of that are late by then; the last day lies in the future."""
    e, low, high = _stamped(spark, sf)
    e = e.select("event_id", "timestamp", "ts_us")
    parts = F.when(F.col("event_id") % 10 == 0, 3).otherwise(F.floor((F.col("ts_us") - low) * 3 / (high - low + 1)))
    accepted, late, refused, marks, ck = (scratch_path(spark, f"policy-{n}") for n in ("accepted", "late", "refused", "marks", "state"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{_timed_files(spark, e, parts)}/*")
    J.policy_stream(stream, accepted, late, refused, marks, ck, now=F.timestamp_micros(F.lit(high - DAY_US)), once=True).awaitTermination()
    kept = [spark.read.parquet(p).select("event_id", "ts_us", F.col("batch").cast("int").alias("batch"), F.lit(n).alias("outcome"))
            for n, p in (("accepted", accepted), ("late", late), ("refused", refused))]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query
def burst_state(spark, sf):
    """Files in turn hold a third of the time each, every event up to 40 hours late; a last event far ahead closes the open runs."""
    e, low, high = _stamped(spark, sf)
    e = e.select("event_id", "website_id", "event_type", "source_ip", "session_id", "user_id", "timestamp", "ts_us")
    delayed = F.col("ts_us") + F.pmod(F.xxhash64("event_id"), F.lit(40 * 3600 * 1_000_000))
    end = e.where("source_ip IS NOT NULL").limit(1).select(*[c for c in e.columns if c not in ("event_type", "timestamp", "ts_us")], F.lit("page_view").alias("event_type"),
                                                          F.timestamp_micros(F.lit(high + 10 * DAY_US)).alias("timestamp"), F.lit(high + 10 * DAY_US).alias("ts_us"))
    parts = F.when(F.col("ts_us") > high, 3).otherwise(F.least(F.floor((delayed - low) * 3 / (high - low + 1)), F.lit(2)))
    path = _timed_files(spark, e.unionByName(end), parts)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    out, ck = scratch_path(spark, "bursts"), scratch_path(spark, "bursts-state")
    (burst_runs(stream, 12 * 3600, 5, "48 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out)


@query
def live_counters(spark, sf):
    rows = events(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    return J.live_counters(rows, "1 hour").select("website_id", "event_type", F.unix_micros("window_start").alias("start_us"), "n")


QUERIES = {f.__name__: f for f in (session_matrix, robust_baseline, directional_z, flag_deviations, notable_deviations, isolation_forest, flag_anomalies,
                                   anomaly_confidence, anomaly_findings, model_status, ingest_stream, detect_stream, late_and_future_policy, burst_state,
                                   live_counters)}

V = ORACLE_VIEWS
V["smat"] = """
SELECT s.website_id, s.session_key, CAST(event_count AS DOUBLE) AS event_count, CAST(distinct_paths AS DOUBLE) AS distinct_paths, CAST(login_failures AS DOUBLE) AS login_failures,
  CAST(distinct_failed_users AS DOUBLE) AS distinct_failed_users, CAST(sensitive_accesses AS DOUBLE) AS sensitive_accesses, error_events / event_count AS error_ratio,
  CAST(COALESCE(p.peak, 0) AS DOUBLE) AS peak_requests_10s, requests_per_min, m.median_gap_us / 1e6 AS median_page_gap_s,
  CASE WHEN page_views > 0 THEN interaction_total / page_views END AS interaction_per_page
FROM summ s LEFT JOIN peak10 p USING (website_id, session_key) LEFT JOIN med m USING (website_id, session_key)"""
V["slong"] = " UNION ALL ".join(f"SELECT website_id, session_key, '{f}' AS feature, {f} AS value, CAST({v[1]} AS DOUBLE) AS floor FROM smat" for f, v in ANOMALY_FEATURES.items())
V["smed"] = "SELECT website_id, feature, COALESCE(median(value), 0) AS median, any_value(floor) AS floor FROM slong GROUP BY 1, 2"
V["sbase"] = """
SELECT website_id, feature, any_value(b.median) AS median, greatest(1.4826 * median(abs(COALESCE(value, b.median) - b.median)),
  (quantile_cont(COALESCE(value, b.median), 0.75) - quantile_cont(COALESCE(value, b.median), 0.25)) / 1.349, any_value(b.floor)) AS scale
FROM slong JOIN smed b USING (website_id, feature) GROUP BY 1, 2"""
V["sz"] = """
SELECT l.website_id, l.session_key, l.feature, greatest(0, (COALESCE(value, median) - median) / scale * CASE WHEN feature IN ('median_page_gap_s', 'interaction_per_page')
  THEN -1 ELSE 1 END) AS z FROM slong l JOIN sbase USING (website_id, feature)"""
# the forest level by level: nodes are paths, chosen features and cuts come from the same hashes
V["if_x"] = f"""
SELECT l.website_id, l.session_key, [{", ".join(f"max(COALESCE(value, median, 0)) FILTER (l.feature = '{f}')" for f in ANOMALY_FEATURES)}] AS x
FROM slong l JOIN sbase USING (website_id, feature) GROUP BY 1, 2"""
V["if_r0"] = f"""
SELECT website_id, tree, session_key, x, '1' AS node FROM (SELECT *, row_number() OVER (PARTITION BY website_id, tree
  ORDER BY md5(concat_ws('|', '{P.seed}', website_id, CAST(tree AS VARCHAR), session_key)), session_key) AS r
  FROM if_x, (SELECT unnest(range({P.trees})) AS tree) t) y WHERE r <= {P.max_samples}"""
V["if_t"] = "SELECT website_id, tree, count(*) AS samples, ceil(log2(greatest(count(*), 2))) AS most FROM if_r0 GROUP BY 1, 2"
_N, LEVELS = len(ANOMALY_FEATURES), 8
for _i in range(LEVELS + 1):
    V[f"if_n{_i}"] = f"""
SELECT website_id, tree, node, n, f, lo[f] + u * (hi[f] - lo[f]) AS cut FROM (
  SELECT website_id, tree, node, n, lo, hi, ('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0 AS u,
    CASE WHEN n > 1 AND {_i} < most AND len(usable) > 0 THEN usable[CAST(1 + ('0x' || substr(h, 1, 8))::BIGINT % len(usable) AS INTEGER)] END AS f
  FROM (SELECT *, list_filter(range(1, {_N + 1}), lambda i: hi[i] > lo[i]) AS usable, md5(concat_ws('|', '{P.seed}', website_id, CAST(tree AS VARCHAR), node)) AS h FROM (
    SELECT website_id, tree, node, count(*) AS n, [{", ".join(f"min(x[{k}])" for k in range(1, _N + 1))}] AS lo, [{", ".join(f"max(x[{k}])" for k in range(1, _N + 1))}] AS hi
    FROM if_r{_i} GROUP BY 1, 2, 3) a JOIN if_t USING (website_id, tree)) b) c"""
    V[f"if_r{_i + 1}"] = f"""
SELECT website_id, tree, session_key, x, node || CASE WHEN x[f] <= cut THEN '0' ELSE '1' END AS node
FROM if_r{_i} JOIN if_n{_i} USING (website_id, tree, node) WHERE f IS NOT NULL"""
    V[f"if_s{_i}"] = ("SELECT website_id, session_key, x, tree, '1' AS node FROM if_x JOIN if_t USING (website_id)" if _i == 0 else f"""
SELECT website_id, session_key, x, tree, node || CASE WHEN x[f] <= cut THEN '0' ELSE '1' END AS node FROM if_s{_i - 1} JOIN if_n{_i - 1} USING (website_id, tree, node) WHERE f IS NOT NULL""")
V["if_leaf"] = " UNION ALL ".join(f"SELECT website_id, session_key, {_i} AS depth, n FROM if_s{_i} JOIN if_n{_i} USING (website_id, tree, node) WHERE f IS NULL" for _i in range(LEVELS + 1))
_C = "CASE WHEN {0} > 2 THEN 2.0 * (ln({0} - 1.0) + 0.5772156649015329) - 2.0 * ({0} - 1.0) / {0} WHEN {0} = 2 THEN 1.0 ELSE 0.0 END"
V["if_score"] = f"""
SELECT website_id, session_key, CASE WHEN norm > 0 THEN pow(2.0, -(total / {P.trees}) / norm) ELSE 0.5 END AS anomaly_score
FROM (SELECT website_id, session_key, sum(depth + {_C.format("n")}) AS total FROM if_leaf GROUP BY 1, 2) a
JOIN (SELECT website_id, {_C.format("max(samples)")} AS norm FROM if_t GROUP BY 1) b USING (website_id)"""
V["if_flag"] = f"""
SELECT website_id, session_key, anomaly_score, max_z, anomaly_score >= {P.score_threshold} AND max_z >= {P.min_z} AS flagged
FROM if_score JOIN (SELECT website_id, session_key, max(z) AS max_z FROM sz GROUP BY 1, 2) z USING (website_id, session_key)"""
V["pol_rows"] = f"""
SELECT event_id, us, CASE WHEN event_id % 10 = 0 THEN 3 ELSE CAST(floor((us - low) * 3 / (high - low + 1)) AS INTEGER) END AS batch, us > high - {DAY_US} + 600000000 AS refused
FROM ev, (SELECT min(us) AS low, max(us) AS high FROM ev) lim"""
V["pol_latest"] = "SELECT batch, max(us) FILTER (NOT refused) AS latest FROM pol_rows GROUP BY 1"
V["pol_marks"] = f"SELECT a.batch, max(c.latest) - {DAY_US} AS mark FROM pol_latest a LEFT JOIN pol_latest c ON c.batch < a.batch GROUP BY 1"
ORACLES = {
    "detect_stream": "SELECT website_id, rule_id, subject, event_id, confidence FROM allf",
    "session_matrix": "SELECT website_id, session_key, " + ", ".join(ANOMALY_FEATURES) + " FROM smat",
    "robust_baseline": "SELECT website_id, feature, round(median, 5) AS median, round(scale, 5) AS scale FROM sbase",
    "directional_z": "SELECT website_id, session_key, " + ", ".join(f"round(max(z) FILTER (feature = '{f}'), 7) AS z_{f}" for f in ANOMALY_FEATURES) + " FROM sz GROUP BY 1, 2",
    "flag_deviations": "SELECT website_id, session_key, round(max(z), 7) AS max_z FROM sz GROUP BY 1, 2 HAVING max(z) >= 3",
    "notable_deviations": """
SELECT website_id, session_key, CAST(r AS INTEGER) AS position, feature, round(z, 2) AS deviation_z FROM (SELECT *, row_number() OVER (PARTITION BY website_id, session_key
  ORDER BY round(z, 2) DESC, feature) AS r FROM sz WHERE z >= 1) x WHERE r <= 5""",
    "anomaly_confidence": """
SELECT event_id, round(CAST(0.5 AS DOUBLE) + CAST(0.4 AS DOUBLE) * greatest(0, least(1, ((event_id % 101) / 100 - CAST(0.65 AS DOUBLE)) / CAST(0.35 AS DOUBLE))), 3) AS confidence FROM ev""",
    "model_status": """
SELECT website_id, count(*) AS sessions, CASE WHEN count(*) < 1800 THEN 'insufficient_baseline' ELSE 'ok' END AS status FROM smat GROUP BY 1""",
    "ingest_stream": """
SELECT CASE WHEN status_code = 500 OR interaction_total IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS outcome,
  CASE WHEN status_code = 500 OR interaction_total IS NOT NULL THEN NULL ELSE event_id END AS event_id FROM ev""",
    "isolation_forest": "SELECT website_id, session_key, round(anomaly_score, 7) AS anomaly_score FROM if_score",
    "flag_anomalies": "SELECT website_id, session_key, round(anomaly_score, 7) AS anomaly_score, round(max_z, 7) AS max_z, flagged FROM if_flag",
    "anomaly_findings": f"""
SELECT 'fnd_' || left(sha256(concat_ws('|', website_id, '{ANOMALY_RULE[0]}', session_key)), 32) AS finding_id, website_id, first_id AS event_id, session_key AS subject,
  round({P.confidence_min} + least(greatest((anomaly_score - {P.score_threshold}) / (1 - {P.score_threshold}), 0), 1) * ({P.confidence_max} - {P.confidence_min}), 3) AS confidence, n AS cited_events
FROM if_flag JOIN (SELECT website_id, session_key, count(*) AS n, arg_min(event_id, (us, event_id)) AS first_id FROM ev GROUP BY 1, 2) e USING (website_id, session_key) WHERE flagged""",
    "late_and_future_policy": """
SELECT event_id, us AS ts_us, batch, CASE WHEN refused THEN 'refused' WHEN us < mark THEN 'late' ELSE 'accepted' END AS outcome FROM pol_rows JOIN pol_marks USING (batch)""",
    "burst_state": "SELECT website_id, entity, n, s_us AS first_us, e_us AS last_us, users AS accounts FROM burst",
    "live_counters": "SELECT website_id, event_type, us - us % 3600000000 AS start_us, count(*) AS n FROM ev GROUP BY 1, 2, 3",
}
