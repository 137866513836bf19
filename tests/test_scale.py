"""Plans that must not change with the size of the files: what goes through the driver, and which rows meet in one task."""

import re

from pyspark.sql import functions as F

from tidewatch.functions import masking as M
from tidewatch.functions.metrics import safe_metrics
from tidewatch.operators.components import _with_min, connected_components
from tidewatch.operators.ingest import to_processed
from tidewatch.operators.rules import touched_events
from tidewatch.operators.sessions import session_counts
from tidewatch.plans.catalog.base import query
from tidewatch.session import checkpointed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_components_send_no_round_through_the_driver(spark):
    name = F.concat(F.lit("web_a|same_session|"), (F.col("id") % 500).cast("string"))
    edges = checkpointed(spark.range(2000).select(name.alias("u"), F.concat(F.lit("web_a|same_ip|"), (F.col("id") % 3).cast("string")).alias("v")).distinct())
    assert "BroadcastHashJoin" not in plan(_with_min(edges))
    found = {tuple(r) for r in connected_components(edges, "u", "v").collect()}
    assert len(found) == 503 and {c for _, c in found} == {"web_a|same_ip|0"}


def test_compressed_files_are_not_taken_for_small_tables(spark):
    """The files of these 400,000 names are smaller than the broadcast threshold, the rows are many times larger."""
    @query
    def joined(spark, sf):
        rows = checkpointed(spark.range(400_000).select(F.col("id"), F.concat(F.lit("web_a|same_user|a rather long name of a node|"), (F.col("id") % 1000).cast("string")).alias("node")))
        return rows.join(rows.withColumnRenamed("node", "other"), "id")
    spark.conf.unset("spark.sql.sources.fileCompressionFactor")
    assert "BroadcastHashJoin" not in plan(joined(spark, ""))


def _raw(spark):
    return spark.createDataFrame([("web_a", 1, "page_view", "{}"), ("web_b", 2, "page_view", "{}"), ("web_c", 3, "page_view", "{}")],
                                 "website_id STRING, event_id BIGINT, event_type STRING, attributes STRING").select(
        "*", *[F.lit(None).cast("string").alias(c) for c in ("session_id", "user_id", "source_ip", "user_agent", "method", "endpoint")],
        F.lit("sdk").alias("source"), F.lit(None).cast("int").alias("status_code"), F.current_timestamp().alias("timestamp"), F.lit('{"a":1}').alias("raw"))


def test_stored_events_are_not_shuffled_by_tenant(spark):
    sites = spark.createDataFrame([("web_a", True), ("web_b", False)], "website_id STRING, retain_raw_data BOOLEAN").repartition(3).groupBy("website_id").agg(
        F.max("retain_raw_data").alias("retain_raw_data"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = to_processed(_raw(spark), sites)
        assert "hashpartitioning(website_id" not in plan(out)
        assert {r.event_id: r.raw_data for r in out.select("event_id", "raw_data").collect()} == {1: '{"a":1}', 2: None, 3: None}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_events_without_a_key_do_not_meet_in_one_task(spark):
    rows = [("w", 1, "1.1.1.1", None, 10), ("w", 2, "1.1.1.1", "s", 20), ("w", 3, None, None, 5), ("w", 4, "2.2.2.2", "", 30), ("w", 5, "", "s", 1), ("v", 6, "1.1.1.1", None, 20)]
    store = spark.createDataFrame(rows, "website_id STRING, event_id INT, source_ip STRING, session_id STRING, ts_us BIGINT")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = touched_events(store.where("event_id = 2"), store, None)
        assert sorted(r.event_id for r in out.collect()) == [1, 2, 5]
        assert sorted(r.event_id for r in touched_events(store.where("event_id = 3"), store, 24).collect()) == [3]
        text = plan(out)
        keyed = re.findall(r"hashpartitioning\(([^)]*), \d+\), ENSURE", text)
        assert keyed and any("_slice" in k for k in keyed)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_masks_look_only_at_texts_that_can_hold_a_secret(spark):
    odd = ["eyJabcdef.abcdef12.abcdefgh x", "BEARER abcdefghijk", "bEaReR  abcdefgh12", "paſſword=hunter2", "toKen: abc", "api-Key : zz9", "a@b.co",
           "4111 1111 1111 1111", "٤" * 13, "x1234567890123", "1234-5678-9012-3", "1" * 20, None, "", "plain text of no interest"]
    d = spark.createDataFrame(list(enumerate(odd)), "id INT, t STRING")

    def plain(c):
        for pattern, by in (("(?U)" + M.JWT, M.REDACTED), ("(?U)" + M.BEARER, "Bearer " + M.REDACTED), ("(?U)" + M.KEY_VALUE, "$1=" + M.REDACTED), (M.EMAIL, "[EMAIL]"), ("(?U)" + M.CARD, "[NUMBER]")):
            c = F.regexp_replace(c, pattern, by)
        return c
    rows = d.select("id", M.mask_text(F.col("t")).alias("a"), plain(F.col("t")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert "contains(" in plan(d.select(M.mask_text(F.col("t")).alias("a"))).lower()


def test_metrics_are_made_safe_once(spark):
    m = F.create_map(F.lit("a"), F.col("x"), F.lit("o"), F.to_json(F.struct("x", F.struct("x").alias("deep"))))
    rows = spark.createDataFrame([("seen <b>",), ("10.0.0.1",), ("[1,2]",), ("1.23456",)], "x STRING")
    out = rows.select(safe_metrics(m).alias("m"))
    assert plan(out).count("from_json") == 1
    assert [r.m for r in out.collect()] == [{"a": "seen b", "o": '{"x":"seen b"}'}, {}, {"a_count": "2", "o": '{"x_count":"2"}'},
                                            {"a": "1.2346", "o": '{"x":"1.2346"}'}]


def test_distinct_counts_do_not_repeat_whole_events(spark):
    rows = [("w", "s", "1.1.1.1", "u1", "login_failure", "/a"), ("w", "s", "1.1.1.1", "u2", "page_view", "/a"), ("w", "s", "2.2.2.2", "", "page_view", "/b"),
            ("w", "t", None, None, "page_view", ""), (None, "s", "1.1.1.1", "u1", "login_failure", None)]
    e = spark.createDataFrame(rows, "website_id STRING, session_id STRING, source_ip STRING, user_id STRING, event_type STRING, path STRING").select(
        "*", F.monotonically_increasing_id().alias("event_id"), F.lit(1).cast("bigint").alias("ts_us"), F.struct(
            "path", (F.col("event_type") == "page_view").alias("is_request_event"), F.lit(0).alias("interaction_total"), F.lit(False).alias("is_sensitive_endpoint"),
            F.lit(False).alias("is_error_status"), F.lit("browser").alias("ua_class"), F.lit(False).alias("webdriver")).alias("features"))
    out = session_counts(e)
    assert "Expand" not in plan(out)
    names = ["source_ip_count", "user_count", "distinct_paths", "distinct_failed_users", "event_count"]
    assert {(r.website_id, r.session_key): tuple(r[n] for n in names) for r in out.collect()} == {("w", "s"): (2, 2, 2, 1, 3), ("w", "t"): (0, 0, 0, 0, 1), (None, "s"): (1, 1, 0, 1, 1)}


def test_a_round_of_components_plans_its_edges_once(spark, monkeypatch):
    from tidewatch.operators import components
    rounds, cut = [], components._cut
    monkeypatch.setattr(components, "_cut", lambda df: rounds.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    edges = spark.createDataFrame([(i + 1, i) for i in range(6)], "u BIGINT, v BIGINT")
    assert {tuple(r) for r in connected_components(edges, "u", "v").collect()} == {(i, 0) for i in range(7)}
    assert len(rounds) > 1 and all(p.count("Relation") <= 4 and "Union" not in p for p in rounds[1:])    # rows and minima of two joins


def test_findings_of_the_correlation_queries_are_read_not_worked_out_again(spark):
    from tidewatch.plans.catalog import correlate
    sf = "/root/testdata/sf0.001"
    found, by_reference = correlate.findings(spark, sf), correlate.cited(spark, sf)
    assert all("Window" not in plan(x) and "Join" not in plan(x) for x in (found, by_reference.members))
    assert found.count() > 0


def test_timeline_works_nothing_out_twice(spark, monkeypatch):
    from tidewatch.operators import timeline as T
    from tidewatch.plans.catalog import timeline as catalog
    sf = "/root/testdata/sf0.001"
    events, found, incidents = catalog.incident_events(spark, sf), catalog.cited_findings(spark, sf), catalog.incidents(spark, sf)
    whole = T.timeline(events, found, incidents, catalog.P)
    text = whole._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Window") == 0 and whole.count() > incidents.count()      # entries were numbered once, when they were written
    assert whole.where("evidence_type NOT IN ('system', 'ai_inference')").count() == T.timeline(events, found, None, catalog.P).count()


def test_repeats_of_a_spread_join_count_in_its_size(spark):
    """16 repeats of 1000 rows are over the threshold, 1000 rows are not: they must not be sent through the driver."""
    from tidewatch.operators.ordered import spread_join
    big = spark.range(5000).select((F.col("id") % 1200).alias("k"), F.col("id").alias("event_id"))
    small = spark.range(1000).select(F.col("id").alias("k"), F.struct((F.col("id") * 2).alias("twice")).alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold, sent in (("60000", False), ("10m", True)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            out = {how: spread_join(big, small, ["k"], how) for how in ("inner", "left", "left_semi")}
            assert all(("BroadcastHashJoin" in plan(d)) == sent for d in out.values())
            assert {(r.k, r.event_id, r.v.twice) for r in out["inner"].collect()} == {(i % 1200, i, i % 1200 * 2) for i in range(5000) if i % 1200 < 1000}
            assert out["left"].where("v IS NULL").count() == sum(i % 1200 >= 1000 for i in range(5000))
            assert out["left"].count() == 5000 and out["left_semi"].count() == out["inner"].count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
