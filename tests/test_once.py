"""Steps with several readers are worked out once, and rows are shuffled once for them."""

import re

from pyspark.sql import functions as F

from tidewatch.operators import timeline as T
from tidewatch.operators.ordered import top_k
from tidewatch.plans.catalog import timeline as catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_first_rows_of_a_key_are_shuffled_once(spark):
    rows = spark.range(3000).select((F.col("id") % 7).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("ts_us"), F.col("id").alias("event_id"))
    got = top_k(rows, ["k"], [F.asc("ts_us"), F.asc("event_id")], 5, "event_id")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = {}
    for r in rows.collect():
        want.setdefault(r.k, []).append((r.ts_us, r.event_id))
    want = {(k, i + 1, *x) for k, v in want.items() for i, x in enumerate(sorted(v)[:5])}
    assert {(r.k, r["rank"], r.ts_us, r.event_id) for r in got.collect()} == want


def test_citations_meet_events_and_groups_in_one_join(spark):
    rows, found = catalog.rows(spark, SF), catalog.cited_findings(spark, SF)
    events, groups, incidents = catalog.incident_events(spark, SF), catalog.groups(spark, SF), catalog.incidents(spark, SF)
    nodes = T.graph_nodes(events, groups, rows, incidents, found, catalog.P)
    assert plan(nodes).count("Join ") == 7          # lists of addresses, sessions and groups; counts; citations; two of the incident
    at = rows.select("website_id", "event_id", "group_event")
    both = T.cited_in_incident(found, events).join(at, ["website_id", "event_id"])
    one = T.cited_in_incident(found, rows, "group_event")
    assert one.count() == both.count() > 0 and one.select(*both.columns).exceptAll(both).isEmpty()


def test_edges_are_not_worked_out_again_to_be_numbered(spark):
    from tidewatch.plans.catalog.base import fx
    edges = T.graph_edges(catalog.incident_events(spark, SF), catalog.groups(spark, SF), catalog.rows(spark, SF), fx(spark, SF, "fx_links"), catalog.cited_findings(spark, SF))
    assert plan(edges).count("Join ") == 1 and "Union" not in plan(edges)         # rows and the sizes of their buckets
    numbers = edges.groupBy("website_id", "incident_id").agg(F.count("*").alias("n"), F.max("edge_no").alias("last"), F.count_distinct("edge_no").alias("d"))
    assert numbers.where("n <> last OR n <> d").isEmpty() and edges.count() > 0


def test_groups_are_not_worked_out_again_to_be_numbered(spark):
    rows = catalog.rows(spark, SF)
    table = T.group_table(rows)
    assert plan(table).count("Aggregate") == 1                                    # sizes of buckets; the groups themselves are read
    assert table.agg(F.sum("n")).first()[0] == rows.count() > 0


def test_rules_are_worked_out_once_for_findings_and_citations(spark, monkeypatch):
    from tidewatch.operators import rules as R
    from tidewatch.plans.catalog import rules
    from tidewatch.plans.catalog.base import _STORED
    made, real = [], R.all_rules
    monkeypatch.setattr(R, "all_rules", lambda *a: made.append(real(*a)) or made[-1])
    for name in ("findings", "finding_links", "finding_members"):
        monkeypatch.delitem(_STORED, (spark.sparkContext.applicationId, SF, name), raising=False)
    monkeypatch.setattr(rules, "_DETECTED", {}, raising=False)
    found, cited = rules.findings(spark, SF), rules.cited(spark, SF)
    assert len(made) == 1
    assert "Window" not in plan(made[0].hits) and "Window" not in plan(made[0].cites)
    pairs = cited.pairs().groupBy("finding_id").agg(F.count("*").alias("n"))
    assert found.join(pairs, "finding_id", "left").where("n IS NULL OR n <> cited_events").isEmpty() and found.count() > 0


def test_a_batch_is_validated_once_for_accepted_and_rejected_rows(spark, monkeypatch, tmp_path):
    from tidewatch.streaming import jobs
    seen, real = [], jobs._write_batch
    monkeypatch.setattr(jobs, "_write_batch", lambda df, *a: seen.append(df._jdf.queryExecution().withCachedData().toString()) or real(df, *a))
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"events": [{"event_type": "page_view", "endpoint": "/a"}, {"event_type": "no_such"}, 7]}')
    ev, bad, state = (str(tmp_path / n) for n in ("events", "rejects", "state"))
    jobs.ingest_stream(spark, str(source), ev, bad, state, "w", once=True).awaitTermination()
    assert (spark.read.parquet(ev).count(), spark.read.parquet(bad).count()) == (1, 2)
    assert len(seen) == 2 and all(re.search(r"InMemoryRelation \[[^\]]*errors", x) for x in seen)
