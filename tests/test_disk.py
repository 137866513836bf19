"""What steps shuffle, repeat and leave on disk."""

from pyspark.sql import functions as F

from tidewatch.operators import components
from tidewatch.operators import correlate as C
from tidewatch.operators.citations import Citations
from tidewatch.plans.catalog import base

SF = "/root/testdata/sf0.001"


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_go_when_a_table_is_stored(spark):
    before = shuffle_files(spark)
    name = "test_disk_rows"
    base._STORED.pop((spark.sparkContext.applicationId, SF, name), None)
    out = base.stored(spark, SF, name, lambda: spark.range(1000).select((F.col("id") % 7).alias("k")).repartition(4).groupBy("k").count())
    assert not shuffle_files(spark) - before
    assert out.count() == 7


def test_nodes_that_hang_on_one_smaller_node_take_no_part_in_the_rounds(spark, monkeypatch):
    sizes, cut = [], components._cut

    def counted(df):
        out = cut(df)
        sizes.append(out[1][0])
        return out
    monkeypatch.setattr(components, "_cut", counted)
    edges = [(0, i) for i in range(1, 400)] + [(1000, 1001), (1001, 1002), (1000, 1002), (1002, 1003), (5000, 5001), (6001, 6000), (6001, 5999)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src BIGINT, dst BIGINT")).collect()}
    want = {i: 0 for i in range(400)} | {i: 1000 for i in range(1000, 1004)} | {5000: 5000, 5001: 5000} | {i: 5999 for i in (5999, 6000, 6001)}
    assert got == want
    assert sizes[0] == len(edges) and max(sizes[1:]) <= 5             # of the stars only their middles are left


def test_members_of_clusters_meet_them_without_sixteen_repeats(spark, monkeypatch):
    seen, real = [], C.spread_join
    monkeypatch.setattr(C, "spread_join", lambda *a, **k: seen.append(k.get("n", 16)) or real(*a, **k))
    events = spark.createDataFrame([("w", i, i * 1_000_000, "1.1.1.1" if i < 6 else None, f"s{i // 3}", "", "page_view") for i in range(12)],
                                   "website_id STRING, event_id BIGINT, ts_us BIGINT, source_ip STRING, session_id STRING, user_id STRING, event_type STRING")
    findings = spark.createDataFrame([("w", "f1", 2), ("w", "f2", 10)], "website_id STRING, finding_id STRING, event_id BIGINT")
    cited = Citations.of(spark.createDataFrame([("w", "f1", 2), ("w", "f1", 8), ("w", "f2", 10)], "website_id STRING, finding_id STRING, event_id BIGINT"))
    got = {}
    for r in C.clusters(events, findings, cited).collect():
        got.setdefault(r.cluster_event, []).append((r.event_id, r.ts_us, r.is_seed))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(i, i * 1_000_000, i in (2, 8, 10)) for i in ids] for k, ids in {0: range(6), 6: range(6, 9), 9: range(9, 12)}.items()}
    assert seen and max(seen) <= 2


def test_matching_stops_when_no_component_is_large(spark, monkeypatch):
    seen, real = [], C.connected_components
    monkeypatch.setattr(C, "connected_components", lambda *a: seen.append(1) or real(*a))
    writes, cut = [], C.checkpointed
    monkeypatch.setattr(C, "checkpointed", lambda *a: writes.append(1) or cut(*a))
    cand = spark.createDataFrame([("w", 1, 9, 0.5, 0, "c1"), ("w", 2, 8, 0.5, 0, "c2")], "website_id STRING, cluster_event BIGINT, event_count BIGINT, max_confidence DOUBLE, first_us BIGINT, cluster_id STRING")
    members = spark.createDataFrame([("w", 1, 1), ("w", 1, 2), ("w", 2, 3)], "website_id STRING, cluster_event BIGINT, event_id BIGINT")
    existing = spark.createDataFrame([("w", "a", 1), ("w", "a", 2), ("w", "a", 3), ("w", "b", 3)], "website_id STRING, incident_id STRING, event_id BIGINT")
    got = {r.cluster_event: r.incident_id for r in C.match_incidents(cand, members, existing).collect()}
    assert got == {1: "a", 2: "b"} and len(seen) == 1 and len(writes) == 4


def test_links_of_a_summary_are_not_made_distinct_again(spark):
    from tidewatch.plans.catalog import correlate
    whole = C.cluster_summary(correlate.members(spark, SF), correlate.findings(spark, SF), correlate.links(spark, SF), correlate.stages(spark, SF), correlate.P)
    text = whole._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in text.splitlines() if "Aggregate [" in x and "related_event_id#" in x.split("],")[0]]
    assert correlate.links(spark, SF).count() == correlate.links(spark, SF).distinct().count()


def test_groups_of_reports_are_joined_once_and_read_where_they_are_stored(spark, monkeypatch):
    from tidewatch.operators import timeline as T
    from tidewatch.plans.catalog import timeline as catalog
    rows, groups, events, found = catalog.rows(spark, SF), catalog.groups(spark, SF), catalog.incident_events(spark, SF), catalog.cited_findings(spark, SF)
    seen, real = [], T.spread_join
    monkeypatch.setattr(T, "spread_join", lambda *a, **k: seen.append(k.get("n", 16)) or real(*a, **k))
    best = T.best_relationship(groups, rows, base.fx(spark, SF, "fx_links"))
    text = best._jdf.queryExecution().optimizedPlan().toString()
    assert seen == [2] and text.count("Join ") == 2 and best.count() > 0         # links with the ends of one group and the starts of the next
    want = T.timeline(events, found, None, catalog.P)
    monkeypatch.setattr(T, "grouped", None)
    monkeypatch.setattr(T, "group_table", None)
    got = T.timeline(events, found, None, catalog.P, rows, groups)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
