"""Streams over several micro-batches against the same rules on the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.rules import bursts, evaluate_rules, failure_runs
from tidewatch.streaming import jobs as J
from tidewatch.streaming.bursts import burst_state


def written(rows, parts, path):
    """``rows`` as one file for each part, in turn; ``parts`` gives each row's part."""
    for i in range(4):
        rows.where(parts == i).coalesce(1).write.parquet(f"{path}/file={i}")
    return f"{path}/*"


def test_open_runs_are_exact_whatever_the_order(spark, mk, tmp_path):
    r = random.Random(4)
    rows = []
    for ip in ("203.0.113.1", "203.0.113.2", None):
        t = 0.0
        for _ in range(250):
            t += r.choice([0, 1, 5, 29.999999, 30, 30.000001, 31, 400])
            rows.append(mk.ev("login_failure", t, ip=ip, sid="s", uid=r.choice(["a", "b", "c", "", None])))
    rows += [mk.ev("login_failure", 40, ip=None, sid=None), mk.ev("http_request", 60, ip="203.0.113.1")]
    e = mk.frame(rows)
    low, high = e.agg(F.min("ts_us"), F.max("ts_us")).first()
    end = mk.frame([mk.ev("page_view", (high - low) / 1e6 + 9_000)])
    parts = F.when(F.col("ts_us") > high, 3).otherwise(F.least(F.floor((F.col("ts_us") + F.pmod(F.xxhash64("event_id"), F.lit(1_500_000_000)) - low) * 3 / (high - low + 1)), F.lit(2)))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(written(e.unionByName(end), parts, str(tmp_path / "in")))
    (burst_state(stream, 30, 3, "30 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
     .trigger(availableNow=True).start().awaitTermination())
    got = sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    want = bursts(failure_runs(e, 30), 3).select("website_id", "entity", "n", "run_us", "end_us", "accounts")
    assert got == sorted(tuple(x) for x in want.collect()) and len(got) > 20
    assert sorted(tuple(x) for x in burst_state(e, 30, 3).collect()) == got


@pytest.mark.parametrize("step, runs", [(30, [10]), (31, [])])
def test_a_gap_of_exactly_the_limit_is_kept(mk, step, runs):
    assert [r.n for r in burst_state(mk.frame(mk.failures(10, step=step))).collect()] == runs


def test_late_and_future_events_are_kept_apart_and_replayed(spark, mk, tmp_path):
    day = 86_400
    rows = mk.failures(12, start=0, users=list("abcdef")) + [mk.ev("page_view", 2 * day, ip="203.0.113.7", sid="s7"), mk.ev("page_view", 3 * day, ip="203.0.113.8", sid="s8")]
    rows += [mk.ev("page_view", 9 * day, ip="203.0.113.9", sid="s9")]
    e = mk.frame(rows)
    n = F.substring("event_id", -6, 6).cast("int")
    first = e.agg(F.min(n)).first()[0]
    # the last seven failures come after an event two days later; the event of day nine is in the future
    parts = F.when(n < first + 5, 0).when(n == first + 12, 1).when(n == first + 13, 3).otherwise(2)
    path = {k: str(tmp_path / k) for k in ("accepted", "late", "refused", "marks", "c")}
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(written(e, parts, str(tmp_path / "in")))
    now = F.timestamp_micros(F.lit(e.agg(F.min("ts_us")).first()[0] + 4 * day * 1_000_000))
    J.policy_stream(stream, path["accepted"], path["late"], path["refused"], path["marks"], path["c"], now=now, once=True).awaitTermination()
    got = {k: sorted(int(r.event_id[-6:]) - first for r in spark.read.parquet(path[k]).collect()) for k in ("accepted", "late", "refused")}
    assert got == {"accepted": [0, 1, 2, 3, 4, 12, 13], "late": list(range(5, 12)), "refused": [14]}
    store = spark.read.schema(e.schema).parquet(path["accepted"])
    before = evaluate_rules(store)
    assert "R-AUTH-001" not in {f.rule_id for f in before.collect()}
    after = J.replay_late(spark, path["accepted"], path["late"], e.schema, before)
    assert {f.finding_id for f in after.collect()} == {f.finding_id for f in evaluate_rules(e.where(n < first + 14)).collect()}
    assert "R-AUTH-001" in {f.rule_id for f in after.collect()}


def test_incremental_reads_prune_days_and_keep_the_schema(spark, mk, tmp_path):
    day = 86_400
    e = mk.frame([mk.ev("page_view", d * day, ip=f"203.0.113.{d}", sid=None) for d in range(1, 9)])
    path = str(tmp_path / "ev")
    e.withColumn("event_date", F.to_date("timestamp")).write.partitionBy("event_date").parquet(f"{path}/batch=0")
    schema = e.withColumn("event_date", F.to_date("timestamp")).schema
    since = e.agg(F.max("ts_us")).first()[0] - 2 * day * 1_000_000
    rows = J.read_events(spark, path, schema, since)
    assert rows.columns == schema.names and rows.count() == 3
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert J.read_events(spark, path, e.schema).count() == 8
