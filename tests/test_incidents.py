"""Risk, lifecycle, anomaly model and streaming."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import anomaly as A
from tidewatch.operators import evidence as E
from tidewatch.operators import lifecycle as L
from tidewatch.operators import risk as R
from tidewatch.operators import sessions as S
from tidewatch.operators.forest import mean_path
from tidewatch.params import STAGES, STATES, TRANSITIONS, Anomaly
from tidewatch.streaming import jobs as J

FIND = "website_id STRING, incident_id STRING, finding_id STRING, agent_name STRING, finding_type STRING, category STRING, rule_id STRING, confidence DOUBLE, anomaly_score DOUBLE"


def scored(spark, findings=(), stages=(), events=144, strength=0.75, paths=("/api/admin/customers/export",), intel=None, truncated=False):
    f = spark.createDataFrame([("w", "i", f"f{n}", a, t, c, "R", conf, s) for n, (a, t, c, conf, s) in enumerate(findings)], FIND)
    i = spark.createDataFrame([("w", "i", events, truncated)], "website_id STRING, incident_id STRING, event_count BIGINT, truncated BOOLEAN")
    st = spark.createDataFrame([("w", "i", s) for s in stages], "website_id STRING, incident_id STRING, stage STRING")
    li = spark.createDataFrame([("w", "i", strength)] if strength is not None else [], "website_id STRING, incident_id STRING, strength DOUBLE")
    re = spark.createDataFrame([("w", "i", list(paths))], "website_id STRING, incident_id STRING, affected_resources ARRAY<STRING>")
    ti = None if intel is None else spark.createDataFrame([("w", "i", *x) for x in intel], "website_id STRING, incident_id STRING, indicator_type STRING, status STRING, synthetic BOOLEAN")
    r = R.score_incidents(R.risk_inputs(i, f, li, st, re, ti)).first()
    return r, {x["factor"]: (x["value"], x["status"]) for x in r.factors}


def plain_risk(findings, stages, events, strength, paths, intel, p):
    """The eight factors of an incident, written out."""
    by = lambda kind: [f for f in findings if f[1] == kind]
    clamp = lambda v: max(0.0, min(1.0, v))
    attack = by("attack_indicator")
    real = [x for x in intel or [] if x[1] == "evidence_found" and x[0] in ("ip", "domain", "cve") and not x[2]]
    asset = [max([v for k, v in p.asset_values.items() if (x.lower() + "/").startswith(k.lower().rstrip("/") + "/")], default=p.asset_default,
                 key=lambda v: max(len(k) for k, w in p.asset_values.items() if w == v)) for x in paths]
    login, sensitive = "authentication_success" in stages, "sensitive_access" in stages
    value = {
        "behavior": max([f[3] for f in by("behavior_anomaly")], default=0.0),
        "anomaly": clamp((max([f[4] for f in by("ml_anomaly")], default=0.0) - p.score_floor) / (1 - p.score_floor)),
        "attack_indicators": clamp(max([f[3] for f in attack], default=0.0) + p.breadth_bonus * (len({f[2] for f in attack}) - 1)) if attack else 0.0,
        "authentication": max([p.auth_values.get(f[2], p.auth_default) for f in by("auth_anomaly")], default=0.0),
        "sensitive_endpoint": (p.sensitive_login_value if login else p.sensitive_value) if sensitive else 0.0,
        "correlation": (p.stage_weight * len(set(stages)) / len(STAGES) + p.size_weight * clamp(math.log1p(events) / math.log1p(p.size_saturation)) + p.strength_weight * (strength or 0))
        / (p.stage_weight + p.size_weight + p.strength_weight),
        "asset_impact": max(asset, default=0.0),
        "threat_intel": clamp(p.intel_first + p.intel_each * (len(real) - 1)) if real else 0.0,
    }
    return value, round(100 * sum(p.weights[k] * v for k, v in value.items()) / sum(p.weights[k] for k in value), 1)


@pytest.mark.parametrize("seed", range(4))
def test_risk_of_generated_incidents(spark, seed):
    rng = random.Random(seed)
    kinds = [("rule_engine", "auth_anomaly"), ("rule_engine", "attack_indicator"), ("rule_engine", "behavior_anomaly"), ("anomaly_model", "ml_anomaly")]
    findings = []
    for _ in range(rng.randint(0, 7)):
        agent, kind = rng.choice(kinds)
        findings.append((agent, kind, rng.choice([*R.Risk().auth_values, "x1", "x2"]), round(rng.uniform(0.3, 0.95), 2), round(rng.uniform(0.4, 0.95), 2) if kind == "ml_anomaly" else None))
    stages = rng.sample(STAGES, rng.randint(0, len(STAGES)))
    paths = rng.sample(["/zz", "/api/admin/q", "/api/account/payment-methods", "/api/search/x"], rng.randint(0, 3))
    intel = rng.choice([None, [("cve", "evidence_found", False)] * rng.randint(1, 3), [("ip", "evidence_found", True)], [("domain", "no_evidence", False)]])
    events, strength = rng.randint(1, 400), rng.choice([None, round(rng.random(), 2)])
    r, f = scored(spark, findings, stages, events, strength, paths, intel)
    value, score = plain_risk(findings, stages, events, strength, paths, intel, R.Risk())
    assert {k: v for k, (v, _) in f.items()} == pytest.approx(value, abs=1e-3)
    assert r.risk_score == pytest.approx(score, abs=0.11) and 0 <= r.confidence <= 1
    assert ("threat_intel_not_run" in r.evidence_gaps) == (intel is None)
    cut = scored(spark, findings, stages, events, strength, paths, intel, truncated=True)[0]
    assert cut.confidence <= r.confidence and "truncated_evidence" in cut.evidence_gaps


def test_replay_of_many_moves_equals_a_fold(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 7)
    rng = random.Random(2)
    rows = [(k, i, rng.choice(STATES)) for k in ("a", "b") for i in range(60)]
    want, cur = {}, {}
    for k, i, s in rows:
        c = cur.get(k, "DETECTED")
        cur[k] = s if s in TRANSITIONS[c] else c
        want[k, i] = (c, cur[k], s in TRANSITIONS[c])
    d = spark.createDataFrame(rows, "k STRING, seq BIGINT, new_state STRING").repartition(3)
    assert {(r.k, r.seq): (r.from_state, r.state, r.accepted) for r in L.replay_lifecycle(d, ["k"]).collect()} == want


def test_decisions_advance_and_alert_follows(spark):
    rows = [("a", 1, "CONFIRMED", True), ("a", 2, "CONFIRMED", True), ("b", 1, "CONFIRMED", False), ("b", 2, "FALSE_POSITIVE", False)]
    d = L.apply_decisions(spark.createDataFrame(rows, "k STRING, seq BIGINT, decision STRING, has_recommendations BOOLEAN"), ["k"])
    got = {(r.k, r.seq): (r.state, r.refused, r.advanced) for r in d.collect()}
    assert got == {("a", 1): ("RESPONSE_RECOMMENDED", False, True), ("a", 2): ("RESPONSE_RECOMMENDED", True, False), ("b", 1): ("CONFIRMED", False, False),
                   ("b", 2): ("FALSE_POSITIVE", False, False)}
    cases = [("INVESTIGATING", "closed", "open"), ("INVESTIGATING", "acknowledged", "acknowledged"), ("RESOLVED", "open", "closed"), ("CONFIRMED", "open", "acknowledged")]
    d = spark.createDataFrame(cases, "s STRING, a STRING, w STRING").select("w", L.alert_status_follow(F.col("s"), F.col("a")).alias("g"))
    assert all(r.w == r.g for r in d.collect())


def test_confidence_is_capped_and_missing_is_filled(spark):
    v, b = E.cap_confidence(F.col("m"), F.col("e"))
    d = spark.createDataFrame([(0.9, 0.5), (0.3, 0.5), (None, 0.5), (7.0, 1.0)], "m DOUBLE, e DOUBLE").select(v.alias("v"), b.alias("b"))
    assert [r.v for r in d.collect()] == [0.5, 0.3, 0.5, 1.0]


def test_model_output_is_found_in_prose(spark):
    rows = [("```json\n{\"a\": 1}\n```",), ("Sure! {\"a\": {\"b\": \"}\"}} hope it helps {",), ("nothing",), ("{bad",), (None,)]
    d = E.parse_model_output(spark.createDataFrame(rows, "output STRING"))
    assert [r.parse_status for r in d.collect()] == ["ok", "ok", "invalid_output", "invalid_output", "invalid_output"]


def baseline_rows(mk, n=60):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        t = rng.uniform(0, 3600)
        for _ in range(rng.randint(3, 8)):
            rows += [mk.ev("page_view", t, ip=f"192.0.2.{i + 1}", sid=f"n{i}", ep=rng.choice(["/", "/products", "/about", "/cart"])),
                     mk.ev("interaction", t + 3, ip=f"192.0.2.{i + 1}", sid=f"n{i}", attrs='{"clicks":%d,"mouse_moves":%d}' % (rng.randint(1, 4), rng.randint(50, 250)))]
            t += rng.uniform(8, 40)
    return rows


def test_anomaly_model_flags_the_attacker_only(mk):
    rows = baseline_rows(mk) + mk.failures(100, step=0.4, users=[f"u{i}" for i in range(30)], sid="atk", ip="203.0.113.99")
    rows += [mk.ev("sensitive_endpoint_access", 40 + i, sid="atk", ip="203.0.113.99", ep="/api/admin/users", status=200) for i in range(5)]
    e = mk.frame(rows)
    for seed in (42, 7):
        f = A.anomaly_findings(e, S.session_summary(e), Anomaly(trees=100, seed=seed)).collect()
        assert [x.subject for x in f] == ["atk"] and 0.5 <= f[0].confidence <= 0.9 and len(f[0].event_ids) == 105
    assert A.anomaly_findings(e, S.session_summary(e), Anomaly(min_sessions=500)).count() == 0
    assert np.allclose(mean_path([1, 2, 256]), [0, 1, 10.2448], atol=1e-3)


def test_streams_equal_batch(spark, mk, tmp_path):
    rows = mk.failures(12, users=list("abcdef")) + [mk.ev("login_success", 30, uid="a"), mk.ev("http_request", 40, ep="/p?id=1 UNION SELECT 1")]
    e = mk.frame(rows)
    src = str(tmp_path / "ev")
    e.where(F.col("ts_us") < rows[6][3]).write.parquet(f"{src}/batch=0")
    e.where(F.col("ts_us") >= rows[6][3]).write.parquet(f"{src}/batch=1")
    found, seen = str(tmp_path / "f"), str(tmp_path / "a")
    J.detect_stream(spark, src, e.schema, found, seen, str(tmp_path / "c"), once=True, per_trigger=4).awaitTermination()
    from tidewatch.operators.rules import evaluate_rules
    assert {r.finding_id for r in J.current_findings(spark, found, seen).collect()} == {r.finding_id for r in evaluate_rules(e).collect()}
    stream = spark.readStream.schema(e.schema).parquet(f"{src}/*")
    q = J.live_counters(stream, "1 minute").writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM live").first().n == len(rows)
