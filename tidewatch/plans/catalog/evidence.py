"""Evidence sets, model-output checks, alerts and lifecycle."""

from pyspark.sql import functions as F

from tidewatch.functions import text as TX
from tidewatch.operators import evidence as E
from tidewatch.operators import lifecycle as L
from tidewatch.operators import risk as R
from tidewatch.operators import timeline as TL
from tidewatch.operators import views as Q
from tidewatch.params import ACTIONS, OVERCONFIDENT, STATES, TRANSITIONS
from tidewatch.plans.catalog import risk as RC
from tidewatch.plans.catalog import timeline as TC
from tidewatch.plans.catalog import views as VC
from tidewatch.plans.catalog.base import ORACLE_VIEWS, events, fx, joined, query, stored, table
from tidewatch.plans.catalog.correlate import findings as cited

I = "incident_id"


def fx_stage_ends(spark, sf):
    s = fx(spark, sf, "fx_stages")
    order = F.struct("timestamp", "event_id")
    return s.groupBy(*E.INCIDENT, "stage").agg(F.count("*").alias("n"), F.min_by("event_id", order).alias("first_event_id"),
                                               F.max_by("event_id", order).alias("last_event_id"))


def bundles(spark, sf):
    ids = TL.first_ids(TC.incident_events(spark, sf), E.INCIDENT, 10)
    return fx(spark, sf, "fx_incidents").join(ids, E.INCIDENT)


def timeline(spark, sf):
    return stored(spark, sf, "timeline", lambda: TL.timeline(TC.incident_events(spark, sf), cited(spark, sf), None, TC.P, TC.rows(spark, sf), TC.groups(spark, sf)))


def refs(spark, sf):
    return E.evidence_refs(bundles(spark, sf), cited(spark, sf), fx_stage_ends(spark, sf), R.risk_factors(RC.inputs(spark, sf)),
                           fx(spark, sf, "fx_intel"), timeline(spark, sf))


@query
def evidence_refs(spark, sf):
    return refs(spark, sf).select(*E.INCIDENT, "label", "kind", joined("event_ids").alias("event_ids"), joined("finding_ids").alias("finding_ids"))


@query
def rank_findings(spark, sf):
    best, _ = E.rank_findings(fx(spark, sf, "fx_findings"))
    return best.select(*E.INCIDENT, "finding_id", "label")


@query
def omitted_findings(spark, sf):
    return E.rank_findings(fx(spark, sf, "fx_findings"))[1]


@query
def evidence_facts(spark, sf):
    e = events(spark, sf).groupBy("website_id", F.col("user_id").alias(I)).agg(
        F.count("*").alias("event_count"), F.count_if(F.col("event_type") == "waf_alert").alias("seed_event_count"),
        F.count_distinct("source_ip").alias("source_count"), F.count_distinct("session_id").alias("session_count"), F.count_distinct("user_id").alias("account_count"))
    return E.evidence_facts(e, fx_stage_ends(spark, sf), fx(spark, sf, "fx_incidents").select(*E.INCIDENT, "risk_level", F.lit(1).alias("risk_score"), F.lit(2).alias("confidence")))


@query
def fit_budget(spark, sf):
    c = table(spark, sf, "conversations")
    section = F.when(F.col("turn") % 4 == 0, "timeline").when(F.col("turn") % 4 == 1, "threat_intel").when(F.col("turn") % 4 == 2, "findings").otherwise("known_limitations")
    items = c.select("conv_id", section.alias("section"), F.length("text").alias("chars"), "turn")
    items = items.withColumn("position", F.floor(F.col("turn") / 4) + 4)
    return E.fit_budget(items, ["conv_id"], 900).select("conv_id", "turn", "section", "dropped")


@query
def bundle_fingerprint(spark, sf):
    return E.bundle_fingerprint(fx(spark, sf, "fx_incidents"), ["incident_id", "title", "event_count"]).select(*E.INCIDENT, "fingerprint")


@query
def role_summaries(spark, sf):
    return E.role_summaries(fx(spark, sf, "fx_findings"), fx(spark, sf, "fx_incidents")).withColumn("categories", joined("categories"))


@query
def role_indicators(spark, sf):
    return E.role_indicators(cited(spark, sf)).withColumn("event_ids", joined("event_ids"))


def claims(spark, sf):
    return fx(spark, sf, "fx_claims").withColumn("refs", F.split("refs", ","))


def labels(spark, sf):
    """Known labels of every conversation: F1–F8 and T1–T12."""
    k = F.concat(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat(F.lit("F"), i.cast("string"))),
                 F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("T"), i.cast("string"))))
    d = fx(spark, sf, "fx_claims").select(I).distinct().select(I, F.explode(k).alias("label"))
    return d.withColumn("event_ids", F.array(F.concat(F.lit("e-"), "label"))).withColumn(
        "finding_ids", F.when(F.col("label").startswith("F"), F.array(F.concat(F.lit("f-"), "label"))))


def resolved(spark, sf):
    return E.resolve_refs(claims(spark, sf), labels(spark, sf), [I, "claim_no"], [I])


@query
def resolve_refs(spark, sf):
    return resolved(spark, sf).select(I, "claim_no", joined("labels").alias("labels"), "invalid", joined("event_ids").alias("event_ids"),
                                      joined("finding_ids").alias("finding_ids"))


def grounded(spark, sf):
    return E.ground_claims(resolved(spark, sf), [I], p=E.Evidence(claims=3))


@query
def ground_claims(spark, sf):
    return grounded(spark, sf).select(I, "claim_no", "supported", "kept")


@query
def grounding_report(spark, sf):
    hyp = resolved(spark, sf).where("claim_no = 0").select(I, "labels")
    hyp = hyp.unionByName(hyp.where(F.col(I) % 2 == 0).select((-1 - F.col(I)).alias(I), "labels"))       # these have no claims
    return E.grounding_report(grounded(spark, sf), hyp, [I])


@query
def cap_confidence(spark, sf):
    i = fx(spark, sf, "fx_incidents")
    value, basis = E.cap_confidence(F.when(F.col("created_seq") % 5 > 0, F.col("created_seq") % 150 / 100), F.col("confidence"))
    return i.select(*E.INCIDENT, F.round(value, 4).alias("value"), F.left(basis, F.lit(20)).alias("basis"))


def recommendations(spark, sf):
    acts = F.array(*[F.lit(a) for a in (*ACTIONS, "Block Source-Review", "reboot")])
    r = claims(spark, sf).withColumn("website_id", F.lit("web_a"))
    return r.select("website_id", I, F.col("claim_no").alias("rec_no"), F.get(acts, ((F.col(I) * 5 + F.col("claim_no") * 7) % 12).cast("int")).alias("action"),
                    F.col("claim").alias("rationale"), "refs", (F.col("claim_no") % 5).cast("int").alias("priority"))


def kept_recommendations(spark, sf):
    res = E.resolve_refs(recommendations(spark, sf), labels(spark, sf), ["website_id", I, "rec_no"], [I])
    return E.ground_recommendations(res, p=E.Evidence(recommendations=3))


@query
def ground_recommendations(spark, sf):
    return kept_recommendations(spark, sf).select(I, "rec_no", "action", "priority", "position", "requires_human_approval", "executed", "status")


@query
def overconfident_phrases(spark, sf):
    text = F.concat(F.col("text"), F.when(F.col("doc_id") % 3 == 0, " This is DEFINITELY proof of x").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", joined(E.overconfident_phrases(text)).alias("phrases"))


@query
def parse_model_output(spark, sf):
    c = table(spark, sf, "conversations")
    body = F.to_json(F.struct("role", "turn", F.concat(F.lit('} "\\ {'), F.col("text")).alias("note"), F.struct(F.struct(F.col("turn").alias("x")).alias("b")).alias("a")))
    kind = F.col("turn") % 5
    out = (F.when(kind == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n``` as asked, in {braces}"))).when(kind == 1, F.concat(body, body))
           .when(kind == 2, F.concat(F.lit("{"), body)).when(kind == 3, F.concat(F.lit("{role: "), "role", F.lit("}"))).otherwise(F.translate("text", "{", "(")))
    d = E.parse_model_output(c.select("conv_id", "turn", out.alias("output")))
    return d.select("conv_id", "turn", F.get_json_object("parsed", "$.role").alias("role"), F.get_json_object("parsed", "$.a.b.x").cast("bigint").alias("x"),
                    F.length(F.get_json_object("parsed", "$.note")).alias("note_chars"), "parse_status")


@query
def trim_missing_and_alternatives(spark, sf):
    parts = F.split("text", "\\. ")
    return table(spark, sf, "conversations").select("conv_id", "turn", joined(E.trim_missing(parts), "|").alias("missing"),
                                                    joined(E.trim_alternatives(parts), "|").alias("alternatives"))


@query
def missing_evidence(spark, sf):
    c = table(spark, sf, "conversations")
    item = F.concat(F.lit('{"missing_evidence":[{"description":" '), "role", F.lit(' <b>","why_it_matters":"turn '), F.col("turn").cast("string"), F.lit('"},{"description":"  "},"plain '), "role",
                    F.lit('",7,{"why_it_matters":"x"},"a sixth one"]}'))
    got = E.missing_evidence(F.when(F.col("turn") % 4 > 0, item).otherwise("{}"))
    return c.select("conv_id", "turn", joined(F.transform(got, lambda x: F.concat(x["description"], F.lit(":"), x["why_it_matters"])), "|").alias("missing"))


@query
def merge_keep_last_good(spark, sf):
    t = table(spark, sf, "conversations")
    prev = t.where("turn = 0").select("conv_id", F.when(F.col("conv_id") % 2 == 0, "ok").otherwise("error").alias("status"), F.col("role").alias("by"), F.lit(0).alias("run"))
    new = t.where("turn = 1").select("conv_id", F.when(F.col("conv_id") % 3 == 0, "ok").otherwise("invalid_output").alias("status"), F.col("role").alias("by"), F.lit(1).alias("run"))
    return E.merge_keep_last_good(prev, new, ["conv_id"])


@query
def investigation_staleness(spark, sf):
    i = fx(spark, sf, "fx_incidents")
    n = F.col("created_seq")
    d = i.select(*E.INCIDENT, "event_count", (F.col("event_count") + n % 2).alias("inv_event_count"), n.alias("scored_at"), n.alias("inv_scored_at"),
                 F.when(n % 3 == 0, n).alias("intel_at"), F.lit(None).cast("bigint").alias("inv_intel_at"))
    return E.investigation_staleness(d).withColumn("stale_reasons", joined("stale_reasons"))


@query
def audit_tail(spark, sf):
    t = fx(spark, sf, "fx_transitions").select("incident_id", "seq", "new_state")
    more = t.select("incident_id", (F.col("seq") + 100).alias("seq"), "new_state")
    return E.audit_tail(t, more, ["incident_id"], "seq", 5).select("incident_id", "seq", "new_state", "age")


@query
def pick_for_investigation(spark, sf):
    return E.pick_for_investigation(fx(spark, sf, "fx_incidents"), 10).select(*E.INCIDENT, "position")


# ------------------------------------------------------------------------------------------------ lifecycle
def alerts(spark, sf):
    i = fx(spark, sf, "fx_incidents")
    recs = i.where(F.col("created_seq") % 3 == 0).select(*L.INCIDENT, F.lit(1).alias("position"), F.lit("monitor").alias("action"), F.lit("Watch it").alias("title"),
                                                          F.concat(F.lit("because of "), "title").alias("rationale"))
    prior = i.where(F.col("created_seq") % 2 == 0).select(*L.INCIDENT, F.lit("acknowledged").alias("status"), F.col("created_seq").alias("created_us"))
    stages = fx(spark, sf, "fx_stages").groupBy(*L.INCIDENT).agg(F.sort_array(F.collect_set("stage")).alias("stages"))
    paths = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: F.concat(F.lit("/p"), k.cast("string")))
    content = i.join(stages, L.INCIDENT, "left").select(*L.INCIDENT, "stages", F.when(F.col("created_seq") % 4 > 0, paths).alias("affected_resources"), F.col("event_count").alias("related_event_count"),
                                                        F.when(F.col("created_seq") % 5 == 0, "budget_exceeded").alias("ai_status"), (F.col("created_seq") % 7 == 0).alias("contains_synthetic_data"))
    return L.build_alerts(i, recs, prior, 777, findings=fx(spark, sf, "fx_findings"), content=content)


@query
def build_alerts(spark, sf):
    return alerts(spark, sf).select(*L.INCIDENT, "alert_id", "priority", "action", "action_source", "status", "created_us", "updated_us", "related_event_count", "ai_status",
                                    F.col("recommended_next_action.title").alias("action_title"), F.col("recommended_next_action.rationale").alias("rationale"),
                                    joined("affected_resources").alias("resources"), joined("stages").alias("stages"), "contains_synthetic_data",
                                    joined(F.transform("supporting_evidence", lambda x: x["finding_id"])).alias("evidence"))


@query
def list_alerts(spark, sf):
    return L.list_alerts(alerts(spark, sf)).select("alert_id", "priority", "risk_score")


@query
def audit_transitions(spark, sf):
    return L.audit_transitions(fx(spark, sf, "fx_transitions"), [I]).select(I, "seq", "from_state", "new_state", "valid")


@query
def replay_lifecycle(spark, sf):
    return L.replay_lifecycle(fx(spark, sf, "fx_transitions"), [I]).select(I, "seq", "new_state", "from_state", "state", "accepted")


@query
def normalise_state(spark, sf):
    t = fx(spark, sf, "fx_transitions")
    return t.select(I, "seq", L.normalise_state(F.concat(F.lit(" "), F.lower(F.regexp_replace("new_state", "_", "-")))).alias("state"), L.normalise_state(F.col("actor")).alias("none"))


@query
def normalise_decision(spark, sf):
    t = fx(spark, sf, "fx_transitions")
    raw = F.when(F.col("seq") % 4 == 0, "True Positive").when(F.col("seq") % 4 == 1, "FP").when(F.col("seq") % 4 == 2, "further-investigation").otherwise(F.col("actor"))
    return t.select(I, "seq", L.normalise_decision(raw).alias("decision"), L.normalise_recommendation_decision(raw).alias("recommendation"))


@query
def clean_comment(spark, sf):
    text, rejected = TX.clean_comment(F.concat(F.lit("\u0001 "), "text", F.lit(" ")), 2000)
    return table(spark, sf, "documents").select("doc_id", text.alias("comment"), rejected.alias("rejected"))


def feedback(spark, sf):
    return fx(spark, sf, "fx_transitions").select(F.lit("web_a").alias("website_id"), I, F.concat(F.lit("fb-"), F.col("seq")).alias("feedback_id"),
                                                  F.col("new_state").alias("decision"), "comment", (F.col("seq") % 3).alias("created_us"))


@query
def latest_feedback(spark, sf):
    return L.latest_feedback(feedback(spark, sf))


@query
def feedback_history(spark, sf):
    return L.feedback_history(feedback(spark, sf)).select(I, "feedback_id", "decision", "created_us")


@query
def apply_decisions(spark, sf):
    d = fx(spark, sf, "fx_transitions").where(F.col("new_state").isin("CONFIRMED", "FALSE_POSITIVE", "NEEDS_INVESTIGATION"))
    d = d.select(I, "seq", F.col("new_state").alias("decision"), (F.col(I) % 2 == 0).alias("has_recommendations"))
    return L.apply_decisions(d, [I])


def decisions(spark, sf):
    r = recommendations(spark, sf)
    return r.select("website_id", I, E.normal_action(F.col("action")).alias("action"), F.when(F.col("rec_no") % 3 == 0, "accepted").when(F.col("rec_no") % 3 == 1, "rejected")
                    .otherwise("needs_investigation").alias("decision"), F.col("rec_no").alias("decided_us"))


@query
def approval_gate(spark, sf):
    req = fx(spark, sf, "fx_transitions").where("new_state = 'ACTION_TAKEN'").select(F.lit("web_a").alias("website_id"), I, "seq", F.when(F.col("seq") % 2 == 0, F.col("comment")).alias("comment"))
    return L.approval_gate(req, kept_recommendations(spark, sf), decisions(spark, sf)).select(I, "seq", "verdict")


@query
def alert_status_follow(spark, sf):
    t = fx(spark, sf, "fx_transitions")
    alert = F.when(F.col("seq") % 3 == 0, "closed").when(F.col("seq") % 3 == 1, "open").otherwise("acknowledged")
    return t.select(I, "seq", L.alert_status_follow(F.col("new_state"), alert).alias("alert_status"))


@query
def overlay_decisions(spark, sf):
    return L.overlay_decisions(kept_recommendations(spark, sf), decisions(spark, sf)).select(I, "action", "decision", "decided_us")


@query
def recommendation_progress(spark, sf):
    return Q.recommendation_progress(L.overlay_decisions(kept_recommendations(spark, sf), decisions(spark, sf).where("decision <> 'rejected'")))


def reports(spark, sf):
    i = fx(spark, sf, "fx_incidents").withColumn("has_hypothesis", F.col("created_seq") % 4 == 0)
    st = fx(spark, sf, "fx_stages").groupBy(*L.INCIDENT).agg(F.count_distinct("stage").alias("stage_count"))
    i = i.join(st, L.INCIDENT, "left").withColumn("stage_count", F.coalesce("stage_count", F.lit(0)))
    fb = i.where(F.col("created_seq") % 3 == 0).select(*L.INCIDENT, F.lit("fb-1").alias("feedback_id"), F.lit("CONFIRMED").alias("decision"),
                                                       F.lit("seen").alias("comment"), F.col("created_seq").alias("created_us"))
    audit = i.select(*L.INCIDENT, F.col("created_seq").alias("at_us"), F.lit("alert_created").alias("action"), F.lit("system").alias("actor"))
    graph = TL.graph_summary(TC.nodes(spark, sf), TC.edges(spark, sf))
    inputs = RC.inputs(spark, sf)
    return L.incident_report(i, timeline(spark, sf), graph, R.risk_factors(inputs), R.evidence_gaps(inputs), fx(spark, sf, "fx_intel"), fb, audit,
                             fx(spark, sf, "fx_findings"))


@query
def incident_report(spark, sf):
    r = reports(spark, sf)
    return r.select(*L.INCIDENT, "executive_summary", "timeline_entries", F.size("timeline").alias("shown_entries"), F.size("risk_factors").alias("n_factors"),
                    "node_count", "edge_count", F.size("supporting_findings").alias("n_findings"))


@query
def executive_summary(spark, sf):
    return reports(spark, sf).select(*L.INCIDENT, F.regexp_replace("executive_summary", r"Risk (\w+) \([^)]*\) with evidence confidence [0-9.]+\.", "Risk $1.").alias("summary"))


@query
def export_reports(spark, sf):
    from tidewatch.session import scratch_path
    from tidewatch.sources.store import export_reports as write
    path = scratch_path(spark, "reports")
    write(reports(spark, sf), path)
    return spark.read.json(path).select(*L.INCIDENT, "title", "status", F.size("risk_factors").alias("n_factors"))


QUERIES = {f.__name__: f for f in (
    evidence_refs, rank_findings, omitted_findings, evidence_facts, fit_budget, bundle_fingerprint, role_summaries, role_indicators, missing_evidence, resolve_refs, ground_claims,
    grounding_report, cap_confidence, ground_recommendations, overconfident_phrases, parse_model_output, trim_missing_and_alternatives,
    merge_keep_last_good, investigation_staleness, audit_tail, pick_for_investigation, build_alerts, list_alerts, audit_transitions, replay_lifecycle,
    normalise_state, normalise_decision, clean_comment, latest_feedback, feedback_history, apply_decisions, approval_gate, alert_status_follow,
    overlay_decisions, recommendation_progress, incident_report, executive_summary, export_reports)}

V = ORACLE_VIEWS
V["rkf"] = "SELECT *, row_number() OVER (PARTITION BY website_id, incident_id ORDER BY confidence DESC, finding_id) AS r FROM fx_findings"
V["sten"] = """
SELECT website_id, incident_id, stage, count(*) AS n, arg_min(event_id, (timestamp, event_id)) AS f, arg_max(event_id, (timestamp, event_id)) AS l FROM fx_stages GROUP BY 1, 2, 3"""
V["prevs"] = """
SELECT f.finding_id, f.event_id, f.website_id, f.incident_id, p.cited_id AS prev_id FROM fx_findings f LEFT JOIN fx_cited p ON p.finding_id = f.finding_id AND p.cited_id <> f.event_id"""
V["itl"] = "SELECT *, row_number() OVER (PARTITION BY website_id, incident_id ORDER BY indicator_type, indicator) AS k FROM fx_intel"
V["roles"] = """
SELECT *, 'anomaly_agent' AS role FROM fx_findings WHERE agent_name = 'anomaly_model' OR finding_type = 'ml_anomaly' UNION ALL
SELECT *, 'attack_agent' FROM fx_findings WHERE finding_type = 'attack_indicator' UNION ALL
SELECT *, 'detection_agent' FROM fx_findings WHERE agent_name <> 'anomaly_model' AND finding_type NOT IN ('ml_anomaly', 'attack_indicator')"""
V["clm"] = """
SELECT incident_id, claim_no, trim(regexp_replace(regexp_replace(claim, '[\\x00-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g')) AS claim, turn_f, conv_t,
  turn_f BETWEEN 1 AND 8 AS ok_f, conv_t BETWEEN 1 AND 12 AS ok_t FROM (SELECT *, claim_no % 9 AS turn_f, incident_id % 15 AS conv_t FROM fx_claims) x"""
V["clk"] = """
SELECT *, supported AND row_number() OVER (PARTITION BY incident_id, supported ORDER BY claim_no) <= 3 AS kept FROM (
  SELECT *, claim <> '' AND (ok_f OR ok_t) AS supported FROM clm) x"""
_ACT = "[" + ", ".join(f"'{a}'" for a in (*ACTIONS, "block_source_review", "reboot")) + "]"
V["rec0"] = f"""
SELECT incident_id, claim_no AS rec_no, {_ACT}[(incident_id * 5 + claim_no * 7) % 12 + 1] AS action, claim AS rationale, CASE WHEN claim_no % 5 BETWEEN 1 AND 3 THEN claim_no % 5 ELSE 2 END AS priority,
  ok_f OR ok_t AS ok FROM clm"""
V["rec1"] = """
SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY priority, action) AS position FROM (SELECT * FROM rec0 WHERE ok AND rationale <> '' AND action <> 'reboot'
  QUALIFY row_number() OVER (PARTITION BY incident_id, action ORDER BY rec_no) = 1) x"""
V["rec2"] = "SELECT * FROM rec1 WHERE position <= 3"
V["dec0"] = """
SELECT incident_id, action, CASE rec_no % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'needs_investigation' END AS decision, rec_no AS decided_us FROM rec0"""
V["fb"] = """
SELECT 'web_a' AS website_id, incident_id, concat('fb-', seq) AS feedback_id, new_state AS decision, comment, seq % 3 AS created_us FROM fx_transitions"""
_PAIRS = ", ".join(f"'{a}>{b}'" for a, n in TRANSITIONS.items() for b in n)
_PH = ", ".join(f"CASE WHEN contains(t, '{p}') THEN '{p}' END" for p in sorted(OVERCONFIDENT))
V["rpl"] = f"""
SELECT incident_id, seq, new_state, 'DETECTED' AS from_state, CASE WHEN concat('DETECTED>', new_state) IN ({_PAIRS}) THEN new_state ELSE 'DETECTED' END AS state
FROM fx_transitions WHERE seq = 0
UNION ALL SELECT t.incident_id, t.seq, t.new_state, r.state, CASE WHEN concat(r.state, '>', t.new_state) IN ({_PAIRS}) THEN t.new_state ELSE r.state END
FROM rpl r JOIN fx_transitions t ON t.incident_id = r.incident_id AND t.seq = r.seq + 1"""
V["decn"] = """
SELECT incident_id, seq, new_state AS decision, incident_id % 2 = 0 AS has_recommendations, row_number() OVER (PARTITION BY incident_id ORDER BY seq) AS k
FROM fx_transitions WHERE new_state IN ('CONFIRMED', 'FALSE_POSITIVE', 'NEEDS_INVESTIGATION')"""


def _go(cur: str, d: str) -> str:
    ok = f"(concat({cur}, '>', {d}decision) IN ({_PAIRS}))"
    return (f"CASE WHEN {d}decision = 'CONFIRMED' AND {d}has_recommendations AND ({ok} OR {cur} = 'CONFIRMED') THEN 'RESPONSE_RECOMMENDED' "
            f"WHEN {ok} THEN {d}decision ELSE {cur} END")


V["appl"] = f"""
SELECT incident_id, seq, decision, has_recommendations, k, 'DETECTED' AS from_state, {_go("'DETECTED'", '')} AS state FROM decn WHERE k = 1
UNION ALL SELECT d.incident_id, d.seq, d.decision, d.has_recommendations, d.k, a.state, {_go('a.state', 'd.')} FROM appl a JOIN decn d ON d.incident_id = a.incident_id AND d.k = a.k + 1"""
V["sumr"] = """
SELECT i.website_id, i.incident_id, concat_ws(' ', concat('Incident ', i.incident_id, ': ', title, '. Status: ', status, '.'),
  CASE WHEN risk_level IS NULL THEN 'Risk has not been scored.' ELSE concat('Risk ', risk_level, '.') END,
  concat(event_count, ' correlated event(s)', CASE WHEN s.n > 0 THEN concat(' across ', s.n, ' recognised stage(s).') ELSE '.' END),
  CASE WHEN t.n IS NULL THEN 'Threat-intelligence enrichment was not run.' ELSE concat('Threat intelligence: ', t.n, ' indicator(s) checked, ', t.e, ' with evidence.') END,
  CASE WHEN created_seq % 4 = 0 THEN 'An AI hypothesis is included (AI inference, not proof).' ELSE 'No validated AI hypothesis is included.' END,
  CASE WHEN created_seq % 3 = 0 THEN 'Analyst decision: CONFIRMED.' ELSE 'No analyst decision has been recorded.' END) AS summary
FROM fx_incidents i LEFT JOIN (SELECT website_id, incident_id, count(DISTINCT stage) AS n FROM fx_stages GROUP BY 1, 2) s USING (website_id, incident_id)
LEFT JOIN (SELECT website_id, incident_id, count(*) AS n, count(*) FILTER (status = 'evidence_found') AS e FROM fx_intel GROUP BY 1, 2) t USING (website_id, incident_id)"""

ORACLES = {
    "parse_model_output": """
SELECT conv_id, turn, CASE WHEN turn % 5 < 2 THEN role END AS role, CASE WHEN turn % 5 < 2 THEN turn END AS x, CASE WHEN turn % 5 < 2 THEN CAST(length(text) + 6 AS INTEGER) END AS note_chars,
  CASE WHEN turn % 5 < 2 THEN 'ok' ELSE 'invalid_output' END AS parse_status FROM conversations""",
    "bundle_fingerprint": """
SELECT website_id, incident_id, left(sha256(concat('{"event_count":', event_count, ',"incident_id":"', incident_id, '","title":"', title, '"}')), 16) AS fingerprint FROM fx_incidents""",
    "export_reports": "SELECT website_id, incident_id, title, status, CAST(8 AS INTEGER) AS n_factors FROM fx_incidents",
    "evidence_refs": """
SELECT website_id, incident_id, 'C:correlation' AS label, 'correlation' AS kind, array_to_string(list_slice(list(event_id ORDER BY us, event_id), 1, 10), ',') AS event_ids, '' AS finding_ids
FROM ie GROUP BY 1, 2
UNION ALL SELECT website_id, incident_id, concat('S:', stage), 'stage', CASE WHEN f = l THEN CAST(f AS VARCHAR) ELSE concat(f, ',', l) END, '' FROM sten
UNION ALL SELECT r.website_id, r.incident_id, concat('F', r.r), 'finding', CASE WHEN prev_id IS NULL THEN CAST(r.event_id AS VARCHAR) ELSE concat(r.event_id, ',', prev_id) END, r.finding_id
FROM rkf r JOIN prevs p USING (finding_id) WHERE r <= 8
UNION ALL SELECT website_id, incident_id, concat('R:', factor), 'risk_factor', '', '' FROM rfac
UNION ALL SELECT website_id, incident_id, concat('TI', k), 'threat_intel', '', '' FROM itl WHERE k <= 6
UNION ALL SELECT website_id, incident_id, concat('T', no), 'timeline', event_ids, '' FROM tl1 WHERE no <= 12""",
    "rank_findings": "SELECT website_id, incident_id, finding_id, concat('F', r) AS label FROM rkf WHERE r <= 8",
    "omitted_findings": "SELECT website_id, incident_id, greatest(count(*) - 8, 0) AS omitted FROM fx_findings GROUP BY 1, 2",
    "evidence_facts": """
SELECT website_id, incident_id, 'observed' AS evidence_type, concat(count(*), ' correlated events (', count(*) FILTER (event_type = 'waf_alert'), ' flagged by rules/model) across ',
  count(DISTINCT source_ip), ' source(s), ', count(DISTINCT session_id), ' session(s), ', count(DISTINCT user_id), ' account(s).') AS text FROM ie GROUP BY 1, 2
UNION ALL SELECT website_id, incident_id, 'observed', concat('Stage ', chr(39), stage, chr(39), ': ', n, ' event(s).') FROM sten
UNION ALL SELECT website_id, incident_id, 'derived_metric', concat('Deterministic risk: ', risk_level, ' (score 1, evidence confidence 2).') FROM fx_incidents WHERE risk_level IS NOT NULL""",
    "fit_budget": """
SELECT conv_id, turn, section, may AND total - (sum(chars) OVER w - chars) > 900 AS dropped FROM (
  SELECT *, position > keep AS may, sum(chars) OVER (PARTITION BY conv_id) AS total FROM (
    SELECT conv_id, turn, length(text) AS chars, turn // 4 + 4 AS position, turn % 4 AS o, CASE turn % 4 WHEN 0 THEN 'timeline' WHEN 1 THEN 'threat_intel' WHEN 2 THEN 'findings'
      ELSE 'known_limitations' END AS section, CASE turn % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS keep FROM conversations) x) y
WINDOW w AS (PARTITION BY conv_id, may ORDER BY o, position DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "role_summaries": """
SELECT website_id, incident_id, role, COALESCE(n, 0) AS indicators, COALESCE(c, '') AS categories, m AS max_confidence, n IS NOT NULL AS suspicious,
  CASE WHEN n IS NULL THEN 'no_findings' ELSE 'ok' END AS status
FROM fx_incidents CROSS JOIN (SELECT unnest(['detection_agent', 'attack_agent', 'anomaly_agent']) AS role) a
LEFT JOIN (SELECT website_id, incident_id, role, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS c, round(max(confidence), 3) AS m FROM roles GROUP BY 1, 2, 3) b
USING (website_id, incident_id, role)""",
    "role_indicators": """
SELECT r.website_id, r.incident_id, role, r.finding_id, rule_id, category, round(confidence, 3) AS confidence, anomaly_score0 AS anomaly_score,
  CASE WHEN prev_id IS NULL THEN CAST(r.event_id AS VARCHAR) ELSE concat(r.event_id, ',', prev_id) END AS event_ids
FROM (SELECT *, CASE WHEN role = 'anomaly_agent' THEN anomaly_score END AS anomaly_score0 FROM roles) r JOIN prevs p USING (finding_id)""",
    "missing_evidence": """
SELECT conv_id, turn, CASE WHEN turn % 4 > 0 THEN concat(role, ' b:turn ', turn, '|plain ', role, ':') ELSE '' END AS missing FROM conversations""",
    "resolve_refs": """
SELECT incident_id, claim_no, concat_ws(',', CASE WHEN ok_f THEN concat('F', turn_f) END, CASE WHEN ok_t THEN concat('T', conv_t) END) AS labels,
  CAST(NOT ok_f AS BIGINT) + CAST(NOT ok_t AS BIGINT) AS invalid,
  concat_ws(',', CASE WHEN ok_f THEN concat('e-F', turn_f) END, CASE WHEN ok_t THEN concat('e-T', conv_t) END) AS event_ids,
  CASE WHEN ok_f THEN concat('f-F', turn_f) ELSE '' END AS finding_ids FROM clm""",
    "ground_claims": "SELECT incident_id, claim_no, supported, kept FROM clk",
    "grounding_report": """
SELECT *, CASE WHEN hypothesis_grounded AND claims_kept > 0 THEN 'ok' ELSE 'rejected_ungrounded' END AS status FROM (
  SELECT incident_id, count(*) AS claims_received, count(*) FILTER (kept) AS claims_kept, count(*) FILTER (NOT supported) AS unsupported_claims_dropped,
    CAST(sum(CAST(NOT ok_f AS BIGINT) + CAST(NOT ok_t AS BIGINT)) AS BIGINT) AS invalid_refs_removed, bool_or(claim_no = 0 AND (ok_f OR ok_t)) AS hypothesis_grounded FROM clk GROUP BY 1
  UNION ALL SELECT -1 - incident_id, 0, 0, 0, 0, ok_f OR ok_t FROM clk WHERE claim_no = 0 AND incident_id % 2 = 0) x""",
    "cap_confidence": """
SELECT website_id, incident_id, round(CASE WHEN m IS NULL OR m > confidence THEN confidence ELSE m END, 4) AS value,
  CASE WHEN m IS NULL THEN 'model gave no confid' ELSE 'AI self-assessment c' END AS basis0, CASE WHEN m IS NULL THEN 'model gave no confid' WHEN m > confidence THEN 'AI self-assessment c'
  ELSE 'AI self-assessment; ' END AS basis FROM (SELECT *, CASE WHEN created_seq % 5 > 0 THEN least(created_seq % 150 / CAST(100 AS DOUBLE), CAST(1 AS DOUBLE)) END AS m FROM fx_incidents) x""".replace(
        "CASE WHEN m IS NULL THEN 'model gave no confid' ELSE 'AI self-assessment c' END AS basis0, ", ""),
    "ground_recommendations": """
SELECT incident_id, rec_no, action, CAST(priority AS INTEGER) AS priority, CAST(position AS INTEGER) AS position, TRUE AS requires_human_approval, FALSE AS executed, 'proposed' AS status FROM rec2""",
    "overconfident_phrases": f"""
SELECT doc_id, concat_ws(',', {_PH}) AS phrases FROM (SELECT doc_id, lower(concat(text, CASE WHEN doc_id % 3 = 0 THEN ' This is DEFINITELY proof of x' ELSE '' END)) AS t FROM documents) x""",
    "trim_missing_and_alternatives": r"""
SELECT conv_id, turn, array_to_string(list_filter(list_transform(p[1:5], lambda x: left(trim(regexp_replace(replace(replace(x, '<', ''), '>', ''), '\s+', ' ', 'g')), 300)), lambda x: x <> ''), '|') AS missing,
  array_to_string(list_filter(list_transform(p[1:3], lambda x: left(trim(regexp_replace(replace(replace(x, '<', ''), '>', ''), '\s+', ' ', 'g')), 300)), lambda x: x <> ''), '|') AS alternatives
FROM (SELECT *, string_split(text, '. ') AS p FROM conversations) y""",
    "merge_keep_last_good": """
SELECT conv_id, CASE WHEN k OR b.conv_id IS NULL THEN a.status ELSE b.status END AS status, CASE WHEN k OR b.conv_id IS NULL THEN a.role ELSE b.role END AS by,
  CASE WHEN k OR b.conv_id IS NULL THEN 0 ELSE 1 END AS run, k AS kept_previous FROM (
  SELECT conv_id, a, b, COALESCE(b.status <> 'ok' AND a.status = 'ok', FALSE) AS k FROM (SELECT conv_id, role, CASE WHEN conv_id % 2 = 0 THEN 'ok' ELSE 'error' END AS status FROM conversations WHERE turn = 0) a
  FULL JOIN (SELECT conv_id, role, CASE WHEN conv_id % 3 = 0 THEN 'ok' ELSE 'invalid_output' END AS status FROM conversations WHERE turn = 1) b USING (conv_id)) x""",
    "investigation_staleness": """
SELECT website_id, incident_id, created_seq % 2 = 1 OR created_seq % 3 = 0 AS stale,
  concat_ws(',', CASE WHEN created_seq % 2 = 1 THEN 'events_changed' END, CASE WHEN created_seq % 3 = 0 THEN 'threat_intel_changed' END) AS stale_reasons FROM fx_incidents""",
    "audit_tail": """
SELECT incident_id, seq, new_state, CAST(age AS INTEGER) AS age FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY seq DESC) AS age FROM (
  SELECT incident_id, seq, new_state FROM fx_transitions UNION ALL SELECT incident_id, seq + 100, new_state FROM fx_transitions) x) y WHERE age <= 5""",
    "pick_for_investigation": """
SELECT website_id, incident_id, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY website_id ORDER BY COALESCE(risk_score, 0) DESC, incident_id) AS position
  FROM fx_incidents) x WHERE position <= 10""",
    "build_alerts": """
SELECT website_id, incident_id, concat('alr_', incident_id) AS alert_id, CASE risk_level WHEN 'CRITICAL' THEN 'P1' ELSE 'P2' END AS priority,
  CASE WHEN created_seq % 3 = 0 THEN 'monitor' ELSE 'investigate_further' END AS action, CASE WHEN created_seq % 3 = 0 THEN 'response_agent (AI, proposal)' ELSE 'system_default' END AS action_source,
  CASE WHEN created_seq % 2 = 0 THEN 'acknowledged' ELSE 'open' END AS status, CASE WHEN created_seq % 2 = 0 THEN created_seq ELSE 777 END AS created_us, CAST(777 AS INTEGER) AS updated_us,
  event_count AS related_event_count, CASE WHEN created_seq % 5 = 0 THEN 'budget_exceeded' ELSE 'not_run' END AS ai_status,
  CASE WHEN created_seq % 3 = 0 THEN 'Watch it' ELSE 'Review the incident' END AS action_title,
  CASE WHEN created_seq % 3 = 0 THEN concat('because of ', title) ELSE concat('Review the incident evidence, timeline and risk factors and decide on a response. AI recommendations are not available for this incident (',
    CASE WHEN created_seq % 5 = 0 THEN 'budget_exceeded' ELSE 'not_run' END, ').') END AS rationale,
  CASE WHEN created_seq % 4 > 0 THEN '/p1,/p2,/p3,/p4,/p5' ELSE '' END AS resources, COALESCE(s.stages, '') AS stages, created_seq % 7 = 0 AS contains_synthetic_data, COALESCE(r.evidence, '') AS evidence
FROM fx_incidents LEFT JOIN (SELECT website_id, incident_id, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages FROM fx_stages GROUP BY 1, 2) s USING (website_id, incident_id)
LEFT JOIN (SELECT website_id, incident_id, string_agg(finding_id, ',' ORDER BY r) AS evidence FROM rkf WHERE r <= 5 GROUP BY 1, 2) r USING (website_id, incident_id) WHERE risk_level IN ('HIGH', 'CRITICAL')""",
    "list_alerts": """
SELECT concat('alr_', incident_id) AS alert_id, CASE risk_level WHEN 'CRITICAL' THEN 'P1' ELSE 'P2' END AS priority, risk_score FROM fx_incidents WHERE risk_level IN ('HIGH', 'CRITICAL')""",
    "audit_transitions": f"""
SELECT incident_id, seq, from_state, new_state, concat(from_state, '>', new_state) IN ({_PAIRS}) AS valid FROM (
  SELECT *, COALESCE(lag(new_state) OVER (PARTITION BY incident_id ORDER BY seq), 'DETECTED') AS from_state FROM fx_transitions) x""",
    "replay_lifecycle": f"SELECT *, concat(from_state, '>', new_state) IN ({_PAIRS}) AS accepted FROM rpl",
    "normalise_state": "SELECT incident_id, seq, new_state AS state, CAST(NULL AS VARCHAR) AS none FROM fx_transitions",
    "normalise_decision": """
SELECT incident_id, seq, CASE seq % 4 WHEN 0 THEN 'CONFIRMED' WHEN 1 THEN 'FALSE_POSITIVE' WHEN 2 THEN 'NEEDS_INVESTIGATION' END AS decision,
  CASE seq % 4 WHEN 2 THEN 'needs_investigation' END AS recommendation FROM fx_transitions""",
    "clean_comment": r"""
SELECT doc_id, CASE WHEN length(s) <= 2000 AND s <> '' THEN s END AS comment, length(s) > 2000 AS rejected FROM (
  SELECT doc_id, regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '^\s+|\s+$', '', 'g') AS s FROM documents) x""",
    "latest_feedback": """
SELECT website_id, incident_id, count(*) AS feedback_count, arg_min(feedback_id, (-created_us, feedback_id)) AS feedback_id, arg_min(decision, (-created_us, feedback_id)) AS decision,
  arg_min(comment, (-created_us, feedback_id)) AS comment, arg_min(created_us, (-created_us, feedback_id)) AS created_us FROM fb GROUP BY 1, 2""",
    "feedback_history": "SELECT incident_id, feedback_id, decision, created_us FROM fb",
    "apply_decisions": f"""
SELECT *, refused0 AS refused, NOT refused0 AND state = 'RESPONSE_RECOMMENDED' AND has_recommendations AS advanced FROM (
  SELECT * EXCLUDE (k), decision <> from_state AND concat(from_state, '>', decision) NOT IN ({_PAIRS}) AS refused0 FROM appl) x""".replace("SELECT *, refused0 AS refused", "SELECT * EXCLUDE (refused0), refused0 AS refused"),
    "approval_gate": """
SELECT t.incident_id, t.seq, CASE WHEN t.seq % 2 = 1 OR t.comment = '' THEN 'comment_required' WHEN EXISTS (SELECT 1 FROM rec2 r WHERE r.incident_id = t.incident_id) AND NOT EXISTS (
  SELECT 1 FROM rec2 r JOIN dec0 d USING (incident_id, action) WHERE r.incident_id = t.incident_id AND d.decision = 'accepted') THEN 'approval_required' ELSE 'allowed' END AS verdict
FROM fx_transitions t WHERE new_state = 'ACTION_TAKEN'""",
    "alert_status_follow": """
SELECT incident_id, seq, CASE new_state WHEN 'INVESTIGATING' THEN CASE seq % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'open' ELSE 'acknowledged' END WHEN 'DETECTED' THEN 'open'
  WHEN 'FALSE_POSITIVE' THEN 'closed' WHEN 'RESOLVED' THEN 'closed' ELSE 'acknowledged' END AS alert_status FROM fx_transitions""",
    "overlay_decisions": """
SELECT r.incident_id, r.action, arg_max(decision, decided_us) AS decision, max(decided_us) AS decided_us FROM rec2 r LEFT JOIN dec0 d USING (incident_id, action) GROUP BY 1, 2""",
    "recommendation_progress": """
SELECT 'web_a' AS website_id, incident_id, count(*) AS total, count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (decision IS NULL) AS pending,
  count(*) FILTER (decision = 'accepted') > 0 AS can_record_action_taken FROM (
  SELECT r.incident_id, r.action, arg_max(decision, decided_us) AS decision FROM rec2 r LEFT JOIN (SELECT * FROM dec0 WHERE decision <> 'rejected') d USING (incident_id, action) GROUP BY 1, 2) x GROUP BY 2""",
    "executive_summary": "SELECT * FROM sumr",
}
