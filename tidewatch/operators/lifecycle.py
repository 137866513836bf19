"""Alerts, incident states and analyst decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordered import number_rows, prev_row, top_k
from tidewatch.params import (ALERT_PRIORITY, ALERT_STATUS, CLOSED_STATES, DECISION_ALIASES, RECOMMENDATION_ALIASES, STATES, TRANSITIONS,
                              Evidence)

INCIDENT = ["website_id", "incident_id"]
CHUNK = 1000


# ------------------------------------------------------------------------------------------------ vocabulary
def _alias(c: Column, table: dict) -> Column:
    key = F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table.items()])


def normalise_state(c: Column) -> Column:
    """Canonical state, NULL if unknown."""
    key = F.upper(F.regexp_replace(F.trim(c), r"[\s-]+", "_"))
    return F.when(key.isin(*STATES), key)


def normalise_decision(c: Column) -> Column:
    return _alias(c, DECISION_ALIASES)


def normalise_recommendation_decision(c: Column) -> Column:
    return _alias(c, RECOMMENDATION_ALIASES)


def state_no(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATES]), c).cast("int") - 1


def state_name(no: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STATES]), no)


def is_allowed(current: Column, new: Column) -> Column:
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, nxt in TRANSITIONS.items() for b in nxt])
    return F.array_contains(pairs, F.concat(current, F.lit(">"), new))


def alert_status_follow(state: Column, alert: Column) -> Column:
    """Alert status after a state change; INVESTIGATING reopens a closed alert and otherwise leaves it."""
    mapped = F.coalesce(*[F.when(state == k, F.lit(v)) for k, v in ALERT_STATUS.items()])
    return F.when(state == "INVESTIGATING", F.when(alert == "closed", "open").otherwise(alert)).otherwise(F.coalesce(mapped, alert))


# ------------------------------------------------------------------------------------------------ alerts
NO_PROPOSAL = ("Review the incident evidence, timeline and risk factors and decide on a response. AI recommendations are not available "
               "for this incident ({}).")                  # fixed value: must read the same
ALERT_NOTE = ("Alert priority comes from the deterministic risk level, not from an LLM. The recommended action is a proposal for a human analyst.")


def build_alerts(scored: DataFrame, recommendations: DataFrame | None = None, prior: DataFrame | None = None, now_us: int | Column = 0,
                 p: Evidence = Evidence(), findings: DataFrame | None = None, content: DataFrame | None = None) -> DataFrame:
    """One alert per high-risk incident; an earlier alert keeps its status and creation time.

    ``recommendations`` is (incident, position, action, title, rationale); ``prior`` is (incident, status, created_us); ``findings`` gives
    the five most confident as evidence; ``content`` is (incident, affected_resources, stages, related_event_count, ai_status,
    contains_synthetic_data), of which the first five resources are shown."""
    def given(df, columns, d):
        kinds = dict(columns)
        if df is None:
            return d.select("*", *[F.lit(None).cast(k).alias(f"_{c}") for c, k in kinds.items()])
        have = set(df.columns)
        return d.join(df.select(*INCIDENT, *[(F.col(c) if c in have else F.lit(None)).cast(k).alias(f"_{c}") for c, k in kinds.items()]), INCIDENT, "left")
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    a = scored.where(F.col("risk_level").isin(*p.alert_levels)).select(*INCIDENT, "title", "risk_level", "risk_score", "confidence")
    a = given(None if recommendations is None else recommendations.where("position = 1").drop("position"),
              [("action", "string"), ("rationale", "string")], a).withColumnRenamed("_action", "_a")
    if recommendations is not None and "title" in recommendations.columns:
        a = a.join(recommendations.where("position = 1").select(*INCIDENT, F.col("title").alias("_title")), INCIDENT, "left")
    else:
        a = a.withColumn("_title", F.lit(None).cast("string"))
    a = given(prior, [("status", "string"), ("created_us", "bigint")], a)
    a = given(content, [("affected_resources", "array<string>"), ("stages", "array<string>"), ("related_event_count", "bigint"), ("ai_status", "string"),
                        ("contains_synthetic_data", "boolean")], a)
    if findings is not None:
        best = top_k(findings.join(a.select(*INCIDENT), INCIDENT, "left_semi"), INCIDENT, [F.desc("confidence"), F.asc("finding_id")], 5, "finding_id", "_k")
        rows = F.sort_array(F.collect_list(F.struct("_k", "finding_id", "category", "rule_id", F.round("confidence", 4).alias("confidence"))))
        a = a.join(best.groupBy(*INCIDENT).agg(F.transform(rows, lambda x: x.dropFields("_k")).alias("_support")), INCIDENT, "left")
    else:
        a = a.withColumn("_support", F.lit(None).cast("array<struct<finding_id:string,category:string,rule_id:string,confidence:double>>"))
    proposed = F.col("_a").isNotNull()
    ai = F.coalesce("_ai_status", F.lit("not_run"))
    none = F.lit(NO_PROPOSAL.split("{}")[0])
    action = F.struct(
        F.coalesce("_a", F.lit("investigate_further")).alias("action"), F.when(proposed, F.col("_title")).otherwise("Review the incident").alias("title"),
        F.when(proposed, F.col("_rationale")).otherwise(F.concat(none, ai, F.lit(NO_PROPOSAL.split("{}")[1]))).alias("rationale"),
        F.when(proposed, "response_agent (AI, proposal)").otherwise("system_default").alias("source"), F.lit(True).alias("requires_human_approval"))
    return a.select(
        *INCIDENT, F.concat(F.lit("alr_"), F.col("incident_id").cast("string")).alias("alert_id"),
        F.coalesce(*[F.when(F.col("risk_level") == k, F.lit(v)) for k, v in ALERT_PRIORITY.items()]).alias("priority"), "title", "risk_level",
        "risk_score", "confidence", action["action"].alias("action"), action["source"].alias("action_source"), action.alias("recommended_next_action"),
        F.coalesce(F.slice("_affected_resources", 1, 5), F.array().cast("array<string>")).alias("affected_resources"),
        F.coalesce("_related_event_count", F.lit(0).cast("bigint")).alias("related_event_count"),
        F.coalesce("_support", F.array().cast("array<struct<finding_id:string,category:string,rule_id:string,confidence:double>>")).alias("supporting_evidence"),
        F.coalesce("_stages", F.array().cast("array<string>")).alias("stages"), ai.alias("ai_status"),
        F.coalesce("_contains_synthetic_data", F.lit(False)).alias("contains_synthetic_data"),
        F.coalesce("_status", F.lit("open")).alias("status"), F.coalesce("_created_us", now).alias("created_us"), now.alias("updated_us"),
        F.lit("deterministic_risk_threshold").alias("basis"), F.lit(ALERT_NOTE).alias("note"))


def list_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy("priority", F.desc(F.coalesce("risk_score", F.lit(0.0))), "alert_id")


# ------------------------------------------------------------------------------------------------ transitions
def audit_transitions(history: DataFrame, keys, order: str = "seq") -> DataFrame:
    """Each recorded state next to the one recorded before it (DETECTED at first) and whether the move is in the table."""
    d = prev_row(history, keys, ["new_state"], us=order, order=(order,), bucket_s=0.001)
    before = F.coalesce("prev.new_state", F.lit("DETECTED"))
    return d.withColumn("from_state", before).drop("prev").withColumn("valid", is_allowed(F.col("from_state"), F.col("new_state")))


def move_map(target: Column, advance: Column | None = None) -> Column:
    """ARRAY<INT> of eight: the state reached from every state by a requested move, the state itself if it is refused.

    With ``advance`` the move is an analyst decision: repeating the current decision is no change, and CONFIRMED goes on to
    RESPONSE_RECOMMENDED where ``advance`` holds."""
    out = []
    for i, s in enumerate(STATES):
        ok = target.isin(*TRANSITIONS[s])
        reached = F.when(ok, state_no(target)).otherwise(F.lit(i))
        if advance is not None:
            onward = F.coalesce(advance, F.lit(False)) & (target == "CONFIRMED") & (ok | F.lit(s == "CONFIRMED"))
            reached = F.when(onward, F.lit(STATES.index("RESPONSE_RECOMMENDED"))).otherwise(reached)
        out.append(reached)
    return F.array(*out)


def replay(moves: DataFrame, keys, order: str = "seq", start: str = "DETECTED") -> DataFrame:
    """Runs the state machine over ``moves`` (``move`` = :func:`move_map`), adding ``from_state`` and ``state``.

    A move is a function on eight states, and functions compose: every chunk of 1000 moves of an incident is folded to one
    such function, the few chunk functions give the state each chunk starts in, and chunks are then run side by side.  So
    even one incident with very many moves is spread over tasks."""
    d = number_rows(moves, keys, order, (order,), "_n", bucket_s=0.001).withColumn("_chunk", F.floor((F.col("_n") - 1) / CHUNK))
    packed = d.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(F.struct("_n", order, "move"))).alias("_l"))

    def run(i):
        return F.aggregate("_l", F.lit(i), lambda acc, x: F.get(x["move"], acc))
    folded = packed.select(*keys, "_chunk", F.array(*[run(i) for i in range(len(STATES))]).alias("fold"))
    chunks = folded.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_chunk", "fold"))).alias("c"))

    def step(acc, x):
        cur = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.get(x["fold"], cur)))
    first = F.lit(STATES.index(start))
    starts = chunks.select(*keys, F.posexplode(F.slice(F.aggregate("c", F.array(first), step), 1, F.size("c"))).alias("_chunk", "_from"))
    starts = starts.withColumn("_chunk", F.col("_chunk").cast("bigint"))
    opened = packed.join(starts, [*keys, "_chunk"])
    states = F.aggregate("_l", F.array(F.col("_from")), lambda acc, x: F.concat(acc, F.array(F.get(x["move"], F.element_at(acc, -1)))))
    done = opened.select(*keys, F.posexplode(F.transform("_l", lambda x: x[order])).alias("_i", order), states.alias("_st"))
    done = done.select(*keys, order, state_name(F.get("_st", F.col("_i"))).alias("from_state"), state_name(F.get("_st", F.col("_i") + 1)).alias("state"))
    return moves.drop("move").join(done, [*keys, order])


def replay_lifecycle(history: DataFrame, keys, order: str = "seq") -> DataFrame:
    """Strict replay of requested states: refused moves leave the state as it is (``accepted`` tells)."""
    d = replay(history.withColumn("move", move_map(F.col("new_state"))), keys, order)
    return d.withColumn("accepted", is_allowed(F.col("from_state"), F.col("new_state")))


def apply_decisions(decisions: DataFrame, keys, order: str = "seq") -> DataFrame:
    """Analyst decisions in order: the decision, the state before and after, whether it was refused, whether it advanced one
    step on because usable recommendations exist (``has_recommendations``)."""
    d = decisions.withColumn("move", move_map(F.col("decision"), F.col("has_recommendations")))
    d = replay(d, keys, order)
    same = F.col("decision") == F.col("from_state")
    refused = ~same & ~is_allowed(F.col("from_state"), F.col("decision"))
    return d.withColumn("refused", refused).withColumn("advanced", ~refused & (F.col("state") == "RESPONSE_RECOMMENDED") & F.col("has_recommendations"))


def approval_gate(requests: DataFrame, recommendations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Whether ACTION_TAKEN may be recorded: a comment, and an accepted recommendation if there are any."""
    any_rec = recommendations.select(*INCIDENT).distinct().withColumn("_any", F.lit(True))
    live = recommendations.select(*INCIDENT, "action").distinct()
    ok = (decisions.where(F.col("decision") == "accepted").join(live, [*INCIDENT, "action"], "left_semi").select(*INCIDENT).distinct()
          .withColumn("_ok", F.lit(True)))
    d = requests.join(any_rec, INCIDENT, "left").join(ok, INCIDENT, "left")
    no_comment = F.coalesce(F.col("comment") == "", F.lit(True))
    verdict = (F.when(no_comment, "comment_required").when(F.col("_any") & F.col("_ok").isNull(), "approval_required").otherwise("allowed"))
    return d.withColumn("verdict", verdict).drop("_any", "_ok")


def latest_feedback(feedback: DataFrame, keys=INCIDENT, order: str = "created_us", id_col: str = "feedback_id") -> DataFrame:
    """Newest feedback of each incident and the number of all."""
    last = feedback.groupBy(*keys).agg(F.count(F.lit(1)).alias("feedback_count"),
                                       F.min_by(F.struct(*[c for c in feedback.columns if c not in keys]), F.struct((-F.col(order)).alias("o"), id_col)).alias("f"))
    return last.select(*keys, "feedback_count", "f.*")


def feedback_history(feedback: DataFrame, keys=INCIDENT, order: str = "created_us", id_col: str = "feedback_id") -> DataFrame:
    return feedback.orderBy(*keys, F.desc(order), id_col)


def overlay_decisions(recommendations: DataFrame, decisions: DataFrame, order: str = "decided_us") -> DataFrame:
    """Recommendations with the latest analyst decision on the same action."""
    cols = [c for c in ("decision", "comment", order, "decided_by") if c in decisions.columns]
    last = decisions.groupBy(*INCIDENT, "action").agg(F.max_by(F.struct(*cols), order).alias("d")).select(*INCIDENT, "action", "d.*")
    return recommendations.join(last, [*INCIDENT, "action"], "left")


def lifecycle_view(incidents: DataFrame, feedback: DataFrame) -> DataFrame:
    """Status, closed flag and latest decision of each incident."""
    d = incidents.join(latest_feedback(feedback), INCIDENT, "left")
    return d.withColumn("closed", F.col("status").isin(*CLOSED_STATES)).withColumn("feedback_count", F.coalesce("feedback_count", F.lit(0)))


# ------------------------------------------------------------------------------------------------ report
def executive_summary() -> Column:
    """Sentences from numbers: (title, status, risk, events, stages, enrichment, hypothesis, decision)."""
    risk = F.when(F.col("risk_level").isNotNull(), F.format_string("Risk %s (%s/100) with evidence confidence %s.", F.col("risk_level"),
                  F.col("risk_score").cast("string"), F.col("confidence").cast("string"))).otherwise("Risk has not been scored.")
    stages = F.when(F.col("stage_count") > 0, F.format_string(" across %d recognised stage(s).", F.col("stage_count"))).otherwise(".")
    intel = F.when(F.col("indicators_checked").isNull(), "Threat-intelligence enrichment was not run.").otherwise(F.format_string(
        "Threat intelligence: %d indicator(s) checked, %d with evidence.", F.col("indicators_checked"), F.col("evidence_found")))
    hyp = F.when(F.col("has_hypothesis"), "An AI hypothesis is included (AI inference, not proof).").otherwise("No validated AI hypothesis is included.")
    decision = F.when(F.col("decision").isNotNull(), F.concat(F.lit("Analyst decision: "), "decision", F.lit("."))).otherwise("No analyst decision has been recorded.")
    return F.concat_ws(" ", F.format_string("Incident %s: %s. Status: %s.", F.col("incident_id").cast("string"), F.col("title"), F.col("status")), risk,
                       F.concat(F.col("event_count").cast("string"), F.lit(" correlated event(s)"), stages), intel, hyp, decision)


def incident_report(incidents: DataFrame, timeline: DataFrame, graph: DataFrame, factors: DataFrame, gaps: DataFrame, results: DataFrame,
                    feedback: DataFrame, audit: DataFrame, findings: DataFrame) -> DataFrame:
    """One nested row per incident.  Sections are lists of fixed length (timeline 200, audit 20, findings 10, results 50,
    feedback 100), cut before they are gathered, with the true timeline length kept."""
    def section(df, order, fields, n, out, spread):
        best = top_k(df, INCIDENT, order, n, spread, "_k")
        rows = F.sort_array(F.collect_list(F.struct("_k", *fields)))
        return best.groupBy(*INCIDENT).agg(F.transform(rows, lambda x: x.dropFields("_k")).alias(out))
    parts = [
        section(timeline, [F.asc("entry_no")], ["entry_id", "evidence_type", "ts_us", "label", "event_count"], 200, "timeline", "entry_no"),
        timeline.groupBy(*INCIDENT).agg(F.count(F.lit(1)).alias("timeline_entries")),
        graph, section(factors, [F.desc("points"), F.asc("factor")], ["factor", "weight", "value", "status", "points"], 8, "risk_factors", "factor"),
        section(gaps, [F.asc("position")], ["gap"], 5, "evidence_gaps", "position"),
        section(results, [F.asc("indicator_type"), F.asc("indicator")], ["indicator_type", "indicator", "status", "synthetic"], 50, "threat_intelligence", "indicator"),
        results.groupBy(*INCIDENT).agg(F.count(F.lit(1)).alias("indicators_checked"), F.count_if(F.col("status") == "evidence_found").alias("evidence_found")),
        section(feedback, [F.desc("created_us"), F.asc("feedback_id")], ["feedback_id", "decision", "comment", "created_us"], 100, "feedback", "feedback_id"),
        latest_feedback(feedback).select(*INCIDENT, "decision"),
        section(audit, [F.desc("at_us")], ["at_us", "action", "actor"], 20, "audit", "at_us"),
        section(findings, [F.desc("confidence"), F.asc("finding_id")], ["finding_id", "rule_id", "category", "confidence"], 10, "supporting_findings", "finding_id")]
    d = incidents
    for part in parts:
        d = d.join(part, INCIDENT, "left")
    return d.withColumn("executive_summary", executive_summary())


__all__ = [n for n in dir() if not n.startswith("_") and n != "Window"]
