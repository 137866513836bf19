"""Query surface: pages, lists and key figures over the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.citations import Citations
from tidewatch.operators.rules import suspicious_events
from tidewatch.params import CLOSED_STATES, DECISION_STATES, MODEL_AGENT, STATES, TRANSITIONS

INCIDENT = ["website_id", "incident_id"]
EVIDENCE_TEXT = {"observed": "Observed fact", "derived_indicator": "Derived indicator", "derived_metric": "Derived metric",
                 "ai_inference": "AI inference", "missing_evidence": "Missing evidence", "recommendation": "Recommendation", "system": "System"}


def page(df: DataFrame, order, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def list_events(events: DataFrame, website_id: str, session_id: str | None = None, event_type: str | None = None, limit: int = 50,
                offset: int = 0) -> DataFrame:
    """Newest first; filters are on bare columns so that they reach the scan."""
    d = events.where(F.col("website_id") == website_id)
    if session_id is not None:
        d = d.where(F.col("session_id") == session_id)
    if event_type is not None:
        d = d.where(F.col("event_type") == event_type)
    return page(d, [F.desc("ts_us"), F.asc("event_id")], limit, offset)


def ingest_status(websites: DataFrame, events: DataFrame, received: str = "received_at") -> DataFrame:
    g = events.groupBy("website_id").agg(F.count(F.lit(1)).alias("events_received"), F.max(received).alias("last_received"))
    d = websites.select("website_id").join(g, "website_id", "left").withColumn("events_received", F.coalesce("events_received", F.lit(0)))
    return d.withColumn("status", F.when(F.col("events_received") > 0, "active").otherwise("waiting_for_telemetry"))


def _with_time(findings: DataFrame, events: DataFrame) -> DataFrame:
    return findings.join(events.select("website_id", "event_id", "ts_us"), ["website_id", "event_id"])


def list_findings(findings: DataFrame, events: DataFrame, website_id: str, finding_type: str | None = None, event_id=None,
                  min_confidence: float = 0.0, limit: int = 50, offset: int = 0) -> DataFrame:
    d = findings.where((F.col("website_id") == website_id) & (F.col("confidence") >= min_confidence))
    if finding_type is not None:
        d = d.where(F.col("finding_type") == finding_type)
    if event_id is not None:
        d = d.where(F.col("event_id") == event_id)
    return page(_with_time(d, events.where(F.col("website_id") == website_id)), [F.desc("ts_us"), F.asc("finding_id")], limit, offset)


def list_anomalies(findings: DataFrame, events: DataFrame, website_id: str, min_confidence: float = 0.0, limit: int = 50, offset: int = 0) -> DataFrame:
    d = findings.where((F.col("website_id") == website_id) & (F.col("agent_name") == MODEL_AGENT) & (F.col("confidence") >= min_confidence))
    return page(_with_time(d, events), [F.desc("confidence"), F.asc("finding_id")], limit, offset)


def list_incidents(incidents: DataFrame, website_id: str, level: str | None = None, sort: str = "created", created: str = "created_at") -> DataFrame:
    d = incidents.where(F.col("website_id") == website_id)
    if level is not None:
        d = d.where(F.col("risk_level") == level.upper())
    order = [F.desc(created)] if sort == "created" else [F.desc_nulls_last("risk_score"), F.desc(created)]
    return d.orderBy(*order, "incident_id")


def count_findings(findings: DataFrame, events: DataFrame) -> DataFrame:
    keys = events.select("website_id", "event_id")
    return findings.join(keys, ["website_id", "event_id"], "left_semi").groupBy("website_id").agg(F.count(F.lit(1)).alias("findings"))


def suspicious_event_count(findings: DataFrame, cited: Citations) -> DataFrame:
    return suspicious_events(findings, cited).groupBy("website_id").agg(F.count(F.lit(1)).alias("suspicious_events"))


def kpis(events: DataFrame, findings: DataFrame, incidents: DataFrame, alerts: DataFrame, cited: Citations) -> DataFrame:
    """Key figures per tenant."""
    active = ~F.coalesce("status", F.lit("DETECTED")).isin(*CLOSED_STATES)
    high = F.coalesce(F.col("risk_level").isin("HIGH", "CRITICAL"), F.lit(False))
    parts = [
        events.groupBy("website_id").agg(F.count(F.lit(1)).alias("total_events")), suspicious_event_count(findings, cited),
        incidents.groupBy("website_id").agg(F.count_if(active).alias("active_incidents"), F.count_if(active & high).alias("high_risk_incidents")),
        alerts.groupBy("website_id").agg(F.count_if(F.coalesce("status", F.lit("open")) == "open").alias("open_alerts"))]
    d = reduce(lambda a, b: a.join(b, "website_id", "full"), parts)
    return d.na.fill(0)


def funnel_rows(figures: DataFrame) -> DataFrame:
    stages = (("Events ingested", "total_events"), ("Suspicious events", "suspicious_events"), ("Incidents", "active_incidents"),
              ("High-risk incidents", "high_risk_incidents"))
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(c).alias("count")) for i, (n, c) in enumerate(stages, 1)])
    return figures.select("website_id", F.explode(rows).alias("r")).select("website_id", "r.*")


def incident_cards(incidents: DataFrame, alerts: DataFrame) -> DataFrame:
    """Incidents with their alert, highest risk first, unscored last."""
    a = alerts.select(*INCIDENT, "priority", F.lit(True).alias("has_alert"))
    level = F.upper(F.coalesce("risk_level", F.lit("NOT SCORED")))
    rank = F.array_position(F.array(*[F.lit(x) for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW")]), level)
    d = (incidents.join(a, INCIDENT, "left").withColumn("has_alert", F.coalesce("has_alert", F.lit(False))).withColumn("risk_level", level))
    return d.orderBy(F.desc_nulls_last("risk_score"), F.when(rank == 0, 9).otherwise(rank), "website_id", "incident_id")


def factor_rows(factors: DataFrame) -> DataFrame:
    return factors.orderBy(*INCIDENT, F.desc("points"), "factor")


def gap_rows(gaps: DataFrame, missing: DataFrame) -> DataFrame:
    """Deterministic gaps and model-named missing evidence, kept apart by ``source``."""
    why = F.when(F.col("why_it_matters") != "", F.concat(F.lit(" Why it matters: "), "why_it_matters")).otherwise("")
    a = gaps.select(*INCIDENT, F.lit("deterministic").alias("source"), F.lit("missing_evidence").alias("evidence_type"), F.col("gap").alias("text"))
    b = missing.select(*INCIDENT, F.lit("ai_agent").alias("source"), F.lit("missing_evidence").alias("evidence_type"),
                       F.concat(F.col("description"), F.coalesce(why, F.lit(""))).alias("text"))
    return a.unionByName(b)


def short_ids(ids: Column, n: int = 3) -> Column:
    more = F.when(F.size(ids) > n, F.concat(F.lit(" (+"), (F.size(ids) - n).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(F.coalesce(F.size(ids), F.lit(0)) <= 0, "-").otherwise(F.concat(F.array_join(F.slice(ids, 1, n), ", "), more))


def evidence_text(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in EVIDENCE_TEXT.items()], F.lit("Unlabelled"))


def timeline_rows(timeline: DataFrame) -> DataFrame:
    return (timeline.withColumn("evidence_label", evidence_text(F.col("evidence_type"))).withColumn("event_ids_short", short_ids(F.col("event_ids"))))


def indicator_rows(results: DataFrame) -> DataFrame:
    """Results with the evidence count and synthetic flag of their incident."""
    g = results.groupBy(*INCIDENT).agg(F.count_if(F.col("status") == "evidence_found").alias("evidence_count"), F.bool_or("synthetic").alias("has_synthetic"))
    return results.join(g, INCIDENT)


def recommendation_progress(overlaid: DataFrame) -> DataFrame:
    """Accepted / pending / total per incident, and whether an action may be recorded."""
    d = F.col("decision")
    g = overlaid.groupBy(*INCIDENT).agg(F.count(F.lit(1)).alias("total"), F.count_if(d == "accepted").alias("accepted"), F.count_if(d.isNull()).alias("pending"))
    return g.withColumn("can_record_action_taken", F.col("accepted") > 0)


def history_rows(history: DataFrame, keys, order: str = "seq", limit: int = 30) -> DataFrame:
    """The newest ``limit`` status changes of each incident, newest first."""
    from tidewatch.operators.ordered import top_k
    return top_k(history, keys, [F.desc(order)], limit, order, "position")


def next_states(incidents: DataFrame) -> DataFrame:
    """(incident, next_state, step_option): allowed next states; decision states are recorded as feedback, not as steps."""
    allowed = F.coalesce(*[F.when(F.coalesce("status", F.lit("DETECTED")) == s, F.array(*[F.lit(x) for x in STATES if x in TRANSITIONS[s]])) for s in STATES])
    d = incidents.select(*[c for c in INCIDENT if c in incidents.columns], F.explode(allowed).alias("next_state"))
    return d.withColumn("step_option", ~F.col("next_state").isin(*DECISION_STATES))


def investigation_view(investigations: DataFrame) -> DataFrame:
    """Stored investigations split into (incident, part, position, text): facts, hypothesis, claims, missing evidence.

    ``investigations`` has status, facts / claims / missing ARRAY<STRING> and hypothesis STRING."""
    run = ~F.coalesce("status", F.lit("not_run")).isin("not_run")
    none = F.array().cast("array<string>")

    def part(name, values):
        return F.transform(F.coalesce(values, none), lambda t, i: F.struct(F.lit(name).alias("part"), i.alias("position"), t.alias("text")))
    parts = F.concat(part("fact", F.col("facts")), part("hypothesis", F.array_compact(F.array("hypothesis"))), part("claim", F.col("claims")),
                     part("missing_evidence", F.col("missing")))
    return (investigations.withColumn("available", run & F.col("hypothesis").isNotNull())
            .select(*INCIDENT, "status", "available", F.explode_outer(F.when(run, parts)).alias("p")).select(*INCIDENT, "status", "available", "p.*"))
