"""Whole jobs: detection, correlation and risk over stored events.

Every step that later steps read more than once is written and read back, as its table would be."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import correlate as C
from tidewatch.operators import risk as R
from tidewatch.operators.anomaly import anomaly_citations, anomaly_findings
from tidewatch.operators.citations import Citations
from tidewatch.operators.rules import Rule, all_rules, citations, finding_envelope
from tidewatch.operators.sessions import session_summary
from tidewatch.params import Anomaly, Correlation, Detection, Risk
from tidewatch.session import checkpointed


@dataclass
class Correlated:
    members: DataFrame
    stages: DataFrame
    links: DataFrame
    summaries: DataFrame


def detect(events: DataFrame, p: Detection = Detection(), model: Anomaly | None = Anomaly()) -> tuple[DataFrame, Citations]:
    """Findings of the rules and, unless ``model`` is None, of the session anomaly model, and all events that they cite."""
    rules = all_rules(events, p)
    rules = Rule(*[x if x is None else checkpointed(x) for x in rules[:3]], {k: checkpointed(v) for k, v in rules.runs.items()})
    found, cited = checkpointed(finding_envelope(rules, p)), citations(rules).stored()
    if model is None:
        return found, cited
    more = checkpointed(anomaly_findings(events, checkpointed(session_summary(events)), model))
    return found.unionByName(more), cited.union(anomaly_citations(events, more).stored())


def correlate(events: DataFrame, findings: DataFrame, cited: Citations, p: Correlation = Correlation()) -> Correlated:
    seeds = checkpointed(C.seed_events(findings, events, cited))
    groups = checkpointed(C.entity_groups(events, seeds))
    members = checkpointed(C.cluster_events(C.clusters(events, findings, cited, p, seeds, groups), events))
    stages = checkpointed(C.detect_stages(members, findings, cited))
    chain = C.chain_links(groups, p)
    links = checkpointed(C.cluster_links(members, findings, chain, stages, p))
    return Correlated(members, stages, links, checkpointed(C.cluster_summary(members, findings, links, stages, p)))


def score(c: Correlated, findings: DataFrame, events: DataFrame, intel: DataFrame | None = None, p: Correlation = Correlation(), r: Risk = Risk()) -> DataFrame:
    """Scored incidents of a correlation run; the incident id is that of its cluster."""
    keys = c.members.select("website_id", F.col("cluster_id").alias("incident_id"), "cluster_event", "event_id")
    top = C.incident_candidates(c.summaries, p).select("website_id", F.col("cluster_id").alias("incident_id"), "cluster_event", "event_count", "title",
                                                       "affected_resources", (F.col("links_truncated") | (F.col("event_count") > p.max_detail_ids)).alias("truncated"))
    name = top.select("website_id", "cluster_event", "incident_id")
    found = findings.join(keys, ["website_id", "event_id"])
    if "anomaly_score" not in findings.columns:
        found = found.withColumn("anomaly_score", F.try_element_at("derived", F.lit("anomaly_score")))
    links = c.links.join(name, C.CLUSTER)
    stages = c.stages.join(name, C.CLUSTER)
    made = events.join(keys, ["website_id", "event_id"]).select("website_id", "incident_id", F.coalesce(
        F.col("is_synthetic") if "is_synthetic" in events.columns else F.lit(False), F.lit(False)).alias("is_synthetic"))
    inputs = checkpointed(R.risk_inputs(top.drop("affected_resources"), found, links, stages, top.select(*R.INCIDENT, "affected_resources"), intel, made, r))
    return R.score_incidents(inputs, r).join(top.select(*R.INCIDENT, "title"), R.INCIDENT)
