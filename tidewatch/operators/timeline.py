"""Timeline and attack graph of incidents, as node and edge tables.

Everything is done for all incidents at once, keyed by (tenant, incident); id lists are cut at a fixed length after
ordering by time, with the true count beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import plural
from tidewatch.operators.ordered import SPLIT, first_ids, number_rows, spread_join, top_k
from tidewatch.operators.sessions import group_events
from tidewatch.params import STAGES, Correlation
from tidewatch.session import checkpointed, release

INCIDENT = ["website_id", "incident_id"]
GROUP = [*INCIDENT, "group_event"]
# fixed values: names of event types, priority of relationships, events looked at on each side of a group border
TYPE_TEXT = {"sensitive_endpoint_access": "Sensitive endpoint accessed", "api_access": "API access", "http_request": "HTTP request",
             "waf_alert": "WAF alert reported", "security_decision": "Security control decision recorded",
             "app_error": "Application error"}
PRIORITY = ("attack_sequence", "same_session", "same_user", "same_ip", "same_endpoint", "similar_behavior")
BORDER = 25
PHASE = 10**17                   # larger than any time in microseconds: orders (phase, time) as one number


def grouped(events: DataFrame, p: Correlation = Correlation()) -> DataFrame:
    """Incident events with the group they belong to."""
    return group_events(events, INCIDENT, p.group_gap_s)


def group_table(rows: DataFrame) -> DataFrame:
    """One row per group with its facts, numbered per incident in time order (``group_no`` from 1)."""
    order = F.struct("ts_us", "event_id")
    first = F.min_by(F.struct("event_type", "session_id", "source_ip", "user_id", "path", "status_code"), order)
    g = rows.groupBy(*GROUP, "group_us").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("end_us"), first.alias("f"),
        F.min(order)["event_id"].alias("first_id"), F.max(order)["event_id"].alias("last_id"),
        F.count_distinct(F.when(F.col("user_id") != "", F.col("user_id"))).alias("accounts"))
    g = checkpointed(g.select(*GROUP, "group_us", "end_us", "n", "accounts", "first_id", "last_id", "f.*"))     # numbering reads it twice
    g = number_rows(g, INCIDENT, "group_us", ("group_us", "group_event"), "group_no")
    return g.withColumn("label", group_label())


def group_label() -> Column:
    """Recorded facts of a group: what, how often, how long, how many accounts, where."""
    n, kind = F.col("n"), F.col("event_type")
    sec = (F.col("end_us") - F.col("group_us")) / 1e6
    span = F.when(sec >= 1, F.format_string("%.0f s", sec)).otherwise("<1 s")
    times = F.when(n > 1, F.concat(F.lit(" (x"), n.cast("string"), F.lit(")"))).otherwise("")
    accounts = F.when(F.col("accounts") > 0, F.concat(F.lit(", "), plural(F.col("accounts"), "distinct account"))).otherwise("")
    who = F.when(F.col("user_id") != "", F.concat(F.lit(" for account "), "user_id")).otherwise("")
    words = F.regexp_replace(kind, "_", " ")
    name = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in TYPE_TEXT.items()],
                      F.concat(F.upper(F.left(words, F.lit(1))), F.lower(F.substr(words, F.lit(2)))))
    where = F.when(F.col("path") != "", F.concat(F.lit(": "), "path")).otherwise("")
    shown = kind.isin("http_request", "app_error", "api_access") & (F.col("status_code") != 0)
    status = F.when(shown, F.concat(F.lit(" (status "), F.col("status_code").cast("string"), F.lit(")"))).otherwise("")
    many = F.when(n > 1, F.concat(n.cast("string"), F.lit(" \u00d7 "))).otherwise("")
    return (F.when(kind == "login_failure", F.concat(plural(n, "failed login attempt"), F.lit(" in "), span, accounts))
            .when(kind == "login_success", F.concat(F.lit("Successful login"), F.coalesce(who, F.lit("")), times))
            .when(kind == "session_created", F.concat(F.lit("New session created"), times))
            .when(kind == "session_terminated", F.concat(F.lit("Session terminated"), times))
            .when(kind == "page_view", F.concat(plural(n, "page view"), F.lit(" in "), span))
            .when(kind == "interaction", plural(n, "interaction summary event"))
            .otherwise(F.concat(many, name, F.coalesce(where, F.lit("")), F.coalesce(status, F.lit("")))))


def cited_in_incident(findings: DataFrame, events: DataFrame, *more: str) -> DataFrame:
    """(incident, finding, event, ts_us, position): the anchor first, then the cited events, those of the incident only; ``more`` columns
    of the events come along."""
    ids = F.array_union(F.array(F.col("event_id").cast("string")), F.coalesce("event_ids", F.array().cast("array<string>")))
    long = findings.select(*INCIDENT, "finding_id", F.posexplode(ids).alias("position", "cited"))
    at = events.select(*INCIDENT, F.col("event_id").cast("string").alias("cited"), "event_id", "ts_us", *more)
    return long.join(at, [*INCIDENT, "cited"]).drop("cited")


def timeline(events: DataFrame, findings: DataFrame, incidents: DataFrame | None = None, p: Correlation = Correlation(),
             rows: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Entries of all incidents in reading order: event groups and detections by time, then the platform's own steps.

    ``incidents`` may carry ``created_us``, ``enriched_us``, ``indicators_checked``, ``contains_synthetic`` and
    ``inferred_us`` for the system and inference entries.  Rows, citations and entries are read twice each, so they are written once;
    ``rows`` and ``groups`` may be those of :func:`grouped` and :func:`group_table`, where they are stored."""
    rows = checkpointed(grouped(events, p)) if rows is None else rows
    ids = first_ids(rows, GROUP, p.entry_ids)
    seen = (group_table(rows) if groups is None else groups).join(ids, GROUP, "left").select(
        *INCIDENT, F.lit("observed").alias("evidence_type"), F.col("group_us").alias("ts_us"), "end_us", "label", F.lit(0).alias("o"),
        F.lit("").alias("finding_id"), F.col("n").alias("event_count"), "event_ids")
    cited = checkpointed(cited_in_incident(findings, events))
    release(events.sparkSession)
    listed = first_ids(cited, [*INCIDENT, "finding_id"], p.entry_ids, order=("position", "event_id"))
    per = cited.groupBy(*INCIDENT, "finding_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.min_by("ts_us", "position").alias("ts_us"), F.min("position").alias("lead"))
    label = F.concat(F.lit("Detection "), F.coalesce(F.nullif(F.col("rule_id"), F.lit("")), F.col("finding_type")), F.lit(": "), F.col("title"))
    found = (findings.select(*INCIDENT, "finding_id", label.alias("label")).join(per.where("lead = 0"), [*INCIDENT, "finding_id"])
             .join(listed, [*INCIDENT, "finding_id"], "left")
             .select(*INCIDENT, F.lit("derived_indicator").alias("evidence_type"), "ts_us", F.lit(None).cast("bigint").alias("end_us"), "label",
                     F.lit(1).alias("o"), "finding_id", "event_count", "event_ids"))
    body = number_rows(seen.unionByName(found), INCIDENT, "ts_us", ("ts_us", "o", "finding_id", "label"), "entry_no")
    out = body.select(*INCIDENT, "entry_no", "evidence_type", "ts_us", "end_us", "label", "event_count", "event_ids")
    if incidents is not None:
        body = out = checkpointed(out)
        out = out.unionByName(_platform_entries(incidents, body))
    return out.withColumn("entry_id", F.concat(F.lit("tl_"), F.lpad(F.col("entry_no").cast("string"), F.greatest(F.lit(3), F.length(F.col("entry_no").cast("string"))), F.lit("0"))))


def _platform_entries(incidents: DataFrame, body: DataFrame) -> DataFrame:
    have = set(incidents.columns)

    def col(name, kind):
        return (F.col(name) if name in have else F.lit(None)).cast(kind)
    synth = F.when(F.coalesce(col("contains_synthetic", "boolean"), F.lit(False)), " (includes SYNTHETIC demo data)").otherwise("")
    checked = plural(F.coalesce(col("indicators_checked", "bigint"), F.lit(0)), "indicator")
    steps = F.array(
        F.struct(F.lit("system").alias("evidence_type"), col("created_us", "bigint").alias("ts_us"), F.lit("Incident correlated").alias("label")),
        F.struct(F.lit("system").alias("evidence_type"), col("enriched_us", "bigint").alias("ts_us"),
                 F.concat(F.lit("Threat intelligence enrichment: "), checked, F.lit(" checked"), synth).alias("label")),
        F.struct(F.lit("ai_inference").alias("evidence_type"), col("inferred_us", "bigint").alias("ts_us"),
                 F.lit("AI investigation: hypothesis generated (inference grounded in cited evidence; not proof)").alias("label")))
    count = body.groupBy(*INCIDENT).agg(F.count(F.lit(1)).alias("_n"))
    kept = F.filter(steps, lambda x: x["ts_us"].isNotNull())
    return (incidents.select(*INCIDENT, F.posexplode(kept).alias("k", "s")).join(count, INCIDENT, "left")
            .select(*INCIDENT, (F.coalesce("_n", F.lit(0)) + F.col("k") + 1).alias("entry_no"), "s.evidence_type", "s.ts_us",
                    F.lit(None).cast("bigint").alias("end_us"), "s.label", F.lit(0).cast("bigint").alias("event_count"),
                    F.array().cast("array<string>").alias("event_ids")))


# ------------------------------------------------------------------------------------------------ graph
def _node_id(no: Column) -> Column:
    text = no.cast("string")
    return F.concat(F.lit("g"), F.lpad(text, F.greatest(F.lit(3), F.length(text)), F.lit("0")))


def graph_nodes(events: DataFrame, groups: DataFrame, rows: DataFrame, incidents: DataFrame, findings: DataFrame,
                p: Correlation = Correlation()) -> DataFrame:
    """Source addresses (layer 0), sessions (1), groups (1 + n) and the incident (last + 1)."""
    parts = []
    for kind, prefix, col, layer in (("source_ip", "ip:", "source_ip", 0), ("session", "sess:", "session_id", 1)):
        have = events.where(F.col(col) != "")
        ids = first_ids(have, [*INCIDENT, col], p.entry_ids)
        n = have.groupBy(*INCIDENT, col).agg(F.count(F.lit(1)).alias("event_count")).join(ids, [*INCIDENT, col])
        parts.append(n.select(*INCIDENT, F.concat(F.lit(prefix), F.col(col)).alias("node_id"), F.lit(kind).alias("node_type"),
                              F.col(col).alias("label"), "event_count", F.lit(layer).cast("bigint").alias("layer"), "event_ids",
                              F.lit(0).cast("bigint").alias("finding_count"), F.lit(None).cast("bigint").alias("ts_us")))
    fcount = cited_in_incident(findings, rows, "group_event").groupBy(*GROUP).agg(F.count_distinct("finding_id").alias("finding_count"))
    g = groups.join(first_ids(rows, GROUP, p.entry_ids), GROUP, "left").join(fcount, GROUP, "left")
    parts.append(g.select(*INCIDENT, _node_id(F.col("group_no")).alias("node_id"), F.lit("event_group").alias("node_type"), "label",
                          F.col("n").alias("event_count"), (F.col("group_no") + 1).cast("bigint").alias("layer"), "event_ids",
                          F.coalesce("finding_count", F.lit(0)).alias("finding_count"), F.col("group_us").alias("ts_us")))
    last = groups.groupBy(*INCIDENT).agg((F.max("group_no") + 2).cast("bigint").alias("layer"), F.sum("n").alias("event_count"))
    parts.append(incidents.select(*INCIDENT, "title").join(last, INCIDENT).join(first_ids(events, INCIDENT, p.entry_ids), INCIDENT).select(
        *INCIDENT, F.concat(F.lit("inc:"), F.col("incident_id").cast("string")).alias("node_id"), F.lit("incident").alias("node_type"),
        F.col("title").alias("label"), "event_count", "layer", "event_ids", F.lit(0).cast("bigint").alias("finding_count"),
        F.lit(None).cast("bigint").alias("ts_us")))
    return reduce(DataFrame.unionByName, parts)


def group_stages(rows: DataFrame, stages: DataFrame) -> DataFrame:
    """Stages present in each group, in chain order (six at most)."""
    d = rows.select(*GROUP, "event_id").join(stages.select(*INCIDENT, "event_id", "stage"), [*INCIDENT, "event_id"])
    have = F.collect_set("stage")
    return d.groupBy(*GROUP).agg(F.filter(F.array(*[F.lit(s) for s in STAGES]), lambda s: F.array_contains(have, s)).alias("stages"))


def best_relationship(groups: DataFrame, rows: DataFrame, links: DataFrame) -> DataFrame:
    """(incident, group_no, relationship, strength) between each group and the next: the link of best type, then
    strength, among the last and first 25 events of the two groups."""
    numbered = spread_join(rows, groups.select(*GROUP, "group_no"), GROUP, n=SPLIT).select(*INCIDENT, "group_no", "event_id", "ts_us")
    numbered = checkpointed(numbered)                     # read from both sides; about as many groups as events
    key = [*INCIDENT, "group_no"]
    tail = top_k(numbered, key, [F.desc("ts_us"), F.desc("event_id")], BORDER, "event_id").select(*key, "event_id")
    head = top_k(numbered, key, [F.asc("ts_us"), F.asc("event_id")], BORDER, "event_id").select(
        *INCIDENT, (F.col("group_no") - 1).alias("group_no"), F.col("event_id").alias("related_event_id"))
    rank = F.coalesce(*[F.when(F.col("relationship_type") == r, F.lit(i)) for i, r in enumerate(PRIORITY)])
    near = links.join(tail, [*INCIDENT, "event_id"]).join(head, [*key, "related_event_id"])
    best = F.min(F.struct(rank.alias("rank"), (-F.col("strength")).alias("neg"), "relationship_type"))
    return near.groupBy(*key).agg(best.alias("b")).select(
        *key, F.col("b.relationship_type").alias("relationship_type"), (-F.col("b.neg")).alias("strength"))


def graph_edges(events: DataFrame, groups: DataFrame, rows: DataFrame, links: DataFrame, findings: DataFrame) -> DataFrame:
    """Edges address→session, session or address→first group, group→next group, group→incident, numbered per incident."""
    none, no_rel = F.lit(None).cast("double"), F.lit(None).cast("string")

    def edge(df, phase, at, src, dst, rel, evidence, n, strength=none, correlation=no_rel):
        return df.select(*INCIDENT, (F.lit(phase * PHASE) + at).alias("o"), src.alias("source"), dst.alias("target"), F.lit(rel).alias("relationship"),
                         correlation.alias("correlation_type"), strength.alias("strength"), evidence.alias("evidence_type"), n.cast("bigint").alias("event_count"))
    ip, sid = F.concat(F.lit("ip:"), F.col("source_ip")), F.concat(F.lit("sess:"), F.col("session_id"))
    both = events.where((F.col("source_ip") != "") & (F.col("session_id") != ""))
    pairs = both.groupBy(*INCIDENT, "source_ip", "session_id").agg(F.min("ts_us").alias("at"), F.count(F.lit(1)).alias("n"))
    observed = F.lit("observed")
    used = edge(pairs, 0, F.col("at"), ip, sid, "used_session", observed, F.col("n"))
    has_sid = F.coalesce(F.col("session_id") != "", F.lit(False))
    who = F.when(has_sid, sid).when(F.col("source_ip") != "", ip)
    firsts = (groups.withColumn("who", who).where(F.col("who").isNotNull())
              .groupBy(*INCIDENT, "who", has_sid.alias("has_sid")).agg(F.min(F.struct("group_no", "group_us", "n")).alias("g")))
    began = edge(firsts, 1, F.col("g.group_no"), F.col("who"), _node_id(F.col("g.group_no")), "began_with", observed, F.col("g.n"))
    nxt = groups.select(*INCIDENT, (F.col("group_no") - 1).alias("group_no"), F.col("group_no").alias("next_no"))
    step = groups.select(*INCIDENT, "group_no").join(nxt, [*INCIDENT, "group_no"]).join(
        best_relationship(groups, rows, links), [*INCIDENT, "group_no"], "left")
    linked = F.col("relationship_type").isNotNull()
    follow = edge(step, 2, F.col("group_no"), _node_id(F.col("group_no")), _node_id(F.col("next_no")), "followed_by",
                  F.when(linked, "derived_correlation").otherwise("observed"), F.lit(2), F.col("strength"), F.coalesce("relationship_type", F.lit("temporal")))
    bearing = cited_in_incident(findings, rows, "group_event").select(*GROUP).distinct()
    proof = edge(groups.join(bearing, GROUP, "left_semi"), 3, F.col("group_no"), _node_id(F.col("group_no")),
                 F.concat(F.lit("inc:"), F.col("incident_id").cast("string")), "evidence_for", F.lit("derived_indicator"), F.col("n"))
    every = checkpointed(reduce(DataFrame.unionByName, [used, began, follow, proof]))       # numbering reads it twice
    every = number_rows(every, INCIDENT, "o", ("o", "source", "target"), "edge_no")
    text = F.col("edge_no").cast("string")
    return every.withColumn("edge_id", F.concat(F.lit("e"), F.lpad(text, F.greatest(F.lit(3), F.length(text)), F.lit("0")))).drop("o")


def graph_layout(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with x, y; edges between known nodes).  y is the rank in the layer, centred; nodes of the two layers that can
    be large are ordered by id, so rank buckets are id prefixes."""
    key = [*INCIDENT, "layer"]
    d = number_rows(nodes, key, order=("node_type", "node_id"), out="k", bucket=F.concat(F.rpad("node_type", 12, " "), F.left("node_id", F.lit(16))))
    size = nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    placed = (d.join(size, key).withColumn("x", F.col("layer").cast("double"))
              .withColumn("y", (F.col("k") - 1) - (F.col("_n") - 1) / 2.0).drop("k", "_n"))
    known = nodes.select(*INCIDENT, "node_id")
    kept = (edges.join(known.withColumnRenamed("node_id", "source"), [*INCIDENT, "source"], "left_semi")
            .join(known.withColumnRenamed("node_id", "target"), [*INCIDENT, "target"], "left_semi"))
    return placed, kept


def graph_summary(nodes: DataFrame, edges: DataFrame, k: int = 12) -> DataFrame:
    """Node and edge counts, counts by type and relationship, first ``k`` labels by layer."""
    kinds = ("source_ip", "session", "event_group", "incident")
    rels = ("used_session", "began_with", "followed_by", "evidence_for")
    n = nodes.groupBy(*INCIDENT).agg(F.count(F.lit(1)).alias("node_count"), *[F.count_if(F.col("node_type") == t).alias(f"{t}_nodes") for t in kinds])
    e = edges.groupBy(*INCIDENT).agg(F.count(F.lit(1)).alias("edge_count"), *[F.count_if(F.col("relationship") == r).alias(r) for r in rels])
    first = top_k(nodes.where(F.col("label") != ""), INCIDENT, [F.asc("layer"), F.asc("node_id")], k, "node_id", "r")
    path = first.groupBy(*INCIDENT).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("layered_path"))
    return n.join(e, INCIDENT, "left").join(path, INCIDENT, "left")
