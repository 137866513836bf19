"""Evidence sets of incidents and checks of model output against them.  No model is called here."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import model_text, safe_text
from tidewatch.operators.ordered import once, top_k
from tidewatch.params import Evidence

INCIDENT = ["website_id", "incident_id"]
NO_IDS = "array<string>"
# fixed values: order in which sections give up items, and how many each keeps
BUDGET = (("timeline", 3), ("threat_intel", 1), ("findings", 3), ("known_limitations", 0))
MAX_DROPS = 60


def _none() -> Column:
    return F.array().cast(NO_IDS)


# ------------------------------------------------------------------------------------------------ evidence sets
def rank_findings(findings: DataFrame, p: Evidence = Evidence()) -> tuple[DataFrame, DataFrame]:
    """Best findings per incident with labels F1, F2 …, and the number left out."""
    best = top_k(findings, INCIDENT, [F.desc("confidence"), F.asc("finding_id")], p.findings, "finding_id", "rank")
    best = best.withColumn("label", F.concat(F.lit("F"), F.col("rank").cast("string")))
    total = findings.groupBy(*INCIDENT).agg(F.greatest(F.count(F.lit(1)) - p.findings, F.lit(0)).alias("omitted"))
    return best, total


def evidence_refs(incidents: DataFrame, findings: DataFrame, stages: DataFrame, factors: DataFrame, intel: DataFrame, timeline: DataFrame,
                  p: Evidence = Evidence()) -> DataFrame:
    """(incident, label, kind, event_ids, finding_ids) for everything a claim may cite.

    ``incidents`` has event_ids; ``stages`` is (incident, stage, first_event_id, last_event_id); ``factors`` is (incident,
    factor); ``intel`` is (incident, indicator_type, indicator); ``timeline`` is (incident, entry_no, event_ids)."""
    n = p.ids_per_ref

    def ref(df, label, kind, events=None, found=None):
        return df.select(*INCIDENT, label.alias("label"), F.lit(kind).alias("kind"), (events if events is not None else _none()).alias("event_ids"),
                         (found if found is not None else _none()).alias("finding_ids"))
    best, _ = rank_findings(findings, p)
    own = F.array_union(F.array(F.col("event_id").cast("string")), F.coalesce("event_ids", _none()))
    intel_first = top_k(intel, INCIDENT, [F.asc("indicator_type"), F.asc("indicator")], p.intel, "indicator", "k")
    entries = timeline.where(F.col("entry_no") <= p.timeline)
    ends = F.array_distinct(F.array_compact(F.array(F.col("first_event_id").cast("string"), F.col("last_event_id").cast("string"))))
    parts = [
        ref(incidents, F.lit("C:correlation"), "correlation", F.slice("event_ids", 1, n)),
        ref(stages, F.concat(F.lit("S:"), "stage"), "stage", ends),
        ref(best, F.col("label"), "finding", F.slice(own, 1, n), F.array("finding_id")),
        ref(factors, F.concat(F.lit("R:"), "factor"), "risk_factor"),
        ref(intel_first, F.concat(F.lit("TI"), F.col("k").cast("string")), "threat_intel"),
        ref(entries, F.concat(F.lit("T"), F.col("entry_no").cast("string")), "timeline", F.slice("event_ids", 1, n))]
    return reduce(DataFrame.unionByName, parts)


def evidence_facts(incidents: DataFrame, stages: DataFrame, scored: DataFrame) -> DataFrame:
    """Code-authored fact sentences: totals, one per stage, and the risk."""
    i = incidents.select(*INCIDENT, F.lit("observed").alias("evidence_type"), F.format_string(
        "%d correlated events (%d flagged by rules/model) across %d source(s), %d session(s), %d account(s).", F.col("event_count"),
        F.col("seed_event_count"), F.col("source_count"), F.col("session_count"), F.col("account_count")).alias("text"))
    s = stages.select(*INCIDENT, F.lit("observed").alias("evidence_type"),
                      F.format_string("Stage '%s': %d event(s).", safe_text(F.col("stage"), 60), F.col("n")).alias("text"))
    r = scored.where(F.col("risk_level").isNotNull()).select(*INCIDENT, F.lit("derived_metric").alias("evidence_type"), F.format_string(
        "Deterministic risk: %s (score %s, evidence confidence %s).", F.col("risk_level"), F.col("risk_score").cast("string"),
        F.col("confidence").cast("string")).alias("text"))
    return i.unionByName(s).unionByName(r)


def fit_budget(items: DataFrame, keys, max_chars: int = 9000, base_chars: int = 0) -> DataFrame:
    """Items (section, position, chars) with ``dropped``: the tail of the timeline goes first, then enrichment, findings
    and limitations, until the total fits.  An evidence set holds a few dozen items by construction."""
    section, pos = F.col("section"), F.col("position")
    order = F.coalesce(*[F.when(section == s, F.lit(i)) for i, (s, _) in enumerate(BUDGET)], F.lit(99))
    keep = F.coalesce(*[F.when(section == s, F.lit(k)) for s, k in BUDGET], F.lit(10**9))
    total = items.groupBy(*keys).agg((F.sum("chars") + base_chars).alias("_total"))
    d = items.join(total, keys).withColumn("_may", pos > keep)
    w = Window.partitionBy(*keys, "_may").orderBy(order, F.desc("position"))
    freed = F.sum("chars").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("chars")
    nth = F.row_number().over(w)
    d = d.withColumn("dropped", F.col("_may") & (F.col("_total") - freed > max_chars) & (nth <= MAX_DROPS))
    return d.drop("_total", "_may")


def bundle_fingerprint(bundles: DataFrame, columns) -> DataFrame:
    """16 hex digits over the sorted JSON of the given columns."""
    return bundles.withColumn("fingerprint", F.left(F.sha2(F.to_json(F.struct(*sorted(columns))), 256), F.lit(16)))


def role_of() -> Column:
    kind = F.col("finding_type")
    model = (F.col("agent_name") == "anomaly_model") | (kind == "ml_anomaly")
    attack = kind.startswith("attack")
    roles = F.array_compact(F.array(F.when(model, "anomaly_agent"), F.when(attack, "attack_agent"), F.when(~model & ~attack, "detection_agent")))
    return roles


ROLES = ("detection_agent", "attack_agent", "anomaly_agent")


def role_indicators(findings: DataFrame, max_ids: int = 10) -> DataFrame:
    """A row per role and finding: id, rule, category, confidence and its first events, the anchor first.

    A finding of the model on an attack counts for both roles."""
    ids = F.slice(F.array_distinct(F.concat(F.array(F.col("event_id").cast("string")), F.coalesce("event_ids", _none()))), 1, max_ids)
    score = F.when(F.col("role") == "anomaly_agent", F.col("anomaly_score")) if "anomaly_score" in findings.columns else F.lit(None).cast("double")
    return findings.withColumn("role", F.explode(role_of())).select(
        *INCIDENT, "role", "finding_id", "rule_id", F.coalesce("category", "finding_type").alias("category"),
        F.round(F.coalesce("confidence", F.lit(0.0)), 3).alias("confidence"), ids.alias("event_ids"), score.alias("anomaly_score"))


def role_summaries(findings: DataFrame, incidents: DataFrame | None = None) -> DataFrame:
    """Per incident and role: status, findings, categories, highest confidence; every role has a row, ``no_findings`` if it has none.

    ``incidents`` adds incidents without findings.  The rows behind it are :func:`role_indicators`."""
    every = findings.select(*INCIDENT).distinct() if incidents is None else incidents.select(*INCIDENT).distinct()
    grid = every.withColumn("role", F.explode(F.array(*[F.lit(r) for r in ROLES])))
    some = (findings.withColumn("role", F.explode(role_of())).groupBy(*INCIDENT, "role").agg(
        F.count(F.lit(1)).alias("indicators"), F.sort_array(F.collect_set(F.coalesce("category", "finding_type"))).alias("categories"),
        F.round(F.max("confidence"), 3).alias("max_confidence")))
    d = grid.join(some, [*INCIDENT, "role"], "left").withColumn("indicators", F.coalesce("indicators", F.lit(0))).withColumn("categories", F.coalesce("categories", _none()))
    return d.withColumn("suspicious", F.col("indicators") > 0).withColumn("status", F.when(F.col("indicators") > 0, "ok").otherwise("no_findings"))


# ------------------------------------------------------------------------------------------------ grounding
def resolve_refs(claims: DataFrame, refs: DataFrame, keys, incident=INCIDENT, max_ids: int = 25) -> DataFrame:
    """Per claim: valid labels (distinct, in order), number of invalid ones, and the ids they stand for."""
    cited = claims.select(*keys, F.posexplode("refs").alias("pos", "ref")).where(F.col("ref").isNotNull())
    cited = cited.withColumn("label", F.trim("ref"))
    known = refs.select(*incident, "label", "event_ids", "finding_ids", F.lit(True).alias("_ok"))
    d = cited.join(known, [*incident, "label"], "left")
    # a claim's reference list is one short array of one row
    g = d.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("_ok"), F.struct("pos", "label", "event_ids", "finding_ids")))).alias("v"),
        F.count_if(F.col("_ok").isNull()).alias("invalid"))

    def ids(field):
        return F.slice(F.array_distinct(F.flatten(F.transform("v", lambda x: F.coalesce(x[field], _none())))), 1, max_ids)
    g = g.select(*keys, F.array_distinct(F.transform("v", lambda x: x["label"])).alias("labels"), "invalid", ids("event_ids").alias("event_ids"),
                 ids("finding_ids").alias("finding_ids"))
    out = claims.join(g, keys, "left")
    for c in ("labels", "event_ids", "finding_ids"):
        out = out.withColumn(c, F.coalesce(F.col(c), _none()))
    return out.withColumn("invalid", F.coalesce("invalid", F.lit(0)))


def ground_claims(resolved: DataFrame, incident=INCIDENT, order: str = "claim_no", p: Evidence = Evidence()) -> DataFrame:
    """Claims with text and known labels, the first six of each incident kept; ``kept`` and ``supported`` per claim."""
    d = resolved.withColumn("claim", model_text(F.col("claim"), 400))
    d = d.withColumn("supported", (F.col("claim") != "") & (F.size("labels") > 0))
    best = top_k(d.where("supported").select(*incident, order), incident, [F.asc(order)], p.claims, order, "k").select(*incident, order, F.lit(True).alias("kept"))
    return d.join(best, [*incident, order], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def grounding_report(grounded: DataFrame, hypotheses: DataFrame | None = None, incident=INCIDENT) -> DataFrame:
    """Counters per incident and the verdict: ``ok`` or ``rejected_ungrounded``.  ``hypotheses`` is (incident, labels)."""
    g = grounded.groupBy(*incident).agg(
        F.count(F.lit(1)).alias("claims_received"), F.count_if("kept").alias("claims_kept"), F.count_if(~F.col("supported")).alias("unsupported_claims_dropped"),
        F.sum("invalid").alias("invalid_refs_removed"))
    if hypotheses is None:
        g = g.withColumn("hypothesis_grounded", F.lit(True))
    else:                                                  # an incident may have a hypothesis and no claim at all
        h = hypotheses.select(*incident, (F.size("labels") > 0).alias("hypothesis_grounded"))
        g = g.join(h, incident, "full").withColumn("hypothesis_grounded", F.coalesce("hypothesis_grounded", F.lit(False)))
        g = g.na.fill(0, ["claims_received", "claims_kept", "unsupported_claims_dropped", "invalid_refs_removed"])
    ok = F.col("hypothesis_grounded") & (F.col("claims_kept") > 0)
    return g.withColumn("status", F.when(ok, "ok").otherwise("rejected_ungrounded"))


def cap_confidence(model: Column, evidence: Column) -> tuple[Column, Column]:
    """(confidence, basis): the model's value clamped to [0, 1] and capped by the evidence confidence."""
    m = F.when(model.isNotNull(), F.least(F.greatest(model, F.lit(0.0)), F.lit(1.0)))
    capped = F.coalesce(m > evidence, F.lit(False))
    value = F.when(m.isNull() | capped, evidence).otherwise(m)
    basis = (F.when(m.isNull(), "model gave no confidence; deterministic evidence confidence shown; not a probability")
             .when(capped, "AI self-assessment capped at the deterministic evidence confidence; not a probability")
             .otherwise("AI self-assessment; not a probability"))
    return value, basis


def normal_action(c: Column) -> Column:
    return F.translate(F.lower(model_text(c, 60)), " -", "__")


def ground_recommendations(resolved: DataFrame, incident=INCIDENT, order: str = "rec_no", p: Evidence = Evidence()) -> DataFrame:
    """Usable recommendations: allowed action, rationale and known labels, first per action, ordered by priority, at most five.

    Approval fields are fixed here, never taken from the model."""
    d = (resolved.withColumn("action", normal_action(F.col("action"))).withColumn("rationale", model_text(F.col("rationale"), 400))
         .where(F.col("action").isin(*p.actions) & (F.col("rationale") != "") & (F.size("labels") > 0)))
    d = d.withColumn("priority", F.when(F.col("priority").between(1, 3), F.col("priority")).otherwise(2))
    d = top_k(d, [*incident, "action"], [F.asc(order)], 1, order, "_first").drop("_first")
    d = top_k(d, incident, [F.asc("priority"), F.asc("action")], p.recommendations, "action", "position")
    return (d.withColumn("requires_human_approval", F.lit(True)).withColumn("status", F.lit("proposed")).withColumn("executed", F.lit(False)))


def overconfident_phrases(text: Column, p: Evidence = Evidence()) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(x.lower()), F.lit(x)) for x in sorted(p.phrases)]))


TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}]|[^{}"]++|"'          # a string, a brace, a run of neither


def parse_model_output(df: DataFrame, column: str = "output") -> DataFrame:
    """Adds ``parsed`` (JSON text of the first object in the output) and ``parse_status``; fences and prose around the object are tolerated.

    The object ends where the braces outside strings, from the first opening one on, are balanced: one pass over the tokens, then one
    parse."""
    tokens = F.regexp_extract_all(F.substr(F.col(column), F.instr(column, "{")), F.lit(TOKEN), F.lit(0))

    def walk(at, token):
        depth = at["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        done = at["end"] > 0
        return F.struct(F.when(done, at["depth"]).otherwise(depth).alias("depth"), (at["n"] + 1).alias("n"),
                        F.when(done, at["end"]).when(depth == 0, at["n"] + 1).otherwise(0).alias("end"))
    end = F.aggregate("_tokens", F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end")), walk, lambda at: at["end"])
    d = once(df, "_tokens", F.when(F.instr(column, "{") > 0, tokens))
    d = once(d, "_end", end)
    d = d.withColumn("parsed", F.to_json(F.try_parse_json(F.when(F.col("_end") > 0, F.array_join(F.slice("_tokens", 1, F.col("_end")), ""))))).drop("_tokens", "_end")
    return d.withColumn("parse_status", F.when(F.col("parsed").isNull(), "invalid_output").otherwise("ok"))


def trim_missing(items: Column, p: Evidence = Evidence()) -> Column:
    """First five missing-evidence items, cleaned, empty ones left out (the cut comes first)."""
    return F.filter(F.transform(F.slice(items, 1, p.missing), lambda x: model_text(x, 300)), lambda x: x != "")


def missing_evidence(parsed: Column, p: Evidence = Evidence()) -> Column:
    """Array of (description, why_it_matters) from ``missing_evidence`` of a parsed output: objects and plain texts among the first five items;
    items of other kinds and those without a description are left out."""
    doc = F.try_parse_json(parsed)
    items = []
    for i in range(p.missing):
        item = F.try_variant_get(doc, f"$.missing_evidence[{i}]", "variant")
        kind = F.schema_of_variant(item)

        def text(path, item=item):
            return model_text(F.try_variant_get(item, path, "string"), 300)
        one = F.when(kind.startswith("OBJECT"), F.struct(text("$.description").alias("description"), text("$.why_it_matters").alias("why_it_matters")))
        items.append(one.when(kind == "STRING", F.struct(text("$").alias("description"), F.lit("").alias("why_it_matters"))))
    return F.filter(F.array_compact(F.array(*items)), lambda x: x["description"] != "")


def trim_alternatives(items: Column, p: Evidence = Evidence()) -> Column:
    return F.filter(F.transform(F.slice(items, 1, p.alternatives), lambda x: model_text(x, 300)), lambda x: x != "")


# ------------------------------------------------------------------------------------------------ stored results
def merge_keep_last_good(prev: DataFrame, new: DataFrame, keys=INCIDENT) -> DataFrame:
    """Stored result after a run: a failed run never replaces a good one (``kept_previous``)."""
    a, b = prev.select(*keys, F.struct(*[c for c in prev.columns if c not in keys]).alias("a")), new.select(
        *keys, F.struct(*[c for c in prev.columns if c not in keys]).alias("b"))
    d = a.join(b, keys, "full")
    keep = F.coalesce((F.col("b.status") != "ok") & (F.col("a.status") == "ok"), F.lit(False))
    chosen = F.when(F.col("b").isNull() | keep, F.col("a")).otherwise(F.col("b"))
    return d.select(*keys, chosen.alias("r"), (F.col("b").isNotNull() & keep).alias("kept_previous")).select(*keys, "r.*", "kept_previous")


def investigation_staleness(current: DataFrame) -> DataFrame:
    """Compares what an investigation saw (``inv_*``) with the incident now."""
    pairs = (("inv_event_count", "event_count", "events_changed"), ("inv_scored_at", "scored_at", "risk_changed"),
             ("inv_intel_at", "intel_at", "threat_intel_changed"))
    reasons = F.array_compact(F.array(*[F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(t)) for a, b, t in pairs]))
    return current.select(*INCIDENT, (F.size(reasons) > 0).alias("stale"), reasons.alias("stale_reasons"))


def audit_tail(entries: DataFrame, more: DataFrame | None, keys, order: str, n: int = 50) -> DataFrame:
    """The last ``n`` entries of each incident after appending ``more``."""
    every = entries if more is None else entries.unionByName(more)
    return top_k(every, keys, [F.desc(order)], n, order, "age")


def pick_for_investigation(incidents: DataFrame, k: int = 3) -> DataFrame:
    """Highest-risk incidents of each tenant first."""
    return top_k(incidents, ["website_id"], [F.desc(F.coalesce("risk_score", F.lit(0.0))), F.asc("incident_id")], k, "incident_id", "position")
