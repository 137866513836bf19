"""Declarative detection rules.

A rule returns *hits* (one row per finding), *cites* (one row per finding and event cited by it alone) and, where findings share
events, *refs* to runs of events that are kept once.  :func:`finding_envelope` joins them into the common finding shape, with the cited
ids listed up to a cap and the true count kept next to it; :func:`citations` gives all of them.  All grouping is by partial aggregation or by (entity, time bucket), so a source or session may
hold any share of the rows.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.signals import QUERY_ONLY, SIGNALS, decode_target, match_signals, query_part
from tidewatch.operators.citations import GROUP, Citations
from tidewatch.operators.ordered import MICROS, first_ids, once, spread_join, top_k, with_halo
from tidewatch.operators.sessions import (SESSION, entity_runs, median_gap, request_peak, with_entity,
                                          with_session_key)
from tidewatch.params import MAX_CITED, RULE_AGENT, RULES, Detection
from tidewatch.session import checkpointed
from tidewatch.sources.store import replace_findings

ENTITY = ["website_id", "entity"]
KEY = ["website_id", "rule_id", "group_key"]
ATTACK_COLUMNS = ("website_id", "event_id", "ts_us", "source_ip", "session_id", "endpoint", "method", "status_code", "source", "matches")


class Rule(NamedTuple):
    hits: DataFrame
    cites: DataFrame | None = None        # website_id, rule_id, group_key, event_id, ts_us
    refs: DataFrame | None = None         # website_id, rule_id, group_key, group_id
    runs: dict[str, DataFrame] = {}       # by kind of run: website_id, group_id, event_id, ts_us


# ------------------------------------------------------------------------------------------------ helpers
def _seconds(us: Column) -> Column:
    return us / F.lit(1e6)


def _stamp(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _observed(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _derived(**values: Column) -> Column:
    if not values:
        return F.lit(None).cast("map<string,double>")
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("double"))])


def _hits(df: DataFrame, rule_id: Column | str, subject: str, group: Column, anchor: str, confidence: Column | float,
          observed: Column, derived: Column, cited: str) -> DataFrame:
    rule = F.lit(rule_id) if isinstance(rule_id, str) else rule_id
    conf = F.lit(confidence) if isinstance(confidence, (int, float)) else confidence
    return df.select("website_id", rule.alias("rule_id"), group.cast("string").alias("group_key"),
                     F.col(subject).cast("string").alias("subject"), F.col(anchor).alias("event_id"),
                     F.round(F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0)), 3).alias("confidence"),
                     observed.alias("observed"), derived.alias("derived"), F.col(cited).cast("bigint").alias("cited_events"))


def _cites(df: DataFrame, rule_id: Column | str, group: Column) -> DataFrame:
    rule = F.lit(rule_id) if isinstance(rule_id, str) else rule_id
    return df.select("website_id", rule.alias("rule_id"), group.cast("string").alias("group_key"), "event_id", "ts_us")


# ------------------------------------------------------------------------------------------------ authentication
def failure_runs(events: DataFrame, gap_s: float) -> DataFrame:
    """Failed logins with the run they belong to."""
    runs = entity_runs(events.where(F.col("event_type") == "login_failure"), gap_s)
    return runs.select(*ENTITY, "event_id", "ts_us", "user_id", "run_us", "run_event")


def bursts(runs: DataFrame, min_failures: int) -> DataFrame:
    """Runs of at least ``min_failures``: count, start, end, last event and distinct accounts."""
    order = F.struct("ts_us", "event_id")
    return (runs.groupBy(*ENTITY, "run_us", "run_event")
            .agg(F.count(F.lit(1)).alias("n"), F.max("ts_us").alias("end_us"), F.max_by("event_id", order).alias("last_event"),
                 F.count_distinct(F.when(F.col("user_id") != "", F.col("user_id"))).alias("accounts"))
            .where(F.col("n") >= min_failures))


def _burst_members(runs: DataFrame, found: DataFrame) -> DataFrame:
    return spread_join(runs, found.select(*ENTITY, "run_event"), [*ENTITY, "run_event"], "left_semi")


def _run_rule(hits: DataFrame, refs: DataFrame, runs: DataFrame, gap_s: float, least: int, rule_id: str, cites: DataFrame | None = None) -> Rule:
    """A rule whose findings cite whole runs.  ``refs`` is (website_id, group_key, run_event); the runs of one gap and least length are one
    kind, whichever rules cite them."""
    kind = f"run-{gap_s:g}-{least}"
    group = F.concat(F.lit(kind + "|"), F.col("run_event").cast("string")).alias("group_id")
    members = _burst_members(runs, bursts(runs, least)).select("website_id", group, "event_id", "ts_us")
    return Rule(hits, cites, refs.select("website_id", F.lit(rule_id).alias("rule_id"), F.col("group_key").cast("string").alias("group_key"), group), {kind: members})


def auth_burst(events: DataFrame, p: Detection = Detection(), runs: DataFrame | None = None) -> Rule:
    runs = failure_runs(events, p.burst_gap_s) if runs is None else runs
    b = bursts(runs, p.burst_min)
    n, dur = F.col("n"), _seconds(F.col("end_us") - F.col("run_us"))
    growth = F.least(F.lit(1.0), (n - p.burst_min) / F.lit(4.0 * p.burst_min))
    conf = p.burst_confidence + (p.burst_confidence_max - p.burst_confidence) * growth
    hits = _hits(b, "R-AUTH-001", "entity", F.col("run_event"), "last_event", conf,
                 _observed(source=F.col("entity"), failed_login_count=n, window_start=_stamp(F.col("run_us")),
                           window_end=_stamp(F.col("end_us")), duration_s=F.round(dur, 3),
                           distinct_accounts_targeted=F.col("accounts")),
                 _derived(failures_per_second=F.round(n / F.greatest(dur, F.lit(1.0)), 2)), "n")
    return _run_rule(hits, b.select("website_id", F.col("run_event").alias("group_key"), "run_event"), runs, p.burst_gap_s, p.burst_min, "R-AUTH-001")


def auth_multi_account(events: DataFrame, p: Detection = Detection(), runs: DataFrame | None = None) -> Rule:
    runs = failure_runs(events, p.multi_gap_s) if runs is None else runs
    b = bursts(runs, p.multi_min).where(F.col("accounts") >= p.multi_users)
    dur = _seconds(F.col("end_us") - F.col("run_us"))
    hits = _hits(b, "R-AUTH-002", "entity", F.col("run_event"), "last_event", p.multi_confidence,
                 _observed(source=F.col("entity"), failed_login_count=F.col("n"), distinct_accounts_targeted=F.col("accounts"),
                           duration_s=F.round(dur, 3)),
                 _derived(failures_per_account=F.round(F.col("n") / F.col("accounts"), 2)), "n")
    return _run_rule(hits, b.select("website_id", F.col("run_event").alias("group_key"), "run_event"), runs, p.multi_gap_s, p.multi_min, "R-AUTH-002")


def success_after_burst(events: DataFrame, p: Detection = Detection(), runs: DataFrame | None = None) -> Rule:
    """Interval join of successes and burst ends of one entity, on time slots as wide as the look-back: a burst is
    offered to its own slot and the next one, so the join key is (entity, slot) and not a whole entity."""
    runs = failure_runs(events, p.burst_gap_s) if runs is None else runs
    b = bursts(runs, p.burst_min)
    width = int(p.success_lookback_s * MICROS)
    slot = F.floor(F.col("end_us") / F.lit(width)).cast("bigint")
    ends = b.withColumn("_slot", F.explode(F.array(slot, slot + 1)))
    ok = (with_entity(events).where((F.col("event_type") == "login_success") & F.col("entity").isNotNull())
          .select(*ENTITY, "event_id", "ts_us", "user_id")
          .withColumn("_slot", F.floor(F.col("ts_us") / F.lit(width)).cast("bigint")))
    delay = F.col("ts_us") - F.col("end_us")
    pairs = ok.join(ends, [*ENTITY, "_slot"]).where((delay > 0) & (delay <= width)).drop("_slot")
    users = (_burst_members(runs, b).where(F.col("user_id") != "").select(*ENTITY, "run_event", "user_id").distinct()
             .withColumn("matched", F.lit(True)))
    pairs = checkpointed(pairs.join(users, [*ENTITY, "run_event", "user_id"], "left")        # read for hits, references and cites
                         .withColumn("matched", F.coalesce("matched", F.lit(False))).withColumn("cited", F.col("n") + 1))
    group = F.concat_ws("|", F.col("run_event").cast("string"), F.col("event_id").cast("string"))
    conf = F.when(F.col("matched"), p.success_match_confidence).otherwise(p.success_confidence)
    hits = _hits(pairs, "R-AUTH-003", "entity", group, "event_id", conf,
                 _observed(source=F.col("entity"), failed_login_count=F.col("n"), burst_end=_stamp(F.col("end_us")),
                           success_at=_stamp(F.col("ts_us")), account_was_targeted_in_burst=F.col("matched")),
                 _derived(seconds_after_burst=F.round(_seconds(F.col("ts_us") - F.col("end_us")), 3)), "cited")
    refs = pairs.select("website_id", group.alias("group_key"), "run_event")
    return _run_rule(hits, refs, runs, p.burst_gap_s, p.burst_min, "R-AUTH-003", _cites(pairs, "R-AUTH-003", group))


# ------------------------------------------------------------------------------------------------ behaviour
def request_rate(events: DataFrame, p: Detection = Detection()) -> Rule:
    keyed = with_session_key(events)
    rows = keyed.where("features.is_request_event").select(*SESSION, "event_id", "ts_us")
    peaks = request_peak(keyed, p.rate_window_s).where(F.col("peak") >= p.rate_min)
    low = F.col("peak_us") - F.lit(int(p.rate_window_s * MICROS))
    near = checkpointed(spread_join(rows, peaks, SESSION))                                   # read for hits and cites
    start = F.min(F.when(F.col("ts_us").between(low, F.col("peak_us")), F.col("ts_us")))
    per = (near.groupBy(*SESSION, "peak", "peak_us", "peak_event")
           .agg(F.count(F.lit(1)).alias("total"), start.alias("start_us")))
    hits = _hits(per, "R-BEH-001", "session_key", F.col("session_key"), "peak_event", p.rate_confidence,
                 _observed(session=F.col("session_key"), requests_in_peak_window=F.col("peak"), window_s=F.lit(p.rate_window_s),
                           window_start=_stamp(F.col("start_us")), window_end=_stamp(F.col("peak_us")),
                           total_requests_in_session=F.col("total")),
                 _derived(peak_requests_per_second=F.round(F.col("peak") / p.rate_window_s, 2), limit=F.lit(p.rate_min)), "peak")
    return Rule(hits, _cites(near.where(F.col("ts_us").between(low, F.col("peak_us"))), "R-BEH-001", F.col("session_key")))


def automation(events: DataFrame, p: Detection = Detection()) -> Rule:
    agent = F.col("features.ua_class").isin("headless_browser", "automation_tool")
    driver = F.coalesce(F.col("features.webdriver"), F.lit(False))
    rows = with_session_key(events).where(agent | driver)
    order = F.struct("ts_us", "event_id")
    g = rows.groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(agent).alias("by_agent"), F.bool_or(driver).alias("by_driver"),
        F.min_by(F.struct("event_id", F.col("features.ua_class").alias("ua_class"),
                          F.left(F.coalesce("user_agent", F.lit("")), F.lit(200)).alias("ua")), order).alias("a"))
    g = (g.withColumn("anchor", F.col("a.event_id"))
         .withColumn("signals", F.array_compact(F.array(F.when(F.col("by_agent"), "automation_user_agent"),
                                                        F.when(F.col("by_driver"), "navigator_webdriver_flag")))))
    conf = F.when(F.size("signals") >= 2, p.automation_two).otherwise(p.automation_one)
    hits = _hits(g, "R-BEH-002", "session_key", F.col("session_key"), "anchor", conf,
                 _observed(session=F.col("session_key"), signals=F.array_join("signals", ","),
                           user_agent_class=F.col("a.ua_class"), user_agent=F.col("a.ua"), events_with_signal=F.col("n")),
                 _derived(independent_signal_count=F.size("signals")), "n")
    return Rule(hits, _cites(rows, "R-BEH-002", F.col("session_key")))


def non_human_navigation(events: DataFrame, p: Detection = Detection()) -> Rule:
    keyed = with_session_key(events)
    kind = F.col("event_type")
    view = kind == "page_view"
    used = F.when(kind == "interaction", F.col("features.interaction_total"))
    g = keyed.groupBy(*SESSION).agg(
        F.count_if(view).alias("views"), F.coalesce(F.sum(used), F.lit(0)).alias("used"),
        F.max_by(F.when(view, F.col("event_id")), F.when(view, F.struct("ts_us", "event_id"))).alias("anchor"))
    quiet = g.where((F.col("views") >= p.nav_views) & (F.col("used") == 0))
    views = spread_join(keyed.where(view), quiet.select(*SESSION), SESSION, "left_semi")
    gap = median_gap(views).withColumn("gap_s", F.col("median_gap_us") / 1e6).where(F.col("gap_s") <= p.nav_gap_s)
    found = checkpointed(quiet.join(gap, SESSION))                                           # a row per session, read for hits and cites
    hits = _hits(found, "R-BEH-003", "session_key", F.col("session_key"), "anchor", p.nav_confidence,
                 _observed(session=F.col("session_key"), page_views=F.col("views"), interaction_signals_recorded=F.col("used")),
                 _derived(median_seconds_between_page_views=F.round(F.col("gap_s"), 3)), "views")
    return Rule(hits, _cites(spread_join(keyed.where(view), found.select(*SESSION), SESSION, "left_semi"), "R-BEH-003", F.col("session_key")))


def probe_of(path: Column, probes) -> Column:
    """First probe (in list order) that the path equals or lies below."""
    low = F.lower(path)
    return F.coalesce(*[F.when((low == x.lower()) | low.startswith(x.lower() + "/"), F.lit(x.lower())) for x in probes])


def recon_paths(events: DataFrame, p: Detection = Detection()) -> Rule:
    rows = once(with_session_key(events).where("features.is_request_event"), "probe",
                probe_of(F.col("features.path"), p.recon_paths)).where(F.col("probe").isNotNull())
    # the set of probes is at most as long as the configured list
    g = rows.groupBy(*SESSION).agg(F.sort_array(F.collect_set("probe")).alias("probes"), F.count(F.lit(1)).alias("n"),
                                   F.max_by("event_id", F.struct("ts_us", "event_id")).alias("anchor"))
    g = checkpointed(g.where(F.size("probes") >= p.recon_distinct))                          # a row per session, read for hits and cites
    hits = _hits(g, "R-BEH-004", "session_key", F.col("session_key"), "anchor", p.recon_confidence,
                 _observed(session=F.col("session_key"), probe_paths_requested=F.array_join("probes", ","), requests=F.col("n")),
                 _derived(distinct_probe_paths=F.size("probes")), "n")
    return Rule(hits, _cites(spread_join(rows, g.select(*SESSION), SESSION, "left_semi"), "R-BEH-004", F.col("session_key")))


# ------------------------------------------------------------------------------------------------ attack indicators
def attack_events(events: DataFrame, p: Detection = Detection()) -> DataFrame:
    """Events with matching attack signals: ``matches ARRAY<STRUCT<rule_id, signals>>``.  The decoded target is computed
    once per row (one-element explode), not once per pattern."""
    on = [r for r in SIGNALS if p.enabled(r)]
    rows = once(events.where(F.col("endpoint") != ""), "_t", decode_target(F.col("endpoint")))
    found = [F.struct(F.lit(r).alias("rule_id"),
                      match_signals(query_part(F.col("_t")) if r in QUERY_ONLY else F.col("_t"), SIGNALS[r]).alias("signals"))
             for r in on]
    empty = F.array().cast("array<struct<rule_id:string,signals:array<string>>>")
    matches = F.filter(F.array(*found), lambda m: F.size(m["signals"]) > 0) if on else empty
    rows = once(rows, "matches", matches).drop("_t")
    return rows.where(F.size("matches") > 0)


def attack_patterns(events: DataFrame, p: Detection = Detection(), attacks: DataFrame | None = None) -> Rule:
    rows = attack_events(events, p) if attacks is None else attacks
    rows = rows.withColumn("m", F.explode("matches")).withColumn("one", F.lit(1))
    base = F.coalesce(*[F.when(F.col("m.rule_id") == r, F.lit(float(c))) for r, c in p.attack_confidence.items()])
    n = F.size("m.signals")
    conf = F.least(F.lit(0.95), base + F.when(n > 1, 0.1).otherwise(0.0))
    observed = {"endpoint": F.left("endpoint", F.lit(300)), "matched_signals": F.array_join("m.signals", ",")}
    observed.update({c: F.col(c) for c in ("method", "status_code", "source") if c in rows.columns})
    rule = F.col("m.rule_id")
    hits = _hits(rows, rule, "event_id", F.col("event_id"), "event_id", conf, _observed(**observed),
                 _derived(matched_signal_count=n), "one")
    return Rule(hits, _cites(rows, rule, F.col("event_id")))


def multi_vector(events: DataFrame, p: Detection = Detection(), attacks: DataFrame | None = None) -> Rule:
    """Widest set of attack categories of an entity in a sliding window, earliest on ties.

    For each row the last time every category was seen is a running maximum inside (entity, bucket); the halo holds the
    rows of the window that lie in the previous bucket, so no entity is ever sorted as a whole."""
    rows = attack_events(events, p) if attacks is None else attacks
    rules = list(SIGNALS)
    rows = with_entity(rows).where(F.col("entity").isNotNull()).select(
        *ENTITY, "event_id", "ts_us", *[F.array_contains(F.col("matches.rule_id"), r).alias(r) for r in rules])
    w = Window.partitionBy(*ENTITY, "_bucket").orderBy("ts_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    width = int(p.vector_window_s * MICROS)
    seen = [(F.max(F.when(F.col(f"`{r}`"), F.col("ts_us"))).over(w) >= F.col("ts_us") - F.lit(width)) for r in rules]
    distinct = reduce(lambda a, b: a + b, [F.coalesce(s.cast("int"), F.lit(0)) for s in seen])
    d = with_halo(rows, p.vector_window_s).withColumn("k", distinct).where(~F.col("_halo"))
    best = (d.where(F.col("k") >= p.vector_categories).groupBy(*ENTITY)
            .agg(F.min(F.struct((-F.col("k")).alias("nk"), F.col("ts_us").alias("us"), F.col("event_id").alias("id"))).alias("b"))
            .select(*ENTITY, (-F.col("b.nk")).alias("k"), F.col("b.us").alias("hi_us"), F.col("b.id").alias("hi_id")))
    inside = (F.col("ts_us") >= F.col("hi_us") - F.lit(width)) & (
        F.struct("ts_us", "event_id") <= F.struct("hi_us", "hi_id"))
    window = checkpointed(spread_join(rows, best, ENTITY).where(inside))                     # read for hits and cites
    counts = [F.count_if(F.col(f"`{r}`")).alias(r) for r in rules]
    per = window.groupBy(*ENTITY, "k", "hi_us", "hi_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("lo_us"), *counts)
    cats = F.array_join(F.array_sort(F.array_compact(F.array(*[
        F.when(F.col(f"`{r}`") > 0, F.concat(F.lit(RULES[r][2] + "="), F.col(f"`{r}`").cast("string"))) for r in rules]))), ",")
    hits = _hits(per, "R-ATK-005", "entity", F.col("entity"), "hi_id", p.vector_confidence,
                 _observed(source=F.col("entity"), categories=cats, indicator_events=F.col("n"), window_start=_stamp(F.col("lo_us")),
                           window_end=_stamp(F.col("hi_us"))),
                 _derived(distinct_categories=F.col("k"), window_limit_s=F.lit(p.vector_window_s)), "n")
    return Rule(hits, _cites(window, "R-ATK-005", F.col("entity")))


def waf_alerts(events: DataFrame, p: Detection = Detection()) -> Rule:
    rows = events.where(F.col("event_type") == "waf_alert").withColumn("one", F.lit(1))
    observed = {"endpoint": F.left(F.coalesce("endpoint", F.lit("")), F.lit(300)), "status_code": F.col("status_code")}
    if "attributes" in events.columns:
        observed.update(waf_rule_name=F.get_json_object("attributes", "$.rule_name"), waf_mode=F.get_json_object("attributes", "$.mode"))
    hits = _hits(rows, "R-WAF-001", "event_id", F.col("event_id"), "event_id", p.waf_confidence, _observed(**observed),
                 _derived(), "one")
    return Rule(hits, _cites(rows, "R-WAF-001", F.col("event_id")))


# ------------------------------------------------------------------------------------------------ envelope
def _lookup(column: Column, values: dict) -> Column:
    return F.coalesce(*[F.when(column == k, F.lit(v)) for k, v in values.items() if v is not None])


def _finding_id() -> Column:
    text = F.concat_ws("|", "website_id", "rule_id", F.col("event_id").cast("string"), "subject", "group_key")
    return F.concat(F.lit("fnd_"), F.left(F.sha2(text, 256), F.lit(32)))


def citations(rule: Rule) -> Citations:
    """Every event that a finding cites, however many, by reference.  Later steps read this, not the short list."""
    ids = checkpointed(rule.hits.select(*KEY, _finding_id().alias("finding_id")))           # read for links, cites and references
    links = [ids.select("website_id", "finding_id", F.col("finding_id").alias("group_id"))]
    members = [run.select(*GROUP, "event_id") for run in rule.runs.values()]
    if rule.cites is not None:
        members.append(spread_join(rule.cites.select(*KEY, "event_id"), ids, KEY).select("website_id", F.col("finding_id").alias("group_id"), "event_id"))
    if rule.refs is not None:
        links.append(rule.refs.join(ids, KEY).select("website_id", "finding_id", "group_id"))
    return Citations(reduce(DataFrame.unionByName, links), reduce(DataFrame.unionByName, members))


def _first_cites(rule: Rule) -> DataFrame:
    """Enough of each finding's citations to list the first MAX_CITED: of a run only so many can be among them."""
    parts = [] if rule.cites is None else [rule.cites]
    if rule.refs is not None:
        run = reduce(DataFrame.unionByName, rule.runs.values())
        first = top_k(run, GROUP, [F.asc("ts_us"), F.asc("event_id")], MAX_CITED, "event_id", "_r").drop("_r")
        parts.append(rule.refs.join(first, GROUP).select(*KEY, "event_id", "ts_us"))
    return reduce(DataFrame.unionByName, parts)


def finding_envelope(rule: Rule, p: Detection = Detection()) -> DataFrame:
    """Findings in the common shape, with stable ids so that a re-run gives equal rows.

    ``event_ids`` lists the first MAX_CITED events for show, ``cited_events`` counts them all; ``citations`` has the whole."""
    ids = first_ids(_first_cites(rule), KEY, MAX_CITED)
    out = rule.hits.join(ids, KEY, "left")
    limits = F.coalesce(*[F.when(F.col("rule_id") == r, F.create_map(
        *[x for k, v in p.thresholds(r).items() for x in (F.lit(k), F.lit(float(v)))])) for r in RULES])
    col = F.col("rule_id")
    return out.select(
        _finding_id().alias("finding_id"), "website_id",
        F.lit(RULE_AGENT).alias("agent_name"), "rule_id", _lookup(col, {r: v[0] for r, v in RULES.items()}).alias("title"),
        _lookup(col, {r: v[1] for r, v in RULES.items()}).alias("finding_type"),
        _lookup(col, {r: v[2] for r, v in RULES.items()}).alias("category"),
        _lookup(col, {r: v[3] for r, v in RULES.items()}).alias("technique_id"),
        "event_id", "subject", "confidence", "observed", "derived", limits.alias("thresholds"), "event_ids", "cited_events",
        (F.col("cited_events") > MAX_CITED).alias("event_ids_truncated"))


def evaluate_rules(events: DataFrame, p: Detection = Detection()) -> DataFrame:
    """Findings of every enabled rule."""
    return finding_envelope(all_rules(events, p), p)


def all_rules(events: DataFrame, p: Detection = Detection()) -> Rule:
    """Hits and cites of every enabled rule.  Failure runs and attack matches are written once for all rules that read them, and what a
    rule needs for its hits and again for its cites once for both, so the frames can be read several times at little cost."""
    first = checkpointed(failure_runs(events, p.burst_gap_s))
    second = first if p.multi_gap_s == p.burst_gap_s else checkpointed(failure_runs(events, p.multi_gap_s))
    attacks = attack_events(events, p)
    attacks = checkpointed(attacks.select(*[c for c in ATTACK_COLUMNS if c in attacks.columns]))
    rules = {
        "R-AUTH-001": lambda: auth_burst(events, p, first),
        "R-AUTH-002": lambda: auth_multi_account(events, p, second),
        "R-AUTH-003": lambda: success_after_burst(events, p, first),
        "R-BEH-001": lambda: request_rate(events, p),
        "R-BEH-002": lambda: automation(events, p),
        "R-BEH-003": lambda: non_human_navigation(events, p),
        "R-BEH-004": lambda: recon_paths(events, p),
        "R-WAF-001": lambda: waf_alerts(events, p),
        "R-ATK-005": lambda: multi_vector(events, p, attacks),
    }
    parts = [make() for r, make in rules.items() if p.enabled(r)]
    if any(p.enabled(r) for r in SIGNALS):
        parts.append(attack_patterns(events, p, attacks))
    if not parts:
        raise ValueError("no rule is enabled")
    def union(frames):
        frames = [f for f in frames if f is not None]
        return reduce(DataFrame.unionByName, frames) if frames else None
    runs = {k: v for r in parts for k, v in r.runs.items()}
    return Rule(union(r.hits for r in parts), union(r.cites for r in parts), union(r.refs for r in parts), runs)


def suspicious_events(findings: DataFrame, cited: Citations) -> DataFrame:
    """Distinct events that carry a finding or are cited by one."""
    anchor = findings.select("website_id", F.col("event_id").cast("string").alias("event_id"))
    return anchor.unionByName(cited.events(findings).select("website_id", F.col("event_id").cast("string").alias("event_id"))).distinct()


def detection_counters(events: DataFrame, findings: DataFrame, cited: Citations) -> DataFrame:
    """Long table (website_id, metric, key, n): events, findings by rule / type / total, anchors, suspicious events."""
    sets = [[F.col("website_id"), F.col("rule_id")], [F.col("website_id"), F.col("finding_type")], [F.col("website_id")]]
    by = (findings.groupingSets(sets, F.col("website_id"), F.col("rule_id"), F.col("finding_type"))
          .agg(F.count(F.lit(1)).alias("n"), F.grouping("rule_id").alias("g1"), F.grouping("finding_type").alias("g2")))
    metric = (F.when(F.col("g1") == 0, "rule").when(F.col("g2") == 0, "finding_type").otherwise("findings"))
    by = by.select("website_id", metric.alias("metric"), F.coalesce("rule_id", "finding_type", F.lit("all")).alias("key"), "n")

    def total(df, name):
        return df.groupBy("website_id").agg(F.count(F.lit(1)).alias("n")).select(
            "website_id", F.lit(name).alias("metric"), F.lit("all").alias("key"), "n")
    return (by.unionByName(total(events, "events_analyzed"))
            .unionByName(total(findings.select("website_id", "event_id").distinct(), "anchor_events"))
            .unionByName(total(suspicious_events(findings, cited), "suspicious_events")))


def rule_catalogue(spark: SparkSession, p: Detection = Detection()) -> DataFrame:
    """Dimension of all rules with title, type, category, technique, state and thresholds (a fixed small list)."""
    rows = [(r, *v, p.enabled(r), {k: float(x) for k, x in p.thresholds(r).items()}) for r, v in RULES.items()]
    return spark.createDataFrame(rows, "rule_id STRING, title STRING, finding_type STRING, category STRING, technique_id STRING, "
                                       "technique_name STRING, enabled BOOLEAN, thresholds MAP<STRING,DOUBLE>")


def _who(events: DataFrame) -> list[Column]:
    """By whom an event is found again: its address, its session, or, with neither, the nameless session of its tenant."""
    ip, sid = F.when(F.col("source_ip") != "", F.col("source_ip")), F.when(F.col("session_id") != "", F.col("session_id"))
    return [ip, sid, F.when(ip.isNull() & sid.isNull(), F.lit("unknown"))]


def touched_events(new_events: DataFrame, store: DataFrame, hours: float | None = 24) -> DataFrame:
    """Stored events of the addresses and sessions of a batch, each once.

    An address or session is read back to ``hours`` before its own oldest new event, so that every new event is analysed however long
    the batch is; with None its whole history is read."""
    since = F.min("ts_us") - F.lit(int(hours * 3600 * MICROS)) if hours is not None else F.min(F.lit(-(2**62)))
    found = []
    for key in _who(new_events):
        first = new_events.groupBy("website_id", key.alias("_k")).agg(since.alias("_since")).where(F.col("_k").isNotNull())
        rows = store.withColumn("_k", key).where(F.col("_k").isNotNull())           # or all rows without such a key would meet in one task
        found.append(spread_join(rows, first, ["website_id", "_k"]).where(F.col("ts_us") >= F.col("_since")).select(*store.columns))
    # only what a batch touches is made distinct; columns that cannot be compared do not matter, an event is its tenant and id
    return reduce(DataFrame.unionByName, found).dropDuplicates(["website_id", "event_id"])


def touched_subjects(new_events: DataFrame) -> DataFrame:
    """(website_id, subject): the addresses and sessions of a batch, as findings name them.  Of these all events are read again."""
    ip, sid, nobody = _who(new_events)
    names = F.explode(F.array(ip, F.concat(F.lit("ip:"), ip), sid, F.concat(F.lit("sid:"), sid), nobody))
    return new_events.select("website_id", names.alias("subject")).where("subject IS NOT NULL").distinct()


def settled(findings: DataFrame, subjects: DataFrame) -> DataFrame:
    """Findings that a re-run over touched entities can vouch for: those of a touched address or session, and those of single events.

    Events come along with a touched session that belong to an address read only in part; what the rules say of that address is left out."""
    own = F.col("subject") == F.col("event_id").cast("string")
    return findings.where(own).unionByName(findings.where(~own).join(subjects, ["website_id", "subject"], "left_semi").select(*findings.columns))


def detect_incremental(new_events: DataFrame, store: DataFrame, findings: DataFrame | None = None,
                       p: Detection = Detection()) -> DataFrame:
    """Findings after a freshly stored batch: rules re-run over the touched entities, results replaced idempotently."""
    rows = checkpointed(touched_events(new_events, store, p.lookback_hours))     # read by every rule
    fresh = settled(evaluate_rules(rows, p), touched_subjects(new_events))
    return fresh if findings is None else replace_findings(findings, fresh, rows, RULE_AGENT).drop("change")
