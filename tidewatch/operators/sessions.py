"""Sessions derived from events, and window measures over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import exact_quantiles, near_prev, peak_in_window, prev_row, split_runs
from tidewatch.schema import EVENT_TYPES

SESSION = ["website_id", "session_key"]


def _present(name: str) -> Column:
    return F.when(F.col(name) != "", F.col(name))


def with_session_key(events: DataFrame) -> DataFrame:
    """``session_key`` = session id, else ``ip:<address>``, else ``unknown``; ``inferred`` tells the last two."""
    sid, ip = _present("session_id"), _present("source_ip")
    return (events.withColumn("session_key", F.coalesce(sid, F.concat(F.lit("ip:"), ip), F.lit("unknown")))
            .withColumn("inferred", sid.isNull()))


def with_entity(events: DataFrame) -> DataFrame:
    """``entity`` = address, else ``sid:<session>``; rows with neither give NULL."""
    return events.withColumn("entity", F.coalesce(_present("source_ip"), F.concat(F.lit("sid:"), _present("session_id"))))


def median_gap(events: DataFrame, keys=SESSION, event_type: str = "page_view") -> DataFrame:
    """Exact median of the gaps between successive events of one type, in microseconds."""
    rows = events.where(F.col("event_type") == event_type).select(*keys, "ts_us", "event_id")
    gaps = (prev_row(rows, keys, ["ts_us"]).where(F.col("prev").isNotNull())
            .withColumn("gap_us", F.col("ts_us") - F.col("prev.ts_us")))
    return exact_quantiles(gaps, keys, "gap_us", {"median_gap_us": 0.5})


def request_peak(events: DataFrame, window_s: float = 10.0, keys=SESSION) -> DataFrame:
    """Most request events in any ``window_s`` window of a session, with the last row of that window."""
    rows = events.where("features.is_request_event").select(*keys, "ts_us", "event_id")
    return peak_in_window(rows, keys, window_s)


def session_entities(events: DataFrame) -> DataFrame:
    """Distinct addresses, users and agent classes of each session in long form (session, kind, value)."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (
        ("source_ip", _present("source_ip")), ("user_id", _present("user_id")), ("ua_class", F.col("features.ua_class")))])
    return (with_session_key(events).select(*SESSION, F.explode(kinds).alias("e"))
            .select(*SESSION, "e.kind", "e.value").where(F.col("value").isNotNull()).distinct())


def _with_distinct(sessions: DataFrame, keyed: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds to each session how many distinct values of each name its rows have; an unknown tenant is a tenant like others."""
    long = keyed.select(*SESSION, F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in values.items()])).alias("_v"))
    seen = long.where(F.col("_v.value").isNotNull()).select(*SESSION, "_v.name", "_v.value").distinct()
    counts = seen.groupBy(F.col("website_id").alias("_w"), F.col("session_key").alias("_k")).agg(*[F.count_if(F.col("name") == k).alias(k) for k in values])
    same = F.col("website_id").eqNullSafe(F.col("_w")) & (F.col("session_key") == F.col("_k"))
    return sessions.join(counts, same, "left").drop("_w", "_k").withColumns({k: F.coalesce(k, F.lit(0)) for k in values})


def session_counts(events: DataFrame) -> DataFrame:
    """Counts of each session by partial aggregation.

    Distinct values are counted in a pass of their own over narrow rows; beside the other counts, Spark would repeat every whole row for
    each of them."""
    f, kind, us = (lambda n: F.col(f"features.{n}")), F.col("event_type"), F.col("ts_us")
    request = F.coalesce(f("is_request_event"), F.lit(False))

    def of_type(t):
        return F.count_if(kind == t)
    by_type = F.map_from_arrays(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.array(*[of_type(t) for t in EVENT_TYPES]))
    span = (F.max(F.when(request, us)) - F.min(F.when(request, us))) / 1e6
    g = with_session_key(events).groupBy(*SESSION).agg(
        F.first("inferred").alias("inferred"),
        F.min(us).alias("first_us"), F.max(us).alias("last_us"),
        F.min(F.struct(us, F.col("event_id")))["event_id"].alias("first_event_id"),
        F.count(F.lit(1)).alias("event_count"),
        by_type.alias("event_types"),
        F.coalesce(F.sum(f("interaction_total")), F.lit(0)).alias("interaction_total"),
        F.count_if(request).alias("request_events"),
        F.count_if(f("is_sensitive_endpoint")).alias("sensitive_accesses"),
        F.count_if(f("is_error_status")).alias("error_events"),
        F.sort_array(F.collect_set(f("ua_class"))).alias("ua_classes"),
        F.coalesce(F.bool_or(f("webdriver")), F.lit(False)).alias("webdriver_seen"),
        F.when(span >= 1, F.round(F.count_if(request) / span * 60, 2)).alias("requests_per_min"),
    )
    g = _with_distinct(g, with_session_key(events), {
        "source_ip_count": _present("source_ip"), "user_count": _present("user_id"),
        "distinct_paths": F.when(request & (f("path") != ""), f("path")), "distinct_failed_users": F.when(kind == "login_failure", _present("user_id"))})
    named = {"page_views": "page_view", "interaction_events": "interaction", "login_failures": "login_failure",
             "login_successes": "login_success", "waf_alerts": "waf_alert"}
    for out, t in named.items():
        g = g.withColumn(out, F.col("event_types")[t])
    return (g.withColumn("event_types", F.map_filter("event_types", lambda k, v: v > 0))
            .withColumn("duration_s", F.round((F.col("last_us") - F.col("first_us")) / 1e6, 3)))


def session_summary(events: DataFrame) -> DataFrame:
    """One row per (tenant, session) with counts, distinct counts, rates, peak and median page gap.

    The unbounded sets (addresses, users) are counted here and listed in long form by :func:`session_entities`."""
    keyed = with_session_key(events)
    peak = request_peak(keyed).select(*SESSION, F.col("peak").alias("peak_requests_10s"))
    gap = median_gap(keyed).withColumnRenamed("median_gap_us", "median_page_gap_us")
    return (session_counts(events).join(peak, SESSION, "left").join(gap, SESSION, "left")
            .withColumn("peak_requests_10s", F.coalesce("peak_requests_10s", F.lit(0)))
            .withColumn("median_page_gap_s", F.round(F.col("median_page_gap_us") / 1e6, 3)))


def entity_runs(events: DataFrame, gap_s: float) -> DataFrame:
    """Rows of one entity split into runs whose successive gaps are at most ``gap_s``."""
    rows = with_entity(events).where(F.col("entity").isNotNull())
    return split_runs(rows, ["website_id", "entity"], gap_s)


def group_events(events: DataFrame, keys, gap_s: float) -> DataFrame:
    """Consecutive events of ``keys`` with equal type, session and address and gap ≤ ``gap_s``: adds ``group_us`` and
    ``group_event`` (time and id of the group's first event)."""
    return (split_runs(events, keys, gap_s, same=("event_type", "session_id", "source_ip"))
            .withColumnRenamed("run_us", "group_us").withColumnRenamed("run_event", "group_event"))


def session_findings(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings with the session of their anchor event."""
    key = with_session_key(events).select("website_id", "event_id", "session_key", "ts_us")
    return findings.join(key, ["website_id", "event_id"])


def list_sessions(events: DataFrame, findings: DataFrame, since_us: int | None = None, suspicious_only: bool = False,
                  sort: str = "recent", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of sessions with finding count, rule ids and highest finding confidence."""
    ev = events if since_us is None else events.where(F.col("ts_us") >= since_us)
    per = session_findings(ev, findings).groupBy(*SESSION).agg(
        F.count(F.lit(1)).alias("finding_count"), F.sort_array(F.collect_set("rule_id")).alias("rule_ids"),
        F.max("confidence").alias("max_finding_confidence"))
    rows = session_summary(ev).join(per, SESSION, "inner" if suspicious_only else "left")
    rows = (rows.withColumn("finding_count", F.coalesce("finding_count", F.lit(0)))
            .withColumn("rule_ids", F.coalesce("rule_ids", F.array().cast("array<string>"))))
    first = {"recent": ["last_us"], "events": ["event_count"], "findings": ["finding_count", "last_us"]}[sort]
    return rows.orderBy(*[F.desc(c) for c in first], "website_id", "session_key").offset(offset).limit(limit)


def in_session(events: DataFrame, key: str) -> DataFrame:
    """Events of one session key, as a filter on the stored columns so that it reaches the scan."""
    sid, ip = F.col("session_id"), F.col("source_ip")
    no_sid = sid.isNull() | (sid == "")
    if key.startswith("ip:"):
        return events.where(no_sid & (ip == key[3:]))
    if key == "unknown":
        return events.where(no_sid & (ip.isNull() | (ip == "")))
    return events.where(sid == key)


def session_detail(events: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Events of one session in time order with the findings anchored on each (one row per event and finding)."""
    cols = ["website_id", "event_id", "finding_id", "rule_id", "confidence"]
    rows = with_session_key(in_session(events, key))
    return (rows.select("website_id", "session_key", "event_id", "ts_us", "event_type")
            .join(findings.select(*cols), ["website_id", "event_id"], "left").orderBy("ts_us", "event_id", "finding_id"))


__all__ = ["with_session_key", "with_entity", "median_gap", "request_peak", "session_entities", "session_summary",
           "entity_runs", "group_events", "list_sessions", "session_detail", "near_prev"]
