"""Per-event features and target normalisation as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.masking import unquote_plus, url_path, url_query
from tidewatch.params import Detection

FEATURE_VERSION = 1

# fixed values: event types that count as requests and as authentication, characters counted as special
REQUEST_TYPES = ("page_view", "http_request", "api_access", "sensitive_endpoint_access")
AUTH_TYPES = ("login_success", "login_failure", "session_created", "session_terminated")
INTERACTION_KEYS = ("clicks", "key_events", "scroll_events", "mouse_moves")
SPECIAL_CHARACTERS = "'\"<>;()\\`{}|"


def normalize_endpoint(c: Column) -> Column:
    """Trimmed, without fragment, rooted at ``/`` unless it is an absolute URL; empty becomes NULL."""
    s = F.substring_index(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), "#", 1)
    rooted = F.when(s.startswith("/") | s.contains("://"), s).otherwise(F.concat(F.lit("/"), s))
    return F.when(c != "", rooted)


def _contains_any(c: Column, tokens) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in tokens])


def classify_user_agent(c: Column, p: Detection = Detection()) -> Column:
    low = F.lower(c)
    return (F.when(c.isNull() | (c == ""), "empty")
            .when(_contains_any(low, p.headless_tokens), "headless_browser")
            .when(_contains_any(low, p.automation_tokens), "automation_tool")
            .when(low.startswith("mozilla/"), "browser")
            .otherwise("other"))


def path_prefix_match(path: Column, prefixes) -> Column:
    """Segment-boundary prefix test: equal to a prefix or below it, ignoring case."""
    low = F.lower(path)
    hit = reduce(lambda a, b: a | b, [(low == x.lower()) | low.startswith(x.lower() + "/") for x in prefixes])
    return F.coalesce(hit, F.lit(False))


def typed_number(doc: Column, key: str, lo: int = 0, hi: int = 10**9) -> Column:
    """Number stored under ``key`` of a VARIANT, clamped and truncated; booleans and strings give NULL."""
    kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{key}", "variant"))
    value = F.try_variant_get(doc, f"$.{key}", "double")
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(numeric, F.least(F.greatest(value, F.lit(float(lo))), F.lit(float(hi))).cast("bigint"))


def typed_boolean(doc: Column, key: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(doc, f"$.{key}", "variant"))
    return F.when(kind == "BOOLEAN", F.try_variant_get(doc, f"$.{key}", "boolean"))


def param_count(query: Column) -> Column:
    return F.size(F.filter(F.split(query, "&"), lambda x: x != ""))


def special_char_count(query: Column) -> Column:
    return F.length(query) - F.length(F.translate(query, SPECIAL_CHARACTERS, ""))


def target_parts(endpoint: Column) -> Column:
    """STRUCT(path, query): the target's path and decoded query."""
    ep = F.when(endpoint != "", endpoint)
    return F.struct(url_path(ep).alias("path"), F.coalesce(unquote_plus(url_query(ep)), F.lit("")).alias("query"))


def target_features(path: Column, query: Column, p: Detection = Detection(), event_type="event_type", status="status_code",
                    user_agent="user_agent", timestamp="timestamp") -> list[Column]:
    """Features that need only plain columns (no attributes)."""
    kind, code = F.col(event_type), F.col(status)
    return [
        F.lit(FEATURE_VERSION).alias("v"),
        path.alias("path"),
        F.coalesce(F.size(F.filter(F.split(path, "/"), lambda x: x != "")), F.lit(0)).alias("path_depth"),
        (query != "").alias("has_query"),
        F.length(query).alias("query_length"),
        param_count(query).alias("param_count"),
        special_char_count(query).alias("special_char_count"),
        kind.isin(*REQUEST_TYPES).alias("is_request_event"),
        kind.isin(*AUTH_TYPES).alias("is_auth_event"),
        path_prefix_match(path, p.auth_paths).alias("is_auth_endpoint"),
        ((kind == "sensitive_endpoint_access") | path_prefix_match(path, p.sensitive_paths)).alias("is_sensitive_endpoint"),
        F.when(code != 0, F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))).alias("status_class"),
        F.coalesce(code >= 400, F.lit(False)).alias("is_error_status"),
        classify_user_agent(F.col(user_agent), p).alias("ua_class"),
        F.hour(timestamp).alias("hour_utc"),
    ]


def attribute_features(attributes="attributes", event_type="event_type") -> list[Column]:
    """Features read from the JSON attributes column."""
    doc, kind = F.try_parse_json(F.col(attributes)), F.col(event_type)
    total = reduce(lambda a, b: a + b, [F.coalesce(typed_number(doc, k), F.lit(0)) for k in INTERACTION_KEYS])
    return [
        typed_boolean(doc, "webdriver").alias("webdriver"),
        F.when(kind == "interaction", total).alias("interaction_total"),
        F.when(kind == "page_view", typed_number(doc, "page_seq")).alias("page_seq"),
        F.when(kind == "page_view", typed_number(doc, "load_ms", hi=600_000)).alias("load_ms"),
    ]


def extract_features(events: DataFrame, p: Detection = Detection()) -> DataFrame:
    """Adds ``features STRUCT`` (18 values and a version). Reads only masked columns."""
    if "attributes" in events.columns:
        extra = attribute_features()
    else:
        have = {"webdriver": "boolean", "interaction_total": "bigint", "page_seq": "bigint", "load_ms": "bigint"}
        extra = [(F.col(c) if c in events.columns else F.lit(None)).cast(t).alias(c) for c, t in have.items()]
    d = events.select("*", F.explode(F.array(target_parts(F.col("endpoint")))).alias("_target"))
    parts = target_features(F.col("_target.path"), F.col("_target.query"), p)
    return d.withColumn("features", F.struct(*parts, *extra)).drop("_target")


def event_micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))
