"""Sources, validation, masking and features."""

import os

from pyspark.sql import functions as F

from tidewatch.functions import features as FE
from tidewatch.functions import masking as M
from tidewatch.functions import signals as SG
from tidewatch.functions import text as TX
from tidewatch.functions.metrics import safe_metrics as metrics_map
from tidewatch.operators import ingest as I
from tidewatch.operators import sessions as S
from tidewatch.operators.ordered import once
from tidewatch.params import SENSITIVE_PATHS
from tidewatch.plans.catalog.base import ORACLE_VIEWS, events, fx, joined, query, table
from tidewatch.session import scratch_path
from tidewatch.sources import batches as B
from tidewatch.sources import store as ST

SALT = "pepper"
SINCE = 1705276800000000          # 2024-01-15
NOW = 1714521600000000            # 2024-05-01


def hexes(c):
    return F.lower(F.hex(c))


def v6_source(canonical: bool):
    """Addresses of every fifth event in version 6, once as typed by people and once as kept; every 35th is broken."""
    low, mapped = hexes(F.col("event_id") % 65535 + 1), F.concat(F.lit("::ffff:10.0.3."), (F.col("event_id") % 250).cast("string"))
    if canonical:
        return F.when(F.col("event_id") % 35 == 0, None).when(F.col("event_id") % 10 == 0, mapped).when(F.col("event_id") % 5 == 0, F.concat(F.lit("2001:db8::7:0:0:"), low)).otherwise(F.col("source_ip"))
    return (F.when(F.col("event_id") % 35 == 0, F.concat(F.lit("2001:db8:::"), low)).when(F.col("event_id") % 10 == 0, F.upper(mapped))
            .when(F.col("event_id") % 5 == 0, F.concat(F.lit(" 2001:0DB8:0:0:07:0000:0:"), F.lpad(low, 4, "0"))).otherwise(F.col("source_ip")))


def raw_events(spark, sf, v6=False):
    """Adapter events as raw JSON texts; interactions carry an unknown field, status 500 becomes an invalid 700."""
    e = fx(spark, sf, "web_events")
    e = e.withColumn("source_ip", v6_source(False)) if v6 else e
    raw = F.to_json(F.struct(
        "event_type", F.lit("sdk").alias("source"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "session_id", "user_id", "source_ip", "user_agent", F.lit("get").alias("method"), "endpoint",
        F.when(F.col("status_code") == 500, 700).otherwise(F.col("status_code")).alias("status_code"), F.struct(F.col("event_id").alias("page_seq")).alias("attributes"),
        "interaction_total"))
    return e.select("website_id", "event_id", raw.alias("raw"))


# ------------------------------------------------------------------------------------------------ sources
@query
def read_event_batches(spark, sf):
    rows = raw_events(spark, sf).withColumn("batch_id", F.floor(F.col("event_id") / 100).cast("bigint"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "raw"))), lambda x: x["raw"])
    files = rows.groupBy("batch_id").agg(F.concat(F.lit('{"events":['), F.array_join(texts, ","), F.lit("]}")).alias("value"))
    path = scratch_path(spark, "batches")
    files.drop("batch_id").write.text(path)
    return (B.explode_batches(spark.read.text(path))
            .select("index", F.get_json_object("raw", "$.event_type").alias("event_type"),
                    F.get_json_object("raw", "$.attributes.page_seq").cast("bigint").alias("event_id")))


@query
def read_labelled_csv(spark, sf):
    e = fx(spark, sf, "web_events")
    path = scratch_path(spark, "labelled")
    cols = [F.col("timestamp").cast("string"), "event_type", F.lit("sdk").alias("source"), "session_id", "user_id", "source_ip",
            "user_agent", F.lit("GET").alias("method"), "endpoint", "status_code", F.to_json(F.struct("event_id")).alias("attributes"),
            F.lit("true").alias("is_synthetic"), "website_id", "event_type"]
    out = e.select(*[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")).alias(n)
                     for c, n in zip(cols, B.CSV_COLUMNS)])
    out.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    ev, labels = B.read_labelled_csv(spark, path)
    return (ev.join(labels, "event_id")
            .select(F.get_json_object("attributes", "$.event_id").cast("bigint").alias("event_id"), "session_id", "endpoint",
                    "status_code", "scenario", "label"))


@query
def load_events(spark, sf):
    return (ST.load_events(events(spark, sf), "web_a", SINCE, ordered=True)
            .select("event_id", "website_id", "ts_us", "event_type", "session_id"))


@query
def load_events_for_entities(spark, sf):
    e = events(spark, sf)
    touched = e.where(F.col("event_type") == "waf_alert").where(F.col("ts_us") >= SINCE)
    return ST.load_events_for_entities(e, touched, touched, SINCE).select("event_id", "website_id", "source_ip", "session_id", "ts_us")


@query
def tenant_scope(spark, sf):
    sites = table(spark, sf, "customer").select(F.col("c_custkey").alias("website_id"), F.col("c_nationkey").alias("account_id"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("website_id"))
    return ST.tenant_scope(orders, sites, 3)


def _rerun(spark, sf):
    e, old = events(spark, sf), fx(spark, sf, "fx_findings")
    analysed = e.where(F.col("ts_us") >= SINCE)
    new = (old.join(analysed.select("website_id", "event_id"), ["website_id", "event_id"], "left_semi")
           .where(F.col("confidence") >= 0.6).withColumn("finding_id", F.concat(F.col("finding_id"), F.lit("-n"))))
    return old, new.select(*old.columns), analysed


@query
def replace_findings(spark, sf):
    old, new, analysed = _rerun(spark, sf)
    return ST.replace_findings(old, new, analysed, "rule_engine").select("finding_id", "website_id", "agent_name", "change")


@query
def replace_counts(spark, sf):
    old, new, analysed = _rerun(spark, sf)
    return ST.replace_counts(old, new, analysed, "rule_engine")


@query
def write_findings(spark, sf):
    path = scratch_path(spark, "findings")
    ST.write_findings(fx(spark, sf, "fx_findings"), path)
    return ST.read_table(spark, path).select("finding_id", "event_id", "website_id", "agent_name", "confidence")


@query
def write_links(spark, sf):
    path = scratch_path(spark, "links")
    ST.write_links(fx(spark, sf, "fx_links"), path)
    return ST.read_table(spark, path).select("website_id", "event_id", "related_event_id", "relationship_type", "strength")


@query
def write_events(spark, sf):
    path = scratch_path(spark, "events")
    ST.write_events(events(spark, sf).withColumn("event_date", F.to_date("timestamp")), path)
    return (ST.load_events(ST.read_table(spark, path), "web_b", SINCE)
            .select("event_id", "website_id", "ts_us", F.col("features.path").alias("path")))


OFFSETS = {"page_view": 300_000_000, "login_failure": 20_000_000}


@query
def shift_time(spark, sf):
    return B.shift_time(events(spark, sf), "event_type", NOW, OFFSETS).select("event_id", "event_type", "ts_us")


@query
def load_report(spark, sf):
    e = B.shift_time(events(spark, sf), "event_type", NOW, OFFSETS)
    return B.load_report(e.withColumn("accepted", F.coalesce(F.col("status_code") != 500, F.lit(True))), "event_type")


# ------------------------------------------------------------------------------------------------ validation
@query
def validate_events(spark, sf):
    return (I.validate_events(raw_events(spark, sf, v6=True))
            .select("event_id", "method", "is_synthetic", "status_code", "source_ip", F.size("errors").alias("n_errors"),
                    F.array_join(F.transform("errors", lambda e: F.substring_index(e, ":", 1)), ",").alias("fields")))


@query
def split_accept_reject(spark, sf):
    good, bad = I.split_accept_reject(I.validate_events(raw_events(spark, sf, v6=True)))
    return (good.select("website_id", F.lit("accepted").alias("outcome"))
            .unionByName(bad.select("website_id", F.lit("rejected").alias("outcome")))
            .groupBy("website_id", "outcome").agg(F.count("*").alias("n")))


@query
def normalize_endpoint(spark, sf):
    url = table(spark, sf, "pages").select("page_id", FE.normalize_endpoint(F.concat(F.lit(" "), "url", F.lit("#top "))).alias("endpoint"))
    rel = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), FE.normalize_endpoint(F.col("text")).alias("endpoint"))
    return url.unionByName(rel)


@query
def normalize_event(spark, sf):
    e = (fx(spark, sf, "web_events").withColumn("timestamp", F.when(F.col("event_type") != "waf_alert", F.col("timestamp").cast("timestamp")))
         .withColumn("user_agent", F.coalesce("user_agent", F.lit(""))))
    n = I.normalize_event(e, F.timestamp_micros(F.lit(NOW)))
    return n.select("event_id", "event_type", F.unix_micros("timestamp").alias("ts_us"), "user_agent", "endpoint", "status_code")


@query
def fill_source_ip(spark, sf):
    e = fx(spark, sf, "web_events").withColumn("source", F.when(F.col("event_type") == "login_failure", "auth").otherwise("sdk"))
    return I.fill_source_ip(e, F.lit("198.51.100.1")).select("event_id", "source", "source_ip")


@query
def to_processed(spark, sf):
    raw = raw_events(spark, sf).where(F.get_json_object("raw", "$.interaction_total").isNull())
    sites = raw.groupBy("website_id").agg((F.max("event_id") % 2 == 0).alias("retain_raw_data"))
    ok, _ = I.ingest(raw, sites, ip_mode="truncate", salt=SALT)
    return ok.select("event_id", "website_id", "source_ip", "user_id", "endpoint", "attributes", "features.*", "raw_data")


# ------------------------------------------------------------------------------------------------ masking
@query
def mask_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.mask_text(F.col("text")).alias("text"))


@query
def is_sensitive_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.is_sensitive_key(F.col("text")).alias("sensitive"))


def _nested(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.to_json(F.struct(
        "text", F.struct(F.col("source").alias("api_key"), F.array("lang", "source").alias("list")).alias("inner"))).alias("doc"))


@query
def mask_value(spark, sf):
    return _nested(spark, sf).select("doc_id", M.mask_value(F.col("doc")).alias("masked"))


@query
def redact_secret_keys(spark, sf):
    d = _nested(spark, sf).select("doc_id", M.redact_secret_keys(F.col("doc")).alias("doc"))
    return d.select("doc_id", F.get_json_object("doc", "$.inner.api_key").alias("api_key"), F.get_json_object("doc", "$.text").alias("text"))


@query
def mask_map(spark, sf):
    m = F.create_map(F.lit("api_key"), F.col("source"), F.lit("text"), F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", M.mask_map(m).alias("m"))
    return d.select("doc_id", F.col("m")["api_key"].alias("api_key"), F.col("m")["text"].alias("text"))


@query
def mask_endpoint(spark, sf):
    e = fx(spark, sf, "web_events").select(F.col("event_id").alias("id"), "endpoint")
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("endpoint"))
    return e.unionByName(p).select("id", M.mask_endpoint(F.col("endpoint")).alias("endpoint"))


@query
def privacy_safe_ip(spark, sf):
    e = fx(spark, sf, "web_events").withColumn("source_ip", v6_source(True))
    return e.select("event_id", *[M.privacy_safe_ip(F.col("source_ip"), m, SALT).alias(f"ip_{m}")
                                  for m in ("none", "truncate", "hash")])


@query
def pseudonymize_user_id(spark, sf):
    e = fx(spark, sf, "web_events")
    uid = F.when(F.col("website_id") == "web_a", F.concat("user_id", F.lit("@Corp.Example"))).otherwise(F.col("user_id"))
    return e.select("event_id", M.pseudonymize_user_id(uid, SALT).alias("user_id"))


@query
def safe_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", TX.safe_text(F.col("text"), 80).alias("text"))


@query
def safe_metrics(spark, sf):
    e = fx(spark, sf, "web_events")
    m = F.create_map(F.lit("source_ip"), F.col("source_ip"), F.lit("note"), F.concat(F.lit("seen at "), "source_ip"),
                     F.lit("status"), F.col("status_code").cast("string"), F.lit("kinds"), F.to_json(F.array("event_type")),
                     F.lit("inner"), F.to_json(F.struct(F.col("event_id").alias("n"), "user_id", F.array(F.col("event_id").cast("string"), "event_type").alias("ids"), F.struct(F.lit(1).alias("deep")).alias("far"))),
                     F.lit("barred"), F.to_json(F.struct("user_id")))
    e = once(e.select("event_id", m.alias("given")), "made", metrics_map(F.col("given")))          # one map for all columns
    m = F.col("made")
    return e.select("event_id", m["status"].alias("status"), m["kinds_count"].alias("kinds_count"), m["note"].alias("note"),
                    m["source_ip"].alias("source_ip"), m["inner"].alias("inner"), m["barred"].alias("barred"))


@query
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", TX.clean_text(F.col("text"), 300).alias("text"))


# ------------------------------------------------------------------------------------------------ features
@query
def classify_user_agent(spark, sf):
    return fx(spark, sf, "web_events").select("event_id", FE.classify_user_agent(F.col("user_agent")).alias("ua_class"))


@query
def extract_features(spark, sf):
    return events(spark, sf).select("event_id", *[f"features.{c}" for c in (
        "path", "path_depth", "has_query", "query_length", "param_count", "special_char_count", "is_request_event", "is_auth_event",
        "is_auth_endpoint", "is_sensitive_endpoint", "status_class", "is_error_status", "ua_class", "interaction_total", "hour_utc")])


@query
def path_prefix_match(spark, sf):
    path = F.substring_index("endpoint", "?", 1)
    return fx(spark, sf, "web_events").select("event_id", FE.path_prefix_match(path, SENSITIVE_PATHS).alias("hit"))


@query
def typed_number(spark, sf):
    doc = F.try_parse_json("props")
    return table(spark, sf, "events").select("event_id", FE.typed_number(doc, "k", 10, 50).alias("k"), FE.typed_number(doc, "none").alias("none"))


@query
def decode_target(spark, sf):
    return fx(spark, sf, "web_events").select("event_id", SG.decode_target(F.col("endpoint")).alias("target"))


@query
def match_signals(spark, sf):
    e = fx(spark, sf, "web_events").withColumn("t", SG.decode_target(F.col("endpoint")))
    cols = []
    for rule, bank in SG.SIGNALS.items():
        bank = {k: v for k, v in bank.items() if k != "boolean_tautology"}
        text = SG.query_part(F.col("t")) if rule in SG.QUERY_ONLY else F.col("t")
        cols.append(joined(F.array_sort(SG.match_signals(text, bank))).alias(rule[-3:]))
    return e.select("event_id", *[c.alias(f"s{i}") for i, c in enumerate(cols, 1)])


@query
def find_cves(spark, sf):
    e = fx(spark, sf, "web_events").select(F.col("event_id").alias("id"), F.col("endpoint").alias("t"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    return e.unionByName(d).select("id", joined(SG.find_cves(F.col("t"))).alias("cves"))


@query
def normalize_cve(spark, sf):
    c = F.concat(F.lit(" cve-"), F.col("user_id"), F.lit("-"), F.col("event_id"))
    return table(spark, sf, "events").select("event_id", SG.normalize_cve(c).alias("cve"))


@query
def normalize_domain(spark, sf):
    host = F.concat(F.regexp_extract("url", "://([^/]*)", 1), F.lit("."))
    return table(spark, sf, "pages").select("page_id", SG.normalize_domain(host).alias("domain"), SG.normalize_domain(F.col("url")).alias("none"))


def address():
    return F.concat_ws(".", (F.col("user_id") % 224).cast("string"), (F.col("event_id") % 256).cast("string"), F.lit("0"), F.lit("9"))


SCOPED_V6 = {"2001:db8::": "not_public", "2a00:1450:4001::": "public", "FE80::": "not_public", "::ffff:0a00:": "not_public", "::ffff:0808:": "public", "2001:30::": "public",
             "2001:7::": "not_public", "2002:a00::": "not_public", "64:ff9b::": "public", "64:ff9b:1::": "not_public", "fd00:1:2:3:4:5:6:": "not_public", "1:2:3:4:5:6:7:8:": "invalid",
             "1::2::": "invalid", "12345::": "invalid", ":1::": "invalid", "::": "public"}


def _scoped(value) -> str:
    """SQL picking one of SCOPED_V6 for every eighth event."""
    return "CASE CAST(event_id // 8 % 16 AS INT) " + " ".join(f"WHEN {i} THEN '{value(*x)}'" for i, x in enumerate(SCOPED_V6.items())) + " END"


@query
def ip_scope(spark, sf):
    e = table(spark, sf, "events")
    v6 = F.concat(F.expr(_scoped(lambda k, v: k).replace("//", "DIV")), hexes(F.col("event_id") % 4096 + 4096))
    e = e.withColumn("_a", F.when(F.col("event_id") % 8 == 0, v6).otherwise(address()))
    return e.select("event_id", SG.ip_scope(F.col("_a")).alias("scope"),
                    SG.ip_scope(F.concat("_a", F.lit("/24"))).alias("masked"))


QUERIES = {f.__name__: f for f in (
    read_event_batches, read_labelled_csv, load_events, load_events_for_entities, tenant_scope, replace_findings, replace_counts,
    write_findings, write_links, write_events, shift_time, load_report, validate_events, split_accept_reject, normalize_endpoint,
    normalize_event, fill_source_ip, to_processed, mask_text, is_sensitive_key, mask_value, redact_secret_keys, mask_map,
    mask_endpoint, privacy_safe_ip, pseudonymize_user_id, safe_text, safe_metrics, clean_text, classify_user_agent,
    extract_features, path_prefix_match, typed_number, decode_target, match_signals, find_cves, normalize_cve, normalize_domain,
    ip_scope)}

_key = SALT.encode().ljust(64, b"\0")
_IPAD, _OPAD = bytes(b ^ 0x36 for b in _key).hex(), bytes(b ^ 0x5C for b in _key).hex()


def _hmac(x: str, n: int) -> str:
    inner = f"unhex(sha256(unhex('{_IPAD}') || encode({x})))"
    return f"substr(sha256(unhex('{_OPAD}') || {inner}), 1, {n})"


def _mask_sql(x: str) -> str:
    steps = [(r"\beyJ[A-Za-z0-9_\-]{5,}\.[A-Za-z0-9_\-]{5,}\.[A-Za-z0-9_\-]{5,}\b", "[REDACTED]", "g"),
             (r"\bbearer\s+[A-Za-z0-9._~+/=\-]{8,}", "Bearer [REDACTED]", "gi"),
             (r"\b(password|passwd|pwd|token|secret|api[_-]?key|authorization)\s*[=:]\s*[^\s&;,\"'']+", r"\1=[REDACTED]", "gi"),
             (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "[EMAIL]", "g"),
             (r"\b(?:\d[ \-]?){13,19}\b", "[NUMBER]", "g")]
    for rx, to, flags in steps:
        # word boundaries are Unicode in the operator, ASCII here: non-ASCII letters are framed by ASCII ones meanwhile
        if to != "[EMAIL]":
            x = f"regexp_replace({x}, '([À-ÖØ-öø-ɏͰ-ӿ一-鿿])', 'ZqZq\\1ZqZq', 'g')"
        x = f"regexp_replace({x}, '{rx}', '{to}', '{flags}')"
        if to != "[EMAIL]":
            x = f"replace({x}, 'ZqZq', '')"
    return x


ORACLE_VIEWS["shifted"] = f"""
SELECT e.*, {NOW} - (CASE event_type WHEN 'page_view' THEN 300000000 WHEN 'login_failure' THEN 20000000 ELSE 0 END)
  - max(us) OVER (PARTITION BY event_type) + us AS ts_us FROM ev e"""
_KEYS = "password|passwd|pwd|secret|token|authorization|cookie|api_key|apikey|api-key|session_key|credit|card_number|cvv|ssn"
_RESERVED = " OR ".join(f"(v BETWEEN {a} AND {b})" for a, b in (
    (0, 16777215), (167772160, 184549375), (1681915904, 1686110207), (2130706432, 2147483647), (2851995648, 2852061183),
    (2886729728, 2887778303), (3221225472, 3221225727), (3221225984, 3221226239), (3232235520, 3232301055),
    (3323068416, 3323199487), (3325256704, 3325256959), (3405803776, 3405804031), (4026531840, 4294967295)))
_SIG = {
    1: {"drop_table": r"\bdrop\s+table\b", "information_schema": r"\binformation_schema\b", "quote_then_comment": r"[''\"]\s*--",
        "stacked_statement": r";\s*(drop|delete|insert|update|alter|truncate)\b",
        "time_delay_function": r"\b(sleep|pg_sleep|benchmark)\s*\(|waitfor\s+delay\b", "union_select": r"\bunion\b(\s+all)?\s+select\b"},
    2: {"embedding_tag": r"<\s*(iframe|svg|object|embed)\b", "event_handler_attr": r"\bon(error|load|click|mouseover|mouseenter|focus)\s*=",
        "javascript_uri": r"\bjavascript\s*:", "script_tag": r"<\s*script\b"},
    3: {"dot_dot_slash": r"\.\.[/\\]", "sensitive_system_file": r"(/etc/(passwd|shadow)\b|\bwin\.ini\b|\bboot\.ini\b)"},
    4: {"file_scheme": r"\bfile://", "internal_address_url": r"\b(https?|ftp|gopher)://(localhost|127\.\d{1,3}\.\d{1,3}\.\d{1,3}|169\.254\.\d{1,3}\.\d{1,3}|10\.\d{1,3}\.\d{1,3}\.\d{1,3})"},
}


def _signals(n: int) -> str:
    text = "q" if n == 4 else "t"
    items = ", ".join(f"CASE WHEN regexp_matches({text}, '{rx}', 'i') THEN '{name}' END" for name, rx in _SIG[n].items())
    return f"concat_ws(',', {items}) AS s{n}"


ORACLE_VIEWS["decoded"] = """
SELECT event_id, website_id, entity, us, endpoint, t, CASE WHEN contains(t, '?') THEN substr(t, strpos(t, '?') + 1) ELSE '' END AS q FROM (
  SELECT *, url_decode(replace(url_decode(replace(COALESCE(endpoint, ''), '+', ' ')), '+', ' ')) AS t FROM ev) x"""
_SLICE = f"FROM ev WHERE us >= {SINCE}"

ORACLE_VIEWS["v6_events"] = """
SELECT *, CASE WHEN event_id % 35 = 0 THEN NULL WHEN event_id % 10 = 0 THEN concat('::ffff:10.0.3.', CAST(event_id % 250 AS VARCHAR))
  WHEN event_id % 5 = 0 THEN concat('2001:db8::7:0:0:', lower(to_hex(event_id % 65535 + 1))) ELSE source_ip END AS v6_kept FROM ev"""
ORACLES = {
    "read_event_batches": "SELECT CAST(event_id % 100 AS INTEGER) AS index, event_type, event_id FROM ev",
    "read_labelled_csv": "SELECT event_id, session_id, endpoint, status_code, website_id AS scenario, event_type AS label FROM ev",
    "load_events": f"SELECT event_id, website_id, us AS ts_us, event_type, session_id {_SLICE} AND website_id = 'web_a'",
    "load_events_for_entities": f"""
SELECT event_id, website_id, source_ip, session_id, us AS ts_us {_SLICE} AND (
  (website_id, source_ip) IN (SELECT website_id, source_ip {_SLICE} AND event_type = 'waf_alert' AND source_ip IS NOT NULL) OR
  (website_id, session_id) IN (SELECT website_id, session_id {_SLICE} AND event_type = 'waf_alert' AND session_id IS NOT NULL))""",
    "tenant_scope": "SELECT o_orderkey, o_custkey AS website_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "replace_findings": f"""
SELECT finding_id, f.website_id, agent_name, 'kept' AS change FROM fx_findings f JOIN ev e USING (event_id)
WHERE NOT (us >= {SINCE} AND agent_name = 'rule_engine')
UNION ALL SELECT concat(finding_id, '-n'), f.website_id, agent_name, 'created' FROM fx_findings f JOIN ev e USING (event_id)
WHERE us >= {SINCE} AND agent_name = 'rule_engine' AND confidence >= 0.6""",
    "replace_counts": f"""
SELECT f.website_id, count(*) AS replaced, count(*) FILTER (confidence >= 0.6) AS created FROM fx_findings f JOIN ev e USING (event_id)
WHERE us >= {SINCE} AND agent_name = 'rule_engine' GROUP BY 1""",
    "write_findings": "SELECT finding_id, event_id, website_id, agent_name, confidence FROM fx_findings",
    "write_links": "SELECT website_id, event_id, related_event_id, relationship_type, strength FROM fx_links",
    "write_events": f"SELECT event_id, website_id, us AS ts_us, path {_SLICE} AND website_id = 'web_b'",
    "shift_time": "SELECT event_id, event_type, ts_us FROM shifted",
    "load_report": """
SELECT event_type, count(*) FILTER (ok) AS loaded, count(*) FILTER (NOT ok) AS rejected, min(ts_us) FILTER (ok) AS window_start_us,
  max(ts_us) FILTER (ok) AS window_end_us FROM (SELECT *, COALESCE(status_code <> 500, TRUE) AS ok FROM shifted) x GROUP BY 1""",
    "validate_events": """
SELECT event_id, 'GET' AS method, FALSE AS is_synthetic, CASE WHEN status_code = 500 THEN 700 ELSE status_code END AS status_code,
  CASE WHEN event_id % 35 <> 0 THEN v6_kept END AS source_ip,
  CASE WHEN event_id % 35 = 0 THEN 1 ELSE 0 END + CASE WHEN status_code = 500 THEN 1 ELSE 0 END + CASE WHEN interaction_total IS NOT NULL THEN 1 ELSE 0 END AS n_errors,
  concat_ws(',', CASE WHEN event_id % 35 = 0 THEN 'source_ip' END, CASE WHEN status_code = 500 THEN 'status_code' END, CASE WHEN interaction_total IS NOT NULL THEN 'interaction_total' END) AS fields
FROM v6_events""",
    "split_accept_reject": """
SELECT website_id, CASE WHEN event_id % 35 = 0 OR status_code = 500 OR interaction_total IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS outcome,
  count(*) AS n FROM ev GROUP BY 1, 2""",
    "normalize_endpoint": r"""
SELECT page_id, split_part(trim(url), '#', 1) AS endpoint FROM pages
UNION ALL SELECT doc_id, CASE WHEN text = '' THEN NULL WHEN starts_with(e, '/') OR contains(e, '://') THEN e ELSE concat('/', e) END
FROM (SELECT doc_id, text, split_part(regexp_replace(text, '^\s+|\s+$', '', 'g'), '#', 1) AS e FROM documents) x""",
    "normalize_event": f"""
SELECT event_id, event_type, CASE WHEN event_type = 'waf_alert' THEN {NOW} ELSE us END AS ts_us, user_agent, endpoint, status_code FROM ev""",
    "fill_source_ip": """
SELECT event_id, CASE WHEN event_type = 'login_failure' THEN 'auth' ELSE 'sdk' END AS source,
  CASE WHEN event_type <> 'login_failure' AND source_ip IS NULL THEN '198.51.100.1' ELSE source_ip END AS source_ip FROM ev""",
    "mask_text": f"SELECT doc_id, {_mask_sql('text')} AS text FROM documents",
    "mask_value": f"""
SELECT doc_id, CAST(to_json({{'inner': {{'api_key': '[REDACTED]', 'list': [{_mask_sql('lang')}, {_mask_sql('source')}]}}, 'text': {_mask_sql('text')}}}) AS VARCHAR) AS masked
FROM documents""",
    "mask_map": f"SELECT doc_id, '[REDACTED]' AS api_key, {_mask_sql('text')} AS text FROM documents",
    "redact_secret_keys": "SELECT doc_id, '[REDACTED]' AS api_key, text FROM documents",
    "is_sensitive_key": f"SELECT doc_id, regexp_matches(lower(text), '{_KEYS}') AS sensitive FROM documents",
    "privacy_safe_ip": rf"""
SELECT event_id, v6_kept AS ip_none, CASE WHEN v6_kept LIKE '::ffff:%' THEN '::/48' WHEN v6_kept LIKE '2001:%' THEN '2001:db8::/48' ELSE regexp_replace(v6_kept, '\.\d+$', '.0/24') END AS ip_truncate,
  'iph_' || {_hmac('v6_kept', 16)} AS ip_hash FROM v6_events""",
    "pseudonymize_user_id": f"""
SELECT event_id, CASE WHEN website_id = 'web_a' THEN 'usr_' || {_hmac("lower(concat(user_id, '@Corp.Example'))", 12)} ELSE user_id END AS user_id FROM ev""",
    "safe_metrics": """
SELECT event_id, CAST(status_code AS VARCHAR) AS status, '1' AS kinds_count, CASE WHEN source_ip IS NULL THEN NULL END AS note,
  CAST(NULL AS VARCHAR) AS source_ip, concat('{"n":"', event_id, '","ids_count":"2"}') AS inner, CAST(NULL AS VARCHAR) AS barred FROM ev""",
    "clean_text": r"""
SELECT doc_id, CASE WHEN length(s) <= 300 THEN s ELSE concat(left(s, 299), '…') END AS text FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM documents) x""",
    "classify_user_agent": "SELECT event_id, ua_class FROM ev",
    "extract_features": r"""
SELECT event_id, path, CAST(COALESCE(len(list_filter(string_split(path, '/'), lambda x: x <> '')), 0) AS INTEGER) AS path_depth,
  COALESCE(query, '') <> '' AS has_query, CAST(length(COALESCE(query, '')) AS INTEGER) AS query_length,
  CAST(COALESCE(len(list_filter(string_split(query, '&'), lambda x: x <> '')), 0) AS INTEGER) AS param_count,
  CAST(length(COALESCE(query, '')) - length(regexp_replace(COALESCE(query, ''), '[''"<>;()\\`{}|]', '', 'g')) AS INTEGER) AS special_char_count,
  is_request AS is_request_event, event_type IN ('login_success', 'login_failure', 'session_created', 'session_terminated') AS is_auth_event,
  COALESCE(regexp_matches(path, '^(/login|/api/login|/auth|/api/auth)(/.*)?$'), FALSE) AS is_auth_endpoint,
  is_sensitive AS is_sensitive_endpoint, concat(CAST(status_code // 100 AS VARCHAR), CASE WHEN status_code IS NOT NULL THEN 'xx' END) AS status_class0,
  is_error AS is_error_status, ua_class, CAST(interaction_total AS BIGINT) AS interaction_total, CAST(hour(timestamp) AS INTEGER) AS hour_utc,
  CASE WHEN status_code IS NOT NULL THEN concat(CAST(status_code // 100 AS VARCHAR), 'xx') END AS status_class FROM ev""",
    "path_prefix_match": """
SELECT event_id, COALESCE(regexp_matches(path, '^(/api/admin|/admin|/api/account/payment-methods)(/.*)?$'), FALSE) AS hit FROM ev""",
    "typed_number": """
SELECT event_id, greatest(10, least(50, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT))) AS k, CAST(NULL AS BIGINT) AS none FROM events""",
    "decode_target": "SELECT event_id, t AS target FROM decoded",
    "match_signals": f"SELECT event_id, {_signals(1)}, {_signals(2)}, {_signals(3)}, {_signals(4)} FROM decoded",
    "find_cves": r"""
SELECT id, array_to_string(list_transform(regexp_extract_all(COALESCE(t, ''), '(?i)\bCVE-\d{4}-\d{4,7}\b'), lambda x: upper(x)), ',') AS cves
FROM (SELECT event_id AS id, endpoint AS t FROM ev UNION ALL SELECT doc_id, text FROM documents) x""",
    "normalize_cve": r"""
SELECT event_id, CASE WHEN regexp_full_match(c, 'CVE-\d{4}-\d{4,7}') THEN c END AS cve FROM (
  SELECT event_id, concat('CVE-', user_id, '-', event_id) AS c FROM events) x""",
    "normalize_domain": """
SELECT page_id, lower(regexp_extract(url, '://([^/]*)', 1)) AS domain, CAST(NULL AS VARCHAR) AS none FROM pages""",
    "ip_scope": f"""
SELECT event_id, CASE WHEN event_id % 8 = 0 THEN {_scoped(lambda k, v: v)} WHEN {_RESERVED} THEN 'not_public' ELSE 'public' END AS scope, 'invalid' AS masked FROM (
  SELECT event_id, (user_id % 224) * 16777216 + (event_id % 256) * 65536 + 9 AS v FROM events) x""",
}
ORACLES["extract_features"] = ORACLES["extract_features"].replace(
    "concat(CAST(status_code // 100 AS VARCHAR), CASE WHEN status_code IS NOT NULL THEN 'xx' END) AS status_class0,", "")
