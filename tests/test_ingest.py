import json
from urllib.parse import parse_qsl, unquote_plus, urlencode, urlsplit

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import features as FE
from tidewatch.functions import masking as M
from tidewatch.functions import signals as SG
from tidewatch.functions import text as TX
from tidewatch.operators import ingest as I


def one(spark, value, fn, kind="STRING"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


def test_mask_text(spark):
    t = one(spark, "mail bob@corp.com token=abc123 card 4111 1111 1111 1111 Bearer abcdefghijkl", M.mask_text)
    for secret in ("bob@corp.com", "abc123", "4111", "abcdefghijkl"):
        assert secret not in t


def test_nested_json_is_masked(spark):
    doc = json.dumps({"password": "hunter2", "ok": "x", "nested": {"api_key": "abc", "list": ["a@b.co"] * 205}, "n": 3})
    out = json.loads(one(spark, doc, M.mask_value))
    assert out["password"] == M.REDACTED and out["nested"]["api_key"] == M.REDACTED and out["ok"] == "x" and out["n"] == 3
    assert out["nested"]["list"] == ["[EMAIL]"] * 200
    raw = json.loads(one(spark, doc, M.redact_secret_keys))
    assert raw["nested"]["list"][0] == "a@b.co" and raw["password"] == M.REDACTED
    deep = "1"
    for _ in range(9):
        deep = '{"a":' + deep + "}"
    assert M.REDACTED in one(spark, deep, M.mask_value)


TARGETS = ["/api/login?user=bob&password=hunter2&page=2", "/p", "/p?a=1&&b", "/p?q=%27%20or%201%3D1&x=[1]~*", "http://h.example/a/b?tok+en=1&c=d+e#f",
           "/s?q=caf%C3%A9&bad=%zz&m=a@b.co", "?x=1"]


def test_mask_endpoint_equals_url_library(spark):
    d = spark.createDataFrame([(t,) for t in TARGETS], "v STRING").select("v", M.mask_endpoint(F.col("v")).alias("r"), M.url_path(F.col("v")).alias("p"),
                                                                       M.url_query(F.col("v")).alias("q"))
    for r in d.collect():
        parts = urlsplit(r.v)
        assert (r.p, r.q) == (parts.path, parts.query), r.v
        pairs = [(k, M.REDACTED if any(x in k.lower() for x in M.SENSITIVE_FRAGMENTS) else v.replace("a@b.co", "[EMAIL]"))
                 for k, v in parse_qsl(parts.query, keep_blank_values=True)]
        assert r.r == parts.path + ("?" + urlencode(pairs, safe="[]") if pairs else ""), r.v


def test_addresses_and_users(spark):
    import hashlib
    import hmac
    assert one(spark, "203.0.113.77", lambda c: M.privacy_safe_ip(c, "truncate")) == "203.0.113.0/24"
    assert one(spark, "2001:db8:1:2::5", lambda c: M.privacy_safe_ip(c, "truncate")) == "2001:db8:1::/48"
    want = "iph_" + hmac.new(b"s", b"203.0.113.77", hashlib.sha256).hexdigest()[:16]
    assert one(spark, "203.0.113.77", lambda c: M.privacy_safe_ip(c, "hash", "s")) == want
    a, b = (one(spark, u, lambda c: M.pseudonymize_user_id(c, "s")) for u in ("Alice@Example.com", "alice@example.com"))
    assert a == b and "@" not in a and a.startswith("usr_")
    assert one(spark, "visitor-42", lambda c: M.pseudonymize_user_id(c, "s")) == "visitor-42"
    scopes = {"8.8.8.8": "public", "10.1.2.3": "not_public", "203.0.113.7": "not_public", "192.0.0.9": "public", "203.0.113.0/24": "invalid",
              "2606:4700::1111": "public", "::1": "not_public", "300.1.1.1": "invalid"}
    for ip, want in scopes.items():
        assert one(spark, ip, SG.ip_scope) == want, ip


def test_user_agents(spark):
    cases = {"Mozilla/5.0 HeadlessChrome/118": "headless_browser", "Scrapy/2.11.0": "automation_tool", "curl/8.1.2": "automation_tool", "Mozilla/5.0 Chrome": "browser",
             "": "empty", None: "empty", "SomeAgent/1.0": "other"}
    for ua, want in cases.items():
        assert one(spark, ua, FE.classify_user_agent) == want


def test_features(spark, mk):
    e = mk.frame([mk.ev("http_request", ep="/api/reports/search?q=%27+OR+1%3D1--", status=500), mk.ev("api_access", ep="/api/adminx"),
                  mk.ev("session_created", ep=None), mk.ev("interaction", attrs='{"clicks":2,"key_events":3,"scroll_events":true,"mouse_moves":"many"}'),
                  mk.ev("page_view", ep="/API/Admin/x", attrs='{"webdriver":true,"page_seq":3,"load_ms":-5}'), mk.ev("page_view", attrs='{"webdriver":"yes","load_ms":9000000}')])
    f = [r.features for r in e.orderBy("event_id").collect()]
    assert (f[0].path, f[0].path_depth, f[0].param_count, f[0].status_class, f[0].hour_utc) == ("/api/reports/search", 3, 1, "5xx", 9)
    assert f[0].has_query and f[0].special_char_count >= 1 and f[0].is_request_event and f[0].is_error_status
    assert f[1].is_sensitive_endpoint is False and f[4].is_sensitive_endpoint is True
    assert (f[2].path, f[2].path_depth, f[2].has_query, f[2].status_class, f[2].is_auth_event) == (None, 0, False, None, True)
    assert f[3].interaction_total == 5 and f[0].interaction_total is None
    assert (f[4].webdriver, f[4].page_seq, f[4].load_ms) == (True, 3, 0) and (f[5].webdriver, f[5].load_ms) == (None, 600000)


BAD = [
    ({"event_type": "page_view", "extra": 1}, "extra: Extra inputs are not permitted"),
    ({}, "event_type: Field required"),
    ({"event_type": "nope"}, "event_type: Input should be 'page_view'"),
    ({"event_type": "page_view", "status_code": 700}, "status_code: Input should be less than or equal to 599"),
    ({"event_type": "page_view", "status_code": "x"}, "status_code: Input should be a valid integer"),
    ({"event_type": "page_view", "source_ip": "1.2.3.999"}, "source_ip: Value error"),
    ({"event_type": "page_view", "session_id": "x" * 129}, "session_id: String should have at most 128 characters"),
    ({"event_type": "page_view", "user_id": 5}, "user_id: Input should be a valid string"),
    ({"event_type": "page_view", "method": "FETCH"}, "method: Input should be 'GET'"),
    ({"event_type": "page_view", "timestamp": "2999-01-01T00:00:00Z"}, "timestamp: Value error"),
    ({"event_type": "page_view", "attributes": {"a": "x" * 9000}}, "attributes: Value error"),
    ({"event_type": "page_view", "attributes": [1]}, "attributes: Input should be a valid dictionary"),
]


def test_validation(spark):
    good = {"event_type": "page_view", "source": "sdk", "method": "get", "source_ip": "2001:DB8::1", "status_code": 200, "session_id": " s ", "attributes": {"k": 1}}
    texts = [json.dumps(good)] + [json.dumps(b) for b, _ in BAD] + ["[1]", "not json"]
    d = spark.createDataFrame(list(enumerate(texts)), "index INT, raw STRING")
    r = {x["index"]: x for x in I.validate_events(d).collect()}
    assert r[0].errors == [] and (r[0].method, r[0].source_ip, r[0].session_id) == ("GET", "2001:db8::1", "s")
    for i, (_, message) in enumerate(BAD, 1):
        assert len(r[i].errors) == 1 and r[i].errors[0].startswith(message), (r[i].errors, message)
    assert r[len(BAD) + 1].errors and r[len(BAD) + 2].errors
    ok, no = I.split_accept_reject(I.validate_events(d))
    assert ok.count() == 1 and no.count() == len(texts) - 1


def test_ingest_masks_before_features_and_keeps_raw_only_where_wanted(spark):
    raw = [("w1", "e1", json.dumps({"event_type": "http_request", "endpoint": "x?token=abc123secret&q=1#f", "user_id": "a@b.co"})),
           ("w2", "e2", json.dumps({"event_type": "http_request", "endpoint": "/y", "attributes": {"password": "p"}}))]
    d = spark.createDataFrame(raw, "website_id STRING, event_id STRING, raw STRING").withColumn("fallback_ip", F.lit("198.51.100.1"))
    sites = spark.createDataFrame([("w1", False), ("w2", True)], "website_id STRING, retain_raw_data BOOLEAN")
    ok, _ = I.ingest(d, sites, salt="s")
    r = {x.event_id: x for x in ok.collect()}
    assert "abc123secret" not in str(r["e1"]) and r["e1"].features.param_count == 2 and r["e1"].user_id.startswith("usr_")
    assert r["e1"].source_ip == "198.51.100.1" and r["e1"].raw_data is None
    assert json.loads(r["e2"].raw_data)["attributes"]["password"] == M.REDACTED


def test_texts(spark):
    assert one(spark, "a\x01b  c from 203.0.113.77 <x> at 10:31:02 2001:db8::1", TX.safe_text) == "a b c from (source ip) x at 10:31:02 (source ip)"
    assert one(spark, "x" * 400, lambda c: TX.clean_text(c, 300)) == "x" * 299 + "\u2026"
    text, rejected = TX.clean_comment(F.lit("  "))
    assert spark.range(1).select(text.alias("a"), rejected.alias("b")).first() == (None, False)


@pytest.mark.parametrize("value,want", [("%2527", "'"), ("a+b%20c", "a b c"), ("100%", "100%"), ("%zz", "%zz")])
def test_decode_target(spark, value, want):
    assert one(spark, value, SG.decode_target) == want == unquote_plus(unquote_plus(value))
