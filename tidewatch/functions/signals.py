"""Attack-signal patterns on request targets, indicator parsing and address scopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.addresses import v6_is_global
from tidewatch.functions.masking import unquote_plus

# ------------------------------------------------------------------------------------ fixed values: pattern bank
_INTERNAL = (
    r"(localhost|127\.\d{1,3}\.\d{1,3}\.\d{1,3}|0\.0\.0\.0|169\.254\.\d{1,3}\.\d{1,3}|10\.\d{1,3}\.\d{1,3}\.\d{1,3}"
    r"|192\.168\.\d{1,3}\.\d{1,3}|172\.(1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}|\[?::1\]?|metadata\.google\.internal)"
)
SIGNALS = {
    "R-ATK-001": {
        "union_select": r"\bunion\b(\s+all)?\s+select\b",
        "boolean_tautology": r"\b(or|and)\s+(['\"]?)(\w+)\2\s*=\s*\2\3",
        "stacked_statement": r";\s*(drop|delete|insert|update|alter|truncate)\b",
        "drop_table": r"\bdrop\s+table\b",
        "time_delay_function": r"\b(sleep|pg_sleep|benchmark)\s*\(|waitfor\s+delay\b",
        "information_schema": r"\binformation_schema\b",
        "quote_then_comment": r"['\"]\s*--",
    },
    "R-ATK-002": {
        "script_tag": r"<\s*script\b",
        "javascript_uri": r"\bjavascript\s*:",
        "event_handler_attr": r"\bon(error|load|click|mouseover|mouseenter|focus)\s*=",
        "embedding_tag": r"<\s*(iframe|svg|object|embed)\b",
    },
    "R-ATK-003": {
        "dot_dot_slash": r"\.\.[/\\]",
        "sensitive_system_file": r"(/etc/(passwd|shadow)\b|\bwin\.ini\b|\bboot\.ini\b)",
    },
    "R-ATK-004": {
        "internal_address_url": r"\b(https?|ftp|gopher)://" + _INTERNAL,
        "file_scheme": r"\bfile://",
    },
}
QUERY_ONLY = ("R-ATK-004",)
CVE = r"(?i)\bCVE-\d{4}-\d{4,7}\b"
CVE_FULL = r"^CVE-\d{4}-\d{4,7}$"
DOMAIN = r"^(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"

# fixed values: IPv4 ranges that are not single public addresses (first, last as integers are derived below)
RESERVED_V4 = ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
               "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
               "240.0.0.0/4")
PUBLIC_IN_RESERVED = ("192.0.0.9", "192.0.0.10")
V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def decode_target(c: Column, rounds: int = 2) -> Column:
    """URL-decoded up to ``rounds`` times (double encoding), NUL characters dropped."""
    s = F.coalesce(c, F.lit(""))
    for _ in range(rounds):
        s = unquote_plus(s)
    return F.replace(s, F.lit("\x00"), F.lit(""))


def match_signals(text: Column, bank: dict[str, str]) -> Column:
    """Names of all patterns of ``bank`` found in ``text``."""
    return F.array_compact(F.array(*[F.when(text.rlike("(?i)" + rx), F.lit(name)) for name, rx in bank.items()]))


def query_part(target: Column) -> Column:
    """Text after the first question mark of a decoded target."""
    at = F.instr(target, "?")
    return F.when(at > 0, F.substr(target, at + 1)).otherwise(F.lit(""))


def find_cves(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CVE), F.lit(0)), F.upper)


def normalize_cve(c: Column) -> Column:
    v = F.upper(F.trim(c))
    return F.when(v.rlike(CVE_FULL), v)


def normalize_domain(c: Column) -> Column:
    v = F.regexp_replace(F.lower(F.trim(c)), r"\.+$", "")
    return F.when((F.length(v) <= 253) & v.rlike(DOMAIN), v)


def ipv4_value(c: Column) -> Column:
    """IPv4 text as BIGINT, NULL for anything else."""
    octets = F.split(c, r"\.")
    value = sum((F.get(octets, F.lit(i)).cast("bigint") * (256 ** (3 - i)) for i in range(4)), F.lit(0).cast("bigint"))
    return F.when(c.rlike(V4), value)


def _public_v4(value: Column) -> Column:
    import ipaddress
    inside, kept = F.lit(False), [int(ipaddress.ip_address(x)) for x in PUBLIC_IN_RESERVED]
    for net in map(ipaddress.ip_network, RESERVED_V4):
        inside = inside | value.between(int(net.network_address), int(net.broadcast_address))
    return ~inside | value.isin(*kept)


def ip_scope(c: Column) -> Column:
    """``public`` / ``not_public`` for one address, ``invalid`` for anything else (masked forms included)."""
    t = F.trim(c)
    is_public = F.coalesce(_public_v4(ipv4_value(t)), v6_is_global(t, _public_v4))
    return F.when(c.isNotNull(), F.when(is_public, "public").when(~is_public, "not_public").otherwise("invalid"))
