"""Reduction of finding metrics to values that identify nobody."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import IP_PLACEHOLDER, safe_text

# fixed values: keys whose values name people, hosts or requests
IDENTIFYING = ("source", "sources", "ip", "source_ip", "source_ips", "user", "user_id", "users", "account", "accounts", "target",
               "targets", "path", "paths", "endpoint", "query", "url", "session", "session_id", "session_ids", "payload", "ua",
               "user_agent", "referrer", "email", "token", "key", "password")
_NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"
_QUAD = r"\d{1,3}(\.\d{1,3}){3}"


def safe_metrics(m: Column, n: int = 80, depth: int = 1) -> Column:
    """MAP<STRING,STRING> whose values are JSON scalars, arrays or objects: identifying keys dropped, numbers and booleans kept,
    arrays become ``<key>_count``, strings holding an address dropped, other strings made safe.

    Objects are reduced in the same way, ``depth`` levels deep, and stay as JSON objects of texts; empty and deeper ones are dropped."""
    kept = F.filter(F.map_entries(m), lambda e: ~F.lower(e["key"]).isin(*IDENTIFYING) & e["value"].isNotNull())

    def worked_out(e):
        """What an entry needs more than once: inside a function on arrays, Spark works an expression out wherever it is named."""
        is_object = e["value"].startswith("{")
        inner = safe_metrics(F.when(is_object, F.from_json(e["value"], "map<string,string>")), n, depth - 1) if depth else F.lit(None)
        return F.struct(e["key"].alias("key"), e["value"].alias("value"), is_object.alias("is_object"), inner.alias("inner"),
                        F.when(~is_object, safe_text(e["value"], n)).alias("text"))

    def entry(e):
        is_list, is_object = e["value"].startswith("["), e["is_object"]
        plain = e["value"].rlike(_NUMBER) | e["value"].isin("true", "false")
        number = F.when(e["value"].contains("."), F.round(e["value"].cast("double"), 4).cast("string")).otherwise(e["value"])
        text = e["text"]
        ok = (text != "") & ~text.contains(IP_PLACEHOLDER) & ~text.rlike(_QUAD)
        value = F.when(is_list, F.coalesce(F.json_array_length(e["value"]), F.lit(0)).cast("string")).when(plain, number)
        if depth:
            value = value.when(is_object & (F.size(e["inner"]) > 0), F.to_json(e["inner"]))
        value = value.when(ok & ~is_object, text)
        key = safe_text(e["key"], 40)
        return F.struct(F.when(is_list, F.concat(key, F.lit("_count"))).otherwise(key).alias("key"), value.alias("value"))
    out = F.filter(F.transform(F.transform(kept, worked_out), entry), lambda e: e["value"].isNotNull() & (e["key"] != ""))
    return F.map_from_entries(out)
