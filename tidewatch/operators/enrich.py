"""Indicators of incidents and their join to intelligence feed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.signals import find_cves, ip_scope, normalize_domain
from tidewatch.functions.text import clean_text
from tidewatch.operators.ordered import first_ids, top_k
from tidewatch.params import TECHNIQUES, Enrichment

INCIDENT = ["website_id", "incident_id"]
KEY = [*INCIDENT, "indicator_type", "indicator"]
TYPES = ("ip", "cve", "domain", "attack_technique")
FAILED = ("rate_limited", "timeout", "error")


def extract_indicators(events: DataFrame, findings: DataFrame, p: Enrichment = Enrichment(), sites: DataFrame | None = None) -> DataFrame:
    """(incident, indicator_type, indicator, source_ids): addresses, CVE ids in targets, foreign referrer domains and
    techniques of findings, each with the first ids it came from.  ``events`` and ``findings`` carry incident_id."""
    parts = []
    if p.ips:
        ips = events.where(F.col("source_ip") != "").select(*INCIDENT, F.lit("ip").alias("indicator_type"), F.col("source_ip").alias("indicator")).distinct()
        parts.append(ips.withColumn("source_ids", F.array().cast("array<string>")))
    traced = []
    if p.cves:
        traced.append(events.select(*INCIDENT, F.lit("cve").alias("indicator_type"), F.explode(find_cves(F.col("endpoint"))).alias("indicator"),
                                    "ts_us", F.col("event_id").cast("string").alias("event_id")))
    if p.domains and "attributes" in events.columns:
        d = events.withColumn("indicator", normalize_domain(F.get_json_object("attributes", "$.referrer_host"))).where(F.col("indicator").isNotNull())
        if sites is not None:
            own = F.lower(F.regexp_replace(F.col("domain"), r"\.+$", ""))
            d = (d.join(sites.select("website_id", own.alias("_own")), "website_id", "left")
                 .where(F.coalesce((F.col("_own") == "") | ((F.col("indicator") != F.col("_own")) & ~F.col("indicator").endswith(F.concat(F.lit("."), "_own"))), F.lit(True))))
        traced.append(d.select(*INCIDENT, F.lit("domain").alias("indicator_type"), "indicator", "ts_us", F.col("event_id").cast("string").alias("event_id")))
    traced.append(findings.where(F.trim("technique_id") != "").select(
        *INCIDENT, F.lit("attack_technique").alias("indicator_type"), F.upper(F.trim("technique_id")).alias("indicator"),
        F.lit(0).cast("bigint").alias("ts_us"), F.col("finding_id").alias("event_id")))
    rows = traced[0]
    for t in traced[1:]:
        rows = rows.unionByName(t)
    out = first_ids(rows.distinct(), KEY, p.context_ids, out="source_ids")
    for part in parts:
        out = out.unionByName(part.select(*KEY, "source_ids"))
    return out


def cap_indicators(indicators: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """First ``n`` per incident and type by value (techniques are never cut), and the number dropped per incident and type."""
    cut = indicators.where(F.col("indicator_type") != "attack_technique")
    kept = top_k(cut, [*INCIDENT, "indicator_type"], [F.asc("indicator")], n, "indicator", "r").drop("r")
    kept = kept.unionByName(indicators.where(F.col("indicator_type") == "attack_technique"))
    total = cut.groupBy(*INCIDENT, "indicator_type").agg((F.count(F.lit(1)) - n).alias("dropped"))
    return kept, total.where(F.col("dropped") > 0)


def technique_table(spark: SparkSession) -> DataFrame:
    rows = [(k, v[0], list(v[1]), f"https://attack.mitre.org/techniques/{k}/") for k, v in TECHNIQUES.items()]
    return spark.createDataFrame(rows, "technique_id STRING, name STRING, tactics ARRAY<STRING>, url STRING")


def _evidence(found: Column) -> Column:
    return F.when(found, "evidence_found").otherwise("no_evidence")


def enrich_technique(indicators: DataFrame, techniques: DataFrame) -> DataFrame:
    rows = indicators.where(F.col("indicator_type") == "attack_technique")
    d = rows.join(techniques, rows["indicator"] == techniques["technique_id"], "left")
    return d.select(*KEY, _evidence(F.col("name").isNotNull()).alias("status"), "name", "tactics", F.lit(False).alias("synthetic"))


def read_reputation_feed(spark: SparkSession, path: str) -> DataFrame:
    """Feed file ``{"ips": {address: record}}`` as (indicator, pulse_count, names, synthetic)."""
    record = "STRUCT<simulated_label:STRING, simulated_report_count:BIGINT, simulated_categories:ARRAY<STRING>>"
    raw = spark.read.schema(f"ips MAP<STRING, {record}>").option("multiLine", True).json(path)
    return raw.select(F.explode("ips").alias("indicator", "r")).select(
        "indicator", F.coalesce("r.simulated_report_count", F.lit(0)).alias("pulse_count"),
        F.array_compact(F.array("r.simulated_label")).alias("names"), F.lit(True).alias("synthetic"))


def enrich_reputation(indicators: DataFrame, feed: DataFrame) -> DataFrame:
    """Addresses and domains joined to a reputation feed (indicator, pulse_count, names, synthetic)."""
    rows = indicators.where(F.col("indicator_type").isin("ip", "domain"))
    d = rows.join(feed.dropDuplicates(["indicator"]), "indicator", "left")
    names = F.transform(F.slice(F.coalesce("names", F.array().cast("array<string>")), 1, 3), lambda x: clean_text(x, 80))
    return d.select(*KEY, _evidence(F.coalesce("pulse_count", F.lit(0)) > 0).alias("status"), F.coalesce("pulse_count", F.lit(0)).alias("pulse_count"),
                    names.alias("example_names"), F.coalesce("synthetic", F.lit(False)).alias("synthetic"))


CVE_FEED = ("STRUCT<id:STRING, published:STRING, lastModified:STRING, vulnStatus:STRING, descriptions:ARRAY<STRUCT<lang:STRING,value:STRING>>, "
            "metrics:STRUCT<cvssMetricV40:ARRAY<STRUCT<cvssData:STRUCT<baseScore:DOUBLE,baseSeverity:STRING>>>, "
            "cvssMetricV31:ARRAY<STRUCT<cvssData:STRUCT<baseScore:DOUBLE,baseSeverity:STRING>>>, "
            "cvssMetricV30:ARRAY<STRUCT<cvssData:STRUCT<baseScore:DOUBLE,baseSeverity:STRING>>>, "
            "cvssMetricV2:ARRAY<STRUCT<cvssData:STRUCT<baseScore:DOUBLE>,baseSeverity:STRING>>>, "
            "weaknesses:ARRAY<STRUCT<description:ARRAY<STRUCT<value:STRING>>>>>")


def parse_cve_feed(raw: DataFrame, column: str = "value") -> DataFrame:
    """Vulnerability feed texts ``{"vulnerabilities": [{"cve": …}]}`` as one flat row per CVE."""
    doc = F.from_json(column, f"STRUCT<vulnerabilities:ARRAY<STRUCT<cve:{CVE_FEED}>>>")
    c = raw.select(F.explode(doc["vulnerabilities"]["cve"]).alias("c")).where(F.col("c.id").isNotNull())
    english = F.filter("c.descriptions", lambda d: (d["lang"] == "en") & (d["value"] != ""))

    def rating(key, version):
        m = F.get(F.col(f"c.metrics.{key}"), F.lit(0))
        sev = F.coalesce(m["cvssData"]["baseSeverity"], F.lit(None).cast("string")) if key != "cvssMetricV2" else m["baseSeverity"]
        return F.when(m["cvssData"]["baseScore"].isNotNull(), F.struct(
            F.lit(version).alias("version"), m["cvssData"]["baseScore"].alias("base_score"), clean_text(sev, 20).alias("severity")))
    cwes = F.transform(F.filter(F.flatten(F.transform(F.coalesce("c.weaknesses", F.array().cast(
        "array<struct<description:array<struct<value:string>>>>")), lambda w: w["description"])),
        lambda d: d["value"].startswith("CWE-")), lambda d: clean_text(d["value"], 30))
    return c.select(
        F.upper("c.id").alias("indicator"), clean_text(F.col("c.published"), 40).alias("published"), clean_text(F.col("c.vulnStatus"), 40).alias("vuln_status"),
        clean_text(F.get(english, F.lit(0))["value"], 300).alias("description"),
        F.coalesce(rating("cvssMetricV40", "4.0"), rating("cvssMetricV31", "3.1"), rating("cvssMetricV30", "3.0"), rating("cvssMetricV2", "2.0")).alias("cvss"),
        F.slice(F.sort_array(F.array_distinct(cwes)), 1, 5).alias("weaknesses"))


def enrich_cve(indicators: DataFrame, feed: DataFrame) -> DataFrame:
    rows = indicators.where(F.col("indicator_type") == "cve")
    d = rows.join(feed.dropDuplicates(["indicator"]).withColumn("_hit", F.lit(True)), "indicator", "left")
    return d.select(*KEY, _evidence(F.col("_hit").isNotNull()).alias("status"), "published", "description", "cvss", "weaknesses",
                    F.lit(False).alias("synthetic"))


def lookup_status(indicators: DataFrame, found: DataFrame, configured=("ip", "cve", "attack_technique"), public_only: bool = True) -> DataFrame:
    """Status of every indicator: ``not_configured``, ``not_applicable`` (not a single public address), else the feed's
    answer.  ``found`` is (indicator_type, indicator, synthetic) of feed rows that are evidence."""
    hits = found.select("indicator_type", "indicator", "synthetic").dropDuplicates(["indicator_type", "indicator"]).withColumn("_hit", F.lit(True))
    d = indicators.join(hits, ["indicator_type", "indicator"], "left")
    kind, scope = F.col("indicator_type"), ip_scope(F.col("indicator"))
    barred = (kind == "ip") & ((scope != "public") if public_only else (scope == "invalid"))
    status = (F.when(~kind.isin(*configured), "not_configured").when(barred, "not_applicable").otherwise(_evidence(F.col("_hit").isNotNull())))
    return d.select(*KEY, status.alias("status"), (F.coalesce("synthetic", F.lit(False)) & (status == "evidence_found")).alias("synthetic"))


def enrichment_report(incidents: DataFrame, results: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """One row per incident: indicators checked, counts by status, overall status, synthetic flag, number dropped."""
    names = ("evidence_found", "no_evidence", "not_configured", "not_applicable", *FAILED)
    g = results.groupBy(*INCIDENT).agg(
        F.count(F.lit(1)).alias("indicators_checked"), *[F.count_if(F.col("status") == s).alias(s) for s in names],
        F.bool_or("synthetic").alias("contains_synthetic"))
    d = incidents.select(*INCIDENT).join(g, INCIDENT, "left")
    if dropped is not None:
        d = d.join(dropped.groupBy(*INCIDENT).agg(F.sum("dropped").alias("dropped")), INCIDENT, "left")
    zero = ["indicators_checked", *names] + (["dropped"] if dropped is not None else [])
    d = d.na.fill(0, zero).na.fill(False, ["contains_synthetic"])
    failed = sum((F.col(s) for s in FAILED), F.lit(0))
    status = F.when(F.col("indicators_checked") == 0, "no_indicators").when(failed > 0, "partial").otherwise("ok")
    return d.withColumn("status", status)


def enrichment_rollup(incidents: DataFrame, reports: DataFrame, limit: int = 10, created: str = "created_at") -> DataFrame:
    """Status and counts of the latest incidents of each tenant."""
    latest = top_k(incidents, ["website_id"], [F.desc(created), F.asc("incident_id")], limit, "incident_id", "position")
    return latest.select(*INCIDENT, "position").join(reports, INCIDENT)
