"""Stored tables: scoped reads and idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_events(events: DataFrame, website_id: str, since_us: int | None = None, ordered: bool = False) -> DataFrame:
    """Events of one tenant from a time on.  On a table partitioned by ``website_id, event_date`` the date bound prunes
    partitions; both predicates are on bare columns, so they reach the Parquet scan."""
    out = events.where(F.col("website_id") == website_id)
    if since_us is not None:
        if "event_date" in events.columns:
            out = out.where(F.col("event_date") >= F.to_date(F.timestamp_micros(F.lit(since_us))))
        out = out.where(F.col("ts_us") >= since_us)
    return out.orderBy("ts_us", "event_id") if ordered else out


def load_events_for_entities(events: DataFrame, ips: DataFrame, session_ids: DataFrame, since_us: int | None = None) -> DataFrame:
    """Events whose address or session is in a given set, each once.

    Two semi joins; the second skips rows the first one took (anti join), so no de-duplication shuffle is needed."""
    rows = events if since_us is None else events.where(F.col("ts_us") >= since_us)
    ip_keys = ips.select("website_id", "source_ip").where("source_ip <> ''").distinct()
    sid_keys = session_ids.select("website_id", "session_id").where("session_id <> ''").distinct()
    by_ip = rows.join(ip_keys, ["website_id", "source_ip"], "left_semi")
    by_sid = (rows.join(sid_keys, ["website_id", "session_id"], "left_semi")
              .join(ip_keys, ["website_id", "source_ip"], "left_anti"))
    return by_ip.select(*events.columns).unionByName(by_sid.select(*events.columns))


def tenant_scope(df: DataFrame, websites: DataFrame, account_id) -> DataFrame:
    """Only rows of websites the account owns.  The owned list is one account's sites, found by a filter."""
    owned = websites.where(F.col("account_id") == account_id).select("website_id").distinct()
    return df.join(owned, "website_id", "left_semi")


def replace_findings(old: DataFrame, new: DataFrame, analysed: DataFrame, agent: str) -> DataFrame:
    """The finding table after a re-run: this agent's findings on analysed events go, the new ones come, others stay.
    ``change`` says ``kept`` or ``created``."""
    keys = analysed.select("website_id", "event_id").distinct()
    mine = F.col("agent_name") == agent
    gone_keys = keys.withColumn("agent_name", F.lit(agent))
    kept = old.join(gone_keys, ["website_id", "event_id", "agent_name"], "left_anti").select(*old.columns)
    fresh = new.where(mine).select(*old.columns)
    return kept.withColumn("change", F.lit("kept")).unionByName(fresh.withColumn("change", F.lit("created")))


def replace_counts(old: DataFrame, new: DataFrame, analysed: DataFrame, agent: str) -> DataFrame:
    """(created, replaced) per tenant."""
    keys = analysed.select("website_id", "event_id").distinct()
    gone = (old.where(F.col("agent_name") == agent).join(keys, ["website_id", "event_id"], "left_semi")
            .groupBy("website_id").agg(F.count(F.lit(1)).alias("replaced")))
    made = new.where(F.col("agent_name") == agent).groupBy("website_id").agg(F.count(F.lit(1)).alias("created"))
    return (made.join(gone, "website_id", "full")
            .select("website_id", F.coalesce("created", F.lit(0)).alias("created"), F.coalesce("replaced", F.lit(0)).alias("replaced")))


def _write(df: DataFrame, path: str, parts: list[str], mode: str) -> None:
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path))


def write_events(df: DataFrame, path: str, mode: str = "append") -> None:
    """Event table partitioned for pruning; rows are clustered so that a task writes few files, and a hot tenant-day is
    split by AQE instead of landing in one task."""
    _write(df.hint("rebalance", "website_id", "event_date"), path, ["website_id", "event_date"], mode)


def write_findings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _write(df, path, ["website_id", "agent_name"], mode)


def write_links(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _write(df, path, ["website_id"], mode)


def write_incidents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Incidents with nested ``details`` kept as STRUCT, so that readers prune nested columns."""
    _write(df, path, ["website_id"], mode)


def export_reports(reports: DataFrame, path: str) -> None:
    """One JSON object per incident."""
    reports.write.mode("overwrite").json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
