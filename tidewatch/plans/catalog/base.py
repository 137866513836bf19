"""Shared by the registered queries: loaders over the driver's tables and the views of the oracle SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import adapter
from tidewatch.session import release, scratch_path, sized_by_rows

ORACLE_VIEWS = dict(adapter.VIEWS)
ORACLE_VIEWS["ev"] = """
SELECT w.*, epoch_us(timestamp) AS us, COALESCE(session_id, concat('ip:', source_ip)) AS sk0,
  CASE WHEN session_id IS NOT NULL THEN session_id WHEN source_ip IS NOT NULL THEN concat('ip:', source_ip) ELSE 'unknown' END AS session_key,
  session_id IS NULL AS inferred,
  CASE WHEN source_ip IS NOT NULL THEN source_ip WHEN session_id IS NOT NULL THEN concat('sid:', session_id) END AS entity,
  split_part(endpoint, '?', 1) AS path,
  CASE WHEN contains(endpoint, '?') THEN url_decode(replace(substr(endpoint, strpos(endpoint, '?') + 1), '+', ' ')) ELSE '' END AS query,
  event_type IN ('page_view', 'http_request', 'api_access', 'sensitive_endpoint_access') AS is_request,
  event_type = 'sensitive_endpoint_access' OR COALESCE(regexp_matches(split_part(endpoint, '?', 1),
    '^(/api/admin|/admin|/api/account/payment-methods)(/.*)?$'), FALSE) AS is_sensitive,
  COALESCE(status_code >= 400, FALSE) AS is_error,
  CASE WHEN user_agent IS NULL OR user_agent = '' THEN 'empty'
    WHEN regexp_matches(lower(user_agent), 'headlesschrome|phantomjs|selenium|puppeteer|playwright') THEN 'headless_browser'
    WHEN regexp_matches(lower(user_agent), 'scrapy|curl/|wget/|python-requests|python-urllib|go-http-client|libwww-perl') THEN 'automation_tool'
    WHEN starts_with(lower(user_agent), 'mozilla/') THEN 'browser' ELSE 'other' END AS ua_class
FROM web_events w"""


def query(fn):
    """Pins the session time zone, so results do not depend on the caller's, and how table sizes are guessed."""
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        sized_by_rows(spark)
        return fn(spark, sf_dir)
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table, written once per session as the ingest and detection jobs would, then read back."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _STORED[key] = path
        release(spark)
    return spark.read.parquet(_STORED[key])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored adapter events with ``ts_us`` and ``features``."""
    return stored(spark, sf_dir, "events", lambda: adapter.web_events(spark, sf_dir))


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    events(spark, sf_dir)
    return adapter.view(spark, sf_dir, name, stored={"web_events": _STORED[(spark.sparkContext.applicationId, sf_dir, "events")]})


def joined(c: Column | str, sep: str = ",") -> Column:
    """Array column as text (arrays of registered queries are shown as text)."""
    return F.array_join(F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("string")), sep)
