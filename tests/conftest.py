import os
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tidewatch.functions.features import extract_features  # noqa: E402
from tidewatch.session import local_session  # noqa: E402

T0 = datetime(2026, 10, 3, 9, 0, 0, tzinfo=timezone.utc)
BROWSER = "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/118.0.0.0 Safari/537.36"
HEADLESS = "Mozilla/5.0 (X11; Linux x86_64) HeadlessChrome/118.0.0.0 Safari/537.36"
SCHEMA = ("event_id STRING, website_id STRING, timestamp TIMESTAMP, ts_us BIGINT, event_type STRING, source_ip STRING, session_id STRING, "
          "user_id STRING, endpoint STRING, status_code INT, user_agent STRING, attributes STRING, method STRING, source STRING")


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", "4")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


class Maker:
    """Small event frames; ``t`` is in seconds after a fixed start."""

    def __init__(self, spark):
        self.spark, self.n = spark, 0

    def ev(self, kind, t=0.0, ip="203.0.113.10", sid="s1", uid=None, ep=None, status=None, ua=BROWSER, attrs="{}", site="web_t"):
        self.n += 1
        us = int(T0.timestamp() * 1_000_000) + round(t * 1_000_000)
        at = T0 + timedelta(microseconds=round(t * 1_000_000))
        return (f"evt_{self.n:06d}", site, at, us, kind, ip, sid, uid, ep, status, ua, attrs, "GET", "sdk")

    def failures(self, n, start=0.0, step=1.0, ip="203.0.113.10", users=None, sid="s1"):
        return [self.ev("login_failure", start + i * step, ip=ip, sid=sid, uid=users[i % len(users)] if users else "u-1", ep="/api/login", status=401)
                for i in range(n)]

    def frame(self, rows):
        return extract_features(self.spark.createDataFrame(rows, SCHEMA))


@pytest.fixture
def mk(spark):
    return Maker(spark)


def findings_of(df, rule=None):
    rows = [r.asDict() for r in df.collect()]
    return [r for r in rows if rule in (None, r["rule_id"])]


__all__ = ["F"]
