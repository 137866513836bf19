"""Open failed-login runs of a stream, exactly: keyed map state for what still waits for its order, a run for what is in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewatch.operators.ordered import MICROS
from tidewatch.operators.sessions import with_entity

OUT = "website_id STRING, entity STRING, n BIGINT, first_us BIGINT, last_us BIGINT, accounts BIGINT"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def open_runs(gap_us: int) -> StatefulProcessor:
    """The runs of one entity; the class is made here so that it travels by value to workers that do not have this package yet."""
    class OpenRuns(StatefulProcessor):
        """Runs of one entity.

        Rows wait in slots as wide as the gap: rows of one slot always belong together, so a slot is its first and last time, its count and
        its accounts, however many rows it has.  A timer at the end of a slot means that no row of it can come any more; slots then join the
        open run or close it and open the next.  A run is also closed by a timer once the watermark has passed its last row and the gap."""

        def __init__(self, gap_us: int):
            self.gap = gap_us

        def init(self, handle) -> None:
            self.handle = handle
            self.slots = handle.getMapState("slots", "slot BIGINT", "first BIGINT, last BIGINT, n BIGINT")
            self.callers = handle.getMapState("callers", "slot BIGINT, account STRING", "there BOOLEAN")
            self.run = handle.getValueState("run", "first BIGINT, last BIGINT, n BIGINT, accounts BIGINT")
            self.seen = handle.getMapState("seen", "account STRING", "there BOOLEAN")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            for batch in rows:
                slot = batch["ts_us"] // self.gap
                for s, g in batch.groupby(slot)["ts_us"]:
                    at, first, last, n = (int(s),), int(g.min()), int(g.max()), len(g)
                    if self.slots.containsKey(at):
                        f, la, m = self.slots.getValue(at)
                        first, last, n = min(first, f), max(last, la), n + m
                    else:
                        self.handle.registerTimer(-(-(at[0] + 1) * self.gap // 1000))
                    self.slots.updateValue(at, (first, last, n))
                named = batch["user_id"].notna() & (batch["user_id"] != "")
                for s, account in set(zip(slot[named], batch["user_id"][named], strict=True)):
                    self.callers.updateValue((int(s), account), (True,))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            now = timerValues.getCurrentWatermarkInMs() * 1000
            slots = {k[0]: tuple(v) for k, v in self.slots.iterator()}
            due = sorted(s for s in slots if (s + 1) * self.gap <= now)
            accounts: dict[int, list[str]] = {s: [] for s in due}
            for slot, account in (list(self.callers.keys()) if due else ()):
                if slot in accounts:
                    accounts[slot].append(account)
            for s in due:
                first, last, n = slots.pop(s)
                run = self._open()
                if run and first - run[1] > self.gap:
                    yield self._closed(key, run)
                    run = None
                new = [a for a in accounts[s] if not self.seen.containsKey((a,))]
                for a in new:
                    self.seen.updateValue((a,), (True,))
                run = (run[0], max(run[1], last), run[2] + n, run[3] + len(new)) if run else (first, last, n, len(new))
                self.run.update(run)
                self.slots.removeKey((s,))
                for a in accounts[s]:
                    self.callers.removeKey((s, a))
                self.handle.registerTimer((run[1] + self.gap) // 1000 + 1)
            run = self._open()
            if run and run[1] + self.gap < now and not any(first - run[1] <= self.gap for first, _, _ in slots.values()):
                yield self._closed(key, run)

        def _open(self) -> tuple | None:
            return tuple(self.run.get()) if self.run.exists() else None

        def _closed(self, key, run: tuple) -> pd.DataFrame:
            self.run.clear()
            self.seen.clear()
            first, last, n, accounts = run
            return pd.DataFrame({"website_id": [key[0]], "entity": [key[1]], "n": [n], "first_us": [first], "last_us": [last], "accounts": [accounts]})

        def close(self) -> None:
            pass
    return OpenRuns(gap_us)


def burst_state(events: DataFrame, gap_s: float = 30, min_failures: int = 10, watermark: str = "24 hours") -> DataFrame:
    """Failed-login runs per entity with their exact number of accounts: ``website_id, entity, n, first_us, last_us, accounts``.

    On a stream a run comes out once the watermark has passed its last row and the gap, whatever the order of the rows within the
    watermark; on a table all runs come out.  Every event moves the watermark, not only failed logins.  The state of one source is one
    key, so a row costs two map updates and a slot's repeated rows and accounts are kept once."""
    gap = int(gap_s * MICROS)
    if not events.isStreaming:
        from tidewatch.operators.rules import bursts, failure_runs
        return bursts(failure_runs(events, gap_s), min_failures).select("website_id", "entity", "n", F.col("run_us").alias("first_us"), F.col("end_us").alias("last_us"), "accounts")
    events.sparkSession.conf.set(*STATE_STORE)           # arbitrary state needs a store with several columns
    # a condition without the time column would be pushed below the watermark, and other events would not move it
    wanted = F.when(F.col("timestamp").isNotNull() & F.col("entity").isNotNull(), F.lit("login_failure"))
    rows = with_entity(events.withWatermark("timestamp", watermark)).where(F.col("event_type") == wanted)
    runs = (rows.select("website_id", "entity", "timestamp", "ts_us", "user_id").groupBy("website_id", "entity")
            .transformWithStateInPandas(open_runs(gap), OUT, "Append", "EventTime"))
    return runs.where(F.col("n") >= min_failures)
