"""A retry queue as a stream: operations of an account are sent in order, and one that waits for its next attempt holds back those behind it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# fixed values: seconds before the second attempt, and the longest wait
FIRST_S, MOST_S = 5, 900
READY = "account long, op string, attempts int, at timestamp"
OPS = "created timestamp, attempts int, next timestamp, done boolean"


def wait(attempts: int) -> int:
    return int(min(FIRST_S * 2.0 ** min(attempts, 30), MOST_S))


class RetryQueue(StatefulProcessor):
    """Keeps the operations of an account; gives those that may be sent, whenever the account's events or a timer change what may be.

    Events are `new` (created at), `failed` (attempt number, at) and `done`. They may come again and in any order: an
    attempt number counts once, what is done stays done. State is one entry per operation; a done one keeps only that.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ops = handle.getMapState("ops", "op string", OPS)
        self.clock = handle.getValueState("clock", "at timestamp")

    def _ready(self, account: int, now: dt.datetime) -> pd.DataFrame:
        waiting = sorted((v[0], k[0], v[1], v[2]) for k, v in self.ops.iterator() if not v[3] and v[0] is not None)
        out = []
        for _, op, attempts, upto in waiting:
            if upto is not None and upto > now:
                self.handle.registerTimer(int(upto.timestamp() * 1000))
                break
            out.append((account, op, attempts, now))
        return pd.DataFrame(out, columns=["account", "op", "attempts", "at"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.clock.get()[0] if self.clock.exists() else None
        for part in rows:
            for r in part.itertuples(index=False):
                at = pd.Timestamp(r.at).to_pydatetime()
                created, attempts, upto, done = self.ops.getValue((r.op,)) if self.ops.containsKey((r.op,)) else (None, 0, None, False)
                if r.event == "new":
                    created = at if created is None else min(created, at)
                elif r.event == "failed" and int(r.attempt) > attempts:
                    attempts, upto = int(r.attempt), at + dt.timedelta(seconds=wait(int(r.attempt)))
                elif r.event == "done":
                    done = True
                self.ops.updateValue((r.op,), (created, attempts, upto, done))
                now = at if now is None else max(now, at)
        self.clock.update((now,))
        yield self._ready(key[0], now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000)
        if self.clock.exists():
            now = max(now, self.clock.get()[0])
        self.clock.update((now,))
        yield self._ready(key[0], now)

    def close(self) -> None:
        pass


def sendable(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """account, op, attempts, at: the head of each account's queue, up to the first operation that waits, each time it may have changed.

    events hold account, op, event, attempt and at. Timers run on event time. Needs a state store that keeps several
    kinds of state (RocksDB).
    """
    return events.withWatermark("at", late).groupBy("account").transformWithStateInPandas(RetryQueue(), READY, "append", "eventTime")


def sendable_now(events: DataFrame) -> DataFrame:
    """What sendable() last gives when all events are in, worked out from a table: account, op, attempts."""
    e = events.groupBy("account", "op").agg(
        F.min(F.when(F.col("event") == "new", F.col("at"))).alias("created"), F.coalesce(F.max(F.when(F.col("event") == "failed", F.col("attempt"))), F.lit(0)).alias("attempts"),
        F.max_by("at", F.when(F.col("event") == "failed", F.struct("attempt", -F.unix_micros("at")))).alias("failed"), F.max(F.col("event") == "done").alias("done"))
    seconds = F.least(FIRST_S * F.pow(F.lit(2.0), F.col("attempts")), F.lit(float(MOST_S))).cast("int")
    e = e.withColumn("next", F.when(F.col("attempts") > 0, F.timestamp_seconds(F.unix_timestamp("failed") + seconds)))
    now = events.groupBy("account").agg(F.max("at").alias("now"))
    q = e.filter("not done and created is not null").join(now, "account")
    w = Window.partitionBy("account").orderBy("created", "op").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.max(F.coalesce(F.col("next") > F.col("now"), F.lit(False)).cast("int")).over(w)
    return q.withColumn("held", held).filter("held = 0").select("account", "op", F.col("attempts").cast("int").alias("attempts"))
