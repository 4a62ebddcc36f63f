"""The retry queue as a stream against a table of the same events, under repeats."""

import datetime as dt
import random
import tempfile

from meridia.streaming import queue

SCHEMA = "account long, op string, event string, attempt int, at timestamp"


def test_stream_equals_table_under_replays(spark):
    rng, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    events = []
    for account in range(6):
        for i in range(8):
            at = t0 + dt.timedelta(seconds=rng.randrange(400))
            events.append((account, f"op{i}", "new", None, at))
            for n in range(1, rng.randrange(5)):
                at += dt.timedelta(seconds=queue.wait(n - 1) + 1)
                events.append((account, f"op{i}", "failed", n, at))
            if rng.random() < 0.4:
                events.append((account, f"op{i}", "done", None, at + dt.timedelta(seconds=1)))
    rng.shuffle(events)
    source = tempfile.mkdtemp(prefix="spark-queue-")
    for i in range(4):
        part = events[i * len(events) // 4 : (i + 1) * len(events) // 4] + events[: 20 * i]  # earlier events come again
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        q = queue.sendable(stream, "1 hour").writeStream.format("memory").queryName("ready").outputMode("append").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-queue-")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        rows = spark.table("ready").collect()
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    last = {}
    for r in rows:
        last.setdefault(r["account"], {}).setdefault(r["at"], set()).add((r["op"], r["attempts"]))
    want = {}
    for r in queue.sendable_now(spark.createDataFrame(events, SCHEMA)).collect():
        want.setdefault(r["account"], set()).add((r["op"], r["attempts"]))
    end = {a: max(e[4] for e in events if e[0] == a) for a in range(6)}
    got = {a: by[end[a]] for a, by in last.items() if end[a] in by}
    assert want and all(w <= got.get(a, set()) for a, w in want.items())
    for account, ops in want.items():  # the order of creation holds, and nothing behind a waiting operation is given
        assert ops == {x for x in got[account] if x in ops}


def test_queue_stops_at_the_first_that_waits(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, "a", "new", None, at(0)), (1, "b", "new", None, at(1)), (1, "c", "new", None, at(2)), (1, "a", "done", None, at(3)), (1, "b", "failed", 1, at(4)), (2, "x", "new", None, at(0)), (2, "y", "new", None, at(1)), (2, "y", "failed", 1, at(2)), (2, "z", "new", None, at(3)), (3, "m", "new", None, at(0)), (3, "m", "failed", 1, at(1)), (3, "n", "new", None, at(60))]
    got = {tuple(r) for r in queue.sendable_now(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(2, "x", 0), (3, "m", 1), (3, "n", 0)}
