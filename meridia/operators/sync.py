"""Change feeds, pushed operations, idempotent ingestion and the states of rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KNOWN = ("route:upsert", "route:delete", "trip:upsert", "favorite:upsert", "favorite:delete", "place:upsert", "place:delete")  # operations a push may hold


def change_page(routes: DataFrame, tombstones: DataFrame, user: int, after: tuple[str, int], size: int) -> DataFrame:
    """The user's next changes after (time, id), live routes and tombstones in one order, with the live rows' data.

    One row more than `size` is looked for: more tells whether there is one. Ties in time go on by id.
    """
    cursor = F.struct(F.lit(dt.datetime.fromisoformat(after[0])).alias("at"), F.lit(after[1]).cast("long").alias("id"))
    mine = lambda df, at, gone: df.filter(F.col("user_id") == user).select("route_id", F.col(at).alias("changed_at"), F.lit(gone).alias("deleted"))
    both = mine(routes, "updated_at", False).unionByName(mine(tombstones, "deleted_at", True))
    page = both.filter(F.struct(F.col("changed_at").alias("at"), F.col("route_id").alias("id")) > cursor).orderBy("changed_at", "route_id").limit(size + 1)
    w = Window.orderBy("changed_at", "route_id")  # size + 1 rows
    page = page.withColumns({"n": F.row_number().over(w), "all": F.count("*").over(Window.partitionBy(F.lit(0)))}).filter(F.col("n") <= size)
    live = routes.select(F.col("route_id").alias("r"), F.col("metres"))
    got = page.join(live, (F.col("route_id") == F.col("r")) & ~F.col("deleted"), "left")
    return got.select("route_id", "changed_at", "deleted", "metres", (F.col("all") > size).alias("more"))


def pushed(events: DataFrame, operations: DataFrame) -> DataFrame:
    """Result of each operation: DUPLICATE where it was applied before or stands earlier in the push, FAILED where its kind is unknown, else APPLIED.

    Only operations that did not fail count as applied. events holds user_id, operation_id, status.
    """
    done = events.filter("status <> 'FAILED'").select("user_id", "operation_id").distinct().withColumn("done", F.lit(True))
    first = F.row_number().over(Window.partitionBy("user_id", "operation_id").orderBy("created_at", "event_id")) == 1
    kind = F.concat_ws(":", "entity", "operation")
    got = operations.join(done, ["user_id", "operation_id"], "left").withColumn("first", first)
    what = F.when(F.col("done").isNotNull() | ~F.col("first"), "DUPLICATE").when(~kind.isin(*KNOWN), "FAILED").otherwise("APPLIED")
    return got.select("event_id", "user_id", "operation_id", what.alias("status"))


def first_of(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row by order of each key, by a partial aggregate."""
    row = F.struct(*batch.columns)
    return batch.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(row, order).alias("r")).select("r.*")


def insert_ignore(held: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of batch whose key is new: the first by order of each key, none that held has."""
    return first_of(batch, keys, order).join(held.select(*keys).distinct(), keys, "left_anti").select(*batch.columns)


def plausible(fixes: DataFrame, now: str) -> Column:
    """Whether a fix has a valid position and a time from 2000 on, at most a day ahead."""
    return F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & (F.col("recorded_at") >= F.lit("2000-01-01 00:00:00").cast("timestamp"))
                      & (F.col("recorded_at") <= F.expr(f"timestamp'{now}' + interval 24 hours")), F.lit(False))


def ingested(held: DataFrame, batch: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fixes to insert, rejected ones, and counts received, inserted, duplicates, rejected of one batch."""
    ok = plausible(batch, now)
    good, bad = batch.filter(ok), batch.filter(~ok)
    new = insert_ignore(held, good, ["trip_id", "recorded_at"], "event_id")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    counts = count(batch, "received").crossJoin(count(new, "inserted")).crossJoin(count(bad, "rejected"))  # one row each
    return new, bad, counts.select("received", "inserted", (F.col("received") - F.col("inserted") - F.col("rejected")).alias("duplicates"), "rejected")


def upserted(held: DataFrame, batch: DataFrame, key: str, owner: str) -> DataFrame:
    """held with the rows of batch put in; a row of another owner is left as it is."""
    values = [c for c in held.columns if c not in (key, owner)]
    new = batch.select(F.col(key), F.col(owner).alias("__owner"), *[F.col(c).alias(f"__{c}") for c in values], F.lit(True).alias("__new"))
    j = held.withColumn("__old", F.lit(True)).join(new, key, "full")
    take = F.col("__new").isNotNull() & (F.col("__old").isNull() | F.col(owner).eqNullSafe(F.col("__owner")))
    return j.select(F.col(key), F.when(take, F.col("__owner")).otherwise(F.col(owner)).alias(owner), *[F.when(take, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in values])


def patched(held: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """held with the values that patch supplies; a null in patch keeps the old value."""
    values = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(c).alias(f"__{c}") for c in values])
    return held.join(p, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in values else F.col(c) for c in held.columns])


def latest_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row by order of each key, by a partial aggregate."""
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def live_tombstones(tombstones: DataFrame, routes: DataFrame) -> DataFrame:
    """The last tombstone of each route that is not live again."""
    last = tombstones.groupBy("user_id", "route_id").agg(F.max("deleted_at").alias("deleted_at"))
    return last.join(routes.select("route_id"), "route_id", "left_anti").select("user_id", "route_id", "deleted_at")


def next_state(state: Column, action: Column) -> Column:
    """State of a trip after finish or cancel: only an active trip changes; the same end twice is no error, another one is null."""
    end = F.when(action == "finish", "COMPLETED").when(action == "cancel", "CANCELLED")
    return F.when(state == "ACTIVE", end).when(state == end, state)


def numbered_chunks(points: DataFrame, key: str, order: list[str], size: int = 500) -> DataFrame:
    """Chunk number of each point of a trip."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return points.withColumn("chunk", F.floor((n - 1) / size).cast("int"))


def sized_batches(rows: DataFrame, key: str, order: list[str], payload: str, most: int) -> DataFrame:
    """Batch number of each row of a queue by running size: a batch begins where the bytes so far pass a multiple of `most`."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("upto", F.sum(F.octet_length(payload)).over(w)).withColumn("batch", F.floor((F.col("upto") - F.octet_length(payload)) / most).cast("int"))


def ready_head(queue: DataFrame, key: str, order: list[str], now: str, most: int) -> DataFrame:
    """Rows at the head of each queue up to the first that is not ready, `most` at most."""
    w = Window.partitionBy(key).orderBy(*order)
    blocked = F.max((F.col("ready_at") > F.lit(now).cast("timestamp")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return queue.withColumns({"blocked": blocked, "n": F.row_number().over(w)}).filter((F.col("blocked") == 0) & (F.col("n") <= most)).drop("blocked", "n")


def backoff(attempts: Column) -> Column:
    """Seconds until the next attempt."""
    return F.least(5 * F.pow(F.lit(2.0), attempts), F.lit(900.0)).cast("int")


def purged(queue: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Rows that are not completed, or were less than some days ago."""
    return queue.filter((F.col("status") != "COMPLETED") | (F.col("updated_at") >= F.expr(f"timestamp'{now}' - interval {days} days")))


def remote_applied(local: DataFrame, unsent_deletes: DataFrame, changed: DataFrame, deleted: DataFrame, user: int) -> DataFrame:
    """Saved routes after a page of the feed: an unsent delete wins over the server's copy, deletes touch the user's rows only."""
    new = changed.join(unsent_deletes.select("route_id"), "route_id", "left_anti")
    kept = local.join(new.select("route_id"), "route_id", "left_anti").join(deleted.select("route_id", F.lit(user).alias("user_id")), ["route_id", "user_id"], "left_anti")
    return kept.select(*local.columns).unionByName(new.select(*local.columns))
