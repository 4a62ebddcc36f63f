"""Streams of position fixes: idempotent ingestion, sliding speeds, running trip totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geo import grid
from ..operators.sync import insert_ignore, plausible
from ..operators.tracks import track_lengths

FIXES = "event_id long, trip_id long, recorded_at timestamp, lon double, lat double, speed double, accuracy double"


def sliding_speeds(fixes: DataFrame, minutes: int = 15, every: int = 5, late: str = "1 hour") -> DataFrame:
    """Samples, trips (approximate in a stream, where a distinct count has no bound) and mean km/h per cell and sliding window.

    A watermark closes windows; fixes later than it are left out of this live view only.
    """
    f = fixes.filter("speed is not null").withWatermark("recorded_at", late)
    w = F.window("recorded_at", f"{minutes} minutes", f"{every} minutes").alias("w")
    got = f.groupBy(w, grid(F.col("lon"), 2).alias("cell_lon"), grid(F.col("lat"), 2).alias("cell_lat")).agg(
        F.count("*").alias("samples"), F.approx_count_distinct("trip_id").alias("trips"), F.sum(F.col("speed").cast("decimal(18,6)")).alias("s"))
    return got.select(F.col("w.start").alias("start"), "cell_lon", "cell_lat", "samples", "trips", F.round((F.col("s") * 3.6).cast("double") / F.col("samples"), 1).alias("kmh"))


def unique_fixes(fixes: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first fix of each trip and time; state is kept for as long as the watermark allows repeats."""
    return fixes.withWatermark("recorded_at", late).dropDuplicatesWithinWatermark(["trip_id", "recorded_at"])


def into_table(fixes: DataFrame, table: str, rejected: str, now: str, checkpoint: str) -> StreamingQuery:
    """Appends the plausible fixes whose trip and time the table has not, as often as batches are retried.

    Rows carry their batch's number: a batch that runs again replaces its own partition, and compares with the
    partitions of other batches only. Late fixes are inserted as well: nothing here depends on a watermark.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ok = plausible(batch, now)
        held = existing(spark, table).filter(F.col("batch") != number)
        new = insert_ignore(held, batch.filter(ok), ["trip_id", "recorded_at"], "event_id")
        for df, path in ((new, table), (batch.filter(~ok), rejected)):
            df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return fixes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def existing(spark: SparkSession, table: str) -> DataFrame:
    """The table's fixes; none before its first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    schema = FIXES + ", batch long"
    return spark.read.schema(schema).parquet(table) if there else spark.createDataFrame([], schema)


def touched_lengths(spark: SparkSession, table: str, batch: int) -> DataFrame:
    """Points and metres of the trips that a batch touched, from all their fixes: late ones count."""
    all_ = existing(spark, table)
    trips = all_.filter(F.col("batch") == batch).select("trip_id").distinct()
    return track_lengths(all_.join(trips, "trip_id", "left_semi"))
