"""Track operators over position fixes (trip_id, recorded_at, lon, lat)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine

ORDER = ("recorded_at", "event_id")


def track_lengths(fixes: DataFrame) -> DataFrame:
    """Points and length in whole metres of each trip."""
    w = Window.partitionBy("trip_id").orderBy(*ORDER)
    step = haversine(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    return fixes.select("trip_id", step.alias("m")).groupBy("trip_id").agg(F.count("*").alias("points"), F.round(F.coalesce(F.sum("m"), F.lit(0.0)), 0).alias("metres"))


def thinned(fixes: DataFrame, most: int = 10) -> DataFrame:
    """At most `most` evenly spaced points of each trip, ends included."""
    t = Window.partitionBy("trip_id")
    p = fixes.withColumn("pos", F.row_number().over(t.orderBy(*ORDER)) - 1).withColumn("n", F.count("*").over(t))
    at = lambda x: F.floor(x * (most - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    keep = (F.col("n") <= most) | (F.col("pos") == 0) | (at(F.col("pos")) > at(F.col("pos") - 1))
    return p.filter(keep).select("trip_id", "event_id", F.col("pos").cast("long").alias("pos"), "lon", "lat")


def latest_fix(fixes: DataFrame) -> DataFrame:
    """The last fix of each trip, by a partial aggregate rather than a sort."""
    last = fixes.groupBy("trip_id").agg(F.max(F.struct("recorded_at", "event_id", "lon", "lat")).alias("f"))
    return last.select("trip_id", "f.*")
