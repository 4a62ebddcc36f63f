"""Two drawings of one road: which stretches of state roads a street repeats, and which streets take over their class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bearing, haversine, line_length, segment_metres, sides, undirected_gap
from . import runs, spatial

# fixed values: distance and angle within which a street repeats a road, metres between samples, samples of a gap to fill
NEAR_M, ANGLE, STEP_M, GAP = 22.0, 35.0, 15.0, 4


def samples(lines: DataFrame, step: float = STEP_M) -> DataFrame:
    """line, pos, lon, lat, bearing: points every `step` metres of each segment, the segment's start included."""
    s = lines.select("line", F.posexplode(sides(F.col("shape"))).alias("i", "s"))
    a, b = (lambda k: F.col(f"s.a.{k}")), (lambda k: F.col(f"s.b.{k}"))
    long_ = haversine(a("lon"), a("lat"), b("lon"), b("lat"))
    n = F.greatest(F.ceil(long_ / step), F.lit(1)).cast("int")
    s = s.withColumns({"n": n, "bearing": bearing(a("lon"), a("lat"), b("lon"), b("lat"))}).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("k") / F.col("n")
    return s.select("line", (F.col("i") * F.lit(1 << 32) + F.col("k")).alias("pos"), (a("lon") + t * (b("lon") - a("lon"))).alias("lon"), (a("lat") + t * (b("lat") - a("lat"))).alias("lat"), "bearing")


def repeated(state_roads: DataFrame, streets: DataFrame) -> DataFrame:
    """line, pos, street, covered of each sample of a state road: the nearest street segment within NEAR_M, if it runs the same way.

    covered is smoothed: gaps of up to GAP samples are filled, a lone covered sample is a crossing and does not count.
    """
    s = samples(state_roads).withColumn("k", F.concat_ws(":", "line", "pos"))
    near = spatial.cell_join(s.select("k", "lon", "lat"), spatial.segments(streets.select(F.col("street").alias("edge"), "shape"), NEAR_M))
    d = F.round(segment_metres(F.col("lon"), F.col("lat"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 3)
    best = near.withColumns({"d": d, "b": bearing(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))}).filter(F.col("d") <= NEAR_M).groupBy("k").agg(F.min(F.struct("d", F.col("edge").alias("street"), "b")).alias("m"))
    got = s.join(best, "k", "left").withColumn("hit", F.coalesce(undirected_gap(F.col("bearing"), F.col("m.b")) <= ANGLE, F.lit(False)))
    got = got.withColumn("street", F.when(F.col("hit"), F.col("m.street")))
    return runs.smoothed(got.select("line", "pos", "street", "hit"), "line", ["pos"], "hit", GAP).select("line", "pos", "street", "hit", F.col("smooth").alias("covered"))


def kept_stretches(samples_: DataFrame) -> DataFrame:
    """Runs of samples that no street repeats, by line: what is drawn of the state road."""
    r = runs.runs(samples_, "line", ["pos"], "covered")
    return r.filter(~F.col("covered")).select("line", "first", "length")


def promoted(samples_: DataFrame, streets: DataFrame, state_roads: DataFrame, share: float = 0.5) -> DataFrame:
    """street and class of the streets that a state road covers for half of their length or more, where its class is the better one."""
    c = samples_.filter("hit").groupBy("street").agg((F.count("*") * STEP_M).alias("metres"), F.max_by("line", F.struct("line", "pos")).alias("line"))
    s = streets.select("street", F.col("cls").alias("old"), line_length(F.col("shape")).alias("all"))
    j = c.join(s, "street").filter((F.col("all") > 0) & (F.col("metres") >= share * F.col("all"))).join(state_roads.select("line", "cls"), "line")
    return j.select("street", F.least("cls", "old").alias("cls"))


def all_inside(points: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """line of the links all of whose samples (line, key, lon, lat) lie in some area."""
    hit = spatial.first_area(points, areas, key).select(key).withColumn("in", F.lit(True))
    return points.join(hit, key, "left").groupBy("line").agg(F.bool_and(F.coalesce("in", F.lit(False))).alias("ok")).filter("ok").select("line")
