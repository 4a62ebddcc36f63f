"""Traffic over position fixes (trip_id, recorded_at, lon, lat, speed in m/s, accuracy) as of a given time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import grid, in_box, shape_metres
from ..functions.text import numbers_in
from ..sources.tables import APPROXIMATE, CONNECTOR, MOTOR_CLASS, STATE, UNPAVED
from . import spatial

MOTORS = ("CAR", "MOTORCYCLE", "TRUCK")
# fixed values: km/h by road class (motorway, trunk, primary, secondary, tertiary, street, service, track, path, footway, steps, connector)
TOWN_KPH = {
    "CAR": (80, 60, 55, 45, 35, 28, 15, 20, 0, 0, 0, 25),
    "TRUCK": (70, 50, 45, 38, 30, 22, 10, 15, 0, 0, 0, 20),
    "MOTORCYCLE": (80, 60, 55, 45, 35, 28, 15, 20, 0, 0, 0, 25),
    "BICYCLE": (0, 18, 18, 17, 16, 15, 13, 12, 12, 6, 0, 12),
    "PEDESTRIAN": (0, 5, 5, 5, 5, 5, 5, 4.5, 4.5, 5, 3, 5),
}
# fixed values: km/h of the first three classes on state roads
STATE_KPH = {"CAR": (90, 65, 55), "TRUCK": (75, 52, 45), "MOTORCYCLE": (85, 62, 52), "BICYCLE": (20, 18, 16), "PEDESTRIAN": (4.5, 4.5, 4.5)}
# fixed values: seconds lost at a junction of three or more roads
JUNCTION_S = {"CAR": 3, "TRUCK": 4, "MOTORCYCLE": 2, "BICYCLE": 2, "PEDESTRIAN": 1}


def valid_box(box: tuple[float, float, float, float], span: float = 2.5) -> tuple[float, float, float, float]:
    """The box (west, south, east, north), or an error: four finite numbers in range, in order, at most `span` degrees wide and high."""
    import math

    if len(box) != 4 or not all(map(math.isfinite, box)):
        raise ValueError("a box has four finite numbers")
    w, s, e, n = box
    if not (-180 <= w < e <= 180 and -90 <= s < n <= 90):
        raise ValueError("a box is west, south, east, north")
    if e - w > span or n - s > span:
        raise ValueError(f"a box spans {span} degrees at most")
    return box


def since(column: str, as_of: str, amount: int, unit: str) -> Column:
    """At most so long before a time."""
    return F.col(column) >= F.expr(f"timestamp'{as_of}' - interval {amount} {unit}")


def traffic_cells(fixes: DataFrame, box, as_of: str, minutes: int = 15, min_samples: int = 5, min_trips: int = 3, most: int = 5000) -> DataFrame:
    """Mean speed per cell of recent fixes with a known speed, the latest cells first; a cell with few samples or trips stays hidden."""
    f = fixes.filter(since("recorded_at", as_of, minutes, "minutes") & F.col("speed").isNotNull() & in_box(F.col("lon"), F.col("lat"), valid_box(box)))
    cells = f.groupBy(grid(F.col("lon"), 3).alias("cell_lon"), grid(F.col("lat"), 3).alias("cell_lat")).agg(
        F.count("*").alias("samples"), F.countDistinct("trip_id").alias("trips"),
        F.round((F.sum(F.col("speed").cast("decimal(18,6)")) * F.lit(3.6).cast("decimal(3,1)")).cast("double") / F.count("*"), 1).alias("kmh"), F.max("recorded_at").alias("latest"))
    return cells.filter((F.col("samples") >= min_samples) & (F.col("trips") >= min_trips)).orderBy(F.desc("latest"), "cell_lon", "cell_lat").limit(most)


def activity_cells(fixes: DataFrame, box, as_of: str, hours: int = 24, min_trips: int = 3, most: int = 20000) -> DataFrame:
    """Cells where at least min_trips different trips were."""
    f = fixes.filter(since("recorded_at", as_of, hours, "hours") & in_box(F.col("lon"), F.col("lat"), valid_box(box)))
    cells = f.groupBy(grid(F.col("lon"), 3).alias("cell_lon"), grid(F.col("lat"), 3).alias("cell_lat")).agg(F.count("*").alias("samples"), F.countDistinct("trip_id").alias("trips"))
    return cells.filter(F.col("trips") >= min_trips).orderBy("cell_lon", "cell_lat").limit(most)


def good_fixes(fixes: DataFrame, trips: DataFrame) -> DataFrame:
    """Fixes of motor trips with a plausible speed and an accuracy of 50 m or better, or unknown."""
    ok = (F.col("speed") >= 0) & (F.col("speed") < 70) & (F.col("accuracy").isNull() | (F.col("accuracy") <= 50))
    return fixes.filter(ok).join(trips.filter(F.col("profile").isin(*MOTORS)), "trip_id")


def same_clock(as_of: str, zone: str) -> Column:
    """Same kind of day (Monday to Friday, Saturday, Sunday) and within an hour of the clock time, in a time zone."""
    local, now = F.from_utc_timestamp("recorded_at", zone), F.from_utc_timestamp(F.lit(as_of).cast("timestamp"), zone)
    kind = lambda c: F.greatest(F.weekday(c), F.lit(4))  # noqa: E731  Monday is 0
    return (kind(local) == kind(now)) & F.pmod(F.hour(local) - F.hour(now), F.lit(24)).isin(0, 1, 23)


def typical_fixes(fixes: DataFrame, as_of: str, zone: str, days: int = 28, minutes: int = 15) -> DataFrame:
    return fixes.filter(since("recorded_at", as_of, days, "days") & ~since("recorded_at", as_of, minutes, "minutes") & same_clock(as_of, zone))


def free_flow(profile: str, cls: Column, flags: Column) -> Column:
    """km/h on an edge without traffic; 0 where the profile may not go."""
    kph = F.element_at(F.array(*[F.lit(float(x)) for x in TOWN_KPH[profile]]), cls + 1)
    state = F.coalesce(F.try_element_at(F.array(*[F.lit(float(x)) for x in STATE_KPH[profile]]), cls + 1), kph)
    kph = F.when((kph > 0) & (flags.bitwiseAND(STATE) > 0), state).otherwise(kph)
    kph = kph * F.when(flags.bitwiseAND(UNPAVED) > 0, 0.6 if profile in MOTORS else 0.8).otherwise(1.0)
    return kph * F.when(flags.bitwiseAND(APPROXIMATE) > 0, 0.7).otherwise(1.0)


def status(ratio: Column) -> Column:
    return F.when(ratio >= 0.75, "free").when(ratio >= 0.5, "moderate").when(ratio >= 0.25, "slow").otherwise("jammed")


def edge_speeds(matched: DataFrame, keys: list[str], min_samples: int, min_trips: Column | int) -> DataFrame:
    """Upper median of km/h per edge: the element at half the count of the sorted speeds, which from above is the discrete median."""
    got = matched.groupBy(*keys).agg(F.count("*").alias("samples"), F.countDistinct("trip_id").alias("trips"), F.round(F.expr("percentile_disc(0.5) within group (order by speed desc)") * 3.6, 6).alias("median_kph"))
    return got.filter((F.col("samples") >= min_samples) & (F.col("trips") >= min_trips))


def matched(fixes: DataFrame, edges: DataFrame, metres: float = 25.0) -> DataFrame:
    """Fixes on the nearest edge for motors, connectors left out."""
    return spatial.nearest_edges(fixes, edges.filter((F.col("cls") <= MOTOR_CLASS) & (F.col("cls") != CONNECTOR)), "event_id", metres)


def traffic_flow(fixes: DataFrame, trips: DataFrame, edges: DataFrame, box, as_of: str, zone: str, minutes: int = 15, days: int = 28) -> DataFrame:
    """Per edge: km/h, free-flow km/h, their ratio and status; typical speeds where too few live ones are.

    Fixes are matched once, marked live or typical, and aggregated once by edge and mark.
    """
    f = good_fixes(fixes.filter(in_box(F.col("lon"), F.col("lat"), valid_box(box)) & since("recorded_at", as_of, days, "days")), trips)
    live = since("recorded_at", as_of, minutes, "minutes")
    f = f.withColumn("source", F.when(live, "live").when(same_clock(as_of, zone), "typical")).filter("source is not null")
    speeds = edge_speeds(matched(f, edges), ["edge", "source"], 3, F.when(F.col("source") == "live", 2).otherwise(3))
    best = speeds.groupBy("edge").agg(F.min(F.struct("source", "samples", "trips", "median_kph")).alias("m")).select("edge", "m.*")  # live sorts before typical
    free = free_flow("CAR", F.col("cls"), F.col("flags"))
    out = best.join(edges.select("edge", free.alias("free")), "edge")
    ratio = F.when(F.col("free") > 0, F.least(F.lit(1.5), F.col("median_kph") / F.col("free"))).otherwise(1.0)
    up = lambda x: F.floor(x + 0.5)
    return out.select("edge", "source", "samples", "trips", up(F.col("median_kph")).alias("kph"), up(F.col("free")).alias("free_kph"), (up(ratio * 100) / 100).alias("ratio"), status(ratio).alias("status"))


def route_traffic(fixes: DataFrame, routes: DataFrame, as_of: str, minutes: int = 15, metres: float = 150.0) -> DataFrame:
    """Per route with enough recent fixes nearby: mean km/h, samples, trips and the duration adjusted by them; others keep theirs."""
    f = fixes.filter(since("recorded_at", as_of, minutes, "minutes") & F.col("speed").isNotNull())
    near = spatial.cell_join(f, spatial.segments(routes.select(F.col("route_id").alias("edge"), "shape"), metres)).select("event_id", "edge", "lon", "lat", "speed", "trip_id").distinct()
    near = near.join(routes.select(F.col("route_id").alias("edge"), "shape"), "edge").filter(shape_metres(F.col("lon"), F.col("lat"), F.col("shape")) <= metres)
    seen = near.groupBy(F.col("edge").alias("route_id")).agg(
        F.count("*").alias("samples"), F.countDistinct("trip_id").alias("trips"),
        F.round((F.sum(F.col("speed").cast("decimal(18,6)")) * F.lit(3.6).cast("decimal(3,1)")).cast("double") / F.count("*"), 1).alias("kph"))
    out = routes.join(seen.filter("samples >= 5 and trips >= 3"), "route_id", "left")
    expected = F.col("metres") / F.nullif(F.col("seconds"), F.lit(0)) * 3.6
    factor = F.when((F.col("kph") > 0) & (expected > F.col("kph")), F.least(expected / F.col("kph"), F.lit(2.5))).otherwise(1.0)
    return out.select("route_id", F.coalesce("samples", F.lit(0)).alias("samples"), F.coalesce("trips", F.lit(0)).alias("trips"), "kph", F.floor(F.col("seconds") * factor + 0.5).alias("adjusted_seconds"))


def route_climate(routes: DataFrame, zones: DataFrame, most: int = 20) -> DataFrame:
    """Zones that a route's sampled points touch, wettest first: one row per route and range, `most` per route."""
    stride = F.greatest(F.lit(1), F.floor(F.size("shape") / 150))
    p = routes.select("route_id", F.posexplode("shape").alias("i", "p"), stride.alias("stride")).filter("i % stride = 0").select(F.concat_ws(":", "route_id", "i").alias("k"), "route_id", "p.lon", "p.lat")
    from ..functions.geo import bounds, in_polygon

    z = zones.withColumn("b", bounds(F.get(F.col("rings"), F.lit(0)))).select("zone", "range", "rings", *[F.col(f"b.{x}").alias(x) for x in spatial.BOX])
    hit = spatial.cell_join(p, z).filter(in_polygon(F.col("lon"), F.col("lat"), F.col("rings"))).select("route_id", "range").distinct()
    mm = numbers_in(F.col("range"))
    hit = hit.withColumn("min_mm", F.get(mm, F.lit(0))).withColumn("max_mm", F.coalesce(F.get(mm, F.lit(1)), F.get(mm, F.lit(0))))
    from pyspark.sql import Window

    w = Window.partitionBy("route_id").orderBy(F.coalesce("max_mm", F.lit(0.0)).desc(), "range")
    return hit.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n")


def cached_until(kind: Column) -> Column:
    """Seconds that a result of a kind stays valid."""
    ttl = {"flow": 60, "activity": 300, "route": 600, "typical": 900, "geocoding": 86400}
    return reduce(lambda c, k: F.when(kind == k, ttl[k]).otherwise(c), ttl, F.lit(None).cast("int"))
