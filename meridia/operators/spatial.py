"""Spatial joins by grid cells of several sizes: a box lies in the level whose cells are as wide as the box, so it touches four at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_M, haversine, in_polygon, locate, lon_gap, on_ring, ring_area, segment_metres, sides, square_metres
from ..sources.staging import cut

CELL = 1e-3
BOX = ("west", "south", "east", "north")


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / (F.lit(CELL) * F.pow(F.lit(2.0), level)))


def filed(df: DataFrame) -> DataFrame:
    """One row per cell that a row's box (west, south, east, north) touches; four at most whatever its size."""
    wide = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"), F.lit(CELL))
    level = F.greatest(F.ceil(F.log2(wide / CELL)), F.lit(0)).cast("int")
    df = df.withColumn("level", level)
    xs, ys = (F.sequence(_cell(F.col(a), F.col("level")), _cell(F.col(b), F.col("level"))) for a, b in (("west", "east"), ("south", "north")))
    return df.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


def probed(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """One row per point and level that stands in boxes; levels are a few dozen at most, as the earth has 360 degrees."""
    levels = sorted(r[0] for r in boxes.select("level").distinct().collect())
    p = points.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")))
    return p.withColumn("cx", _cell(F.col("lon"), F.col("level"))).withColumn("cy", _cell(F.col("lat"), F.col("level")))


def cell_join(points: DataFrame, boxes: DataFrame, same: tuple[str, ...] = ()) -> DataFrame:
    """Points with the boxes that may hold them: an equi-join on cells, and on columns that must be the same, and then the box itself."""
    f = filed(boxes)
    return probed(points, f).join(f, ["level", "cx", "cy", *same]).filter(F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))).drop("level", "cx", "cy")


def touched(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """The points in cells that boxes touch, without pairs: all that cell_join would find, and some beside them. Equal rows become one."""
    f = filed(boxes).select("level", "cx", "cy").distinct()
    return probed(points, f).join(f, ["level", "cx", "cy"], "left_semi").select(*points.columns).distinct()


def padded(s: DataFrame, metres: float) -> DataFrame:
    """Segments x1, y1, x2, y2 with boxes widened by a distance; a degree of longitude is as short as at the box's far side."""
    pad = metres * 1.001 / DEGREE_M
    far = F.least(F.greatest(F.abs("y1"), F.abs("y2")) + pad, F.lit(89.9))
    side = F.lit(pad) / F.cos(F.radians(far))
    return s.withColumns({"west": F.least("x1", "x2") - side, "south": F.least("y1", "y2") - pad, "east": F.greatest("x1", "x2") + side, "north": F.greatest("y1", "y2") + pad})


def segments(edges: DataFrame, metres: float) -> DataFrame:
    """edge and its segments, with padded boxes."""
    s = edges.select("edge", F.explode(sides(F.col("shape"))).alias("s")).select("edge", F.col("s.a.lon").alias("x1"), F.col("s.a.lat").alias("y1"), F.col("s.b.lon").alias("x2"), F.col("s.b.lat").alias("y2"))
    return padded(s, metres)


def nearest_edges(points: DataFrame, edges: DataFrame, key: str, metres: float = 25.0, most: int = 1) -> DataFrame:
    """Columns of points with edge, metres, fraction along the edge and position: the `most` nearest edges of each point within `metres`.

    Ties go to the least edge. Distances are rounded to millimetres. A point may meet an edge through several
    segments: the nearest counts. Points without an edge go; a segment without length counts as a point.
    """
    near = cell_join(points.select(key, "lon", "lat"), segments(edges, metres))
    d = F.round(segment_metres(F.col("lon"), F.col("lat"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), 3)
    best = near.select(key, "edge", d.alias("metres")).filter(F.col("metres") <= metres)
    if most == 1:
        best = best.groupBy(key).agg(F.min(F.struct("metres", "edge")).alias("m")).select(key, "m.*")
    else:
        best = best.groupBy(key, "edge").agg(F.min("metres").alias("metres"))
        w = Window.partitionBy(key).orderBy("metres", "edge")
        best = best.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n")
    got = points.join(best, key).join(edges.select("edge", "shape"), "edge")
    at = locate(F.col("lon"), F.col("lat"), F.col("shape"))
    return got.withColumn("at", at).select(*points.columns, "edge", "metres", F.round("at.fraction", 6).alias("fraction"), F.col("at.lon").alias("snap_lon"), F.col("at.lat").alias("snap_lat"))


def inside_fences(points: DataFrame, fences: DataFrame, key: str) -> DataFrame:
    """Pairs of point and fence that holds it, with the fence's area in square metres; the boundary belongs to the fence.

    A fence is a circle (lon, lat, radius in metres) or rings, of which those after the first are holes.
    """
    pad = F.col("radius") * 1.001 / DEGREE_M
    side = pad / F.cos(F.radians(F.least(F.abs("lat") + pad, F.lit(89.9))))
    ring = F.get(F.col("rings"), F.lit(0))
    edge = lambda name, f, of: F.coalesce(of, f(F.transform(ring, lambda p: p[name])))
    f = fences.select(
        "fence", F.col("lon").alias("flon"), F.col("lat").alias("flat"), "radius", "rings",
        edge("lon", F.array_min, F.col("lon") - side).alias("west"), edge("lat", F.array_min, F.col("lat") - pad).alias("south"),
        edge("lon", F.array_max, F.col("lon") + side).alias("east"), edge("lat", F.array_max, F.col("lat") + pad).alias("north"))
    p = cell_join(points.select(key, "lon", "lat"), f)
    inside = in_polygon(F.col("lon"), F.col("lat"), F.col("rings")) | F.exists("rings", lambda r: on_ring(F.col("lon"), F.col("lat"), r))
    hit = F.when(F.col("radius").isNotNull(), haversine(F.col("lon"), F.col("lat"), F.col("flon"), F.col("flat")) <= F.col("radius")).otherwise(inside)
    holes = F.aggregate(F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + F.abs(ring_area(r)))
    area = F.coalesce(F.pi() * F.col("radius") * F.col("radius"), square_metres(F.abs(ring_area(F.get(F.col("rings"), F.lit(0)))) - holes, F.col("flat")))
    return p.filter(hit).select(key, "fence", F.round(area, 0).alias("area"))


def first_area(points: DataFrame, areas: DataFrame, key: str) -> DataFrame:
    """Each point with the first area (least number) whose rings hold it; points outside all go."""
    from ..functions.geo import bounds

    a = areas.withColumn("b", bounds(F.get(F.col("rings"), F.lit(0)))).select("area", "rings", *[F.col(f"b.{x}").alias(x) for x in BOX])
    hit = cell_join(points, a).filter(in_polygon(F.col("lon"), F.col("lat"), F.col("rings")))
    return hit.groupBy(key).agg(F.min("area").alias("area"))


def nearest_points(points: DataFrame, others: DataFrame, key: str, other: str, metres: float, shares: tuple[float, ...] = (1 / 64, 1 / 8, 1)) -> DataFrame:
    """Each point with the nearest of others within `metres`; ties go to the least key.

    Others at one position count as their least. The radius widens by shares, and a point that has found one leaves,
    so that in dense places no point meets all others of the full radius.
    """
    o = others.groupBy(F.col("lon").alias("olon"), F.col("lat").alias("olat")).agg(F.min(other).alias(other)).filter("olon is not null and olat is not null")
    left, found = points.select(key, "lon", "lat"), None
    for share in shares:
        r = metres * share
        pad = r * 1.001 / DEGREE_M
        side = F.lit(pad) / F.cos(F.radians(F.least(F.abs("olat") + pad, F.lit(89.9))))
        boxes = o.withColumns({"west": F.col("olon") - side, "south": F.col("olat") - pad, "east": F.col("olon") + side, "north": F.col("olat") + pad})
        kx = F.cos(F.radians("lat"))
        d = F.round(F.sqrt(F.pow((F.col("olon") - F.col("lon")) * kx, 2) + F.pow(F.col("olat") - F.col("lat"), 2)) * DEGREE_M, 3)
        near = cell_join(left, boxes).withColumn("metres", d).filter(F.col("metres") <= r)
        got = cut(near.groupBy(key).agg(F.min(F.struct("metres", other)).alias("m")).select(key, f"m.{other}", "m.metres"))
        found = got if found is None else found.unionByName(got)
        left = left.join(got.select(key), key, "left_anti")
    return found


def within(df: DataFrame, lon: float, lat: float, metres: float) -> DataFrame:
    """Rows within a distance of one place, with the distance; a box, also across the date line, is tested before it."""
    import math

    pad = metres * 1.001 / DEGREE_M
    side = 360.0 if abs(lat) + pad > 89.9 else pad / math.cos(math.radians(abs(lat) + pad))
    d = df.filter((lon_gap(F.col("lon"), F.lit(lon)) <= side) & F.col("lat").between(lat - pad, lat + pad))
    return d.withColumn("metres", F.round(haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")), 1)).filter(F.col("metres") <= metres)
