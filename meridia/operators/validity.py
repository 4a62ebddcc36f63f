"""Whether polygons are valid: rings closed, not crossing themselves or each other, holes inside their shell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_ring, on_ring, sides
from ..sources.staging import apart, cut

REASONS = ("too few points", "not closed", "self-intersection", "rings cross", "hole outside shell", "nested holes")


def cleaned(ring: Column) -> Column:
    """A ring without repeated neighbours, closed; null where fewer than three different corners are left."""
    thin = F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))
    closed = F.when(F.element_at(thin, 1) == F.element_at(thin, -1), thin).otherwise(F.concat(thin, F.slice(thin, 1, 1)))
    return F.when((F.size(ring) > 0) & (F.size(F.array_distinct(ring)) >= 3), closed)


def _cross(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> Column:
    """Sign of the turn from a over b to c."""
    c = F.col
    return F.signum((c(bx) - c(ax)) * (c(cy) - c(ay)) - (c(by) - c(ay)) * (c(cx) - c(ax)))


def _on(px: str, py: str, k: str) -> Column:
    return F.col(px).between(F.least(f"{k}x1", f"{k}x2"), F.greatest(f"{k}x1", f"{k}x2")) & F.col(py).between(F.least(f"{k}y1", f"{k}y2"), F.greatest(f"{k}y1", f"{k}y2"))


def _pairs(rings: DataFrame) -> DataFrame:
    """Pairs of segments of one polygon whose boxes share a cell; the cells of a polygon are as many as its segments."""
    s = rings.select("polygon", "ring", F.size("points").alias("size"), F.posexplode(sides(F.col("points"))).alias("i", "s"))
    s = s.select("polygon", "ring", "i", (F.col("size") - 1).alias("n"), F.col("s.a.lon").alias("x1"), F.col("s.a.lat").alias("y1"), F.col("s.b.lon").alias("x2"), F.col("s.b.lat").alias("y2"))
    box = s.groupBy("polygon").agg(F.min(F.least("x1", "x2")).alias("w"), F.max(F.greatest("x1", "x2")).alias("e"), F.min(F.least("y1", "y2")).alias("so"), F.max(F.greatest("y1", "y2")).alias("no"), F.count("*").alias("m"))
    s = s.join(apart(box), "polygon").withColumn("cell", F.greatest(F.col("e") - F.col("w"), F.col("no") - F.col("so"), F.lit(1e-12)) / F.greatest(F.sqrt("m"), F.lit(1.0)))
    at = lambda v, o: F.floor((v - F.col(o)) / F.col("cell"))
    s = s.withColumns({"fx": at(F.least("x1", "x2"), "w"), "fy": at(F.least("y1", "y2"), "so")})
    s = s.withColumn("cx", F.explode(F.sequence("fx", at(F.greatest("x1", "x2"), "w")))).withColumn("cy", F.explode(F.sequence("fy", at(F.greatest("y1", "y2"), "so"))))
    side = lambda k: s.select("polygon", "cx", "cy", *[F.col(c).alias(f"{k}{c}") for c in ("ring", "i", "n", "x1", "y1", "x2", "y2", "fx", "fy")])
    pairs = side("a").join(apart(side("b")), ["polygon", "cx", "cy"]).filter("aring < bring or aring = bring and ai < bi")
    # a pair counts in the first cell that both touch
    return pairs.filter((F.col("cx") == F.greatest("afx", "bfx")) & (F.col("cy") == F.greatest("afy", "bfy"))).drop("cx", "cy", "afx", "afy", "bfx", "bfy")


def validity(polygons: DataFrame) -> DataFrame:
    """polygon, valid and reason (null for a valid one) of each polygon (polygon, rings); the first reason in the order of REASONS.

    A ring needs four positions, the last equal to the first; repeated neighbours count once. Segments of a ring may
    meet only in the corner that they share in a row: a touch elsewhere, a crossing or a spike is a self-intersection.
    Different rings may touch in points, but not cross or run along each other. Every hole must lie in the first ring
    and in no other hole. Holes that only together cut the inside in two are not looked for. Null and empty polygons
    have too few points.
    """
    p = polygons.select("polygon", F.coalesce("rings", F.array().cast("array<array<struct<lon: double, lat: double>>>")).alias("rings"))
    thin = lambda r: F.filter(r, lambda q, i: (i == 0) | (q != F.get(r, i - 1)))
    p = cut(p.withColumn("rings", F.transform("rings", thin)))
    few = (F.size("rings") == 0) | F.exists("rings", lambda r: F.size(r) < 4)
    loose = F.exists("rings", lambda r: F.element_at(r, 1) != F.element_at(r, -1))
    p = p.withColumn("code", F.when(F.size("rings") == 0, 0).when(F.exists("rings", lambda r: F.size(r) == 0), 0).when(loose, 1).when(few, 0))
    base, sound = p.select("polygon", "code"), p.filter("code is null").drop("code")
    rings = sound.select("polygon", F.posexplode("rings").alias("ring", "points"))
    s = _pairs(rings)
    o = [_cross("ax1", "ay1", "ax2", "ay2", "bx1", "by1"), _cross("ax1", "ay1", "ax2", "ay2", "bx2", "by2"), _cross("bx1", "by1", "bx2", "by2", "ax1", "ay1"), _cross("bx1", "by1", "bx2", "by2", "ax2", "ay2")]
    s = s.withColumns({f"o{i}": x for i, x in enumerate(o)})
    proper = (F.col("o0") * F.col("o1") < 0) & (F.col("o2") * F.col("o3") < 0)
    touch = (F.col("o0") == 0) & _on("bx1", "by1", "a") | (F.col("o1") == 0) & _on("bx2", "by2", "a") | (F.col("o2") == 0) & _on("ax1", "ay1", "b") | (F.col("o3") == 0) & _on("ax2", "ay2", "b")
    same = F.col("aring") == F.col("bring")
    along = (F.col("o0") == 0) & (F.col("o1") == 0) & (F.col("o2") == 0) & (F.col("o3") == 0)
    follows = same & ((F.col("bi") == F.col("ai") + 1) | (F.col("ai") == 0) & (F.col("bi") == F.col("an") - 1))
    # neighbours share a corner; they are a spike where they lie on one line and turn back
    back = along & (((F.col("ax2") - F.col("ax1")) * (F.col("bx2") - F.col("bx1")) + (F.col("ay2") - F.col("ay1")) * (F.col("by2") - F.col("by1"))) < 0)
    over = along & (F.least(F.greatest("ax1", "ax2"), F.greatest("bx1", "bx2")) - F.greatest(F.least("ax1", "ax2"), F.least("bx1", "bx2")) + F.least(F.greatest("ay1", "ay2"), F.greatest("by1", "by2")) - F.greatest(F.least("ay1", "ay2"), F.least("by1", "by2")) > 0) & touch
    code = F.when(same & F.when(follows, back).otherwise(proper | touch), 2).when(~same & (proper | over), 3)
    bad = s.select("polygon", code.alias("code")).filter("code is not null")
    # holes: the corners of one ring against another; where rings do not cross, corners off the boundary agree
    shell = F.get(F.col("rings"), F.lit(0))
    holes = sound.filter(F.size("rings") > 1).select("polygon", shell.alias("shell"), F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(1))).alias("holes"))
    outside = lambda q, r: ~in_ring(q["lon"], q["lat"], r) & ~on_ring(q["lon"], q["lat"], r)
    inside = lambda q, r: in_ring(q["lon"], q["lat"], r) & ~on_ring(q["lon"], q["lat"], r)
    out = holes.filter(F.exists("holes", lambda h: F.exists(h, lambda q: outside(q, F.col("shell"))))).select("polygon", F.lit(4).alias("code"))
    each = holes.select("polygon", F.posexplode("holes").alias("i", "h"))
    deep = each.alias("a").join(apart(each.alias("b")), "polygon").filter("a.i <> b.i").filter(F.exists("a.h", lambda q: inside(q, F.col("b.h")))).select("polygon", F.lit(5).alias("code"))
    worst = base.filter("code is not null").unionByName(bad).unionByName(out).unionByName(deep).groupBy("polygon").agg(F.min("code").alias("code"))
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), F.col("code") + 1)
    return polygons.select("polygon").join(apart(worst), "polygon", "left").select("polygon", F.col("code").isNull().alias("valid"), F.when(F.col("code").isNotNull(), reason).alias("reason"))
