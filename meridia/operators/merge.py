"""Lines of one kind that meet end to end become one line; polygons that touch or overlap become one outline."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import bounds, in_polygon, line_length, ring_area, sides
from ..functions.linear import joined
from ..sources.staging import apart, cut, forgotten
from . import spatial
from .graph import stars


def _key(p: Column) -> Column:
    """A corner as micro-degrees."""
    whole = lambda c: F.round(c * 1e6).cast("long")
    return F.concat_ws(":", whole(p["lon"]), whole(p["lat"]))


def ranked(halves: DataFrame) -> DataFrame:
    """h, last, left: of each element of chains (h, next), the element at its chain's end and the steps to it.

    Pointers double their reach each round, so rounds grow with the log of the longest chain. Chains must have ends.
    """
    at = cut(halves.select("h", F.coalesce("next", "h").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("left")))
    while True:
        far = at.select(F.col("h").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
        new = cut(at.join(far, "to").select("h", F.col("to2").alias("to"), (F.col("left") + F.col("left2")).alias("left"), (F.col("to") != F.col("to2")).alias("moved")))
        forgotten(at)
        at = new
        if at.filter("moved").isEmpty():
            return at.select("h", F.col("to").alias("last"), "left")


def chained(lines: DataFrame, kind: list[str]) -> DataFrame:
    """line, chain, pos, back: the chain that each line belongs to, named by its least line, its place in it and whether it is turned round.

    Lines of one kind (columns of lines; null is a kind) are chained where exactly two ends of that kind meet. A chain
    runs the way its least line is drawn. A chain without ends is a loop and begins with its least line. line is unique.
    """
    tips = lines.select("line", F.to_json(F.struct(*kind)).alias("kind") if kind else F.lit("").alias("kind"), F.element_at("shape", 1).alias("a"), F.element_at("shape", -1).alias("b"))
    tips = cut(tips.select("line", F.explode(F.array(F.struct(F.lit(0).alias("end"), _key(F.col("a")).alias("key")), F.struct(F.lit(1).alias("end"), _key(F.col("b")).alias("key")))).alias("t"), "kind").select("line", "t.end", F.concat_ws("|", "kind", "t.key").alias("key")))
    two = tips.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("line", "end")).alias("x"), F.max(F.struct("line", "end")).alias("y")).filter("n = 2").select("x", "y")
    two = cut(two.select(F.col("x.line").alias("u"), F.col("x.end").alias("ue"), F.col("y.line").alias("v"), F.col("y.end").alias("ve")))
    one = lines.select("line")
    comp = cut(one.join(stars(two.select("u", "v")).select(F.col("node").alias("line"), "root"), "line", "left").select("line", F.coalesce("root", "line").alias("chain")))
    # a chain of n lines with n joints is a loop: the joint at the start of its least line is opened
    joints = two.join(comp.withColumnRenamed("line", "u"), "u").groupBy("chain").agg(F.count("*").alias("joints"))
    loops = comp.groupBy("chain").agg(F.count("*").alias("n")).join(joints, "chain").filter("n = joints").select(F.col("chain").alias("least"))
    open_ = two.join(loops, (F.col("least") == F.col("u")) & (F.col("ue") == 0) | (F.col("least") == F.col("v")) & (F.col("ve") == 0), "left_anti")
    # along a line drawn forwards (2 line) one leaves by end 1, backwards (2 line + 1) by end 0; one enters forwards by end 0
    leave = lambda n, e: F.col(n) * 2 + F.when(F.col(e) == 1, 0).otherwise(1)
    enter = lambda n, e: F.col(n) * 2 + F.when(F.col(e) == 0, 0).otherwise(1)
    nexts = open_.select(leave("u", "ue").alias("h"), enter("v", "ve").alias("next")).unionByName(open_.select(leave("v", "ve").alias("h"), enter("u", "ue").alias("next")))
    halves = one.select(F.explode(F.array(F.col("line") * 2, F.col("line") * 2 + 1)).alias("h")).join(nexts, "h", "left")
    r = cut(ranked(halves).withColumn("line", F.expr("h div 2")).join(comp, "line"))
    way = r.filter(F.col("h") == F.col("chain") * 2).select("chain", "last")
    first = r.groupBy("last").agg(F.max("left").alias("most"))
    return r.join(way, ["chain", "last"]).join(first, "last").withColumn("pos", F.col("most") - F.col("left")).select("line", "chain", "pos", (F.col("h") % 2 == 1).alias("back"))


def merged_lines(lines: DataFrame, kind: list[str]) -> DataFrame:
    """line (the least of those merged), kind, lines (their number), metres and shape; see chained(). Length is kept."""
    c = lines.join(chained(lines, kind), "line").withColumn("s", F.when(F.col("back"), F.reverse("shape")).otherwise(F.col("shape")))
    got = c.groupBy("chain").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("pos", "s")))["s"].alias("s"))  # one chain's lines
    got = got.select(F.col("chain").alias("line"), "lines", joined(F.col("s")).alias("shape"))
    return got.join(lines.select("line", *kind), "line").select("line", *kind, "lines", F.round(line_length(F.col("shape")), 2).alias("metres"), "shape")


SNAP = 7  # digits that corners of outlines are rounded to
ASIDE = 2e-7  # degrees beside a side at which its other side is looked at


def _directed(areas: DataFrame) -> DataFrame:
    """area, kind, side and its ends x1, y1, x2, y2, the inside to the left: shells run counter-clockwise, holes clockwise."""
    ring = areas.select("area", "kind", F.posexplode("rings").alias("r", "ring"))
    snap = lambda v: F.round(v.cast("decimal(20,10)"), SNAP).cast("double")
    ring = ring.withColumn("ring", F.transform("ring", lambda p: F.struct(snap(p["lon"]).alias("lon"), snap(p["lat"]).alias("lat"))))
    right = (ring_area(F.col("ring")) > 0) == (F.col("r") == 0)
    ring = ring.withColumn("ring", F.when(right, F.col("ring")).otherwise(F.reverse("ring")))
    s = ring.select("area", "kind", F.explode(sides(F.col("ring"))).alias("s")).select("area", "kind", F.col("s.a.lon").alias("x1"), F.col("s.a.lat").alias("y1"), F.col("s.b.lon").alias("x2"), F.col("s.b.lat").alias("y2"))
    return s.filter("x1 <> x2 or y1 <> y2").withColumn("side", F.monotonically_increasing_id())


def _celled(s: DataFrame, degrees: float) -> DataFrame:
    """A row per cell that a side's box touches."""
    at = lambda a, b: F.sequence(F.floor(F.least(a, b) / degrees), F.floor(F.greatest(a, b) / degrees))
    low = lambda a, b: F.floor(F.least(a, b) / degrees)
    return s.withColumns({"fx": low("x1", "x2"), "fy": low("y1", "y2")}).withColumn("cx", F.explode(at("x1", "x2"))).withColumn("cy", F.explode(at("y1", "y2")))


def _cuts(s: DataFrame, degrees: float) -> DataFrame:
    """side, t: where sides of other areas of the kind cross, touch or run along a side, as a part of its length."""
    c = _celled(s, degrees)
    a = c.select("kind", "cx", "cy", "side", "area", "x1", "y1", "x2", "y2", "fx", "fy")
    b = c.select("kind", "cx", "cy", *[F.col(n).alias(f"o{n}") for n in ("side", "area", "x1", "y1", "x2", "y2", "fx", "fy")])
    # a pair counts in the first cell that both touch
    p = a.join(apart(b), ["kind", "cx", "cy"]).filter("area <> oarea and cx = greatest(fx, ofx) and cy = greatest(fy, ofy)")
    v = F.col
    dx, dy, ex, ey = v("x2") - v("x1"), v("y2") - v("y1"), v("ox2") - v("ox1"), v("oy2") - v("oy1")
    cross = dx * ey - dy * ex
    t, u = ((v("ox1") - v("x1")) * ey - (v("oy1") - v("y1")) * ex) / F.nullif(cross, F.lit(0.0)), ((v("ox1") - v("x1")) * dy - (v("oy1") - v("y1")) * dx) / F.nullif(cross, F.lit(0.0))
    on_line = (cross == 0) & (((v("ox1") - v("x1")) * dy - (v("oy1") - v("y1")) * dx) == 0)
    along = lambda x, y: ((v(x) - v("x1")) * dx + (v(y) - v("y1")) * dy) / (dx * dx + dy * dy)
    ts = F.when(on_line, F.array(along("ox1", "oy1"), along("ox2", "oy2"))).when(u.between(-1e-12, 1 + 1e-12), F.array(t))
    return p.select("side", F.explode(ts).alias("t")).filter("t > 1e-12 and t < 1 - 1e-12")


def outlines(areas: DataFrame, degrees: float = 0.01) -> DataFrame:
    """kind, ring, area, corners, shape: the outline of all areas (area, kind, rings) of a kind together.

    Sides are cut where others of the kind meet them. A piece stays where no other area lies on its outer side; of
    equal pieces one stays, so shared sides cancel. Pieces are strung to rings, at a corner with several the one
    farthest to the left, so that areas which touch in a corner keep rings of their own. Rings of positive area (square
    degrees) are shells, of negative area holes. Corners are rounded to seven digits; a gap narrower than ASIDE
    closes. Sides are compared within cells of `degrees`, never all with all.
    """
    s = cut(_directed(areas))
    parts = s.join(_cuts(s, degrees).groupBy("side").agg(F.array_sort(F.array_distinct(F.collect_list("t"))).alias("ts")), "side", "left")  # what meets one side
    t = F.concat(F.array(F.lit(0.0)), F.coalesce("ts", F.array().cast("array<double>")), F.array(F.lit(1.0)))
    snap = lambda v: F.round(v.cast("decimal(20,10)"), SNAP).cast("double")
    at = lambda k, f: F.when(f == 0, F.col(f"{k}1")).when(f == 1, F.col(f"{k}2")).otherwise(snap(F.col(f"{k}1") + (F.col(f"{k}2") - F.col(f"{k}1")) * f))
    pts = F.transform(t, lambda f: F.struct(at("x", f).alias("lon"), at("y", f).alias("lat")))
    e = parts.select("kind", "area", F.explode(sides(pts)).alias("s")).select("kind", "area", F.col("s.a.lon").alias("x1"), F.col("s.a.lat").alias("y1"), F.col("s.b.lon").alias("x2"), F.col("s.b.lat").alias("y2")).filter("x1 <> x2 or y1 <> y2")
    e = cut(e.withColumn("piece", F.monotonically_increasing_id()))
    long_ = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    beside = e.select("piece", "kind", F.col("area").alias("own"), ((F.col("x1") + F.col("x2")) / 2 + (F.col("y2") - F.col("y1")) / long_ * ASIDE).alias("lon"), ((F.col("y1") + F.col("y2")) / 2 - (F.col("x2") - F.col("x1")) / long_ * ASIDE).alias("lat"))
    boxes = areas.withColumn("b", bounds(F.get(F.col("rings"), F.lit(0)))).select("area", "kind", "rings", *[F.col(f"b.{x}").alias(x) for x in spatial.BOX])
    covered = spatial.cell_join(beside, apart(boxes), ("kind",)).filter("area <> own").filter(in_polygon(F.col("lon"), F.col("lat"), F.col("rings"))).select("piece").distinct()
    left = e.join(covered, "piece", "left_anti").groupBy("kind", "x1", "y1", "x2", "y2").agg(F.min("piece").alias("piece"))
    left = cut(left.withColumn("b", F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))))
    nxt = left.select("kind", F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("piece").alias("next"), F.col("b").alias("nb"))
    turned = F.pmod(F.col("nb") - F.col("b") + math.pi, F.lit(2 * math.pi))  # the way back is 0, straight on is pi, to the left is more
    j = cut(left.join(nxt, ["kind", "x2", "y2"]).groupBy("piece").agg(F.max_by("next", F.struct(turned, -F.col("next"))).alias("next")))
    ring = cut(left.select(F.col("piece").alias("node")).join(stars(j.select(F.col("piece").alias("u"), F.col("next").alias("v"))), "node", "left").select(F.col("node").alias("piece"), F.coalesce("root", "node").alias("ring")))
    # a ring begins with its least piece: the pointer to that one is cut
    chain = j.join(ring, "piece").select(F.col("piece").alias("h"), F.when(F.col("next") != F.col("ring"), F.col("next")).alias("next"))
    rank = ranked(left.select(F.col("piece").alias("h")).join(chain, "h", "left"))
    got = rank.withColumnRenamed("h", "piece").join(ring, "piece").join(left, "piece").groupBy("kind", "ring").agg(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("o"), F.struct(F.col("x1").alias("lon"), F.col("y1").alias("lat")).alias("p"))))["p"].alias("p"))  # one ring
    shape = F.concat("p", F.slice("p", 1, 1))
    return got.select("kind", "ring", shape.alias("shape")).select("kind", "ring", ring_area(F.col("shape")).alias("area"), (F.size("shape") - 1).alias("corners"), "shape")
