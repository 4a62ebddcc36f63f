"""Positions along a shape: finding, cutting and joining. A position is a vertex number plus the part of the segment behind it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import DEGREE_M, haversine, line_length, sides


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def point_at(shape: Column, pos: Column) -> Column:
    """The point at a position; the last one beyond the end."""

    def at(g: Column) -> Column:
        a, b, f = F.get(shape, g["v"]), F.get(shape, g["v"] + 1), g["f"]
        between_ = F.struct((a["lon"] + (b["lon"] - a["lon"]) * f).alias("lon"), (a["lat"] + (b["lat"] - a["lat"]) * f).alias("lat"))
        return F.when((f == 0) | (g["v"] >= F.size(shape) - 1), F.get(shape, F.least(g["v"], F.size(shape) - 1))).otherwise(between_)

    return let(pos, lambda p: let(F.struct(F.floor(p).cast("int").alias("v"), (p - F.floor(p)).alias("f")), at))


def position(shape: Column, lon: Column, lat: Column, after: Column) -> Column:
    """Position of a shape nearest to a point, at or behind `after`, in the plane at the point; the first of ties.

    On the segment of `after` only what lies behind it counts, so that a shape can be followed forwards.
    """

    def place(s: Column, i: Column, o: Column) -> Column:
        x, y = (lambda p: (p["lon"] - lon) * F.cos(F.radians(lat))), (lambda p: p["lat"] - lat)
        side = F.struct(x(s["a"]).alias("ax"), y(s["a"]).alias("ay"), (x(s["b"]) - x(s["a"])).alias("dx"), (y(s["b"]) - y(s["a"])).alias("dy"))
        least = F.when(i == F.floor(o), o - F.floor(o)).otherwise(0.0)
        part = lambda g: F.greatest(F.least(F.coalesce(-(g["ax"] * g["dx"] + g["ay"] * g["dy"]) / F.nullif(g["dx"] * g["dx"] + g["dy"] * g["dy"], F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), least)
        away = lambda g, t: F.pow(g["ax"] + t * g["dx"], 2) + F.pow(g["ay"] + t * g["dy"], 2)
        return let(side, lambda g: let(part(g), lambda t: F.struct(away(g, t).alias("d"), i.alias("i"), t.alias("t"))))

    def nearest(o: Column) -> Column:
        ahead = F.filter(F.transform(sides(shape), lambda s, i: F.when(i >= F.floor(o), place(s, i, o))), lambda p: p.isNotNull())
        found = let(F.array_min(ahead), lambda m: m["i"] + m["t"])
        return F.when((F.size(shape) == 1) | (o >= F.size(shape) - 1), o).otherwise(found)

    return let(after, nearest)


def metres_at(shape: Column, pos: Column, lon: Column, lat: Column) -> Column:
    """Distance of a point to the point at a position."""
    return let(point_at(shape, pos), lambda p: haversine(p["lon"], p["lat"], lon, lat))


def between(shape: Column, start: Column, end: Column) -> Column:
    """The part of a shape from one position to a later one, both included."""
    none = F.array().cast("array<struct<lon: double, lat: double>>")

    def part(g: Column) -> Column:
        v, w = F.floor(g["a"]).cast("int"), F.ceil(g["b"]).cast("int")  # vertices v + 1 to w - 1 lie inside
        inner = F.slice(shape, v + 2, F.greatest(w - v - 1, F.lit(0)))
        return F.concat(F.array(point_at(shape, g["a"])), inner, F.when(g["a"] != g["b"], F.array(point_at(shape, g["b"]))).otherwise(none))

    return let(F.struct(start.alias("a"), end.alias("b")), part)


def _rounded(p: Column) -> Column:
    six = lambda v: F.round(v.cast("decimal(18,9)"), 6).cast("double")
    return F.struct(six(p["lon"]).alias("lon"), six(p["lat"]).alias("lat"))


def cut_by_share(shape: Column, start: Column, end: Column) -> Column:
    """The part of a shape between two shares of its length, in the order of travel: turned round where end is before start.

    Lengths are those of the plane at each segment's first corner; corners are rounded to six digits.
    """

    def grown(acc: Column, s: Column) -> Column:
        kx = F.cos(F.radians(s["a"]["lat"])) * DEGREE_M
        long_ = F.sqrt(F.pow((s["b"]["lon"] - s["a"]["lon"]) * kx, 2) + F.pow((s["b"]["lat"] - s["a"]["lat"]) * DEGREE_M, 2))
        return F.concat(acc, F.array(F.element_at(acc, -1) + long_))

    def at(want: Column, lengths: Column) -> Column:
        i = F.array_min(F.filter(F.transform(lengths, lambda x, k: F.when((k > 0) & (x >= want), k)), lambda k: k.isNotNull()))
        span = lambda k: F.coalesce(F.nullif(F.get(lengths, k) - F.get(lengths, k - 1), F.lit(0.0)), F.lit(1.0))
        return let(i, lambda k: F.coalesce(point_at(shape, k - 1 + F.least((want - F.get(lengths, k - 1)) / span(k), F.lit(1.0))), F.element_at(shape, -1)))

    def part(g: Column) -> Column:
        n, whole = g["lengths"], F.coalesce(F.nullif(F.element_at(g["lengths"], -1), F.lit(0.0)), F.lit(1.0))
        inner = F.filter(shape, lambda p, k: (k > 0) & (k < F.size(shape) - 1) & (F.get(n, k) / whole > g["low"]) & (F.get(n, k) / whole < g["high"]))
        return F.transform(F.concat(F.array(let(g["low"] * whole, lambda x: at(x, n))), inner, F.array(let(g["high"] * whole, lambda x: at(x, n)))), _rounded)

    bound = F.struct(F.aggregate(sides(shape), F.array(F.lit(0.0)), grown).alias("lengths"), F.least(start, end).alias("low"), F.greatest(start, end).alias("high"))
    return let(let(bound, part), lambda got: F.when(start > end, F.reverse(got)).otherwise(got))


def joined(shapes: Column) -> Column:
    """Shapes one after another as one; a corner that repeats the one before it counts once."""
    return let(F.flatten(shapes), lambda flat: F.filter(flat, lambda p, i: (i == 0) | (p != F.get(flat, i - 1))))


def length(shape: Column) -> Column:
    """line_length of a shape that is an expression of its own."""
    return let(shape, line_length)


def share(shape: Column, start: Column, end: Column) -> Column:
    """Length between two positions as a share of the whole, 1 at most; 0 for a shape without length."""
    return let(shape, lambda s: F.coalesce(F.least(length(between(s, start, end)) / F.nullif(line_length(s), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))
