"""Queries over drawn shapes and pictures: merged lines, validity of polygons, holes of rasters, colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import merge, stencil, validity
from ..sources.tables import EDGES_SQL, load, point, road_edges
from .sqltext import great_circle

# rings by kind, corners in thousandths of a degree: square, with a hole, bow tie, spike, repeated corner, touching itself, open,
# hole that touches the shell in a point, hole along the shell, hole outside, nested holes, too few corners, hole that crosses
SHAPES = (
    [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]], [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]], [[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]], [[(0, 0), (4, 0), (8, 0), (4, 0), (4, 4), (0, 0)]],
    [[(0, 0), (4, 0), (4, 0), (4, 4), (0, 4), (0, 0)]], [[(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2), (0, 0)]], [[(0, 0), (4, 0), (4, 4), (0, 4)]], [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(0, 2), (2, 1), (2, 3), (0, 2)]],
    [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(0, 1), (2, 1), (2, 3), (0, 3), (0, 1)]], [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(5, 5), (6, 5), (6, 6), (5, 5)]],
    [[(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)], [(1, 1), (7, 1), (7, 7), (1, 7), (1, 1)], [(2, 2), (3, 2), (3, 3), (2, 2)]], [[(0, 0), (4, 0), (0, 0)]], [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(3, 1), (6, 1), (6, 2), (3, 2), (3, 1)]],
)
FAULTS = {2: "self-intersection", 3: "self-intersection", 5: "self-intersection", 6: "not closed", 8: "rings cross", 9: "hole outside shell", 10: "nested holes", 11: "too few points", 12: "rings cross"}


def fences(s, d):
    """A polygon per customer, of thirteen kinds and of a size of its own, in quarters of a thousandth."""
    p = "array<array<struct<x: double, y: double>>>"
    spec = s.createDataFrame([(k, [[(float(x), float(y)) for x, y in r] for r in rings]) for k, rings in enumerate(SHAPES)], f"kind int, corners {p}")
    k = F.col("c_custkey")
    c = load(s, d, "customer").select(k.alias("polygon"), (k % len(SHAPES)).cast("int").alias("kind"), (k % 64).cast("double").alias("x"), (F.expr("c_custkey div 64") % 64).cast("double").alias("y"), (F.lit(1.0) + k % 4).alias("size")).join(F.broadcast(spec), "kind")  # thirteen fixed rows
    # positions are multiples of powers of two, so that corners lie exactly on sides
    return c.select("polygon", F.transform("corners", lambda r: F.transform(r, lambda q: point(F.col("x") + q["x"] * F.col("size") / 1024, F.col("y") + q["y"] * F.col("size") / 1024))).alias("rings"))


def streets(s, d):
    """Edges with the tile of their first corner."""
    first = F.element_at("shape", 1)
    return road_edges(s, d).select(F.col("edge").alias("line"), geo.tile_x(first["lon"], F.lit(13)).alias("x"), geo.tile_y(first["lat"], F.lit(13)).alias("y"), "name", "cls", "flags", "shape")


def plots(s, d):
    """A rectangle per customer, some thirty of a kind, on a grid of 1,024ths of a degree."""
    k = F.col("c_custkey")
    x, y, w, h = (k * 37 % 40), (F.expr("c_custkey div 3") * 53 % 40), (k % 7 + 1), (k % 5 + 1)
    at = lambda a, b: point(a / 1024, b / 1024)
    return load(s, d, "customer").select(k.alias("area"), F.expr("c_custkey div 30").alias("kind"), F.array(F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h), at(x, y))).alias("rings"))


def masks(s, d):
    """Tiles of 8 by 8 cells out of vectors, sixteen side by side: a cell has data where its component is small."""
    bits = F.transform("embedding", lambda x: F.when(x < 0.06, "01").otherwise("00"))
    v = F.col("vec_id")
    return load(s, d, "embeddings").select((v % 16).alias("tx"), F.expr("vec_id div 16").alias("ty"), F.unhex(F.array_join(bits, "")).alias("mask"))


def holes(s, d):
    """Cells of small holes, in the picture's own numbers."""
    h = stencil.small_holes(masks(s, d), 8, 1).select("tx", "ty", F.hex("holes").alias("h"))
    h = h.select("tx", "ty", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"), "h").filter(F.substring(F.col("h"), F.col("i") * 2 + 2, F.lit(1)) == "1")
    return h.select((F.col("tx") * 8 + F.col("i") % 8).alias("x"), (F.col("ty") * 8 + F.floor(F.col("i") / 8)).alias("y"))


def colours(s, d):
    k = F.col("l_orderkey")
    raw = lambda a, m: (F.floor(F.col("l_extendedprice")).cast("long") * a % m).cast("double")
    c = load(s, d, "lineitem").select(k.alias("row"), "l_linenumber", stencil.natural_colour(raw(1, 4001), raw(3, 3001), raw(7, 11)).alias("c"))
    return c.select("row", F.col("l_linenumber").alias("line"), "c.r", "c.g", "c.b", "c.valid")


def queries():
    return {
        "merged_streets": lambda s, d: merge.merged_lines(streets(s, d), ["x", "y", "name", "cls", "flags"]).select("line", "lines", "metres"),
        "fence_validity": lambda s, d: validity.validity(fences(s, d)).fillna("", ["reason"]),
        "merged_areas": lambda s, d: merge.outlines(plots(s, d)).groupBy("kind").agg(F.round(F.sum("area") * 1024 * 1024, 2).alias("cells")),
        "raster_holes": holes,
        "natural_colours": colours,
    }


def oracle_sql():
    length = f"list_sum(list_transform(range(1, len(shape)), lambda i: {great_circle('shape[i].lon', 'shape[i].lat', 'shape[i + 1].lon', 'shape[i + 1].lat')}))"
    tile = "cast(floor((shape[1].lon + 180) / 360 * 8192) as bigint) as x, cast(floor((1 - asinh(tan(radians(shape[1].lat))) / pi()) / 2 * 8192) as bigint) as y"
    why = " ".join(f"when {k} then '{v}'" for k, v in FAULTS.items())
    light = lambda v: f"pow(least(greatest({v} / 10000e0 * 3e0, 0e0), 1e0), 1e0 / 1.7e0)"
    byte = lambda c: f"cast(case when r0 <> 0 or g0 <> 0 or b0 <> 0 then round_even(least(greatest(luma + ({c} - luma) * 1.35e0, 0e0), 1e0) * 255, 0) else 0 end as int)"
    return {
        "merged_areas": "with r as (select c_custkey // 30 as kind, c_custkey * 37 % 40 as x, c_custkey // 3 * 53 % 40 as y, c_custkey % 7 + 1 as w, c_custkey % 5 + 1 as h from customer), c as (select distinct kind, x + i as x, y + j as y from r, lateral (select unnest(range(w)) as i) a, lateral (select unnest(range(h)) as j) b) select kind, round(cast(count(*) as double), 2) as cells from c group by kind",
        "raster_holes": """with p as (select vec_id % 16 * 8 + (i - 1) % 8 as x, vec_id // 16 * 8 + (i - 1) // 8 as y, embedding[i] < 0.06::double as v from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings)),
          n as (select dx, dy from (select unnest([-1, 0, 1]) as dx), (select unnest([-1, 0, 1]) as dy)),
          g as (select p.x, p.y, p.v, bool_or(q.v) as grown from p join n on true join p q on q.x = p.x + dx and q.y = p.y + dy group by all), c as (select g.x, g.y, g.v, bool_and(h.grown) as closed from g join n on true join g h on h.x = g.x + dx and h.y = g.y + dy group by all)
          select x, y from c where closed and not v""",
        "natural_colours": f"""with a as (select l_orderkey as row, l_linenumber as line, cast(cast(floor(l_extendedprice) as bigint) % 4001 as double) as r0, cast(cast(floor(l_extendedprice) as bigint) * 3 % 3001 as double) as g0, cast(cast(floor(l_extendedprice) as bigint) * 7 % 11 as double) as b0 from lineitem),
          b as (select *, {light('r0')} as r1, {light('g0')} as g1, {light('b0')} as b1 from a), c as (select *, 0.2126e0 * r1 + 0.7152e0 * g1 + 0.0722e0 * b1 as luma from b)
          select row, line, {byte('r1')} as r, {byte('g1')} as g, {byte('b1')} as b, r0 <> 0 or g0 <> 0 or b0 <> 0 as valid from c""",
        "merged_streets": f"""with recursive e as ({EDGES_SQL}), l as (select edge as line, u, v, name, cls, flags, {tile}, {length} as metres from e),
          t as (select line, u as node, x, y, name, cls, flags from l union all select line, v, x, y, name, cls, flags from l),
          j as (select node, x, y, name, cls, flags, min(line) as a, max(line) as b from t group by all having count(*) = 2 and min(line) < max(line)), k as (select a, b from j union all select b, a from j),
          r using key (line) as (select line, line as c from l union select k.b, min(r.c) from r join k on k.a = r.line left join recurring.r old on old.line = k.b where r.c < old.c group by k.b)
          select c as line, count(*) as lines, round(sum(metres), 2) as metres from r join l using (line) group by c""",
        "fence_validity": f"select c_custkey as polygon, c_custkey % 13 not in ({', '.join(map(str, FAULTS))}) as valid, case c_custkey % 13 {why} else '' end as reason from customer",
    }
