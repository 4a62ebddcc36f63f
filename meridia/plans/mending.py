"""Queries that mend a road network: dead ends, bridges and loose ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import line_length
from ..operators import graph, repair
from ..sources.tables import EDGES_SQL, NODES_SQL, load, point, road_edges, road_nodes
from .sqltext import great_circle, to_segment

# streets of a town as they were drawn: k, source, class and corners in thousandths of a degree from the town's own corner
DRAWN = (
    [(y, 0 if y else 1, 5 if y else 2, [(x, y) for x in range(20)]) for y in range(10)] + [(10 + x, 0, 5, [(x, y) for y in range(10)]) for x in range(10)] + [
        (20, 0, 5, [(5.5, 3.5), (5.5, 3.018)]), (21, 0, 5, [(7.4, 0.6), (7.4, 0.072)]), (22, 0, 8, [(8.4, 0.6), (8.4, 0.072)]), (23, 1, 2, [(12.5, 5.8), (12.5, 5.36)]), (24, 1, 1, [(0, 13), (3, 13), (6, 13)]),
        (25, 1, 1, [(8, 13), (10, 14)]), (26, 1, 1, [(20, 5), (21.5, 5)]), (27, 2, 11, [(3.5, 7.5), (3.5, 7.01)]), (28, 0, 5, [(15.5, 0.1), (15.5, 1)]), (29, 0, 6, [(15.5, 0.1), (16.5, 0.1)]),
    ])


def drawn(s, d):
    """The drawn streets of every town: line, source, cls, ref, shape."""
    p = "array<struct<x: double, y: double>>"
    spec = s.createDataFrame([(k, source, cls, [(float(x), float(y)) for x, y in c]) for k, source, cls, c in DRAWN], f"k int, source int, cls int, corners {p}")
    n = road_nodes(s, d).withColumn("k", (F.col("node") % 200).cast("int")).join(F.broadcast(spec), "k")  # fixed rows
    west, south = F.lit(-79.95) + (F.col("town") % 200) * F.lit(2.7e-2), F.lit(-2.2) + F.expr("town div 200") * F.lit(2e-2)
    return n.select((F.col("town") * 40 + F.col("k")).alias("line"), "source", "cls", F.when(F.col("source") == 1, F.concat(F.lit("E"), F.col("town"))).alias("ref"), F.transform("corners", lambda c: point(west + c["x"] * F.lit(1e-3), south + c["y"] * F.lit(1e-3))).alias("shape"))


def boxes(s, d, wanted, west, south, east, north):
    """A rectangle per town that a condition picks, as an area."""
    x = lambda v: F.col("lon") + F.lit(v)
    y = lambda v: F.col("lat") + F.lit(v)
    ring = F.array(*[point(x(a), y(b)) for a, b in ((west, south), (east, south), (east, north), (west, north), (west, south))])
    return road_nodes(s, d).filter(f"node % 200 = 0 and {wanted}").select(F.col("town").alias("area"), F.array(ring).alias("rings"))


def land(s, d):
    return boxes(s, d, "true", -0.0041, -0.0041, 0.0241, 0.0131)


def lakes(s, d):
    """Lakes beside every ninth town."""
    return boxes(s, d, "town % 9 = 5", 0.0205, -0.0101, 0.0225, 0.0201)


def loose(s, d):
    """Road ends in the west of each town, with the number of the road of the town before."""
    return road_nodes(s, d).filter("node % 200 in (80, 82) and town > 0").select("node", F.concat(F.lit("E"), "town").alias("ref"))


def mended(s, d):
    """Junctions and parts of the drawn network when dead ends and street ends beside state roads are joined."""
    lines = drawn(s, d)
    places = repair.joins(lines).select("line", "i", "target", "segment", "t", "plon", "plat").unionByName(repair.ladder(lines).select("line", "i", "target", "segment", "t", "plon", "plat"))
    return graph.noded(repair.rejoined(lines, places))


def queries():
    return {
        "dead_end_joins": lambda s, d: repair.joins(drawn(s, d)).select("line", "i", "rule", "metres", F.coalesce("target", F.lit(-1)).alias("target")),
        "street_ladder": lambda s, d: repair.ladder(drawn(s, d)).select("line", "metres", "target", "segment"),
        "network_rejoined": lambda s, d: mended(s, d).select("line", "part", F.round(line_length(F.col("shape")), 2).alias("metres")),
        "component_bridges": lambda s, d: repair.bridges(road_nodes(s, d), road_edges(s, d), land(s, d), lakes(s, d)),
        "loose_end_links": lambda s, d: repair.loose_links(road_nodes(s, d), road_edges(s, d), loose(s, d), land(s, d), lakes(s, d)),
    }


def oracle_sql():
    spec = ", ".join(f"({k}, {source}, {cls}, {i}, {len(c) - 1}, {float(x)}, {float(y)})" for k, source, cls, c in DRAWN for i, (x, y) in enumerate(c))
    v = f"""v as (select p_partkey // 200 * 40 + k as line, p_partkey // 200 as town, source, cls, i, last, -79.95e0 + p_partkey // 200 % 200 * 2.7e-2 + x * 1e-3 as lon, -2.2e0 + p_partkey // 200 // 200 * 2e-2 + y * 1e-3 as lat
      from part join (values {spec}) t(k, source, cls, i, last, x, y) on p_partkey % 200 = k),
      w as (select *, cast(round(lon * 1e6) as bigint) || ':' || cast(round(lat * 1e6) as bigint) as key, i = 0 or i = last as tip from v),
      g as (select line as target, i as segment, town, source, cls, lon as x1, lat as y1, lead(lon) over q as x2, lead(lat) over q as y2, i < last as inner_ from w window q as (partition by line order by i) qualify inner_)"""
    away = f"round({to_segment('w.lon', 'w.lat', 'x1', 'y1', 'x2', 'y2')}, 3)"
    flat = "round(sqrt(pow((o.lon - a.lon) * cos(radians(a.lat)), 2) + pow(o.lat - a.lat, 2)) * 111195.08e0, 3)"
    far = f"round({great_circle('a.lon', 'a.lat', 'o.lon', 'o.lat')}, 3)"
    length = f"list_sum(list_transform(range(1, len(shape)), lambda i: {great_circle('shape[i].lon', 'shape[i].lat', 'shape[i + 1].lon', 'shape[i + 1].lat')}))"
    net = f"""e as ({EDGES_SQL}), n as ({NODES_SQL}), k as (select * from e where cls <= 7 or cls = 11), b as (select u, v, greatest(cast(round({length} * 1000) as bigint), 1) as mm from k union all select v, u, greatest(cast(round({length} * 1000) as bigint), 1) from k),
      r using key (node) as (select u as node, min(u) as c from b group by u union select b.v, min(r.c) from r join b on r.node = b.u left join recurring.r old on old.node = b.v where r.c < old.c group by b.v),
      p as (select r.node, c, lon, lat from r join n using (node)), z as (select c, count(*) as size from r group by c), m1 as (select c from z order by size desc, c limit 1)"""

    def legal(of: str) -> str:
        # of: rows with x1, y1, x2, y2, m
        spot = "x1 + (x2 - x1) * (j / cast(greatest(floor(m / 200), 1) as double)) as px, y1 + (y2 - y1) * (j / cast(greatest(floor(m / 200), 1) as double)) as py"
        inside = lambda w, s, e, n: f"px > lon + {w} and px < lon + {e} and py > lat + {s} and py < lat + {n}"
        return f"""select * from {of} t where not exists (select 1 from (select {spot} from (select unnest(range(1, cast(greatest(floor(t.m / 200), 1) as bigint))) as j)) where
          not exists (select 1 from n where node % 200 = 0 and {inside(-0.0041, -0.0041, 0.0241, 0.0131)}) or exists (select 1 from n where node % 200 = 0 and town % 9 = 5 and {inside(0.0205, -0.0101, 0.0225, 0.0201)}))"""

    pairs = lambda main, towns: f"select a.c, a.node as u, o.node as v, a.lon as x1, a.lat as y1, o.lon as x2, o.lat as y2, {flat} as m, {far} as metres from p a join p o on o.c in (select c from {main}) and a.c in (select c from {towns}) and abs(a.lon - o.lon) < 0.055 and abs(a.lat - o.lat) < 0.055 where {flat} <= 6000 qualify row_number() over (partition by a.c order by {flat}, a.node, o.node) = 1"
    return {
        "dead_end_joins": f"""with {v}, ends as (select key, count(*) as n from w where tip group by key), inner_keys as (select key from w group by key having bool_or(not tip) and (bool_or(tip) or count(distinct case when not tip then line end) > 1)),
          dead as (select w.* from w join ends using (key) where tip and n = 1 and not exists (select 1 from inner_keys x where x.key = w.key)),
          h as (select w.line, w.i, case when w.source <> 1 and {away} <= 3 then 1 when w.source <> 1 and w.cls <= 7 and g.source = 1 and {away} <= 12 then 2 when w.source = 1 and g.cls <= 7 and {away} <= 60 then 3 when w.source = 1 and g.source = 1 and {away} <= 300 then 4 end as rule, {away} as metres, target, segment
            from dead w join g on g.town = w.town and g.source <> 2 and g.target <> w.line),
          f as (select * from h where rule is not null qualify row_number() over (partition by line, i order by rule, metres, target, segment) = 1),
          tips as (select distinct lon, lat, town from w where tip and source = 0 and cls <= 7),
          j as (select a.line, a.i, 5 as rule, {flat} as metres, -1 as target from dead a join tips o on o.town = a.town where a.source = 1 and {flat} <= 150 and not exists (select 1 from f where f.line = a.line and f.i = a.i) qualify row_number() over (partition by a.line, a.i order by {flat}) = 1)
          select line, i, rule, metres, target from f union all select line, i, rule, metres, target from j""",
        "street_ladder": f"""with {v}, one as (select * from w where tip and source = 0 and cls <= 7 qualify row_number() over (partition by key order by line, i) = 1)
          select line, metres, target, segment from (select w.line, w.i, {away} as metres, target, segment from one w join g on g.town = w.town and g.source = 1 where {away} <= 15 qualify row_number() over (partition by w.line, w.i order by {away}, target, segment) = 1) where metres > 0.05""",
        "component_bridges": f"""with recursive {net}, t1 as (select c from z where size >= 25 and c not in (select c from m1)), b1 as ({pairs('m1', 't1')}), l1 as ({legal('b1')}),
          m2 as (select c from m1 union all select c from l1), t2 as (select c from t1 where c not in (select c from l1)), b2 as ({pairs('m2', 't2')}), l2 as ({legal('b2')})
          select u, v, metres, 1 as attempt from l1 union all select u, v, metres, 2 from l2 where exists (select 1 from l1)""",
        "loose_end_links": f"""with recursive {net}, q as (select p.* from p join m1 using (c)), ends as (select node, lon, lat, 'E' || town as ref from n where node % 200 in (80, 82) and town > 0), named as (select distinct ref, u as node from e where ref is not null union select distinct ref, v from e where ref is not null),
          c1 as (select a.node, 1 as kind, o.node as other, {far} as m, a.lon as x1, a.lat as y1, o.lon as x2, o.lat as y2 from ends a join q o on o.node <> a.node and abs(a.lon - o.lon) < 0.055 and abs(a.lat - o.lat) < 0.055 where {far} <= 1000
            union all select a.node, 2, o.node, {far}, a.lon, a.lat, o.lon, o.lat from ends a join named d on d.ref = a.ref join q o on o.node = d.node and o.node <> a.node where {far} <= 6000),
          lim as (select node as s, cast(max(3 * m + 1000) * 1000 as bigint) as most from c1 group by node),
          reach using key (s, node) as (select s, s as node, cast(0 as bigint) as mm from lim union select t.s, b.v, min(t.mm + b.mm) from reach t join b on t.node = b.u join lim on lim.s = t.s left join recurring.reach old on old.s = t.s and old.node = b.v where t.mm + b.mm <= most and (old.mm is null or t.mm + b.mm < old.mm) group by t.s, b.v),
          open as (select c1.* from c1 left join reach on reach.s = c1.node and reach.node = c1.other where mm is null or mm > (3 * m + 1000) * 1000), fine as ({legal('open')})
          select node as u, other as v, kind, m as metres from fine qualify row_number() over (partition by node order by kind, m, other) = 1""",
    }
