"""Repair of a drawn road network: dead ends joined by ranked rules, towns bridged to the main network, loose ends linked.

Lines hold line, source (STREET, STATE_ROAD or LINK), cls, ref and shape; graphs are the nodes and edges of graph.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine, line_length, segment_metres, segment_part, sides
from ..sources.staging import apart, cut
from ..sources.tables import CONNECTOR, MOTOR_CLASS
from . import graph, paths, spatial

STREET, STATE_ROAD, LINK = 0, 1, 2
# fixed values, in metres: reach of a dead street end to any line and to a state road, of a dead state road end to a
# carriageway, to another state road and to a junction, and of any street end to a state road beside it
STREET_M, SIDE_M, ROAD_M, GAP_M, JUNCTION_M, BESIDE_M = 3.0, 12.0, 60.0, 300.0, 150.0, 15.0
# fixed values: longest bridge of a town, fewest nodes of a town, reach of a loose end, detour that counts as joined, step over land
BRIDGE_M, TOWN_NODES, LOOSE_M, DETOUR, SLACK_M, LAND_M = 6000.0, 25, 1000.0, 3, 1000.0, 200.0
END = ["line", "i"]


def _segments(lines: DataFrame) -> DataFrame:
    s = lines.select("line", "source", "cls", F.posexplode(sides(F.col("shape"))).alias("segment", "s"))
    return s.select(F.col("line").alias("target"), "segment", "source", "cls", F.col("s.a.lon").alias("x1"), F.col("s.a.lat").alias("y1"), F.col("s.b.lon").alias("x2"), F.col("s.b.lat").alias("y2"))


def dead_ends(lines: DataFrame) -> DataFrame:
    """line, i, lon, lat, source, cls and ref of the ends that no other line shares, as an end or inside."""
    ends = graph.vertices(lines).filter("end")
    once = ends.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("line", "i", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))).alias("m")).filter("n = 1").select("key", "m.*")
    return once.join(graph.split_keys(lines), "key", "left_anti").drop("key").join(lines.select("line", "source", "cls", "ref"), "line")


def _hits(points: DataFrame, segments: DataFrame, metres: float, rule: int) -> DataFrame:
    """The nearest of segments of other lines within a distance, per end."""
    at = [F.col(c) for c in ("lon", "lat", "x1", "y1", "x2", "y2")]
    near = spatial.cell_join(points.select(*END, "lon", "lat"), spatial.padded(segments.select("target", "segment", "x1", "y1", "x2", "y2"), metres)).filter("line <> target")
    near = near.withColumn("metres", F.round(segment_metres(*at), 3)).filter(F.col("metres") <= metres)
    t = segment_part(*at)
    six = lambda a, b: F.round((F.col(a) + (F.col(b) - F.col(a)) * t).cast("decimal(18,9)"), 6).cast("double")
    best = near.groupBy(*END).agg(F.min(F.struct("metres", "target", "segment", t.alias("t"), six("x1", "x2").alias("plon"), six("y1", "y2").alias("plat"))).alias("m"))
    return best.select(*END, F.lit(rule).alias("rule"), "m.*")


def motor(cls: Column) -> Column:
    return cls <= MOTOR_CLASS


def joins(lines: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """line, i, rule, metres, target, segment, t, plon, plat: where each dead end is joined, by the first rule that finds a place.

    1: a street within 3 m of any line; 2: a street for motors within 12 m of a state road; 3: a state road within 60 m
    of a carriageway; 4: within 300 m of another state road; 5: within 150 m of a street's end (no segment then).
    Links are not joined to. Places are rounded to six digits; ties go to the least line, then segment.
    """
    ends = cut(dead_ends(lines)) if ends is None else ends
    s = _segments(lines).filter(F.col("source") != LINK)
    # ends that are no state road's count as streets, links included
    streets, roads = ends.filter(F.col("source") != STATE_ROAD), ends.filter(F.col("source") == STATE_ROAD)
    found = _hits(streets, s, STREET_M, 1).unionByName(_hits(streets.filter(motor(F.col("cls"))), s.filter(F.col("source") == STATE_ROAD), SIDE_M, 2))
    found = found.unionByName(_hits(roads, s.filter(motor(F.col("cls"))), ROAD_M, 3)).unionByName(_hits(roads, s.filter(F.col("source") == STATE_ROAD), GAP_M, 4))
    rest = ("rule", "metres", "target", "segment", "t", "plon", "plat")
    found = cut(found.groupBy(*END).agg(F.min(F.struct(*rest)).alias("m")).select(*END, "m.*"))
    left = roads.join(found, END, "left_anti").withColumn("end", F.concat_ws(":", *END))
    tips = lines.filter((F.col("source") == STREET) & motor(F.col("cls"))).select("line", F.explode(F.array(F.element_at("shape", 1), F.element_at("shape", -1))).alias("p")).select("p.lon", "p.lat", F.concat_ws(":", "p.lon", "p.lat").alias("tip")).distinct()
    near = spatial.nearest_points(left.select("end", "lon", "lat"), tips, "end", "tip", JUNCTION_M, (1,)).join(left.select("end", *END), "end").join(tips.select("tip", F.col("lon").alias("plon"), F.col("lat").alias("plat")), "tip")
    none = lambda t: F.lit(None).cast(t)
    last = near.select(*END, F.lit(5).alias("rule"), "metres", none("long").alias("target"), none("int").alias("segment"), none("double").alias("t"), "plon", "plat")
    return found.unionByName(last)


def ladder(lines: DataFrame) -> DataFrame:
    """line, i, metres, target, segment, t, plon, plat: ends of streets for motors within 15 m of a state road that runs beside them.

    Of ends at one place one is joined; an end that lies on the road needs no join.
    """
    ends = graph.vertices(lines.filter((F.col("source") == STREET) & motor(F.col("cls")))).filter("end")
    one = ends.groupBy("key").agg(F.min(F.struct("line", "i", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))).alias("m")).select("m.*")
    got = _hits(one, _segments(lines).filter(F.col("source") == STATE_ROAD), BESIDE_M, 6)
    return got.join(one, END).filter("round(lon * 1e6) <> round(plon * 1e6) or round(lat * 1e6) <> round(plat * 1e6)").select(*got.columns)


def rejoined(lines: DataFrame, places: DataFrame) -> DataFrame:
    """lines with a vertex where something is joined to them, and a link from each joined end to its place. noded() then makes junctions of both."""
    v = lines.select("line", F.posexplode("shape").alias("i", "p")).select("line", F.col("i").cast("double").alias("at"), "p")
    more = places.filter("target is not null").select(F.col("target").alias("line"), (F.col("segment") + F.col("t")).alias("at"), F.struct(F.col("plon").alias("lon"), F.col("plat").alias("lat")).alias("p"))
    shape = F.array_sort(F.collect_list(F.struct("at", "p")))["p"]  # one line's vertices
    bent = v.unionByName(more).groupBy("line").agg(shape.alias("shape"))
    new = F.filter("shape", lambda p, i: (i == 0) | (p != F.get("shape", i - 1)))
    bent = bent.withColumn("shape", new).join(lines.drop("shape"), "line")
    end = lines.select("line", F.posexplode("shape").alias("i", "p"))
    links = places.join(end, END).withColumn("to", F.struct(F.col("plon").alias("lon"), F.col("plat").alias("lat"))).filter("round(p.lon * 1e6) <> round(plon * 1e6) or round(p.lat * 1e6) <> round(plat * 1e6)")
    name = -1 - F.pmod(F.xxhash64("line", "i", "plon", "plat"), F.lit(1 << 62))
    links = links.select(name.alias("line"), F.lit(LINK).alias("source"), F.lit(CONNECTOR).alias("cls"), F.lit(None).cast("string").alias("ref"), F.array("p", "to").alias("shape")).distinct()
    return bent.select("line", "source", "cls", "ref", "shape").unionByName(links)


def over_land(links: DataFrame, land: DataFrame, water: DataFrame) -> DataFrame:
    """The links (link, lon1, lat1, lon2, lat2, metres) of which every 200th metre lies in an area of land and in no water; short ones have no such place and stay."""
    steps = F.greatest(F.floor(F.col("metres") / LAND_M), F.lit(1)).cast("int")
    k = F.explode(F.filter(F.sequence(F.lit(1), steps), lambda x: x < steps))
    p = links.withColumn("n", steps).withColumn("k", k).select("link", (F.col("k") / F.col("n")).alias("f"), "k", "lon1", "lat1", "lon2", "lat2")
    p = p.select("link", F.concat_ws(":", "link", "k").alias("sample"), (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * F.col("f")).alias("lon"), (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * F.col("f")).alias("lat"))
    p = cut(p)
    dry, wet = (spatial.first_area(p.select("sample", "lon", "lat"), a, "sample").select("sample") for a in (land, water))
    bad = p.join(dry, "sample", "left_anti").select("link").unionByName(p.join(wet, "sample", "left_semi").select("link")).distinct()
    return links.join(bad, "link", "left_anti")


def _placed(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links (u, v) with positions, distance and a name."""
    ends = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    n = cut(nodes.select("node", "lon", "lat").join(ends, "node", "left_semi"))  # a few of all nodes
    got = links.join(n.toDF("u", "lon1", "lat1"), "u").join(n.toDF("v", "lon2", "lat2"), "v")
    return got.withColumns({"link": F.concat_ws("-", "u", "v"), "metres": F.round(haversine(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")), 3)})


def bridges(nodes: DataFrame, edges: DataFrame, land: DataFrame, water: DataFrame, metres: float = BRIDGE_M, least: int = TOWN_NODES, attempts: int = 2) -> DataFrame:
    """u, v, metres, attempt: one straight link per town of `least` nodes, from its node nearest to the main network to that node.

    The main network is the largest component for motors, ties to the least node. A town whose nearest link is longer
    than `metres` or leaves the land stays apart. Linked towns belong to the main network in the next attempt. The
    radius widens, and a town that has found a node leaves, so that towns beside the main network meet little of it.
    Nodes in cells that no circle around the main network touches are left out first.
    """
    got = graph.labelled(nodes, edges.filter(graph.for_motors())).filter("component >= 0")
    comp = cut(got.join(apart(nodes.select("node", "lon", "lat")), "node"))
    land, water = cut(land), cut(water)
    sizes = cut(comp.groupBy("component").agg(F.count("*").alias("size")))
    first = sizes.orderBy(F.desc("size"), "component").first()
    main = sizes.filter(F.col("component") == (first["component"] if first else None)).select("component")
    towns = sizes.filter(F.col("size") >= least).join(main, "component", "left_anti").select("component")
    rows = None
    for attempt in range(1, attempts + 1):
        of_main = cut(comp.join(main, "component", "left_semi"))
        circles = spatial.padded(of_main.select(F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.col("lon").alias("x2"), F.col("lat").alias("y2")), metres)
        away = cut(spatial.touched(comp.join(towns, "component", "left_semi"), circles))
        best = None
        for share in (1 / 64, 1 / 16, 1 / 4, 1):
            near = spatial.nearest_points(away.select("node", "lon", "lat"), of_main.select(F.col("node").alias("other"), "lon", "lat"), "node", "other", metres * share, (1,))
            hit = cut(near.join(comp.select("node", "component"), "node").groupBy("component").agg(F.min(F.struct("metres", "node", "other")).alias("m")).select("component", F.col("m.node").alias("u"), F.col("m.other").alias("v")))
            best = hit if best is None else best.unionByName(hit)
            away = cut(away.join(hit, "component", "left_anti"))
        links = cut(over_land(cut(_placed(best, nodes)), land, water).select("component", "u", "v", "metres", F.lit(attempt).alias("attempt")))
        rows = links if rows is None else rows.unionByName(links)
        if links.isEmpty():
            break
        main = cut(main.unionByName(links.select("component")))
        towns = towns.join(links, "component", "left_anti")
    return rows.select("u", "v", "metres", "attempt")


def loose_links(nodes: DataFrame, edges: DataFrame, ends: DataFrame, land: DataFrame, water: DataFrame) -> DataFrame:
    """u, v, kind, metres: one straight link per loose end (node, ref) that the network does not join already.

    Candidates are the nodes of the main network within 1 km (kind 1), then those of the road of the end's number within
    6 km (kind 2). A candidate at d metres is joined already where the network reaches it within 3 d + 1,000 m: a search
    per end and kind, all together, each bounded by that of its farthest candidate. The nearest candidate that is not
    joined, and whose link stays on land, is taken; ties go to the least node. Ends do not see each other's links.
    """
    roads = edges.filter(graph.for_motors())
    comp = graph.components(nodes, roads).filter("component >= 0")
    first = comp.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").first()
    at = nodes.select("node", "lon", "lat")
    main = cut(comp.filter(F.col("component") == (first["component"] if first else None)).select("node").join(at, "node"))
    e = cut(ends.select("node", "ref").distinct().join(at, "node").withColumn("end", F.concat_ws("|", "node", "ref")))

    def within(points: DataFrame, targets: DataFrame, metres: float) -> DataFrame:
        dot = targets.select(F.col("node").alias("other"), "road", F.col("lon").alias("x1"), F.col("lat").alias("y1"), F.col("lon").alias("x2"), F.col("lat").alias("y2"))
        near = spatial.cell_join(points, spatial.padded(dot, metres)).filter("other <> node")
        d = haversine(F.col("lon"), F.col("lat"), F.col("x1"), F.col("y1"))
        return near.withColumn("metres", F.round(d, 3)).filter(F.col("metres") <= metres)

    named = edges.filter("ref is not null").select("ref", F.explode(F.array("u", "v")).alias("node")).distinct()
    same = main.join(named.withColumnRenamed("ref", "road"), "node")
    close = within(e, main.withColumn("road", F.lit(None).cast("string")), LOOSE_M).withColumn("kind", F.lit(1))
    along = within(e, same, BRIDGE_M).filter("road = ref").withColumn("kind", F.lit(2))
    near = cut(close.unionByName(along).select("end", "node", "lon", "lat", "kind", "other", F.col("x1").alias("olon"), F.col("y1").alias("olat"), "metres"))
    asked = cut(near.groupBy("end", "node", "lon", "lat", "kind").agg(F.max("metres").alias("far")).withColumn("request", F.monotonically_increasing_id()))
    place = {"ublock": ("ax", "ay"), "vblock": ("bx", "by")}
    steps = graph.both_ways(roads.select("u", "v", "edge", F.greatest(F.round(line_length(F.col("shape")) * 1000).cast("long"), F.lit(1)).alias("price")))
    steps = steps.join(at.toDF("u", "ax", "ay"), "u").join(at.toDF("v", "bx", "by"), "v").withColumns({k: paths.block_of(F.col(x), F.col(y)) for k, (x, y) in place.items()})
    most = ((DETOUR * F.col("far") + SLACK_M) * 1000).cast("long")
    seeds = asked.select("request", "node", paths.block_of(F.col("lon"), F.col("lat")).alias("block"), F.lit(0).cast("long").alias("price"), F.lit(-1).cast("long").alias("edge"), most.alias("most"))
    reached = paths.labels(paths.searched(paths.packed(steps), seeds)).select("request", F.col("node").alias("other"), "price")
    left = near.join(asked.select("end", "kind", "request"), ["end", "kind"]).join(reached, ["request", "other"], "left")
    left = left.filter(F.col("price").isNull() | (F.col("price") > (DETOUR * F.col("metres") + SLACK_M) * 1000))
    links = left.select(F.concat_ws("-", "end", "kind", "other").alias("link"), "end", "kind", F.col("node").alias("u"), F.col("other").alias("v"), "metres", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.col("olon").alias("lon2"), F.col("olat").alias("lat2"))
    legal = over_land(cut(links), cut(land), cut(water))
    return legal.groupBy("end").agg(F.min(F.struct("kind", "metres", "v", "u")).alias("m")).select("m.u", "m.v", "m.kind", "m.metres")
