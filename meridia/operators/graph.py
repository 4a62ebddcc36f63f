"""Road graph: degrees, components, travel times, junctions of streets, noding, dead ends, snapping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import line_length
from ..sources.staging import apart, cut, forgotten
from ..sources.tables import CONNECTOR, MOTOR_CLASS, STATE
from . import paths as paths_
from . import spatial
from .traffic import JUNCTION_S, MOTORS, free_flow

# fixed values: what an accepted way's edges are dearer by, the slowest and the most alike that another way may be
DEARER, SLOWEST, SHARED = 1.6, 1.45, 0.7
LOCAL = 1 << 18  # edges that a task contracts at a time


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.withColumns({"u": F.col("v"), "v": F.col("u")}))


def for_motors() -> Column:
    return (F.col("cls") <= MOTOR_CLASS) | (F.col("cls") == CONNECTOR)


def node_degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges.select("u", "v")).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def _least(e: pd.DataFrame) -> pd.DataFrame:
    """Each node of some edges with the least node that these edges alone reach, where that is another."""
    nodes, at = np.unique(e.to_numpy(), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root, before = np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before, root = root, root.copy()
        low = np.minimum(before[a], before[b])
        for of in (a, b, before[a], before[b]):
            np.minimum.at(root, of, low)
        root = root[root]
    moved = root != np.arange(len(nodes))
    return pd.DataFrame({"u": nodes[moved], "v": nodes[root[moved]]})


def _contracted(links: DataFrame) -> DataFrame:
    """links as edges to the least node that LOCAL edges beside each other connect: what is joined stays joined."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size >= LOCAL:
                yield _least(pd.concat(held))
                held, size = [], 0
        if held:
            yield _least(pd.concat(held))

    return links.repartitionByRange("u").sortWithinPartitions("u").mapInPandas(run, links.schema)


def stars(links: DataFrame) -> DataFrame:
    """node and root, the least node reachable, for nodes of links (u, v).

    Edges with near ends are contracted where they lie. Then large and small stars by turns: each round replaces edges
    by edges to smaller nodes, so the rounds grow with the log of the diameter that is left, and joins are on nodes
    with one row on one side, never on a component's label.
    """
    drawn = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v"))
    e = cut(_contracted(drawn))
    forgotten(drawn)
    seen = None
    while True:
        # a round that changes nothing leaves the same edges: their number and a sum of their hashes tell
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        b = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = b.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(b.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low, "u")
        small = cut(j.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        forgotten(e, large)
        e = small


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component: its least node, -1 for a node without an edge."""
    e = cut(edges.select("u", "v"))
    root = stars(e)
    ends = e.select(F.explode(F.array("u", "v")).alias("node")).withColumn("root", F.lit(None).cast(root.schema["root"].dataType))
    met = ends.unionByName(root).groupBy("node").agg(F.min("root").alias("root"), F.lit(True).alias("met"))
    got = nodes.select("node").join(apart(met), "node", "left")
    return got.select("node", F.when(F.col("met").isNull(), F.lit(-1)).otherwise(F.coalesce("root", "node")).alias("component"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its least node, -1 for a node without an edge) and size of the component."""
    got = labelled(nodes, edges)
    sizes = got.groupBy("component").agg(F.count("*").alias("size"))
    return got.join(sizes, "component").select("node", "component", F.when(F.col("component") >= 0, F.col("size")).otherwise(F.lit(0)).alias("size"))


def priced(edges: DataFrame, profile: str) -> DataFrame:
    """u, v, edge, ms, metres and blocks of each step a profile may take, both ways, junction delays included.

    A delay counts where an edge arrives at a junction of three or more roads and is not of the state. Whole
    milliseconds, so that sums are exact; one at least.
    """
    kph = free_flow(profile, F.col("cls"), F.col("flags"))
    first, last = F.element_at("shape", 1), F.element_at("shape", -1)
    e = edges.withColumn("kph", kph).filter("kph > 0").withColumns({
        "metres": F.round(line_length(F.col("shape")), 3), "long": line_length(F.col("shape")), "state": F.col("flags").bitwiseAND(STATE) > 0,
        "ublock": paths_.block_of(first["lon"], first["lat"]), "vblock": paths_.block_of(last["lon"], last["lat"])})
    e = e.withColumn("ms", F.greatest(F.round(F.col("long") / (F.col("kph") / 3.6) * 1000).cast("long"), F.lit(1)))
    e = e.select("u", "v", "edge", "metres", "ms", "state", "ublock", "vblock")
    e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "edge", "metres", "ms", "state", F.col("vblock").alias("ublock"), F.col("ublock").alias("vblock")))
    e = e.join(node_degree(edges).withColumnRenamed("node", "v"), "v")
    delay = F.when(~F.col("state") & (F.col("degree") >= 3), JUNCTION_S[profile] * 1000).otherwise(0)
    return e.select("u", "v", "edge", "metres", (F.col("ms") + delay).alias("ms"), "ublock", "vblock")


def node_blocks(steps: DataFrame) -> DataFrame:
    return steps.groupBy(F.col("u").alias("node")).agg(F.min("ublock").alias("block"))


def travel_times(edges: DataFrame, starts: DataFrame, profile: str, most_ms: int | None = None) -> DataFrame:
    """source, node, ms: the least time from each start to each node it reaches, junction delays included.

    All starts are searched together, block by block; see paths.searched. A bound in ms keeps the reach local.
    """
    steps = cut(priced(edges, profile))
    asked = starts.select("node").distinct()
    seeds = asked.join(node_blocks(steps), "node").select(F.col("node").alias("request"), "node", "block", F.lit(0).cast("long").alias("price"), F.lit(-1).cast("long").alias("edge"), F.lit(most_ms).cast("long").alias("most"))
    state = paths_.searched(paths_.packed(steps.withColumnRenamed("ms", "price")), seeds)
    got = paths_.labels(state).select(F.col("request").alias("source"), "node", F.col("price").alias("ms"))
    alone = asked.join(node_blocks(steps), "node", "left_anti").select(F.col("node").alias("source"), "node", F.lit(0).cast("long").alias("ms"))
    return got.unionByName(alone)


def paths(steps: DataFrame, requests: DataFrame, dearer: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """request, pos, edge, node, ms, metres: the cheapest path of each request (request, start, goal), by steps from goal back to start.

    All requests are searched together, block by block, each with its own prices where dearer (request, edge, factor)
    has some; what cannot beat the best way to the goal so far is not followed. Ties go to the least node before.
    A request without a path, or whose start is its goal, has no rows.
    """
    at = node_blocks(steps)
    r = requests.join(at.toDF("start", "block"), "start").join(at.toDF("goal", "gblock"), "goal").withColumn("most", F.lit(None).cast("long"))
    r = cut(r.select("request", "start", "goal", "block", "gblock", "most"))
    seeds = r.select("request", F.col("start").alias("node"), "block", F.lit(0).cast("long").alias("price"), F.lit(-1).cast("long").alias("edge"), "most")
    blocks = paths_.packed(steps.withColumnRenamed("ms", "price")) if blocks is None else blocks
    state = paths_.searched(blocks, seeds, r.select("request", F.col("goal").alias("node"), F.lit(0).cast("long").alias("tail")), dearer)
    ends = paths_.labelled(state, r.select("request", F.col("goal").alias("node"), F.col("gblock").alias("block"))).select("request", "node", "block")
    walk, _ = paths_.traced(state, ends)
    forgotten(state)
    own = steps.select(F.col("u").alias("back"), F.col("v").alias("node"), "edge", "ms", "metres")
    return walk.join(own, ["back", "node", "edge"]).select("request", "pos", "edge", "node", "ms", "metres")


def millimetres(metres: Column) -> Column:
    """metres of a step as a whole number: sums of these are exact in any order."""
    return F.round(metres * 1000).cast("long")


def routes(edges: DataFrame, requests: DataFrame, profile: str, alternatives: int = 0) -> DataFrame:
    """request, rank, pos, edge, node, ms, metres: the quickest path (rank 0) and other ways by the penalty method.

    Each attempt makes the edges of all accepted paths dearer by 1.6 once more; a way that takes over 1.45 times
    the quickest ends the search for its request, one that shares over 70 % of its metres with an accepted way is
    passed over. Requests are searched together, attempt by attempt.
    """
    steps = cut(priced(edges, profile))
    blocks = paths_.packed(steps.withColumnRenamed("ms", "price"))
    quickest = cut(paths(steps, requests, None, blocks).withColumn("rank", F.lit(0)))
    base = quickest.groupBy("request").agg(F.sum("ms").alias("base"))
    accepted, dearer, open_ = quickest, None, requests
    for _ in range(alternatives + 2 if alternatives else 0):
        once = accepted.groupBy("request", "edge").agg(F.count("*").alias("n"))
        factor = F.pow(F.lit(DEARER), F.col("n"))
        dearer = cut(once.select("request", "edge", factor.alias("factor")) if dearer is None else dearer.join(once, ["request", "edge"], "full").select("request", "edge", (F.coalesce("factor", F.lit(1.0)) * F.coalesce(factor, F.lit(1.0))).alias("factor")))
        found = cut(paths(steps, open_, dearer, blocks))
        whole = found.groupBy("request").agg(F.sum("ms").alias("ms"), F.sum(millimetres(F.col("metres"))).alias("all")).join(base, "request").filter(F.col("ms") <= SLOWEST * F.col("base"))
        shared = found.join(accepted.select("request", "edge", F.col("rank").alias("of")).distinct(), ["request", "edge"]).groupBy("request", "of").agg(F.sum(millimetres(F.col("metres"))).alias("m"))
        shared = shared.groupBy("request").agg(F.max("m").alias("m"))
        fresh = whole.join(shared, "request", "left").filter(F.coalesce("m", F.lit(0)) <= SHARED * F.col("all"))
        rank = accepted.groupBy("request").agg((F.max("rank") + 1).alias("rank"))
        accepted = cut(accepted.unionByName(found.join(fresh.select("request"), "request").join(rank, "request").select(*accepted.columns)))
        full = accepted.groupBy("request").agg(F.max("rank").alias("r")).filter(F.col("r") >= alternatives).select("request")
        open_ = cut(open_.join(whole.select("request"), "request", "left_semi").join(full, "request", "left_anti"))
        if open_.isEmpty():
            break
    return accepted


def street_junctions(edges: DataFrame) -> DataFrame:
    """Nodes where two streets of different names meet: first, second (in order), node. Names at a node are few, so pairs are too."""
    named = both_ways(edges.filter("name is not null").select("u", "v", "name")).select(F.col("u").alias("node"), "name").distinct()
    a, b = named.withColumnRenamed("name", "first"), named.withColumnRenamed("name", "second")
    return a.join(b, "node").filter("first < second").select("first", "second", "node")


def vertices(lines: DataFrame) -> DataFrame:
    """line, i, last, key and position of each vertex; keys are micro-degrees."""
    v = lines.select("line", F.size("shape").alias("n"), F.posexplode("shape").alias("i", "p"))
    whole = lambda c: F.round(c * 1e6).cast("long")
    return v.select("line", "i", ((F.col("i") == 0) | (F.col("i") == F.col("n") - 1)).alias("end"), F.concat_ws(":", whole(F.col("p.lon")), whole(F.col("p.lat"))).alias("key"), "p")


def split_keys(lines: DataFrame) -> DataFrame:
    """Keys inside a line that are an end of a line, or stand inside two lines."""
    k = vertices(lines).groupBy("key").agg(F.max("end").alias("some_end"), F.max(~F.col("end")).alias("inside"), F.min(F.when(~F.col("end"), F.col("line"))).alias("lo"), F.max(F.when(~F.col("end"), F.col("line"))).alias("hi"))
    return k.filter(F.col("inside") & (F.col("some_end") | (F.col("lo") < F.col("hi")))).select("key")


def noded(lines: DataFrame, least: float = 0.1) -> DataFrame:
    """Lines cut at split keys: line, part, u, v (keys), metres, shape; parts shorter than `least`, and loops under a metre, go."""
    v = vertices(lines).join(split_keys(lines).withColumn("cut", F.lit(True)), "key", "left")
    w = Window.partitionBy("line").orderBy("i")
    v = v.withColumn("part", F.coalesce(F.sum(F.when(F.col("cut").isNotNull() & ~F.col("end"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a vertex where a line is cut ends one part and begins the next
    again = v.filter(F.col("cut").isNotNull() & ~F.col("end")).withColumn("part", F.col("part") + 1)
    rows = v.unionByName(again).groupBy("line", "part").agg(F.array_sort(F.collect_list(F.struct("i", "key", "p"))).alias("r"))  # one line's vertices
    out = rows.select("line", F.col("part").cast("int").alias("part"), F.col("r.key")[0].alias("u"), F.element_at("r.key", -1).alias("v"), F.col("r.p").alias("shape"))
    out = out.filter(F.size("shape") > 1).withColumn("metres", F.round(line_length(F.col("shape")), 3))
    return out.filter((F.col("metres") >= least) & ((F.col("u") != F.col("v")) | (F.col("metres") >= 1)))


def dead_ends(lines: DataFrame) -> DataFrame:
    """line and key of ends that no other line shares."""
    ends = vertices(lines).filter("end")
    once = ends.groupBy("key").agg(F.count("*").alias("n"), F.min("line").alias("line")).filter("n = 1").select("line", "key")
    return once.join(split_keys(lines), "key", "left_anti").select("line", "key")


def snap_pairs(requests: DataFrame, edges: DataFrame, comp: DataFrame, profile: str, metres: float = 2000.0, most: int = 12) -> DataFrame:
    """request, from_edge, to_edge, metres: of the nearest edges of origin and destination, the pair in one component that is least far in all.

    A snap's component is that of its edge's first node. requests holds request, lon1, lat1, lon2, lat2.
    """
    kph = free_flow(profile, F.col("cls"), F.col("flags"))
    usable = edges.withColumn("kph", kph).filter("kph > 0").select("edge", "shape", "u")
    where = usable.join(comp.select(F.col("node").alias("u"), "component"), "u").select("edge", "component")

    def snapped(a: str, b: str, name: str) -> DataFrame:
        p = requests.select("request", F.col(a).alias("lon"), F.col(b).alias("lat"))
        s = spatial.nearest_edges(p, usable, "request", metres, most).join(where, "edge")
        return s.select("request", "component", F.col("edge").alias(name), F.col("metres").alias(f"{name}_m"))

    both = snapped("lon1", "lat1", "from_edge").join(snapped("lon2", "lat2", "to_edge"), ["request", "component"])  # `most` squared per request at most
    total = F.round(F.col("from_edge_m") + F.col("to_edge_m"), 3)
    return both.groupBy("request").agg(F.min(F.struct(total.alias("metres"), "from_edge", "to_edge")).alias("m")).select("request", "m.*")


def turn_kind(angle: Column) -> Column:
    """Kind of a turn by its angle, right positive."""
    size, side = F.abs(angle), F.when(angle > 0, "RIGHT").otherwise("LEFT")
    name = F.when(size < 45, "SLIGHT_").when(size < 135, "TURN_").otherwise("SHARP_")
    return F.when(size < 20, "CONTINUE").when(size < 170, F.concat(name, side)).otherwise("UTURN")


def turns(edges: DataFrame) -> DataFrame:
    """Turns at nodes from one edge into another: into, out_of, node, angle and kind. Edges at a node are few, so pairs are too."""
    from ..functions.geo import bearing, turn

    n = F.size("shape")
    p = lambda i: F.element_at("shape", i)
    ways = edges.select("edge", F.col("v").alias("node"), bearing(p(n - 1)["lon"], p(n - 1)["lat"], p(n)["lon"], p(n)["lat"]).alias("b"))
    ways = ways.unionByName(edges.select("edge", F.col("u").alias("node"), bearing(p(F.lit(2))["lon"], p(F.lit(2))["lat"], p(F.lit(1))["lon"], p(F.lit(1))["lat"]).alias("b")))
    a = ways.select("node", F.col("edge").alias("out_of"), F.col("b").alias("before"))
    b = ways.select("node", F.col("edge").alias("into"), F.pmod(F.col("b") + 180.0, F.lit(360.0)).alias("after"))
    got = a.join(b, "node").filter("out_of <> into").withColumn("angle", F.round(turn(F.col("before"), F.col("after")), 3))
    return got.select("node", "out_of", "into", "angle", turn_kind(F.col("angle")).alias("kind"))


def is_motor(profile: str) -> bool:
    return profile in MOTORS
