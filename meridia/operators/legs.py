"""Routes between places on edges: legs of whole and partial edges, several legs as one route, and its shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import line_length
from ..functions.linear import cut_by_share, joined
from ..sources.staging import cut
from ..sources.tables import APPROXIMATE, STATE
from . import graph, paths
from .traffic import JUNCTION_S, free_flow


def _usable(edges: DataFrame, profile: str) -> DataFrame:
    """edge, u, v, metres and ms (no delays) of the edges a profile may use, with the blocks of their ends."""
    first, last = F.element_at("shape", 1), F.element_at("shape", -1)
    e = edges.withColumn("kph", free_flow(profile, F.col("cls"), F.col("flags"))).filter("kph > 0").withColumn("long", line_length(F.col("shape")))
    return e.select(
        "edge", "u", "v", F.round("long", 3).alias("metres"), F.greatest(F.round(F.col("long") / (F.col("kph") / 3.6) * 1000).cast("long"), F.lit(1)).alias("ms"), (F.col("flags").bitwiseAND(STATE) > 0).alias("state"),
        paths.block_of(first["lon"], first["lat"]).alias("ublock"), paths.block_of(last["lon"], last["lat"]).alias("vblock"))


def legs(edges: DataFrame, snaps: DataFrame, profile: str) -> DataFrame:
    """request, seq, edge, reverse, a, b, metres, ms, delay: the pieces of the quickest way between two places on edges, in order.

    snaps hold request, from_edge, from_part, to_edge, to_part (parts of the length, 0 to 1). Both ends of the first
    edge are started from with the time to reach them, and the last edge may be entered from either end. Where both
    places lie on one edge, the way along it is taken unless another is quicker. A piece runs from the part a of its
    edge to b, against its drawing where reverse; delay is the time lost at the junction behind it, none behind the
    last. Pieces without length go, but for a lone one. A request without a way has no rows.
    """
    e = cut(_usable(edges, profile))
    steps = cut(graph.priced(edges, profile))
    ends = e.select("edge", "u", "v", "ms", "ublock", "vblock")
    f, t = (ends.select(*[F.col(c).alias(f"{k}_{c}") for c in ends.columns]) for k in ("from", "to"))
    asked = cut(snaps.join(f, "from_edge").join(t, "to_edge").withColumn("most", F.when(F.col("from_edge") == F.col("to_edge"), F.round(F.col("to_ms") * F.abs(F.col("to_part") - F.col("from_part"))).cast("long"))))
    part = lambda ms, p: F.round(F.col(ms) * p).cast("long")
    fp, tp = F.col("from_part"), F.col("to_part")

    def two(k: str, p, name: str) -> DataFrame:
        end = lambda n, price, mark: F.struct(F.col(f"{k}_{n}").alias("node"), F.col(f"{k}_{n}block").alias("block"), price.alias(name), F.lit(mark).cast("long").alias("edge"))
        return asked.select("request", "most", F.explode(F.array(end("u", part(f"{k}_ms", p), -1), end("v", part(f"{k}_ms", 1 - p), -2))).alias("s")).select("request", "most", "s.*")

    goals = two("to", tp, "tail")
    state = paths.searched(paths.packed(steps.withColumnRenamed("ms", "price")), two("from", fp, "price"), goals.groupBy("request", "node").agg(F.min("tail").alias("tail")))
    got = paths.labelled(state, goals.drop("most").withColumnRenamed("edge", "side"))
    # of equal ways the one that enters the last edge at its first end
    best = got.groupBy("request").agg(F.min(F.struct((F.col("price") + F.col("tail")).alias("ms"), (-F.col("side")).alias("side"), "node", "block")).alias("m")).select("request", "m.*")
    best = cut(best.join(asked.select("request", "most"), "request").filter("most is null or ms < most"))
    walk, marks = paths.traced(state, best)
    named = lambda **c: [v.alias(k) for k, v in c.items()]
    one = F.lit(1.0)
    along = asked.filter("most is not null").join(best.select("request"), "request", "left_anti").select("request", *named(seq=F.lit(0), edge=F.col("from_edge"), reverse=tp < fp, a=fp, b=tp))
    first = marks.join(asked, "request").select("request", *named(seq=F.lit(0), edge=F.col("from_edge"), reverse=F.col("mark") == -1, a=fp, b=F.when(F.col("mark") == -1, 0.0).otherwise(1.0)))
    length = walk.groupBy("request").agg(F.count("*").cast("int").alias("n"))
    mid = walk.join(length, "request").join(e.select("edge", "u", "v"), "edge").withColumn("back_", (F.col("node") == F.col("u")) & (F.col("u") != F.col("v")))
    mid = mid.select("request", *named(seq=F.col("n") - F.col("pos"), edge=F.col("edge"), reverse=F.col("back_"), a=F.when(F.col("back_"), 1.0).otherwise(0.0), b=F.when(F.col("back_"), 0.0).otherwise(1.0)))
    last = best.join(asked.drop("most"), "request").join(length, "request", "left")
    last = last.select("request", *named(seq=F.coalesce("n", F.lit(0)) + 1, edge=F.col("to_edge"), reverse=F.col("side") == 2, a=F.when(F.col("side") == 2, one).otherwise(0.0), b=tp))
    pieces = along.unionByName(first).unionByName(mid).unionByName(last)
    p = pieces.join(e.select("edge", "u", "v", "state", F.col("metres").alias("all"), F.col("ms").alias("time")), "edge")
    p = p.withColumn("node", F.when(F.col("reverse"), F.col("u")).otherwise(F.col("v"))).join(graph.node_degree(edges), "node")
    size = pieces.groupBy("request").agg(F.max("seq").alias("last"), F.count("*").alias("count"))
    late = F.when((F.col("seq") < F.col("last")) & ~F.col("state") & (F.col("degree") >= 3), JUNCTION_S[profile] * 1000).otherwise(0)
    share = F.abs(F.col("b") - F.col("a"))
    p = p.join(size, "request").select("request", "seq", "edge", "reverse", "a", "b", F.round(F.col("all") * share, 3).alias("metres"), F.round(F.col("time") * share).cast("long").alias("ms"), late.alias("delay"), "count")
    return p.filter("a <> b or count = 1").drop("count")


def routes_of(pieces: DataFrame, legs_: DataFrame, edges: DataFrame) -> DataFrame:
    """trip, metres, ms, shape and approximate (metres over edges that are drawn as a guess): the legs (trip, leg, request) of each trip as one route.

    Pieces are cut out of their edges by their parts; where one begins at the corner the last one ended with, the
    corner counts once. A trip with a leg that has no way is left out.
    """
    p = pieces.join(legs_, "request").join(edges.select("edge", "shape", "flags"), "edge").withColumn("points", cut_by_share(F.col("shape"), F.col("a"), F.col("b")))
    got = p.groupBy("trip").agg(
        F.countDistinct("leg").alias("found"), F.round(F.sum("metres"), 3).alias("metres"), F.sum(F.col("ms") + F.col("delay")).alias("ms"),
        F.round(F.sum(F.when(F.col("flags").bitwiseAND(APPROXIMATE) > 0, F.col("metres")).otherwise(0.0)), 3).alias("approximate"),
        F.array_sort(F.collect_list(F.struct("leg", "seq", "points"))).alias("s"))  # one route's pieces
    whole = legs_.groupBy("trip").agg(F.countDistinct("leg").alias("asked"))
    return got.join(whole, "trip").filter("found = asked").select("trip", "metres", "ms", "approximate", joined(F.col("s")["points"]).alias("shape"))
