"""Cheapest paths over graphs of any size: a block of nodes is searched whole in a task, and only what crosses its border travels.

A block is a square of BLOCK degrees, so that what a task holds is what stands in such a square. Rounds grow with the
blocks that a path crosses, not with its edges.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import apart, cut, forgotten

BLOCK = 0.05
LABEL = ("node", "price", "back", "bblock", "edge")  # how a node is reached: from which node, in which block, by which edge
CHUNK = 256  # requests that share one copy of a block's steps
ROWS = 512  # rows of a frame that a task gives


def block_of(lon: Column, lat: Column) -> Column:
    return F.floor(lon / BLOCK) * (1 << 24) + F.floor(lat / BLOCK)


def packed(steps: DataFrame) -> DataFrame:
    """A row per block with its steps (u, v, edge, price, ublock, vblock) as parallel arrays."""
    rows = steps.groupBy(F.col("ublock").alias("block")).agg(F.collect_list(F.struct("u", "v", "vblock", "edge", "price")).alias("s"))
    return cut(rows.select("block", *[F.col(f"s.{c}").alias(f"s_{c}") for c in ("u", "v", "vblock", "edge", "price")]))


def _arrays(prefix: str) -> str:
    return ", ".join(f"{prefix}{c} array<long>" for c in LABEL)


FOUND = f"request long, block long, {_arrays('')}"
SENT = f"request long, {_arrays('o_')}, o_block array<long>, best long"
STEP = ("u", "v", "vblock", "edge", "price")
OPTIONS = {"most": "long", "g_node": "array<long>", "g_tail": "array<long>", "d_edge": "array<long>", "d_factor": "array<double>"}


def _relaxed(r, at: dict[int, list[tuple[int, int, int, int]]]) -> tuple[dict, dict, dict]:
    """Labels of a block's nodes for one request from all its offers, the best offers to nodes of other blocks, and its goals."""
    dear = {} if r.d_edge is None else dict(zip(r.d_edge.tolist(), r.d_factor.tolist()))
    goals = {} if r.g_node is None else dict(zip(r.g_node.tolist(), r.g_tail.tolist()))
    most = None if pd.isna(r.most) else int(r.most)
    best, heap, out = {}, [], {}
    for n, p, k, kb, e in zip(*(getattr(r, f"o_{c}").tolist() for c in LABEL)):
        best[n] = (p, k, kb, e)
        heap.append((p, n))
    heapq.heapify(heap)
    while heap:
        p, n = heapq.heappop(heap)
        if p > best[n][0]:
            continue
        if most is not None and p > most:
            break
        if n in goals and (most is None or p + goals[n] < most):
            most = p + goals[n]
        for v, vb, e, step in at.get(n, ()):
            q = p + (step if e not in dear else max(1, round(step * dear[e])))
            if most is not None and q > most:
                continue
            if vb == r.block:
                had = best.get(v)
                if had is None or q < had[0]:
                    heapq.heappush(heap, (q, v))
                    best[v] = (q, n, r.block, e)
                elif q == had[0] and (n, e) < (had[1], had[3]):
                    best[v] = (q, n, r.block, e)
            else:
                had = out.get(v)
                if had is None or (q, n, e) < had[:3]:
                    out[v] = (q, n, e, vb)
    return best, out, goals


def _run(whole: bool):
    """Searches blocks as they stream by, the steps of a block ahead of the requests in it: gives labels, or offers to other blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, rows = {}, []

        def frame() -> pd.DataFrame:
            got = pd.DataFrame(rows, columns=["request", "block", *LABEL] if whole else ["request", *(f"o_{c}" for c in LABEL), "o_block", "best"])
            return got if whole else got.astype({"best": "Int64"})

        for b in batches:
            for r in b.itertuples(index=False):
                if r.s_u is not None:
                    at = {}
                    for u, v, vb, e, p in zip(*(getattr(r, f"s_{c}").tolist() for c in STEP)):
                        at.setdefault(u, []).append((v, vb, e, p))
                    continue
                if pd.isna(r.request):
                    at = {}
                    continue
                best, out, goals = _relaxed(r, at)
                if whole:
                    rows.append((int(r.request), r.block, list(best), *([x[i] for x in best.values()] for i in range(4))))
                else:
                    end = min((best[g][0] + t for g, t in goals.items() if g in best), default=None)
                    if out or end is not None:
                        rows.append((int(r.request), list(out), *([x[i] for x in out.values()] for i in (0, 1)), [r.block] * len(out), *([x[i] for x in out.values()] for i in (2, 3)), end))
                if len(rows) >= ROWS:
                    yield frame()
                    rows = []
        if rows:
            yield frame()

    return run


def dealt(known: DataFrame, blocks: DataFrame, options: list[DataFrame]) -> DataFrame:
    """Rows of steps (kind 0) and of requests with their offers (kind 1). A block's steps travel once for some CHUNK requests, not with each."""
    parts = known.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n"))
    rows = known.select("request", "block", *[F.col(f"o.{c}").alias(f"o_{c}") for c in LABEL])
    for o in options:
        rows = rows.join(apart(o), "request", "left")
    have = set(rows.columns)
    rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in OPTIONS.items() if c not in have])
    rows = rows.join(apart(parts), "block").withColumn("chunk", F.pmod(F.xxhash64("request"), F.col("n")).cast("int")).drop("n")
    # a block without steps has a row too, so that requests never meet the steps of another
    ahead = parts.join(apart(blocks), "block", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    return ahead.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)


def _over(known: DataFrame, blocks: DataFrame, options: list[DataFrame], whole: bool) -> DataFrame:
    """Each (request, block) of known searched from its offers."""
    return dealt(known, blocks, options).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "kind").mapInPandas(_run(whole), FOUND if whole else SENT)


def _merged(offers: DataFrame) -> DataFrame:
    """request, block, o (the best offer to each node) and changed, from rows of offers with new: whether a new one is the best of some node."""
    least = F.struct("price", "back", "edge", "bblock")
    m = offers.repartition("request", "block").groupBy("request", "block", "node").agg(F.min(least).alias("m"), F.min(F.when(~F.col("new"), least)).alias("k"))
    m = m.select("request", "block", F.struct("node", "m.price", "m.back", "m.bblock", "m.edge").alias("l"), (F.col("k").isNull() | (F.col("m") < F.col("k"))).alias("changed"))
    return cut(m.groupBy("request", "block").agg(F.collect_list("l").alias("o"), F.max("changed").alias("changed")))  # a block's border


def searched(blocks: DataFrame, seeds: DataFrame, goals: DataFrame | None = None, dearer: DataFrame | None = None) -> DataFrame:
    """request, block and arrays of labels (node, price, back, bblock, edge): least prices from the seeds of each request.

    blocks come from packed(). seeds hold request, node, block, price and edge (negative: a mark that the trace ends
    with), and `most`, the highest price of interest (null: none). goals hold request, node and tail: what is dearer
    than the best price and tail so far is not followed. dearer holds request, edge and the factor of its price.
    All requests are searched together; ties go to the least node before, then to the least edge. Between rounds only
    the offers that blocks make each other are kept; labels are made once, when no offer changes any more.
    """
    limits = cut(seeds.groupBy("request").agg(F.max("most").alias("most")))
    options = []
    if goals is not None:
        options.append(cut(goals.groupBy("request").agg(F.collect_list(F.struct("node", "tail")).alias("g")).select("request", F.col("g.node").alias("g_node"), F.col("g.tail").alias("g_tail"))))
    if dearer is not None:
        options.append(cut(dearer.groupBy("request").agg(F.collect_list(F.struct("edge", "factor")).alias("d")).select("request", F.col("d.edge").alias("d_edge"), F.col("d.factor").alias("d_factor"))))
    known = _merged(seeds.select("request", "block", "node", "price", F.lit(-1).cast("long").alias("back"), F.col("block").alias("bblock"), F.col("edge").cast("long").alias("edge"), F.lit(True).alias("new")))
    while not (todo := known.filter("changed")).isEmpty():
        out = cut(_over(todo, blocks, [limits, *options], False))
        old = [out, known]
        if goals is not None:
            old.append(limits)
            found = out.groupBy("request").agg(F.min("best").alias("b"))
            limits = cut(limits.join(apart(found), "request", "left").select("request", F.least("most", "b").alias("most")))
        sent = out.select("request", F.explode(F.arrays_zip(*[f"o_{c}" for c in LABEL], "o_block")).alias("o")).select("request", F.col("o.o_block").alias("block"), *[F.col(f"o.o_{c}").alias(c) for c in LABEL], F.lit(True).alias("new"))
        sent = sent.join(apart(limits), "request").filter("most is null or price <= most").drop("most")
        known = _merged(known.select("request", "block", F.explode("o").alias("l")).select("request", "block", "l.*", F.lit(False).alias("new")).unionByName(sent))
        forgotten(*old)
    return cut(_over(known, blocks, [limits, *options], True))


def labelled(state: DataFrame, places: DataFrame) -> DataFrame:
    """places (request, node, block and more) with the price that searched() found there; places that were not reached go."""
    got = places.join(apart(state.select("request", "block", F.col("node").alias("nodes"), "price")), ["request", "block"])
    return got.withColumn("i", F.array_position("nodes", F.col("node"))).filter("i > 0").withColumn("price", F.get("price", (F.col("i") - 1).cast("int"))).drop("i", "nodes")


def labels(state: DataFrame) -> DataFrame:
    """request, block, node, price, back, bblock, edge: the labels of searched() as rows."""
    return state.select("request", "block", F.explode(F.arrays_zip(*LABEL)).alias("l")).select("request", "block", *[f"l.{c}" for c in LABEL])


TRACE = "request long, pos array<int>, edge array<long>, node array<long>, back array<long>, done int, next long, nblock long, mark long"


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            at = dict(zip(r.node.tolist(), zip(r.back.tolist(), r.bblock.tolist(), r.edge.tolist())))
            n, done, walk, mark = r.at, r.done, [], None
            while True:
                back, block, edge = at[n]
                if edge < 0:
                    mark = edge
                    break
                walk.append((done, edge, n, back))
                done, n = done + 1, back
                if block != r.block:
                    break
            rows.append((r.request, *([w[i] for w in walk] for i in range(4)), done, None if mark is not None else n, None if mark is not None else block, mark))
        got = pd.DataFrame(rows, columns=["request", "pos", "edge", "node", "back", "done", "next", "nblock", "mark"])
        for c in ("next", "nblock", "mark"):
            got[c] = got[c].astype("Int64")
        yield got


def traced(state: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps (request, pos, edge, node, back) from the end of each request (request, node, block) back to a seed, pos 0 at the end; and request, mark of the seed.

    A task walks through a whole block, so rounds grow with the blocks on the way.
    """
    at = cut(ends.select("request", F.col("node").alias("at"), "block", F.lit(0).alias("done")))
    rows = []
    while not at.isEmpty():
        got = cut(state.select("request", "block", "node", "back", "bblock", "edge").join(apart(at), ["request", "block"]).mapInPandas(_walked, TRACE))
        rows.append(got)
        at = cut(got.filter("next is not null").select("request", F.col("next").alias("at"), F.col("nblock").alias("block"), "done"))
    if not rows:
        rows = [cut(state.sparkSession.createDataFrame([], TRACE))]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    steps = whole.select("request", F.explode(F.arrays_zip("pos", "edge", "node", "back")).alias("s")).select("request", "s.*")
    return cut(steps), cut(whole.filter("mark is not null").select("request", "mark"))
