"""Near copies among vectors by a pivot-permutation index: inverted lists of pivot pairs, then exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import usable
from .common import dropped, staged
from .jaccard import components

SAMPLE = 4096  # vectors that pivots are chosen from
PIVOTS = 512  # reference points at most
NEAR = 5  # nearest pivots that describe a vector
APART = (0.7, 0.8, 0.9, 0.95)  # pivots are less alike than the first that gives enough of them: among many near copies one pivot stands, so their order is stable
BLOCK = 2048  # members of a list that meet in one task; a longer list is cut into blocks, each pair of blocks on its own
BITS = 64  # random planes of the sketch that screens the members of a list
PAIRS = 1 << 20  # pairs that are looked at together
GROUP = ["list", "bp"]


def _rows(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column as a matrix of doubles, shorter lists filled up with zeros (cosines do not change)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.asarray(column.offsets, np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(np.float64)
    size = np.diff(at)
    out = np.zeros((len(size), max(width or 0, int(size.max(initial=0)))))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pivots_of(classes: DataFrame, most: int) -> np.ndarray:
    """Up to `most` unit vectors out of SAMPLE ones taken by hash, each less alike than APART says to those before it."""
    got = classes.select("h1", "h2", "vec").orderBy(F.xxhash64("h1"), "h2").limit(SAMPLE).select("vec").toArrow()
    if not got.num_rows:
        return np.zeros((0, 1))
    x = _unit(_rows(got.column("vec")))
    chosen: list[int] = []
    like = np.full(len(x), -1.0)  # to the pivot most alike so far
    for apart in APART:
        for i in range(len(x)):
            if len(chosen) < most and like[i] < apart:
                chosen.append(i)
                like = np.maximum(like, x @ x[i])
    return x[chosen]


def described(classes: DataFrame, pivots: np.ndarray, near: int) -> DataFrame:
    """cid, label, size, the numbers of the nearest pivots in ascending order, and a sketch of signs, of each class.

    Where there are fewer pivots than `near`, numbers that all classes share stand for the rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            x = _unit(_rows(b.column("vec"), pivots.shape[1])) if b.num_rows else np.zeros((0, pivots.shape[1]))
            d, k = x.shape[1], min(near, len(pivots))
            if d not in planes:
                planes[d] = np.random.default_rng(BITS).standard_normal((d, BITS))
            far = -(x[:, : pivots.shape[1]] @ pivots.T)
            order = np.argsort(far, axis=1, kind="stable")[:, :k]
            order = np.sort(np.hstack([order, np.tile(np.arange(k, near) - k + len(pivots), (len(order), 1))]), axis=1)
            sketch = np.packbits(x @ planes[d] > 0, axis=1).reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("label"), b.column("size"), pa.array(list(order.astype(np.int32)), pa.list_(pa.int32())), pa.array(sketch)], ["cid", "label", "size", "near", "sketch"])

    label = classes.schema["label"].dataType.simpleString()
    return staged(classes.select("cid", "label", F.size("vec").alias("size"), "vec").mapInArrow(run, f"cid long, label {label}, size int, near array<int>, sketch long"))


def inverted_lists(desc: DataFrame) -> DataFrame:
    """list, bp, blk and description: a class stands in the list of every two of its nearest pivots, within label and size.

    So two classes share a list if and only if they share two pivots or more. Lists with one member go. A list of more
    than BLOCK members is cut into blocks by hash; bp names a pair of blocks, and a member goes to all pairs of its own.
    """
    two = F.filter(F.flatten(F.transform("near", lambda a: F.transform("near", lambda b: F.struct(a.alias("a"), b.alias("b"))))), lambda s: s["a"] < s["b"])
    post = desc.withColumn("p", F.explode(two)).withColumn("list", F.xxhash64("label", "size", "p.a", "p.b"))
    long_ = post.groupBy("list").agg(F.count("*").alias("m")).filter("m > 1").withColumn("nb", F.expr(f"cast((m + {BLOCK - 1}) div {BLOCK} as int)"))
    live = post.join(long_, "list").withColumn("blk", F.expr("cast(pmod(xxhash64(cid), nb) as int)"))
    live = live.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    bp = F.least("blk", "o").cast("long") * F.col("nb") + F.greatest("blk", "o")
    return live.select("list", bp.alias("bp"), "blk", "cid", "label", "size", "near", "sketch", F.col("p.a").alias("a"), F.col("p.b").alias("b"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that are sorted by GROUP as tables of whole groups."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        if t.num_rows:
            a = [t.column(c).to_numpy() for c in GROUP]
            change = np.flatnonzero((a[0][1:] != a[0][:-1]) | (a[1][1:] != a[1][:-1]))
            cut = int(change[-1]) + 1 if len(change) else 0
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _candidates(t: pa.Table, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j of a group whose sketches differ in few bits and whose two least shared pivots are the list's.

    The last makes a pair of classes a pair of one list only, so that links are counted once.
    """
    col = lambda c: t.column(c).to_numpy()
    key, bp, blk, size, label, sketch, a, b = (col(c) for c in ("list", "bp", "blk", "size", "label", "sketch", "a", "b"))
    near = np.asarray(t.column("near").combine_chunks().flatten()).reshape(t.num_rows, -1)
    rest = np.where((near < b[:, None]) & (near != a[:, None]), near, -1 - np.arange(near.shape[1]))  # pivots that would come before
    n = t.num_rows
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (bp[1:] != bp[:-1])]))
    last = np.repeat(np.append(new[1:], n), np.diff(np.append(new, n)))
    times = last - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(times)])
    alone = blk == blk[new][np.repeat(np.arange(len(new)), np.diff(np.append(new, n)))]
    mixed = np.repeat(~np.logical_and.reduceat(alone, new), np.diff(np.append(new, n))) if n else alone
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(at, upto), times[at:upto])
        j = np.arange(len(i)) - np.repeat(total[at:upto] - total[at], times[at:upto]) + i + 1
        at = upto
        ok = np.bitwise_count((sketch[i] ^ sketch[j]).view(np.uint64)) <= bits  # of a signed number it would count the magnitude
        i, j = i[ok], j[ok]
        ok = (size[i] == size[j]) & (label[i] == label[j]) & (a[i] == a[j]) & (b[i] == b[j]) & (~mixed[i] | (blk[i] != blk[j]))
        for x in range(near.shape[1]):
            for y in range(near.shape[1]):
                ok &= (rest[i, x] != rest[j, y]) | (rest[i, x] < 0)
        yield i[ok], j[ok]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least row that each row is linked with, through any number of links."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        np.minimum.at(low, root, low.copy())
        low = low[low]
        if (low == root).all():
            return root
        root = low


def linked(classes: DataFrame, cosine: float, most: int, near: int) -> DataFrame:
    """cid, links (rows of other classes it is linked with) and root of a part of its component, per class and list."""
    angle = BITS * math.acos(cosine) / math.pi
    bits = math.ceil(angle + 8 * math.sqrt(angle) + 1)
    desc = described(classes, pivots_of(classes, most), near)

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            seen = np.zeros(t.num_rows, bool)
            for i, j in _candidates(t, bits):
                seen[i] = seen[j] = True
            yield from t.filter(pa.array(seen)).to_batches()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            x, weight, cid = _unit(_rows(t.column("vec"))), t.column("n").to_numpy(), t.column("cid").to_numpy()
            links, us, vs = np.zeros(t.num_rows, np.int64), [], []
            for i, j in _candidates(t, bits):
                for k in range(0, len(i), PAIRS // 16):
                    u, v = i[k : k + PAIRS // 16], j[k : k + PAIRS // 16]
                    hit = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
                    us.append(u[hit])
                    vs.append(v[hit])
                    np.add.at(links, us[-1], weight[vs[-1]])
                    np.add.at(links, vs[-1], weight[us[-1]])
            if us:
                root = _roots(t.num_rows, np.concatenate(us), np.concatenate(vs))
                got = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(cid[got]), pa.array(links[got]), pa.array(cid[root[got]])], ["cid", "links", "root"])

    post = inverted_lists(desc)
    kept = post.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(screened, post.schema)
    full = kept.join(classes.select("cid", "n", "vec"), "cid").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return staged(full.mapInArrow(verified, "cid long, links long, root long"))


def _nonzero(vec: Column) -> Column:
    return F.exists(vec, lambda x: x != 0)


def near_copies(vectors: DataFrame, cosine: float = 0.98, pivots: int = PIVOTS, near: int = NEAR) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding, label).

    1. Equal vectors of a label form one class, named by 128 bits of hash; the rest is done on classes.
    2. Up to `pivots` reference points are chosen from a bounded sample of SAMPLE classes. Every class is described
       by its `near` nearest ones and posted under every two of them: two classes share an inverted list if and
       only if they share two pivots. This is where pairs can be missed; the tests measure recall.
    3. The members of a list, in blocks where they are many, are screened by 64 signs (eight standard deviations
       beyond what the angle asks for); of members with a candidate, vectors are fetched and cosines computed in
       double precision. A pair counts in one list only. Per list a member gives its number of links and one
       link towards its part of the component, so no pairs are written.
    Vectors of different length are not compared. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without a label, link with nothing and are their own component. Equal rows are linked; rows
    with one vec_id and unlike vectors are different vectors. A null vec_id is linked but names no component (null where
    a component has no other id). An empty table gives an empty table; other columns are not read.
    """
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("vec"))
    good = usable(F.col("vec")) & F.col("label").isNotNull() & F.coalesce(_nonzero(F.col("vec")), F.lit(False))
    keyed = rows.withColumn("good", good).withColumns({"h1": F.when(F.col("good"), F.xxhash64("vec")), "h2": F.when(F.col("good"), F.xxhash64("vec", F.lit(1)))})
    key = ["label", "h1", "h2"]
    classes = staged(keyed.filter("good").groupBy(*key).agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("vec").alias("vec")).withColumn("cid", F.monotonically_increasing_id()))
    links = linked(classes, cosine, pivots, near)
    comp = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.select(*key, "cid", "low", "n").join(links.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    named = staged(named.withColumn("root", F.coalesce("root", "cid")))
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = staged(named.join(low, "root").select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    ids = keyed.select("vec_id", *key, "good")
    got = ids.filter("good").join(named, key).select("vec_id", "n_links", "component_id")
    alone = ids.filter(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return got.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
