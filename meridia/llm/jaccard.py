"""N-gram Jaccard join by grouped prefixes, with connected components of its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, dropped, staged
from .passages import rolled

NO_ID = -(2**63)
PIVOTS = 4  # members that a round compares the rest of a posting list with
ROUNDS = 2  # such rounds at most; the exact join afterwards does the rest
KEY = ["doc_id", "tkey"]  # a row is known by its id and a hash of its text


def shingle_set(text: str | None, n: int, seen: WordHashes) -> np.ndarray:
    """Sorted distinct n-word shingles as 64-bit hashes; a shorter text is one shingle; none without words."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []  # bytes: A-Z and ASCII blanks only
    if not ws:
        return np.zeros(0, np.int64)
    if len(ws) < n:
        return np.array([xxhash.xxh64_intdigest(b"\0" + b" ".join(ws))], np.uint64).view(np.int64)
    return np.unique(rolled(np.fromiter(map(seen.__getitem__, ws), np.uint64, len(ws)), n))


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a whole set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s))).view(np.int64))


def components(links: DataFrame) -> DataFrame:
    """node, root (least node reachable) for nodes of links (a, b); alternating large and small stars."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low, "u")
        small = staged(j.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        same = small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty()
        dropped(edges, large)
        edges = small
        if same:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")


def prefix_size(size: str, percent: int) -> str:
    return f"({size} - ({percent} * {size} + 99) div 100 + 1)"


def _fingerprints(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row the name and size of its set, and the shingles whose hash lies in the first part of all hashes."""
    upto = NO_ID + int(2**64 * min(1.0, 1.5 * (100 - percent) / 100)) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for b in batches:
            sets = [shingle_set(t, n, seen) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "tkey": b["tkey"], "cid": [set_id(s) for s in sets], "size": [len(s) for s in sets], "part": [s[: np.searchsorted(s, upto, "right")] for s in sets]})

    return staged(keyed(docs).mapInPandas(run, "doc_id long, tkey long, cid long, size long, part array<long>"))


def _sets(docs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """cid, size and whole set of the classes in reps, made again from the text of one row each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for b in batches:
            yield pd.DataFrame({"cid": b["cid"], "size": b["size"], "s": [shingle_set(t, n, seen) for t in b["text"]]})

    # by a shuffle at every size: a plan that changes with the size of reps would make small runs a poor guide to large ones
    rows = keyed(docs).join(reps.hint("merge"), KEY).select("cid", "size", "text").mapInPandas(run, "cid long, size long, s array<long>")
    return staged(rows.dropDuplicates(["cid"]))


def _live(docs: DataFrame, rows: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """The classes that may be alike to another: cid, size, u, toks, k, sig, gid.

    A shingle of one class only is in no intersection. A class with as many such shingles as its prefix is long
    links with nothing. This is tested first on a part of the hash range, which drops most classes, then on all
    shingles of the classes left. toks are the shared shingles, rare ones first: above, their true number of classes
    in quarters of its binary logarithm, below, 56 bits of hash. u counts the other shingles; the first k of toks end
    the prefix; sig is a parity bit for each of 512 buckets of toks.
    """
    spread = rows.select("cid", F.explode("part").alias("h")).groupBy("h").agg(F.min("cid").alias("cid"), F.max("cid").alias("hi"))
    alone = staged(spread.filter("cid = hi").groupBy("cid").agg(F.count("*").alias("u")))
    left = classes.join(alone, "cid", "left").filter(f"coalesce(u, 0) < {prefix_size('size', percent)}").select("cid", "size", "rep.*")
    sets = _sets(docs, staged(left), n)
    each = sets.select("cid", F.explode("s").alias("h")).repartition("h")
    times = each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    token = F.expr(f"shiftleft(least(bigint(4 * log2(n)), 127L), 56) | (h & {(1 << 56) - 1}L)")
    held = each.join(times, "h").groupBy("cid").agg(F.sort_array(F.collect_list(token)).alias("toks"))  # a class's own shingles
    live = sets.select("cid", "size").join(held, "cid").withColumn("u", F.col("size") - F.size("toks"))
    live = live.withColumn("k", F.expr(f"cast({prefix_size('size', percent)} - u as int)")).filter("k > 0")
    sig = F.expr("transform(sequence(0, 7), i -> aggregate(filter(toks, h -> (shiftright(h, 6) & 7) = i), 0L, (b, h) -> b ^ shiftleft(1L, cast(h & 63 as int))))")
    prefix = F.when(F.col("u") == 0, F.xxhash64(F.slice("toks", 1, F.col("k")), "size")).otherwise(F.col("cid"))
    out = staged(live.select("cid", "size", "u", "toks", "k", sig.alias("sig"), prefix.alias("p")))
    dropped(alone, sets)
    return out


def _may(x: str, y: str, percent: int) -> str:
    """Whether sizes, and what follows a shared shingle, leave room enough for two classes to be alike."""
    return (f"100 * {x}.size >= {percent} * {y}.size and 100 * {y}.size >= {percent} * {x}.size and "
            f"{100 + percent} * (1 + least({x}.rest, {y}.rest)) >= {percent} * ({x}.size + {y}.size)")


def _parity(x: str, y: str, percent: int) -> str:
    """Parities differ in no more buckets than sets do in shingles, so no pair that is alike enough goes."""
    differ = " + ".join(f"bit_count({x}.sig[{i}] ^ {y}.sig[{i}])" for i in range(8))
    return f"{100 + percent} * ({x}.u + {y}.u + {differ}) <= {100 - percent} * ({x}.size + {y}.size)"


def _verified(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    a = live.select(F.col("cid").alias("a"), F.col("size").alias("na"), F.col("toks").alias("ta"))
    b = live.select(F.col("cid").alias("b"), F.col("size").alias("nb"), F.col("toks").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return staged(pairs.join(a, "a").join(b, "b").filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b"))


def _tagged(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("c", F.coalesce("root", "cid")).drop("root")


def _pivot_pairs(tagged: DataFrame, round_: int, percent: int) -> DataFrame:
    """Pairs of a few members of each posting list that holds several components with the rest: as many as members."""
    first = [F.min(F.struct(F.xxhash64("cid", F.lit(round_ * PIVOTS + i)).alias("x"), "cid", "size", "rest", "c")).alias(f"p{i}") for i in range(PIVOTS)]
    several = tagged.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), *first).filter("lo < hi")
    pivots = several.select("t", F.explode(F.array_distinct(F.array(*[F.struct(*[f"p{i}.{f}" for f in ("cid", "size", "rest", "c")]) for i in range(PIVOTS)]))).alias("p"))
    pairs = tagged.alias("m").join(pivots, "t").filter("m.c <> p.c and " + _may("m", "p", percent))
    return pairs.select(F.least("m.cid", "p.cid").alias("a"), F.greatest("m.cid", "p.cid").alias("b")).distinct()


def _rest_pairs(post: DataFrame, live: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """All other pairs of a posting list that may be alike and lie in two components.

    Members outside the list's largest component meet the whole list, so that a list in one component costs nothing.
    The filters are conditions of the join: what they reject is not emitted.
    """
    members = _tagged(live.select("cid", "size", "u", "sig", "lead"), comp)
    spread = post.select("t", F.col("cid").alias("lead"), "rest").join(members, "lead").select("t", "rest", "cid", "size", "u", "sig", "c")
    most = spread.groupBy("t", "c").agg(F.count("*").alias("n")).groupBy("t").agg(F.max(F.struct("n", "c")).alias("top"), F.count("*").alias("cs")).filter("cs > 1").select("t", F.col("top.c").alias("top"))
    rest = staged(spread.join(most, "t"))
    x, y = rest.filter("c <> top").alias("x"), rest.alias("y")
    on = F.expr(f"x.t = y.t and x.c <> y.c and (y.c = y.top or x.cid < y.cid) and {_may('x', 'y', percent)} and {_parity('x', 'y', percent)}")
    pairs = staged(x.join(y, on).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct())
    dropped(rest)
    return pairs


def _linked(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, tkey, cid, size) of docs; and node, root for the classes that are linked."""
    rows = _fingerprints(docs, n, percent)
    classes = staged(rows.filter("size > 0").groupBy("cid", "size").agg(F.min(F.struct(*KEY)).alias("rep")))
    live = _live(docs, rows, classes, n, percent)
    slim = staged(rows.select(*KEY, "cid", "size"))
    dropped(rows)
    groups = live.groupBy("p").agg(F.min("cid").alias("lead"))
    live = staged(live.join(groups, "p").drop("p"))
    inside = live.filter("cid <> lead").select(F.col("lead").alias("a"), F.col("cid").alias("b"))
    heads = live.filter("cid = lead").select("cid", "size", F.size("toks").alias("v"), F.posexplode(F.slice("toks", 1, F.col("k"))).alias("i", "t"))
    post = heads.select("t", "cid", "size", (F.col("v") - F.col("i") - 1).alias("rest"))
    post = staged(post.join(post.groupBy("t").agg(F.count("*").alias("n")).filter("n > 1").select("t"), "t"))
    # a list of one group whose members are several is kept too, for the pairs inside the group
    links = _verified(inside.distinct(), live, percent)
    comp = components(links)
    for i in range(ROUNDS):
        more = _verified(_pivot_pairs(_tagged(post, comp), i, percent), live, percent)
        if more.isEmpty():
            break
        links = links.unionByName(more)
        comp = components(links)
    own = live.join(live.filter("cid <> lead").select("lead").distinct(), "lead").filter("cid = lead").select("cid", "size", F.size("toks").alias("v"), F.col("toks")[0].alias("t"))
    own = own.select("t", "cid", "size", (F.col("v") - 1).cast("int").alias("rest"))  # members of a group share their first shingle
    more = _verified(_rest_pairs(post.unionByName(own).distinct(), live, comp, percent), live, percent)
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    return slim, comp


def _named(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows with root, the name of their component; null for rows without words."""
    return rows.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.expr("case when size > 0 then coalesce(root, cid) end"))


def jaccard_classes(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs.

    1. Rows with equal sets form one class, named by a hash of the set. Classes that share too few shingles
       with any other leave; see _live.
    2. Shingles are ordered by their true number of classes, rare ones first, and each class keeps its prefix.
       Classes with equal prefix and size form a group.
    3. Members of a group are compared with one leader, and members of a posting list of groups with a few
       pivots: as many comparisons as members. What this links becomes one component. Two rounds at most.
    4. Posting lists that still hold several components are expanded to members and give all pairs between
       these components that size, position and parity filters leave; verified pairs join components.
    No pair that could join two components is left out. Sets are compared as 64-bit hashes. Rows without words
    link with nothing, and their component is their own id; null text has none; a null doc_id is linked but
    names no component (null where a component has no other id); repeated rows share a class; an empty table
    gives an empty table; other columns are not read.
    """
    rows, comp = _linked(docs, n, percent)
    named = _named(rows, comp)
    real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    low = named.filter("root is not null").groupBy("root").agg(F.min(real).alias("low"))
    return named.join(low, "root", "left").select(real.alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("root").isNull(), real).otherwise(F.col("low")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that of the least doc_id (a null one last, then by a hash of the text), with the columns of docs.

    Near duplicates here are five-word shingles with a similarity of 0.8 or more. Equal rows are copies: one stays.
    Rows without words, null text among them, link with nothing and all stay. Rows with one doc_id and unlike
    texts are different documents. An empty table gives an empty table.
    """
    rows, comp = _linked(docs, n, percent)
    order = F.struct((F.col("doc_id") == NO_ID).alias("last"), *KEY)
    keep = staged(_named(rows, comp).filter("root is not null").groupBy("root").agg(F.min(order).alias("m")).select("m.doc_id", "m.tkey"))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    got = docs.filter(~wordless).select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("tkey"))
    return got.join(keep.hint("merge"), KEY).dropDuplicates(KEY).select("row.*").unionByName(docs.filter(wordless))
