"""Benchmark decontamination: rare n-gram seeds, then local alignment of words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, ascii_lower, staged, words
from .passages import rolled

MATCH, MISMATCH, GAP = 2, -1, -1
MARKS = 22
PAIR = 0x9E3779B97F4A7C15  # sets the hashes of pairs apart from those of runs of two words


def align(doc: list[str], item: list[str]) -> tuple[int, int, int]:
    """Best local alignment score of two word lists, and where it ends in doc and item.

    Smith-Waterman by rows of the document; the gap along the item is a running maximum.
    """
    ids: dict[str, int] = {}
    b = np.array([ids.setdefault(w, len(ids)) for w in item], np.int32)
    prev, best, at = np.zeros(len(b) + 1, np.int32), 0, (0, 0)
    steps = -GAP * np.arange(len(b) + 1, dtype=np.int32)
    for i, w in enumerate(doc):
        hit = b == ids.get(w, -1)
        row = np.zeros(len(b) + 1, np.int32)
        row[1:] = np.maximum(np.maximum(prev[:-1] + np.where(hit, MATCH, MISMATCH), prev[1:] + GAP), 0)
        prev = np.maximum.accumulate(row + steps) - steps
        m = int(prev.max())
        if m > best:
            best, at = m, (i, int(prev.argmax()) - 1)
    return best, at[0], at[1]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with two 64-bit hashes of the text: a row is known by its doc_id, null or not, and its text."""
    return docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("text"), F.col("text"))})


def word_hashes(text: str | None, seen: WordHashes) -> np.ndarray:
    ws = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []  # bytes: A-Z and ASCII blanks only
    return np.fromiter(map(seen.__getitem__, ws), np.uint64, len(ws))


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    return rolled(h ^ np.uint64(k), k)


def pairs_of(h: np.ndarray) -> np.ndarray:
    """Hashes of all pairs of adjacent words, others than those of runs_of."""
    return rolled(h ^ np.uint64(PAIR), 2)


def item_seeds(items: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Two tables of seeds: item, h of all runs of n words of each item (an item of fewer words is one run of its own length);
    and item, h, need, reach of the rarer pairs of words of longer items.

    An item keeps the two thirds of its pairs that fewest items hold. An alignment of half the full score leaves two thirds of
    the words where all edits are replacements, so a third of the pairs, wherever they lie; `need` is a sixth of those kept, two
    at least, to be met within `reach` words, twice the item.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = WordHashes()
        for b in batches:
            hs = [word_hashes(t, seen) for t in b["text"]]
            got = [np.unique(runs_of(h, min(n, len(h)))) for h in hs] + [np.unique(pairs_of(h)) if len(h) > n else np.zeros(0, np.int64) for h in hs]
            size = [len(x) for x in got]
            kind = np.repeat(np.arange(2), [sum(size[: len(hs)]), sum(size[len(hs) :])])
            yield pd.DataFrame({"item": np.repeat(np.tile(b["item"].to_numpy(), 2), size), "h": np.concatenate([*got, np.zeros(0, np.int64)]), "pair": kind == 1})

    s = staged(items.select("item", F.array_join("iw", " ").alias("text")).mapInPandas(run, "item long, h long, pair boolean"))
    pairs = s.filter("pair")
    rarity = pairs.join(pairs.groupBy("h").agg(F.count("*").alias("held")), "h").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("held", "h")))
    kept = rarity.join(pairs.groupBy("item").agg(F.ceil(F.count("*") * 2 / 3).alias("most")), "item").filter("rank <= most")
    need = F.greatest(F.lit(2), F.ceil(F.col("most") / 6)).cast("int")
    sized = items.select("item", (2 * F.size("iw")).alias("reach"))
    return s.filter("not pair").select("item", "h"), kept.join(sized, "item").select("item", "h", need.alias("need"), "reach")


def marks(runs: DataFrame, pairs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of 2**MARKS buckets of hashes: a bit where a run falls in, and the least need and greatest reach of the pairs in it.

    need is 255 where there is no pair and counts to 254, reach goes in steps of 16 words to 254, 255 stands for more: some nine
    megabytes, whatever the number of seeds, built in blocks of 2**12 buckets.
    """
    block, bucket = F.expr(f"cast((h & {(1 << MARKS) - 1}) >> 12 as int)").alias("block"), F.expr("cast(h & 4095 as int)").alias("bucket")
    none = F.lit(None).cast("int")
    both = runs.select(block, bucket, none.alias("need"), none.alias("reach")).unionByName(pairs.select(block, bucket, "need", "reach"))
    each = both.groupBy("block", "bucket").agg(F.max(F.col("need").isNull()).alias("run"), F.min("need").alias("need"), F.max("reach").alias("reach"))

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((3, 4096), np.uint8)
        out[1] = 255
        out[0, g["bucket"]] = g["run"]
        p = g.dropna(subset=["need"])
        out[1, p["bucket"]] = np.minimum(p["need"], 254)
        out[2, p["bucket"]] = np.minimum(-(-p["reach"] // 16), 255)
        return pd.DataFrame({"block": g["block"][:1], "bytes": [out.tobytes()]})

    all_ = np.zeros((3, 1 << MARKS), np.uint8)
    all_[1] = 255
    for r in each.groupBy("block").applyInPandas(packed, "block int, bytes binary").toLocalIterator():
        all_[:, r["block"] << 12 : r["block"] + 1 << 12] = np.frombuffer(r["bytes"], np.uint8).reshape(3, 4096)
    return np.packbits(all_[0]), all_[1], all_[2]


def may_be_among(keys: DataFrame) -> Column:
    """Whether t1 may be among those of keys: by a bit for each of 2**MARKS buckets, half a megabyte whatever their number."""
    block, at = F.expr(f"cast((t1 & {(1 << MARKS) - 1}) >> 12 as int)").alias("block"), F.expr("cast(t1 & 4095 as int)").alias("at")

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(4096, bool)
        out[g["at"]] = True
        return pd.DataFrame({"block": g["block"][:1], "bytes": [np.packbits(out).tobytes()]})

    bits = np.zeros((1 << MARKS - 12, 512), np.uint8)
    for r in keys.select(block, at).distinct().groupBy("block").applyInPandas(packed, "block int, bytes binary").toLocalIterator():
        bits[r["block"]] = np.frombuffer(r["bytes"], np.uint8)
    flat = bits.reshape(-1)

    @F.pandas_udf("boolean")
    def marked(t1: pd.Series) -> pd.Series:
        b = t1.to_numpy(np.int64) & ((1 << MARKS) - 1)
        return pd.Series((flat[b >> 3] >> (7 - (b & 7)).astype(np.uint8) & 1).astype(bool))

    return marked(F.coalesce(F.col("t1"), F.lit(0)))


def crowded(pos: np.ndarray, need: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which of the places lie among as many others, within their reach on both sides, as they need."""
    return np.searchsorted(pos, pos + reach, "right") - np.searchsorted(pos, pos - reach, "left") >= need


def seed_hits(docs: DataFrame, runs: DataFrame, pairs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, t1, t2, item, pos wherever a document has a run of an item, or as many of its pairs close together as it needs.

    Runs whose bucket no seed falls in are left out where they lie, and so are pairs that too few marked pairs stand around;
    the others meet the seeds by a join on the hash, and an item's own pairs are then counted again, so nothing depends on
    the buckets but the number of rows. A hash that very many documents hold meets its seeds in
    one task, unless the runtime's skew join splits it.
    """
    packed, least, far = marks(runs, pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, bits, mask = WordHashes(), np.unpackbits(packed).view(bool), (1 << MARKS) - 1
        for b in batches:
            if not len(b):
                continue
            got = []
            for t in b["text"]:
                h = word_hashes(t, seen)
                at = []
                for k in sizes:
                    r = runs_of(h, k)
                    pos = np.flatnonzero(bits[r & mask])
                    at.append((r[pos], pos, np.zeros(len(pos), bool)))
                r = pairs_of(h)
                pos = np.flatnonzero(least[r & mask] < 255)
                reach = far[r[pos] & mask].astype(np.int64)
                pos = pos[crowded(pos, least[r[pos] & mask], np.where(reach == 255, len(h), reach * 16))]
                at.append((r[pos], pos, np.ones(len(pos), bool)))
                got.append([np.concatenate(x) for x in zip(*at)])
            out = b[["doc_id", "t1", "t2"]].loc[b.index.repeat([len(g[0]) for g in got])].reset_index(drop=True)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.assign(**{c: np.concatenate([g[i] for g in got]) for i, c in enumerate(("h", "pos", "pair"))})

    seeds = runs.select("item", "h", F.lit(False).alias("pair"), F.lit(0).alias("need"), F.lit(0).alias("reach")).unionByName(pairs.withColumn("pair", F.lit(True)))
    met = keyed(docs.select("doc_id", "text")).mapInPandas(run, "doc_id long, t1 long, t2 long, h long, pos int, pair boolean").join(seeds, ["h", "pair"])
    row = ["doc_id", "t1", "t2", "item"]
    hits = met.distinct().groupBy(*row).agg(F.max("need").alias("need"), F.max("reach").alias("reach"), F.array_sort(F.collect_list(F.when(F.col("pair"), F.col("pos")))).alias("p"), F.collect_set(F.when(~F.col("pair"), F.col("pos"))).alias("r"))
    # of an item's pairs in a document those stay that begin, end or lie within a stretch of `need` of them no longer than the reach
    first = F.transform("p", lambda x, i: F.coalesce(F.get("p", i + F.col("need") - 1) - x <= F.col("reach"), F.lit(False)))
    dense = F.filter("p", lambda x, i: F.exists(F.slice("first", F.greatest(i - F.col("need") + 2, F.lit(1)), F.least(F.col("need"), i + 1)), lambda f: f))
    near = hits.withColumn("first", first).select(*row, F.when(F.col("need") > 0, dense).otherwise(F.array().cast("array<int>")).alias("p"), "r")
    return near.select(*row, F.explode(F.array_union("p", "r")).alias("pos"))


def findings(docs: DataFrame, benchmark: DataFrame, n: int, least: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, t1, t2, item, score, end_word, ratio of each passage that reaches `least`; and the items' ids by item."""
    named = staged(benchmark.select("item_id", words(ascii_lower(F.col("text"))).alias("iw")).filter(F.size("iw") > 0).distinct())
    items = staged(named.select("iw").distinct().select(F.monotonically_increasing_id().alias("item"), "iw"))
    names = named.join(items, "iw").select("item_id", "item")
    runs, pairs = item_seeds(items, n)
    pairs = staged(pairs)
    d = keyed(docs.select("doc_id", "text"))
    row = ["doc_id", "t1", "t2"]
    sizes = sorted(r[0] for r in items.select(F.least(F.size("iw"), F.lit(n)).alias("k")).distinct().collect())  # n at most
    hits = staged(seed_hits(docs, runs, pairs, sizes)) if sizes else staged(runs.sparkSession.createDataFrame([], "doc_id long, t1 long, t2 long, item long, pos int"))
    pair = Window.partitionBy(*row, "item").orderBy("pos")
    sized = hits.join(items.select("item", F.size("iw").alias("k")), "item").withColumn("gap", F.col("pos") - F.lag("pos").over(pair))
    run = sized.withColumn("run", F.sum(F.when(F.col("gap") > 2 * F.col("k"), 1).otherwise(0)).over(pair))
    spans = staged(run.groupBy(*row, "item", "run").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.first("k").alias("k")))
    passage = F.slice(words(ascii_lower(F.col("text"))), F.greatest(F.col("lo") - F.col("k"), F.lit(0)) + 1, F.col("hi") - F.col("lo") + 2 * F.col("k") + n)
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.t1") == F.col("s.t1")) & (F.col("d.t2") == F.col("s.t2"))
    # texts that no span names stay where they lie, and only the others are shuffled
    cut = spans.alias("s").join(d.filter(may_be_among(spans)).alias("d"), same).select("s.doc_id", "s.t1", "s.t2", "item", F.greatest(F.col("lo") - F.col("k"), F.lit(0)).alias("from"), passage.alias("p")).join(items, "item")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # twice the words in common bounds the score: a passage below that needs no alignment
            may = [sum((Counter(p) & Counter(i)).values()) >= least * len(i) for p, i in zip(b["p"], b["iw"])]
            b = b[may]
            got = [align(list(p), list(i)) for p, i in zip(b["p"], b["iw"])]
            full = b["iw"].map(len) * MATCH
            out = b[["doc_id", "t1", "t2", "item"]].assign(score=pd.Series([g[0] for g in got], b.index, "int64"), end_word=b["from"] + pd.Series([g[1] for g in got], b.index, "int64"))
            out["doc_id"] = b["doc_id"].astype("Int64")
            yield out.assign(ratio=out["score"] / full)

    found = cut.repartition("doc_id", "t1", "t2", "item", "from").mapInPandas(score, "doc_id long, t1 long, t2 long, item long, score long, end_word long, ratio double")
    return found.filter(F.col("ratio") >= least), names


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 4, least: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, ratio, end_word: the documents that hold a copy of an item, edited ones too.

    Seeds are all n-word shingles of the items, and for copies whose every third or fourth word is another the
    rarer pairs of adjacent words, a sixth of which must stand close together; items of equal words are sought once
    and reported under each id; an item of fewer words is one seed of its own length and needs that exact run.
    Seeds that meet a document give a passage around them, as wide as the item on both sides; passages of one item that touch are
    one. The alignment's score over the full score (2 per word of the item) must reach `least`. Case of A-Z is
    ignored. Null texts have no words and match nothing; null ids are kept as they are, and as they name
    nothing, each of their texts has its own result; repeated rows give one result per doc_id; empty tables
    give an empty result. Sides are broadcast only where the session's size threshold allows it.
    """
    found, names = findings(docs, benchmark, n, least)
    named = found.join(names, "item")
    unnamed = [F.when(F.col("doc_id").isNull(), F.col(c)) for c in ("t1", "t2")] + [F.when(F.col("item_id").isNull(), F.col("item"))]
    best = Window.partitionBy("doc_id", "item_id", *unnamed).orderBy(F.desc("score"), "end_word")
    return named.withColumn("n", F.row_number().over(best)).filter("n = 1").select("doc_id", "item_id", "score", "end_word", "ratio")


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 4, least: float = 0.5) -> DataFrame:
    """The rows of docs that hold no item, with all their columns. Cases as in contamination.

    A row is known by its doc_id, null or not, and two hashes of its text, so repeated rows share their fate and
    rows of one id with other texts do not. Null texts stay; without a benchmark all rows stay.
    """
    found, _ = findings(docs, benchmark, n, least)
    bad = staged(found.select(F.col("doc_id").alias("i"), F.col("t1").alias("a"), F.col("t2").alias("b")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("a")) & (F.xxhash64(F.lit("text"), F.col("text")) == F.col("b"))
    return docs.join(bad, same, "left_anti").select(*docs.columns)
