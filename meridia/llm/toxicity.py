"""Toxicity: cumulative-link ordinal regression on sparse word features."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BITS = 20
STEMS = (4, 5, 6)
SAMPLE = 6000  # labelled rows the model is fitted on at most, by hash of doc_id


def letters(text: Column) -> Column:
    """Distinct runs of letters and digits of the whole text, in lower case; signs around a word do not make it another."""
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")), lambda w: w != "")


def features(ws) -> np.ndarray:
    """Hashed features of a text's distinct words: the words, and their beginnings of 4 to 6 letters, which stems share."""
    parts = {w.encode("utf-8", "replace") for w in ws} | {b"^" + w[:n].encode("utf-8", "replace") for w in ws for n in STEMS if len(w) > n}
    return np.unique(np.fromiter((zlib.crc32(p) & ((1 << BITS) - 1) for p in parts), np.int64))


def row_weights(rows: list[np.ndarray], labels: np.ndarray, bands: int = 10, width: int = 6, alike: float = 0.8) -> np.ndarray:
    """1 for a row, and a share of 1 for each of several near copies with one label, which they carry once, not many times.

    Min-hash bands name candidates; a row joins the first one of its band whose features it shares by `alike`.
    """
    draw = np.random.default_rng(5)
    a, c = (draw.integers(0, 1 << 31, (bands * width, 1), np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    group = list(range(len(rows)))

    def root(i: int) -> int:
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    first: dict[tuple, int] = {}
    for i, f in enumerate(rows):
        if len(f):
            low = ((f.astype(np.uint64)[None, :] * a + c) & np.uint64(0xFFFFFFFF)).min(1).reshape(bands, width)
            for k, band in enumerate(low):
                j = first.setdefault((k, bool(labels[i]), *band.tolist()), i)
                if root(j) != root(i):
                    both = len(np.intersect1d(f, rows[j], assume_unique=True))
                    if both >= alike * (len(f) + len(rows[j]) - both):
                        group[root(i)] = root(j)
    names = [root(i) for i in range(len(rows))]
    n = Counter(names)
    return np.array([1 / n[k] for k in names])


class Ordinal:
    """P(grade > k) = sigmoid(w.x - theta_k): one weight vector, ordered thresholds."""

    def __init__(self, keep: np.ndarray, w: np.ndarray, theta: np.ndarray) -> None:
        self.index, self.w, self.theta = {int(k): i for i, k in enumerate(keep)}, w, theta

    def severity(self, f: np.ndarray) -> float:
        z = sum(self.w[i] for x in f if (i := self.index.get(int(x))) is not None)
        return float((1 / (1 + np.exp(self.theta - z))).sum())

    @staticmethod
    def fit(rows: list[np.ndarray], grade: np.ndarray, grades: int, steps: int = 600, l2: float = 1e-4, z_min: float = 3.5) -> Ordinal:
        """Words that mark grades above 0 (weight of 3 rows or more, z over z_min) get weights by gradient steps on the ordinal likelihood."""
        y = grade > 0
        if not len(rows) or y.all() or not y.any():
            return Ordinal(np.array([], int), np.array([]), np.full(grades - 1, 6.0))
        each = row_weights(rows, y)
        n1, n0 = each[y].sum(), each[~y].sum()
        pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for f, t, c in zip(rows, y, each):
            (pos if t else neg)[f] += c
        p = (pos + neg) / (n1 + n0)
        z = (pos / n1 - neg / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
        keep = np.flatnonzero((z > z_min) & (pos >= 3))
        x = np.zeros((len(rows), len(keep)), np.float32)
        place = {int(k): i for i, k in enumerate(keep)}
        for i, f in enumerate(rows):
            x[i, [place[int(v)] for v in f if int(v) in place]] = 1
        w, theta = np.zeros(len(keep)), np.arange(1, grades, dtype=float)
        over = grade[:, None] > np.arange(grades - 1)
        mom = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(theta), np.zeros_like(theta)]
        for t in range(1, steps + 1):
            d = (1 / (1 + np.exp(np.clip(theta - (x @ w)[:, None], -30, 30))) - over) * (each / each.sum())[:, None]
            for k, (v, g) in enumerate(((w, x.T @ d.sum(1) + l2 * w), (theta, -d.sum(0)))):
                m, s = mom[2 * k], mom[2 * k + 1]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
            theta = np.maximum.accumulate(theta)
        return Ordinal(keep, w, theta)


def fit_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Fits on a bounded sample of labelled rows.

    Labels know toxic 0 or 1; grades above 1 come from the distinct words that mark toxic rows: a toxic
    row's grade is 1, or 2 if its count of marked words is above the toxic rows' median.
    """
    lab = labels.filter("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    got = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").select(letters(F.col("text")).alias("w"), "toxic")
    rows, y = [], []
    for r in got.toLocalIterator():
        rows.append(features(r["w"]))
        y.append(r["toxic"])
    y = np.array(y, int)
    flat = Ordinal.fit(rows, y, 2)
    marked = np.array([sum(int(v) in flat.index for v in f) for f in rows])
    mid = np.median(marked[y > 0]) if (y > 0).any() else 0
    return Ordinal.fit(rows, np.where(y > 0, 1 + (marked > mid), 0), 3)


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity (expected grade, 0 to 2), grade and toxic (severity of 0.5 or more) of each whole text.

    Null and empty texts have no features, as have texts without letters and digits; without usable labels all severities
    are near 0. Labels of null, and of ids that docs has not, are passed over; an id labelled twice counts twice.
    Equal z values are all kept or all left. A null doc_id is scored; repeated rows give repeated results; an empty
    table gives none; other columns are not read. The model (kilobytes) travels with the tasks.
    """
    model = fit_model(docs, labels)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = np.array([model.severity(features(w)) for w in b["w"]], float)
            yield pd.DataFrame({"doc_id": b["doc_id"].array, "severity": s, "grade": np.rint(s).astype(int), "toxic": s >= 0.5})

    ws = docs.select("doc_id", letters(F.col("text")).alias("w"))
    return ws.mapInPandas(score, "doc_id long, severity double, grade long, toxic boolean")
