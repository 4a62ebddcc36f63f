"""Periodic runs of words by divide and conquer with Z-functions, and texts with runs collapsed to one period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh

FRAME_BYTES = 4 << 20  # texts that are searched together, so that numpy's overhead is shared; a longer text goes alone
LOOK = 16  # words that a screened position is compared on before its segment's Z-functions are made
RUNS = "array<struct<start: long, length: long, period: long>>"


class Ids(dict):
    """Words as small integers, in the order they are met."""

    def __missing__(self, w: bytes) -> int:
        self[w] = n = len(self)
        return n


def z_function(s: list[int]) -> list[int]:
    """Length of the longest common prefix of s and each of its suffixes; that of s itself is its length."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _crossing(s: list[int], m: int, least: int) -> dict[tuple[int, int], int]:
    """(start, end) -> smallest period of the repetitions of s that cross m, as far as s goes."""
    n = len(s)
    ahead = z_function(s[m:] + [-1] + s)[n - m + 1 :]  # common words from j on and from m on
    back = z_function(s[:m][::-1] + [-1] + s[::-1])[m + 1 :][::-1]  # common words before j + 1 and before m
    f, b = np.array(ahead + [0]), np.array([0] + back)
    j = np.arange(n + 1)
    p = np.abs(j - m)
    at = np.flatnonzero((p > 0) & (f + b >= p) & (f + b + p >= least))
    at = at[np.argsort(p[at], kind="stable")]
    start, end = (np.minimum(j, m) - b)[at], (np.maximum(j, m) + f)[at]
    _, first = np.unique(start * (n + 1) + end, return_index=True)  # of an interval, the smallest period
    return dict(zip(zip(start[first].tolist(), end[first].tolist()), p[at][first].tolist()))


def _reach(w: np.ndarray, j: np.ndarray, m: np.ndarray, step: int, stop: np.ndarray) -> np.ndarray:
    """Equal words at j and m onwards (step 1) or before them (step -1), LOOK at most, within the segment."""
    got, live = np.zeros(len(j), np.int64), np.arange(len(j))
    for k in range(LOOK):
        a, b = (j[live] + k, m[live] + k) if step > 0 else (j[live] - 1 - k, m[live] - 1 - k)
        inside = np.maximum(a, b) < stop[live] if step > 0 else np.minimum(a, b) >= stop[live]
        live, a, b = live[inside], a[inside], b[inside]
        live = live[w[a] == w[b]]
        if not len(live):
            break
        got[live] += 1
    return got


def find_runs(w: np.ndarray, ends: np.ndarray, least: int) -> dict[int, list[tuple[int, int, int]]]:
    """text -> (start, length, period) of its maximal runs of at least `least` words and two periods.

    w holds the word numbers of all texts one after another, ends where each text ends. All texts are halved level by
    level. A run lies across the middle of the smallest segment that holds it whole. There, a position j whose common
    words with the middle m, onwards (f) and before (b), make f + b >= |j - m| gives a repetition of period |j - m|.
    One of f and b is a quarter of `least` or more: three-word hashes drop nearly all positions, LOOK words nearly
    all that are left, and Z-functions of the segment tell the lengths. A repetition that goes on beyond its segment
    is found whole in a larger one. Of equal intervals the smallest period stays.
    """
    gram = max(1, min(3, least // 4))
    n = len(w)
    h = np.concatenate([w.astype(np.uint64) + np.uint64(1), np.zeros(2 * gram + 2, np.uint64)])
    g = h[: n + gram + 2].copy()
    for k in range(1, gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[k : n + gram + 2 + k]
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    lo, hi, text = starts, ends.astype(np.int64), np.arange(len(ends))
    found: dict[tuple[int, int, int], int] = {}
    while True:
        big = hi - lo >= least
        lo, hi, text = lo[big], hi[big], text[big]
        if not len(lo):
            break
        m, size = (lo + hi) // 2, hi - lo
        seg = np.repeat(np.arange(len(lo)), size)
        j = np.arange(len(seg)) + np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        like = g[j] == np.repeat(g[m], size)
        like |= g[np.maximum(j - gram, 0)] == np.repeat(g[np.maximum(m - gram, 0)], size)
        like[j == m[seg]] = False
        at = np.flatnonzero(like)
        j, seg = j[at], seg[at]
        # the segment's end is a position too: what lies before it may equal what lies before the middle
        e = np.flatnonzero(g[hi - gram] == g[m - gram])
        j, seg = np.concatenate([j, hi[e]]), np.concatenate([seg, e])
        f = _reach(w, j, m[seg], 1, hi[seg])
        b = _reach(w, j, m[seg], -1, lo[seg])
        p = np.abs(j - m[seg])
        for s in np.unique(seg[(f == LOOK) | (b == LOOK) | ((f + b >= p) & (f + b + p >= least))]).tolist():
            a, z, t = int(lo[s]), int(hi[s]), int(text[s])
            first, last = int(starts[t]), int(ends[t])
            for (x, y), q in _crossing(w[a:z].tolist(), int(m[s]) - a, least).items():
                x, y = x + a, y + a
                if (x == a > first and w[x - 1] == w[x - 1 + q]) or (y == z < last and w[y] == w[y - q]):
                    continue
                if found.get((t, x, y), q) >= q:
                    found[t, x, y] = q
        lo, hi, text = np.concatenate([lo, m]), np.concatenate([m, hi]), np.concatenate([text, text])
    out: dict[int, list[tuple[int, int, int]]] = {}
    for (t, x, y), q in found.items():
        out.setdefault(t, []).append((x - int(starts[t]), y - x, q))
    return {t: sorted(r, key=lambda v: (v[0], v[2])) for t, r in out.items()}


def _search(texts: list[list[bytes]], least: int) -> list[tuple[list[tuple[int, int, int]], str]]:
    ids = Ids()
    w = np.fromiter((ids[x] for t in texts for x in t), np.int64)
    runs = find_runs(w, np.cumsum([len(t) for t in texts]), least)
    out = []
    for t, ws in enumerate(texts):
        got = runs.get(t, [])
        if got:
            change = np.zeros(len(ws) + 1, np.int64)
            for start, length, q in got:
                change[start + q] += 1
                change[start + length] -= 1
            ws = [ws[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        out.append((got, b" ".join(ws).decode("utf-8", "surrogatepass")))
    return out


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """The rows of docs with two more columns: `runs` (start, length, period of each maximal run, by start) and `collapsed`.

    A run is a stretch of words with smallest period q, of `least` words and 2 q words or more, that no neighbouring
    word extends; collapsed is the text without the words that a run holds after its first q. See find_runs for the
    method. Null text and text without words have no runs and an empty collapsed text; equal rows give equal rows; a
    column of docs that is already called runs or collapsed is replaced; an empty table gives an empty table. Nothing
    is shuffled: each text is searched where it lies, texts in frames of FRAME_BYTES.
    """
    keep, text = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")], fresh(docs, "text")
    rows = docs.withColumn(text, F.col("text")).select(*keep, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            frame: list[list[bytes]] = []
            got, held = [], 0
            for t in b[text]:
                raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
                frame.append(raw.split())
                held += len(raw)
                if held >= FRAME_BYTES:
                    got += _search(frame, least)
                    frame, held = [], 0
            got += _search(frame, least)
            yield b[keep].assign(runs=[[dict(zip(("start", "length", "period"), r)) for r in x] for x, _ in got], collapsed=[c for _, c in got])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInPandas(run, f"{fields}, runs {RUNS}, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts, by crc32 of the id, repeat a stretch to their end; a null id leaves its text as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    ws = F.filter(F.split("text", SPACE), lambda w: w != "")
    d = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, ws).alias("ws")).withColumn("n", F.size("ws"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    times = (3 + F.col("g") % 8).cast("int")
    d = d.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / times)).cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("ws", F.col("a") + 1, F.col("p")), times)), F.lit(1), F.col("n") - F.col("a"))
    return d.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def run_table(docs: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest run and digests of all runs and of the collapsed text, of docs with repeats put in."""
    rows = periodic_runs(with_repeats(docs))
    order = lambda a, b: F.when(a["length"] != b["length"], F.when(a["length"] > b["length"], -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.signum(a["period"] - b["period"]).cast("int"))
    top = rows.withColumn("top", F.get(F.array_sort("runs", order), F.lit(0)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
