"""Substring dedup: repeated passages are confirmed, and located in every text by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
from bisect import bisect
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, staged

GRAM = 6
SHARD = 1 << 21  # bytes of words in a shard, above which it is closed
STEP = 1 << 16  # bytes that are hashed at a time; longer words are hashed one by one
MOST_CODES = 1 << 18
NO_ID = -(2**63)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))).view(np.int64)


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)).view(np.uint64)  # a fixed random number for each byte
UP, DOWN = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(STEP, x, np.uint64)])) for x in (BASE, BASE_INVERSE))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by a polynomial over 2**64 and a final mix."""
    if len(h) < n:
        return np.zeros(0, np.int64)
    h = h ^ (h >> np.uint64(29))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= np.uint64(BASE)
        out += h[k : len(h) - n + 1 + k]
    return mixed(out)


def ranged(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the words lo to hi (exclusive), for each pair: differences of prefix sums, moved to power 0."""
    up, down = np.full(len(h) + 1, BASE, np.uint64), np.full(len(h) + 1, BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((h ^ (h >> np.uint64(29))) * up[:-1])])
    return mixed((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def minimizers(g: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` grams, the place of its least hash (the first of ties)."""
    at, wide = np.arange(len(g)), 1
    while wide < span:
        k = min(wide, span - wide)
        a, b = at[:-k], at[k:]
        at = np.where(g[b] < g[a], b, a)
        wide += k
    return at


def hashed(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of each word of a text of bytes, by its bytes from lo to hi (exclusive), which ascend."""
    out, at = np.empty(len(lo), np.uint64), 0
    while at < len(lo):
        first = int(lo[at])
        to = int(np.searchsorted(hi, first + STEP, "right"))
        if to == at:
            out[at] = xxhash.xxh64_intdigest(text[first : hi[at]].tobytes())
            to += 1
        else:
            x = BYTES[text[first : hi[to - 1]]]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * UP[: len(x)])])
            a, b = lo[at:to] - first, hi[at:to] - first
            out[at:to] = mixed((sums[b] - sums[a]) * DOWN[a] + (b - a).astype(np.uint64)).view(np.uint64)
        at = to
    return out


def worded(lines: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of lines whose words stand one space apart, and the word's line."""
    text = np.frombuffer(lines, np.uint8)
    gap = np.flatnonzero((text == 32) | (text == 10))
    lo, hi = np.concatenate([[0], gap + 1]), np.concatenate([gap, [len(text)]])
    line = np.concatenate([[0], np.cumsum(text[gap] == 10)])
    word = hi > lo  # a line may be empty
    return hashed(text, lo[word], hi[word]), line[word]


def segments(h: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, segment hash, line, first and last window start in it of each run of windows of a line that choose one anchor."""
    at = np.flatnonzero(line[: max(len(h) - n + 1, 0)] == line[n - 1 :])  # windows that end in their line
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    g = rolled(h, GRAM)
    anchor = minimizers(g, n - GRAM + 1)[at]
    new = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(line[at]) != 0)) + 1
    lo, hi = at[np.concatenate([[0], new])], at[np.concatenate([new - 1, [len(at) - 1]])]
    of = line[lo]
    start = np.searchsorted(line, of)
    return g[anchor[np.concatenate([[0], new])]], ranged(h, lo, hi + n), of, lo - start, hi - start


def _packed(docs: DataFrame, n: int) -> DataFrame:
    """A row per shard, some documents of one task.

    It holds their ids, their words compressed, anchor and place of all segments, and of each different segment anchor,
    hash, first place and number, so that copies in one shard travel as one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack, part = zstandard.ZstdCompressor(3), TaskContext.get().partitionId()
        ids, lines, size, k = [], [], 0, 0

        def shard() -> pd.DataFrame:
            text = b"\n".join(lines)
            g, s, doc, lo, hi = segments(*worded(text), n)
            o = np.lexsort((s, g))
            new = np.concatenate([[True], (np.diff(g[o]) != 0) | (np.diff(s[o]) != 0)])[: len(o)]
            first = o[new]  # the sort is stable
            held = np.diff(np.concatenate([np.flatnonzero(new), [len(o)]]))
            return pd.DataFrame({"shard": [(part << 32) + k], "ids": [ids], "z": [pack.compress(text)], "g": [g], "doc": [doc], "lo": [lo], "hi": [hi], "ug": [g[first]], "us": [s[first]], "uj": [first], "un": [held]})

        for b in batches:
            for i, t in zip(b["doc_id"], b["text"]):
                ids.append(i)
                lines.append(b" ".join(t.encode("utf-8", "surrogatepass").split()) if isinstance(t, str) else b"")
                size += len(lines[-1])
                if size >= SHARD or len(ids) >= SHARD >> 7:
                    yield shard()
                    ids, lines, size, k = [], [], 0, k + 1
        if ids:
            yield shard()

    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), "text")
    return bucketed(rows.mapInPandas(run, "shard long, ids array<long>, z binary, g array<long>, doc array<int>, lo array<int>, hi array<int>, ug array<long>, us array<long>, uj array<int>, un array<int>"), "shard")


class Words(dict):
    """Code of each word of a task's shards: a run of digits with an alphabet for each place, so that matches start at words."""

    DIGITS, WIDTH = 128, 3  # two million words, more than a shard can hold unless one text is larger than it

    def __missing__(self, w: bytes) -> str:
        i, out = len(self), []
        for place in range(self.WIDTH):
            i, digit = divmod(i, self.DIGITS)
            out.append(chr(1 + place * self.DIGITS + digit + (i * self.DIGITS * self.WIDTH if place == self.WIDTH - 1 else 0)))
        self[w] = code = "".join(out)
        return code


class Automaton:
    """Aho-Corasick over texts whose words are coded by Words."""

    def __init__(self, phrases: set[str]) -> None:
        import ahocorasick

        self.found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in phrases:
            self.found.add_word(p)
        self.found.make_automaton()

    def places(self, coded: str) -> np.ndarray:
        """First word and the word after the last of every occurrence of every phrase."""
        hits = np.array([(end + 1, size) for end, size in self.found.iter(coded)], np.int64).reshape(-1, 2) // Words.WIDTH
        return np.column_stack([hits[:, 0] - hits[:, 1], hits[:, 0]])


def removed(docs: DataFrame, n: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row: words in a window of n words that starts elsewhere too are gone.

    1. Equal windows choose equal anchors: the least-hashed run of GRAM words inside. The windows in a row that
       choose one anchor make a segment; anchors that stand once are left out.
    2. A segment found twice or more is confirmed as a passage. Where an anchor has several different segments, the
       windows of one copy of each are compared; runs of windows found again in a segment that stands once are
       passages as well. Anchor and segment or window are compared by 64 bits of hash each.
    3. Documents lie in shards of a bounded size. For each shard the confirmed passages that stand in it make an
       Aho-Corasick automaton; the stretches of the shard's documents whose windows choose a passage's anchor stream
       through it, and every occurrence is cut. A copy of a passage chooses the same anchors, so none lies elsewhere.
    An automaton holds no more than its own shard's words, and each document is read by one automaton, so work is
    in proportion to the input. Repeated rows count as other places. Null text and texts under n words lose
    nothing; an empty table gives none; a null doc_id is kept; other columns are not read.
    """
    packed = _packed(docs, n)
    each = packed.select("shard", F.explode(F.arrays_zip("ug", "us", "uj", "un")).alias("x")).select("shard", F.col("x.ug").alias("g"), F.col("x.us").alias("s"), F.col("x.uj").alias("j"), F.col("x.un").alias("n"))
    often = each.groupBy("g").agg(F.sum("n").alias("c")).filter("c > 1").select("g")
    held = staged(each.join(often, "g"))
    kinds = staged(held.groupBy("g", "s").agg(F.sum("n").alias("n"), F.min(F.struct("shard", "j")).alias("m")))
    whole = held.select("shard", "g", "s", "j").join(kinds.filter("n > 1").select("g", "s"), ["g", "s"])
    several = kinds.groupBy("g").agg(F.count("*").alias("c")).filter("c > 1").select("g")
    one = kinds.join(several, "g").select("m.shard", F.struct("m.j", (F.col("n") == 1).alias("once")).alias("r"))
    asked = one.groupBy("shard").agg(F.collect_list("r").alias("r"))  # bounded by a shard's size

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        un = zstandard.ZstdDecompressor()
        for b in batches:
            for shard, z, g, doc, lo, hi, r in zip(b["shard"], b["z"], b["g"], b["doc"], b["lo"], b["hi"], b["r"]):
                lines = un.decompress(z).split(b"\n")
                j, once = np.array([x["j"] for x in r]), np.array([x["once"] for x in r])
                j, once = j[o := np.argsort(j)], once[o]
                of, at = np.unique(doc[j], return_inverse=True)
                h, line = worded(b"\n".join([lines[d] for d in of]))
                first, size = lo[j].astype(np.int64), hi[j] - lo[j] + 1
                i = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
                start = i + np.repeat(np.searchsorted(line, at), size)
                yield pd.DataFrame({"shard": shard, "doc": np.repeat(doc[j], size), "i": i, "once": np.repeat(once, size), "g": np.repeat(g[j], size), "w": ranged(h, start, start + n)})

    shown = staged(packed.select("shard", "z", "g", "doc", "lo", "hi").join(asked, "shard").mapInPandas(windows, "shard long, doc int, i int, once boolean, g long, w long"))
    again = shown.groupBy("g", "w").agg(F.count("*").alias("c")).filter("c > 1").select("g", "w")
    edges = shown.filter("once").join(again, ["g", "w"]).groupBy("shard").agg(F.collect_list(F.struct("doc", "i")).alias("e"))  # as above
    marks = whole.groupBy("shard").agg(F.collect_list("j").alias("js"))  # as above

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        un, code = zstandard.ZstdDecompressor(), Words()
        for b in batches:
            for ids, z, g, doc, lo, hi, js, e in zip(b["ids"], b["z"], b["g"], b["doc"], b["lo"], b["hi"], b["js"], b["e"]):
                lines = un.decompress(z).split(b"\n")
                own = [] if js is None else [np.asarray(js, np.int64)]
                cuts = [(int(doc[j]), int(lo[j]), int(hi[j]) + n) for j in own[0]] if own else []
                if e is not None:
                    at = np.array(sorted((x["doc"], x["i"]) for x in e), np.int64).reshape(-1, 2)
                    new = np.flatnonzero(np.r_[True, (np.diff(at[:, 0]) != 0) | (np.diff(at[:, 1]) != 1)])
                    cuts += [(int(at[x, 0]), int(at[x, 1]), int(at[y - 1, 1]) + n) for x, y in zip(new, np.r_[new[1:], len(at)])]
                    own.append(np.searchsorted((doc.astype(np.int64) << 32) + lo, (at[:, 0] << 32) + at[:, 1], "right") - 1)
                found = _found(lines, cuts, _stretches(np.isin(g, g[np.concatenate(own)]), doc, lo, hi, n), code) if cuts else {}
                out = []
                for d, line in enumerate(lines):
                    gone = 0
                    if d in found:
                        w, keep = found[d]
                        line, gone = b" ".join(compress(w, keep)), len(w) - int(keep.sum())
                    left = line.count(b" ") + 1 if line else 0
                    out.append((left + gone, gone, hashlib.sha256(line).hexdigest()))
                res = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])
                res.insert(0, "doc_id", ids)
                yield res

    rows = packed.select("shard", "ids", "z", "g", "doc", "lo", "hi").join(marks, "shard", "left").join(edges, "shard", "left")
    out = rows.select("ids", "z", "g", "doc", "lo", "hi", "js", "e").mapInPandas(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def _stretches(hot: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int) -> dict[int, list[tuple[int, int]]]:
    """Per document the words, from and to (exclusive), of its segments that are hot; neighbours make one stretch."""
    k = np.flatnonzero(hot)
    new = np.flatnonzero(np.r_[True, (np.diff(k) != 1) | (np.diff(doc[k]) != 0)])
    out: dict[int, list[tuple[int, int]]] = {}
    for x, y in zip(k[new], k[np.r_[new[1:] - 1, len(k) - 1]]):
        out.setdefault(int(doc[x]), []).append((int(lo[x]), int(hi[y]) + n))
    return out


def _found(lines: list[bytes], cuts: list[tuple[int, int, int]], stretches: dict[int, list[tuple[int, int]]], code: Words) -> dict[int, tuple[list[bytes], np.ndarray]]:
    """The words of each document that has stretches, and which of them no passage covers."""
    if len(code) > MOST_CODES:
        code.clear()
    words = {d: lines[d].split() for d in stretches}
    coded = {d: [(x, "".join(map(code.__getitem__, words[d][x:y]))) for x, y in of] for d, of in stretches.items()}
    phrases, wide = set(), code.WIDTH
    for d, x, y in cuts:
        first, own = coded[d][bisect(stretches[d], (x + 1,)) - 1]
        phrases.add(own[(x - first) * wide : (y - first) * wide])
    passages, out = Automaton(phrases), {}
    for d, of in coded.items():
        edge = np.zeros(len(words[d]) + 1, np.int64)
        for first, own in of:
            at, size = passages.places(own), len(own) // wide + 1
            edge[first : first + size] += np.bincount(at[:, 0], minlength=size) - np.bincount(at[:, 1], minlength=size)
        out[d] = words[d], np.cumsum(edge)[:-1] == 0
    return out
