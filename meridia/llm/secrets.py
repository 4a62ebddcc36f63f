"""Secret scans: fixed patterns, and strings that a primed compressor finds new in a sensitive context."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
# fixed values: patterns of the base rule
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(r"auth|bearer|credential|private|access|secret|token|passw|passphrase|pwd|key|signature|salt|cookie|session", re.I | re.A)
SHORT, PLAIN = 12, 16  # characters of a string, and of one that has no digit and letters of one case only, as made-up words have
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{%d,}" % SHORT, re.A)
TRIM = "._-=~/"
REACH = 200  # characters before a string in which its context may stand, on its own line or the line before
NAMES = 4096  # identifiers in the dictionary at most, the most frequent first


def identifiers(docs: DataFrame, most: int = NAMES) -> bytes:
    """The words and identifiers that stand most often in docs, as a compression dictionary; `most` words come to the driver.

    All rows are counted, by partial aggregates. The most frequent stand last, where a compressor reaches them cheapest.
    Long words with digits are no names: a key that copies of a text share must not prime the compressor.
    """
    w = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "[^A-Za-z0-9_]+")).alias("w")).filter(f"length(w) between 4 and 40 and not (length(w) >= {SHORT} and w rlike '[0-9]')")
    top = w.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "w").limit(most).collect()
    return " ".join(r["w"] for r in reversed(top)).encode()


class Novelty:
    """Marginal compressed bytes of a string after a dictionary and its surroundings, per byte of the string."""

    def __init__(self, names: bytes) -> None:
        import zstandard as z

        prime = z.ZstdCompressionDict(names, dict_type=z.DICT_TYPE_RAWCONTENT) if len(names) >= 8 else None
        self.c = z.ZstdCompressor(level=3, dict_data=prime)

    def __call__(self, around: str, part: str) -> float:
        a, p = around.encode("utf-8", "replace"), part.encode()
        return (len(self.c.compress(a + b" " + p)) - len(self.c.compress(a + b" "))) / len(p)


def novel(text: str, novelty: Novelty, least: float, around: int) -> list[tuple[int, int]]:
    """Strings of SHORT characters or more with a letter, in a sensitive context, that the compressor can't shorten.

    Every string of a text is looked at, whatever stands beside it; copies of it in its surroundings are blanked before
    they are measured against. A string of one case without a digit must have PLAIN characters. Its context is a
    sensitive word in the REACH characters before it, on its line or the line before, outside the string itself. Parts
    of web and mail addresses do not count.
    """
    found, words = [], None
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while s < e and text[e - 1] in TRIM:
            e -= 1
        while s < e and text[s] in TRIM:
            s += 1
        part = text[s:e]
        if e - s < SHORT or text[max(0, s - 3) : s].endswith(("://", ":/", "@")) or "//" in part or part.startswith("www."):
            continue
        if not any(c.isalpha() for c in part):
            continue
        if e - s < PLAIN and not any(c.isdigit() for c in part) and (part.islower() or part.isupper()):
            continue
        if words is None:
            words = [w.end() for w in CONTEXT.finditer(text)]
        k = bisect_right(words, s)
        if not k or words[k - 1] < s - REACH or text.count("\n", words[k - 1], s) > 1:
            continue
        if novelty((text[max(0, s - around) : s] + " " + text[e : e + around]).replace(part, " "), part) >= least:
            found.append((s, e))
    return found


def spans(text: str, novelty: Novelty, least: float = 0.9, around: int = 200) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points by start, then kind as listed. A novel string that a base span holds is not listed again."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    out += [(s, e, "novel") for s, e in novel(text, novelty, least, around) if not any(a <= s and e <= b for a, b, _ in out)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def secret_table(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, digest of the fixed patterns' spans, and all spans.

    The dictionary of identifiers comes from docs itself; then every whole text is scanned where it lies. Null
    text is empty: no spans and the digest of the empty string. A null doc_id is kept; repeated rows give repeated
    results; an empty table gives none; other columns are not read. A base span is the whole match; `novel` spans
    are the method's own.
    """
    names = identifiers(docs)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty = Novelty(names)
        for b in batches:
            rows = []
            for t in b["text"]:
                found = spans(t if isinstance(t, str) else "", novelty)
                n = {k: sum(x[2] == k for x in found) for k in KINDS}
                base = ",".join(f"{k}:{s}:{e}" for s, e, k in found if k != "novel")
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, e, k in found)))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            out.insert(0, "doc_id", b["doc_id"].array)
            yield out

    return docs.select("doc_id", "text").mapInPandas(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
