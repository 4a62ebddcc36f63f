"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from meridia.llm import periods

SCHEMA = "doc_id long, text string, runs string, lang string"


def plain(s, least=12):
    """Every maximal run by trying every period."""
    n, out = len(s), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted([(a, b - a, q) for (a, b), q in out.items()], key=lambda v: (v[0], v[2]))


def expected(doc_id, text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(ws)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    runs = plain(ws)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    s, k, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), s, k, q, 1000 * k // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(ws) if i not in gone)))


def same(got, rows):
    order = lambda r: tuple((x is None, x) for x in r)
    cols = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=order) == sorted((expected(*r) for r in rows), key=order)


def test_runs_of_random_words_equal_plain_search():
    rng = random.Random(3)
    for _ in range(600):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 90), rng.choice((1, 2, 3, 6))
            t = [rng.randrange(k) for _ in range(n)]
            if n > 4 and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randint(1, n // 2)
                t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
            texts.append(t)
        least = rng.choice((12, 12, 4, 6, 2))
        got = periods.find_runs(np.array([x for t in texts for x in t], np.int64), np.cumsum([len(t) for t in texts]), least)
        for i, t in enumerate(texts):
            assert got.get(i, []) == plain(t, least)


def test_run_table_on_edges(spark):
    thue = [0]
    for _ in range(9):
        thue += [1 - x for x in thue]
    fib, b = ["a"], ["a", "b"]
    while len(b) < 400:
        fib, b = b, b + fib
    rows = [(i, " ".join(f"w{(i * 7 + k) % (5 + i)}" for k in range(40 + i))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "one"), (None, "a b " * 20), (None, None), (104, "x\x0by\x1cz " * 9), (104, "x\x0by\x1cz " * 9)]
    rows += [(105, " ".join(map(str, thue))), (106, " ".join(b)), (107, "same " * 3000), (108, " ".join(f"u{k}" for k in range(6000))), (109, ("a a b " * 8 + "c ") * 4), (110, "É é " * 7)]
    df = spark.createDataFrame([(*r, "old", "xx") for r in rows], SCHEMA)
    same(periods.run_table(df), rows)
    assert periods.run_table(df.limit(0)).count() == 0
    whole = periods.periodic_runs(df)
    assert set(whole.columns) == {"doc_id", "text", "lang", "runs", "collapsed"}
    assert whole.filter("doc_id = 107").select("collapsed", F.col("runs")[0]["length"]).first()[:] == ("same", 3000)


def test_run_table_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.length("text") < 6000)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = periods.run_table(docs)
    same(got, rows)
    assert got.filter("n_runs > 0").count() > 50
