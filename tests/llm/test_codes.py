"""Product codes against a plain search without numpy's masks."""

import hashlib
import math
import random

import numpy as np

from meridia.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def expected(rows):
    kept = sorted([r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])], key=lambda r: r[0])
    vecs = [[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in kept]
    d = len(vecs[0]) // 16
    cut = lambda v: [v[i * d : i * d + d] for i in range(16)]
    books = [[list(cut(v)[p]) for v in vecs[:64]] for p in range(16)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda a, k: min((dist(a, e), i) for i, e in enumerate(k))
    for _ in range(2):
        held = [[[] for _ in k] for k in books]
        for v in vecs:
            for p, a in enumerate(cut(v)):
                held[p][near(a, books[p])[1]].append(a)
        books = [[[sum(c) // len(h) for c in zip(*h)] if h else e for e, h in zip(k, hs)] for k, hs in zip(books, held)]
    found = [[near(a, books[p]) for p, a in enumerate(cut(v))] for v in vecs]
    by = {}
    for r, f in zip(kept, found):
        by[r[2]] = by.get(r[2], 0) + sum(x for x, _ in f)
    sha = hashlib.sha256(",".join(str(x) for k in books for e in k for x in e).encode()).hexdigest()
    return sorted((r[0], "".join(f"{i:02x}" for _, i in f), sum(x for x, _ in f), by[r[2]], sha) for r, f in zip(kept, found))


def got(df):
    t = codes.code_table(df)
    assert t.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, t.collect()))


def test_codes_of_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert got(df) == expected([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])


def test_codes_on_edges(spark):
    rng = random.Random(5)
    rows = [(1000 - i, [rng.choice((-2.5, -0.001, 0.0, 0.3, 1.0, 7.0)) for _ in range(32)], i % 4 if i % 4 else None) for i in range(150)]
    rows += [(5, [1.0] * 32, 1), (5, [1.0] * 32, 1), (6, [1.0] * 31 + [None], 1), (7, [1.0] * 31 + [math.nan], 1), (8, [math.inf] + [1.0] * 31, 1), (9, None, 1), (10, [], 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    assert got(df) == expected(rows)
    few = rows[:3]
    assert got(spark.createDataFrame([(*r, "clash") for r in few], SCHEMA)) == expected(few)
    assert got(df.limit(0)) == []
    assert got(df.filter("vec_id = 9")) == []
    odd = spark.createDataFrame([(None, [1.0] * 32, 1, ""), (1, [0.0] * 32, 2, ""), (2, [0.0] * 5, 2, "")], SCHEMA)
    assert sorted((r["vec_id"] or 0, r["error"]) for r in codes.code_table(odd).collect()) == [(0, 0), (1, 0)]


def test_nearest_entries_equals_all_distances():
    rng = np.random.default_rng(1)
    for d in (1, 2, 4, 7):
        for span in (2, 300):
            x, book = rng.integers(-span, span, (500, d)), rng.integers(-span, span, (20, d))
            all_ = ((x[:, None] - book[None]) ** 2).sum(-1)
            code, error = codes.nearest_entries(x, book)
            assert (code == all_.argmin(1)).all() and (error == all_.min(1)).all()
