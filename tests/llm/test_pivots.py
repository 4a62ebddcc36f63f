"""Near copies of vectors against all pairs."""

import math

import numpy as np

from meridia.llm import pivots

SCHEMA = "vec_id long, embedding array<double>, label int, near string"


def plain(rows, cosine=0.98):
    """n_links and component of each row by all pairs; rows are vec_id, vector, label."""
    good = [i for i, (_, v, k) in enumerate(rows) if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for (k, d) in {(rows[i][2], len(rows[i][1])) for i in good}:
        mine = [i for i in good if rows[i][2] == k and len(rows[i][1]) == d]
        x = np.array([rows[i][1] for i in mine], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a in range(len(mine)):
            near_ = np.flatnonzero(x @ x[a] >= cosine)
            links[mine[a]] = len(near_) - 1
            for b in near_.tolist():
                root[find(mine[a])] = find(mine[b])
    low = {}
    for i, r in enumerate(rows):
        low.setdefault(find(i), []).append(r[0])
    return [(r[0], links[i], min((x for x in low[find(i)] if x is not None), default=None)) for i, r in enumerate(rows)]


def key(r):
    return tuple((x is None, x) for x in r)


def got(df, **kw):
    t = pivots.near_copies(df, **kw)
    assert t.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = t.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    return sorted((tuple(r)[:3] for r in rows), key=key)


def near(rng, x, cosine):
    u = rng.standard_normal(len(x))
    u -= (u @ x) * x / (x @ x)
    return cosine * x / np.linalg.norm(x) + math.sqrt(1 - cosine**2) * u / np.linalg.norm(u)


def test_near_copies_of_embeddings(spark):
    for sf in ("sf0.01", "sf0.1"):
        df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        assert got(df) == sorted(plain([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]), key=key)


def test_recall_of_planted_pairs(spark):
    """1,000 pairs between the threshold and 1, 700 near copies of one vector, 6,000 vectors in all; no link that is none."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal((4300, 64))
    near_ = [near(rng, base[i], c) for i, c in enumerate(rng.uniform(0.9801, 1, 1000))]
    group = [near(rng, base[-1], c) for c in rng.uniform(0.988, 0.9999, 700)]
    rows = [(i, [float(y) for y in x], 1) for i, x in enumerate([*base, *near_, *group])]
    want = plain(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    have = dict((r[0], r[1:]) for r in got(df))
    total, found = sum(r[1] for r in want), sum(r[0] for r in have.values())
    assert 0.9 * total <= found <= total
    pairs = [have[i][1] == i and have[4300 + i][1] == i and have[i][0] == 1 for i in range(1000)]
    assert sum(pairs) >= 0.97 * 1000
    assert all(have[i][0] <= n for i, n, _ in want)


def test_blocks_and_edges(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 8))
    v = [list(map(float, near(rng, base[i % 4 if i < 120 else i % 40], rng.uniform(0.985, 1)))) for i in range(300)]
    rows = [(i * 3 + 7, x, i % 2) for i, x in enumerate(v)]
    rows += [(1, v[0], 0), (2, v[0], 0), (2, v[0], 0), (3, v[0], 1), (4, v[0], None), (None, v[200], 0), (None, [9.0] * 8, 5), (900, [2e200] * 8, 6), (901, [3e200] * 8, 6), (902, [1e-300] * 8, 6)]
    rows += [(910, None, 0), (911, [], 0), (912, [0.0] * 8, 0), (913, [1.0] * 7 + [None], 0), (914, [math.nan] * 8, 0), (915, [math.inf] * 8, 0), (916, [1.0] * 5, 6), (917, [1.0] * 5, 6), (918, [1.0] * 9, 6), (919, [-0.0] * 4 + [1.0] * 4, 6), (920, [0.0] * 4 + [1.0] * 4, 6)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    want = plain([(i, [x / 1e150 for x in v] if v and None not in v and max(map(abs, v)) > 1e150 else [x * 1e300 for x in v] if v and None not in v and 0 < max(map(abs, v)) < 1e-290 else v, k) for i, v, k in rows])
    # with few pivots every pair shares two of them: the index is whole then
    assert got(df, pivots=4) == sorted(want, key=key)
    assert got(df.limit(0)) == []
    assert got(df.filter("vec_id = 912")) == [(912, 0, 912)]
    assert got(df.filter("vec_id = 916")) == [(916, 0, 916)]
