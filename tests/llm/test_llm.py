import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from meridia.llm import decontam, jaccard, licenses, mixing, pages, passages, quality, secrets, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pid long"  # pid: a clashing extra
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(6000))
ROWS = [(1, None, "en", None, 0, 7), (2, "", None, "a", 0, 7), (3, "one two", "en", "a", 7, 7), (4, LONG, "en", "a", len(LONG), 7), (5, LONG + " end", "en", "b", 9, 7), (3, "one two", "en", "a", 7, 7), (6, "ab ab ab ab ab\nx\nx\n", "en", "b", 9, 7)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, none):
    got = {r["doc_id"]: r for r in quality.quality_table(docs).collect()}
    for i, t, *_ in ROWS:
        w = WORD.findall(t or "")
        c = Counter(zip(w, w[1:], w[2:]))
        cover = {j + k for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(cover), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {4, 5}
    assert quality.quality_table(none).count() == 0


def test_mix(docs, none):
    rows = mixing.mix_table(docs).collect()
    assert len(rows) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_table(docs).collect()), key=str)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix_table(none).count() == 0


def test_tokens(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["A.b, don't.. stop_. x1. É,\tü\nz ,. <|endoftext|>. á.", "", LONG]
    rng = random.Random(7)
    signs = "aZé ñ.,'\u3000\x0b\x1c\u00a0\x85<|>_9😀\t\n\r\x00" + "the of and "
    texts += ["".join(rng.choice(("<|endoftext|>", *signs)) for _ in range(rng.randrange(24))) for _ in range(20_000)]
    ids, counts = tokens.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json")).encode(pa.array(texts))
    assert len(counts) == len(texts)
    want = t.encode_batch(texts, add_special_tokens=False)
    for x, got, w in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), want):
        assert got.tolist() == [*w.ids, 1], repr(x)
    start = 0
    got = sorted(tokens.token_table(docs).collect(), key=lambda r: r["start"])
    for r, (i, x, *_) in zip(got, sorted(ROWS, key=lambda r: r[0])):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokens.token_table(none).count() == 0


def test_jaccard(docs, none):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(docs).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 5997, 4), (5, 5998, 4), (6, 3, 6)} and jaccard.jaccard_classes(none).count() == 0


def test_decontamination(spark, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, "x y " + item.upper() + " z", "", "", 0, 0), (2, "q " + item.replace("eta", "foo", 1), "", "", 0, 0), (3, "nothing of it", "", "", 0, 0), (4, None, "", "", 0, 0)]
    bench = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"] for r in decontam.contamination(docs, bench).collect()} == {1, 2}
    assert {r["doc_id"] for r in decontam.clean_documents(docs, bench).collect()} == {3, 4}
    assert decontam.contamination(none, bench).count() == 0


def test_secrets_repeated_short_and_without_digits(spark):
    """A key that stands twice is found twice; letters alone and short strings are measured; made-up words are not new."""
    key, letters, short = "q7Zr2Kx9Vb4Mn8Tw1Ly6Pd3Hs5Gf0Jc", "QzXvKjWqPbZgHxYdRkMfTcLnVsBwJpGh", "Zq7xK2vR9bW4mT1"
    prose = "the usual words of a text stand here and there, as they do in every other text of this kind"
    rows = [(1, f"the access key is {key} and once more {key} for the service"), (2, f"store the private key {letters} with care"), (3, f"session cookie {short} here"), (4, f"the secret of internationalization and a key undeinlicheintz here: {prose}"), (5, f"{key} stands far from any such word: {prose}")]
    got = {r["doc_id"]: r["spans"] for r in secrets.secret_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = lambda i, x: [f"novel:{m.start()}:{m.end()}" for m in re.finditer(x, rows[i - 1][1])]
    assert got == {1: ",".join(at(1, key)), 2: at(2, letters)[0], 3: at(3, short)[0], 4: "", 5: ""}
    assert len(at(1, key)) == 2


def test_secrets(spark, none):
    t = "é password = 'abcdefgh1' AKIAABCDEFGHIJKL " + "0a" * 16 + " token: short"
    r = secrets.secret_table(spark.createDataFrame([(1, t)], "doc_id long, text string")).collect()[0]
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 1, 1) and r["spans"].startswith("assign:2:")
    assert secrets.secret_table(none).count() == 0


def test_licenses(spark, none):
    t = "All rights reserved. CC-BY " + licenses.TEMPLATES["mit"][0]
    r = licenses.license_table(spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (r[0]["n_base"], r[0]["first_word"], r[0]["last_word"], r[0]["base_labels"], r[0]["labels"]) == (2, 0, 3, "cc-by,reserved", "cc-by,mit,reserved")
    assert r[1]["first_word"] is None and licenses.license_table(none).count() == 0


def test_passages(docs, none):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in passages.removed(docs).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (2, 0), 4: (6000, 6000), 5: (6001, 6000), 6: (7, 0)}
    assert passages.removed(none).count() == 0


def test_passages_by_brute_force(spark):
    pick = random.Random(3)
    phrases = [[pick.choice("abcd") for _ in range(pick.randint(6, 30))] for _ in range(6)]
    rows = [(i, " ".join(w for _ in range(pick.randint(0, 8)) for w in (pick.choice(phrases) if pick.random() < 0.7 else pick.choices("abc", k=5)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (8, 35):
        seen = Counter(tuple(w[k : k + n]) for _, t in rows for w in [t.split()] for k in range(len(w) - n + 1))
        want = []
        for i, t in rows:
            w = t.split()
            cut = {k + j for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for j in range(n)}
            want.append((i, len(w), len(cut), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in cut).encode()).hexdigest()))
        assert sorted(map(tuple, passages.removed(df, n).collect())) == want


def test_toxicity(spark, none):
    rows = [(i, f"plain word{i % 7} text" + (" vile" if i % 5 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(100)], "doc_id long, toxic int")
    held = [r for r in toxicity.toxicity_table(docs, labels).collect() if r["doc_id"] >= 100]
    assert all(r["toxic"] == (r["doc_id"] % 5 == 0) for r in held)
    assert toxicity.toxicity_table(none, labels.limit(0)).count() == 0


def test_pages(spark):
    page = "<html><body><nav>m</nav><div class=ad>x</div><article><h1>T&amp;a</h1><p><b>a<br><p>b  c</article><footer>f</footer></body></html>"
    bare = "<body><div>same</div><div>own {}</div></body>"
    df = spark.createDataFrame([(1, "http://h/1", page), (2, None, None), (3, "http://k/1", bare.format(1)), (4, "http://k/2", bare.format(2))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.page_table(df).collect()}
    assert got[1] == "T&a\na\nb c" and got[2] == "" and "own 2" in (got[3], got[4]) or "own 1" in (got[3], got[4])


def test_license_lines(spark):
    lines = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3.": "gpl", "SPDX-License-Identifier: ISC": "isc",
        "Under the Eclipse Public License 2.0": "epl-2.0", "See the Apache server, version 2.0, and mit": "",
    }
    df = spark.createDataFrame(list(enumerate("some prose. " + x + "\nmore" for x in lines)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.license_table(df).collect()}
    assert [got[i]["labels"] for i in range(len(lines))] == list(lines.values())
    assert all((r["score"] > 0) == (r["labels"] != "") for r in got.values())


def test_license_beside_others(spark):
    mit, apache, gpl = (licenses.TEMPLATES[k][0] for k in ("mit", "apache-2.0", "gpl"))
    prose = " ".join(["hereby granted charge obtaining associated documentation redistribution materials"] + ["the of and to is in you may under"] * 400)
    rows = [(1, f"{mit} . {apache} . {gpl}"), (2, f"{prose} {apache} {prose}"), (3, f"{gpl} {mit}"), (4, apache[len("licensed under the ") :])]
    got = {r["doc_id"]: r["labels"] for r in licenses.license_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "apache-2.0,gpl,mit", 2: "apache-2.0", 3: "gpl,mit", 4: "apache-2.0"}


def test_decontamination_of_common_items_and_null_ids(spark):
    item, asked = "alpha beta gamma delta epsilon zeta eta theta iota kappa", "which of the following words is the right answer"
    bench = spark.createDataFrame([(i, item) for i in range(30)] + [(100 + i, asked) for i in range(25)] + [(200 + i, f"{asked} {i}") for i in range(25)] + [(None, "one two three four five six")], "item_id long, text string")
    rows = [(1, item), (2, asked + " 7"), (None, "q one two three four five six r"), (None, "clean text of no item"), (None, "x " + item), (3, "clean"), (4, "one two three four five six")]
    docs = spark.createDataFrame([(i, t, "", "", 0, 0) for i, t in rows], SCHEMA)
    got = [(r["doc_id"], r["item_id"]) for r in decontam.contamination(docs, bench).collect()]
    ids = list(range(100, 125)) + list(range(200, 225))
    assert Counter(got) == Counter([(d, i) for d in (1, None) for i in range(30)] + [(2, i) for i in ids] + [(None, None), (4, None)])
    assert {(r["doc_id"], r["text"]) for r in decontam.clean_documents(docs, bench).collect()} == {rows[3], rows[5]}


def test_pages_align_lists_of_any_length_by_one_table(monkeypatch):
    import random

    from meridia.llm import pages

    long = 1100  # more than 2**20 pairs
    assert pages.aligned([("li", {k}) for k in range(long)], [("li", long + k) for k in range(long)]) == [(k, k) for k in range(long)]
    rng = random.Random(5)
    cases = [([(rng.choice("ab"), {rng.getrandbits(2) + 2**63 for _ in range(2)}) for _ in range(rng.randint(0, 12))], [(rng.choice("abc"), rng.getrandbits(2) + 2**63) for _ in range(rng.randint(0, 12))]) for _ in range(300)]
    short = [pages.aligned(x, y) for x, y in cases]
    monkeypatch.setattr(pages, "SHORT", 0)
    assert short == [pages.aligned(x, y) for x, y in cases]
