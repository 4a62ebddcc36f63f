"""Product codes of vectors: codebooks per part by integer means, nearest entries by partial-distance search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

PARTS = 16
ENTRIES = 64
ROUNDS = 2
ROWS = 4096  # rows that are searched at once
LIMIT = 1 << 28  # components of this magnitude and above would not leave room for sums of squares in 64 bits


def usable(vec: Column) -> Column:
    """Not null, not empty, without null or non-finite components."""
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def bounds(size: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end; equal parts where the size allows it."""
    at = [i * size // PARTS for i in range(PARTS + 1)]
    return list(zip(at, at[1:]))


def whole_numbers(flat: np.ndarray) -> np.ndarray:
    x = np.floor(flat.astype(np.float64) * 256.0)
    if len(x) and np.abs(x).max() >= LIMIT:
        raise ValueError(f"components must be below {LIMIT // 256} in magnitude")
    return x.astype(np.int64)


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry of book nearest to each row of x; ties go to the lower index.

    Dimensions are taken in descending variance of the book. The entry nearest in the first dimension gives a complete
    distance to beat. After each dimension a mask drops the entries whose sum so far strictly exceeds it.
    """
    if not book.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    order = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    first = (x[:, order[:1]] - book[:, order[0]]) ** 2
    best = ((x - book[first.argmin(axis=1)]) ** 2).sum(axis=1)
    row, entry = np.nonzero(first <= best[:, None])
    so_far = first[row, entry]
    for k in order[1:]:
        so_far = so_far + (x[row, k] - book[entry, k]) ** 2
        left = so_far <= best[row]
        row, entry, so_far = row[left], entry[left], so_far[left]
    # complete distances now; rows ascend, entries ascend within a row, and every row has one at least
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(so_far, starts)
    hit = np.flatnonzero(so_far == np.repeat(least, np.diff(np.append(starts, len(row)))))
    _, one = np.unique(row[hit], return_index=True)
    return entry[hit[one]], least


def _frames(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            yield part, whole_numbers(part.column("vec").flatten().to_numpy(zero_copy_only=False)).reshape(part.num_rows, size)


def _refined(vectors: DataFrame, books: list[np.ndarray], size: int) -> list[np.ndarray]:
    """One round: every part joins its nearest entry, an entry becomes the floored mean of its parts.

    A task sends sums and counts per part and entry, so what is shuffled and what the driver sees is bounded by
    PARTS * ENTRIES rows, whatever the number of vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(k), k.shape[1]), np.int64) for k in books]
        times = [np.zeros(len(k), np.int64) for k in books]
        for _, x in _frames(batches, size):
            for p, (a, z) in enumerate(bounds(size)):
                code, _ = nearest_entries(x[:, a:z], books[p])
                times[p] += np.bincount(code, minlength=len(books[p]))
                for d in range(z - a):  # whole numbers below 2**40 in all: exact in double precision
                    total[p][:, d] += np.bincount(code, x[:, a + d], len(books[p])).astype(np.int64)
        for p in range(PARTS):
            used = np.flatnonzero(times[p])
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(times[p][used]), pa.array(list(total[p][used]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    got = vectors.select("vec").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    width = max(z - a for a, z in bounds(size))
    sums = got.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    new = [k.copy() for k in books]
    for r in sums.collect():
        for i in range(new[r["part"]].shape[1]):
            new[r["part"]][r["entry"], i] = r[f"s{i}"] // r["n"]
    return new


def codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """A codebook per part, and the size of the vectors; none for an empty table.

    The entries begin as the parts of the ENTRIES rows of least vec_id (null ids last, equal ids by their vector).
    """
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vec").select("vec").limit(ENTRIES).collect()
    if not first:
        return [], 0
    size = len(first[0]["vec"])
    x = whole_numbers(np.array([r["vec"] for r in first if len(r["vec"]) == size], np.float64).reshape(-1)).reshape(-1, size)
    books = [x[:, a:z].copy() for a, z in bounds(size)]
    for _ in range(rounds):
        books = _refined(vectors.filter(F.size("vec") == size), books, size)
    return books, size


def encoded(vectors: DataFrame, books: list[np.ndarray], size: int) -> DataFrame:
    """vec_id, label, code (an entry's index per part) and error (squared distance to the entries) of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _frames(batches, size):
            found = [nearest_entries(x[:, a:z], books[p]) for p, (a, z) in enumerate(bounds(size))]
            code = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            out = pa.FixedSizeBinaryArray.from_buffers(pa.binary(PARTS), len(code), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), out, pa.array(sum(d for _, d in found))], ["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.filter(F.size("vec") == size).select("vec_id", "label", "vec").mapInArrow(run, f"vec_id long, label {label}, code binary, error long")


def compressed(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """The codes of vectors (vec_id, embedding, label) as vec_id, label, code, error, written once, and their codebooks.

    Components become floor(256 x); vectors are cut into PARTS consecutive parts. Null and empty vectors, and those
    with null or non-finite components, go, and so do those of another length than that of the least id. A null
    vec_id, a null label, equal ids and equal rows are kept as they are; fewer rows than ENTRIES give as many
    entries; an empty table gives none; other columns are not read. Components of 2**20 or more raise a ValueError.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("vec")).filter(usable(F.col("vec")))
    books, size = codebooks(rows)
    return staged(encoded(rows, books or [np.zeros((1, 0), np.int64)] * PARTS, size)), books


def code_table(vectors: DataFrame) -> DataFrame:
    """vec_id, code as hexadecimal digits, error, error of all vectors of the label (nulls together), digest of the codebooks."""
    codes, books = compressed(vectors)
    digest = hashlib.sha256(",".join(str(v) for k in books for v in k.reshape(-1).tolist()).encode()).hexdigest()
    # one row per label, with its size known when it is written
    sums = staged(codes.groupBy("label").agg(F.sum("error").alias("label_error")))
    got = codes.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return got.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
