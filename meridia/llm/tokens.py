"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read back by memory map."""

from __future__ import annotations

import gc
import os
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, staged

END_ID = 1
CACHE = 600_000  # chunks a worker remembers at most; others are encoded each time
CUT = 1 << 24  # bytes of text that are encoded at once; a longer text is one cut
ARRAY = {"<u2": "H", "<u4": "I"}
_encoders: dict[str, "ChunkEncoder"] = {}  # kept by a worker between its tasks


def _open(url: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(url)


class ChunkEncoder:
    """Encodes texts chunk by chunk. The tokenizer splits at white space, so chunks between blanks are independent.

    A cut of texts is split and its distinct chunks are found by Arrow; only chunks not seen before go to the
    tokenizer; numpy then lays the ids of all chunks side by side.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.seen = Tokenizer.from_file(path), {}

    @staticmethod
    def of(path: str) -> ChunkEncoder:
        if path not in _encoders:
            _encoders[path] = ChunkEncoder(path)
        return _encoders[path]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids side by side, each text closed by END_ID, and the number of ids per text."""
        lists = pc.ascii_split_whitespace(texts)
        chunks = lists.flatten().dictionary_encode()
        names, at = chunks.dictionary.to_pylist(), chunks.indices.to_numpy()
        new, kind = [c for c in names if c not in self.seen], self.width()
        gc.disable()  # the encodings hold no cycles; tracing them takes as long as making them
        try:
            got = self.tok.encode_batch_fast(new, add_special_tokens=False) if new else ()
            ids = {c: array(ARRAY[kind], e.ids).tobytes() for c, e in zip(new, got)}
            del got
        finally:
            gc.enable()
        if len(self.seen) + len(ids) > CACHE:
            get = lambda c: ids[c] if c in ids else self.seen[c]
        else:
            self.seen.update(ids)
            get = self.seen.__getitem__
        known = [get(c) for c in names] + [np.asarray([END_ID], kind).tobytes()]
        flat = np.frombuffer(b"".join(known), kind)
        size = np.fromiter(map(len, known), np.int64, len(known)) // flat.itemsize
        per_text = pc.list_value_length(lists).to_numpy()
        ends = np.cumsum(per_text)
        at = np.insert(at, ends, len(known) - 1)
        n = size[at]
        out = flat[np.repeat(np.cumsum(size)[at] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        done = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]
        return out, np.diff(done)

    def width(self) -> str:
        """The narrowest unsigned integers that hold every id."""
        return "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"


def cuts(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs whose sizes sum to `most` at the most; a larger one stands alone."""
    end, lo = np.cumsum(size), 0
    while lo < len(size):
        before = end[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(end, before + most, "right")))
        yield lo, hi
        lo = hi


def write_tokens(docs: DataFrame, tokenizer: str, out: str) -> DataFrame:
    """Writes the ids of all texts in ascending doc_id order; returns the manifest.

    One .bin (little-endian, 16 bits where the vocabulary fits and else 32), one .idx (int64 end offsets) and one .ids (int64 doc_id) per
    partition; file names are new for each attempt and only those in the manifest count, so a
    task that runs again does no harm. Rows of one doc_id stand by a hash of the text. The manifest has part, path, width, n_docs, n_tokens and base, the
    ids before the part. Null text is empty; repeated rows are written as often as they come;
    a null doc_id comes first and is stored as the smallest int64; an empty table gives no part.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        stem = f"{out}/part-{part:06d}-{uuid.uuid4().hex}"
        enc, sizes, ids, files = ChunkEncoder.of(tokenizer), [], [], None
        for b in batches:
            texts = pc.fill_null(b.column("text"), "")
            for lo, hi in cuts(pc.binary_length(texts).to_numpy(zero_copy_only=False), CUT):
                if files is None:
                    fs, path = _open(stem)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    files = fs.open_output_stream(path + ".bin")
                flat, n = enc.encode(texts[lo:hi])
                files.write(flat.tobytes())
                sizes.append(n)
            ids.append(b.column("doc_id").to_numpy())
        if files is not None:
            files.close()
            ends = np.cumsum(np.concatenate(sizes))
            for kind, v in (("idx", ends), ("ids", np.concatenate(ids))):
                with fs.open_output_stream(f"{path}.{kind}") as f:
                    f.write(v.astype("<i8").tobytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [stem], "width": [enc.width()], "n_docs": [len(ends)], "n_tokens": [int(ends[-1])]})

    rows = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("doc_id"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    m = staged(rows.mapInArrow(write, "part int, path string, width string, n_docs long, n_tokens long"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return staged(m.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")))  # one row per file


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files: mapped where they are local, else read by ranges."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                fs, path = _open(r.path)
                with fs.open_input_file(path + ".idx") as f:
                    ends = np.frombuffer(f.read(), "<i8")
                with fs.open_input_file(path + ".ids") as f:
                    ids = np.frombuffer(f.read(), "<i8")
                n = np.diff(ends, prepend=0)
                step = np.dtype(r.width).itemsize
                local = fs.type_name == "local"
                flat = np.memmap(path + ".bin", r.width, "r") if local else fs.open_input_file(path + ".bin")
                for lo, hi in cuts(n, CUT):
                    at, upto = int(ends[lo] - n[lo]), int(ends[hi - 1])
                    got = flat[at:upto] if local else np.frombuffer(flat.read_at((upto - at) * step, at * step), r.width)
                    raw, cut = memoryview(got.astype("<u4").tobytes()), 4 * (ends[lo:hi] - at)
                    crc = [zlib.crc32(raw[x:y]) for x, y in zip(cut - 4 * n[lo:hi], cut)]
                    yield pd.DataFrame({"doc_id": ids[lo:hi], "start": ends[lo:hi] - n[lo:hi] + r.base, "n_tokens": n[lo:hi], "ids_crc32": crc})

    # one task per file: a count given by number is not merged by size, as rows this small would be
    parts = manifest.select("path", "width", "base").repartition(max(1, manifest.count()), "path")
    out = parts.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))


def token_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the token files of docs and reads them back: doc_id, start, n_tokens, ids_crc32. Cases as in write_tokens."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return read_tokens(write_tokens(docs, str(tokenizer), f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"))
