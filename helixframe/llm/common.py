"""Helpers that the operators share: tables in the shared folder, packed blobs, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import inspect
import math
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

U = np.uint64
_MASK = (1 << 64) - 1
#: Bytes of text that numpy works on at a time; longer texts go in pieces cut between words.
SEGMENT = 1 << 18


# ---------------------------------------------------------------- shared tables


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only in local mode without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = os.path.join(tempfile.gettempdir(), "helixframe-checkpoints")
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Where the session has Spark's own limit, let batches sent to Python end at ``size`` bytes: texts may be long, and a batch stands in memory on both sides."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit) == "67108864b":
        spark.conf.set(limit, str(size))


class Shelf:
    """Tables written to the shared folder to cut lineage; each can be dropped when a later one replaces it."""

    def __init__(self, spark: SparkSession, tag: str):
        bounded_batches(spark)
        self.spark, self.root, self.n, self.held = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0, {}

    def put(self, df: DataFrame) -> DataFrame:
        """Write a table and read it back."""
        self.n += 1
        path, schema = f"{self.root}/{self.n}", df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._shelf_path = self.held[path] = path
        return out

    def keep(self, *dfs: DataFrame) -> None:
        """Drop all tables but these."""
        for path in set(self.held) - {df._shelf_path for df in dfs}:
            self._delete(path)

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            if df is not None:
                self._delete(df._shelf_path)

    def _delete(self, path: str) -> None:
        if self.held.pop(path, None):
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of finished steps: it acts once the driver's references are collected."""
    for _ in range(2):  # Python's references first, and what the JVM then finds dead
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the table's size: file sizes for file sources."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 1 << 30


def n_buckets(df: DataFrame, each: int = 2 << 20, least: int = 16, most: int = 1 << 20) -> int:
    """A power of two so that a bucket holds about what ``each`` bytes of input give rise to."""
    return 1 << math.ceil(math.log2(min(most, max(least, input_bytes(df) / each))))


# ---------------------------------------------------------------- workers' memory

_trimmed = 0.0


def trim(every: float = 1.0) -> None:
    """Give memory that Arrow's pool and the C library hold free back to the system, once a second at most."""
    global _trimmed
    if time.monotonic() - _trimmed >= every:
        _trimmed = time.monotonic()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def lean(f):
    """A function for mapInArrow or applyInArrow whose reused worker doesn't keep what it has freed."""
    if inspect.isgeneratorfunction(f):

        def batches(it):
            try:
                yield from f(it)
            finally:
                trim(0)

        return batches
    if len(inspect.signature(f).parameters) == 1:

        def group(table):
            out = f(table)
            trim()
            return out

        return group

    def groups(left, right):
        out = f(left, right)
        trim()
        return out

    return groups


# ---------------------------------------------------------------- packed arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one compressed blob, their bytes transposed so that equal high bytes meet."""
    parts = [a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes, *dtypes: np.dtype) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    dtypes = [np.dtype(d) for d in dtypes]
    n, at, out = len(raw) // sum(d.itemsize for d in dtypes), 0, []
    for d in dtypes:
        out.append(np.ascontiguousarray(raw[at : at + n * d.itemsize].reshape(d.itemsize, n).T).view(d).ravel())
        at += n * d.itemsize
    return out


def unpack_all(column: pa.ChunkedArray | pa.Array, *dtypes) -> list[np.ndarray]:
    each = [unpack(b, *dtypes) for b in column.to_pylist()]
    return [np.concatenate(x) for x in zip(*each, strict=True)] if each else [np.empty(0, d) for d in dtypes]


def cut_by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted 64-bit keys that share their highest ``bits``."""
    if not len(keys):
        return
    top = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    at = runs(top)
    for s, e in zip(at, np.r_[at[1:], len(top)], strict=True):
        yield int(top[s]), slice(int(s), int(e))


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            t, step = np.ones(1, np.uint64), base
            while len(t) < size:
                t, step = np.concatenate([t, t * U(step)]), step * step & _MASK
            _powers[k] = t
    return _powers[0], _powers[1]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's place in them; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def hash_words(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` of a column, and where each row's words begin (rows + 1)."""
    data, at = text_buffers(column)
    n, s, hashes, starts = len(data), 0, [], []
    row_starts = np.unique(at[:-1])
    while s < n:
        e = min(n, s + SEGMENT)
        while e < n and not _SPACE[data[e]]:
            w = np.flatnonzero(_SPACE[data[e : e + 65536]])
            e = e + int(w[0]) if len(w) else min(n, e + 65536)
        seg = data[s:e]
        word = ~_SPACE[seg]
        first = np.zeros(len(seg) + 1, bool)
        first[row_starts[np.searchsorted(row_starts, s) : np.searchsorted(row_starts, e)] - s] = True
        first[0] = first[-1] = True
        b = np.flatnonzero(word & (first[:-1] | np.r_[True, ~word[:-1]]))
        f = np.flatnonzero(word & (first[1:] | np.r_[~word[1:], True])) + 1
        up, down = _tables(len(seg))
        seg = (_LOWER[seg] if lower else seg).astype(np.uint64) + U(1)
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(seg * up[: len(seg)], out=sums[1:])
        hashes.append(mix((sums[f] - sums[b]) * down[b] + (f - b).astype(np.uint64) * U(0xD6E8FEB86659FD93)))
        starts.append(b + s)
        s = e
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    b = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return h, np.searchsorted(b, at, "left")


def windows_at(words: np.ndarray, at: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of the ``width`` words from each place on."""
    h = np.zeros(len(at), np.uint64)
    for j in range(width):
        h *= U(base)
        h += words[at + j]
    return mix(h)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Whole rows of a batch, about ``most`` bytes of text at a time."""
    if not batch.num_rows:
        return
    size = np.cumsum(np.nan_to_num(pc.binary_length(batch[text]).to_numpy(zero_copy_only=False).astype(float)))
    s = 0
    while s < batch.num_rows:
        e = max(s + 1, int(np.searchsorted(size, (size[s - 1] if s else 0) + most, "right")))
        yield batch.slice(s, e - s)
        s = e


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """The first place of each run of equal keys."""
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.empty(0, np.int64)


class Dealer:
    """Gathers arrays whose first is a 64-bit key and deals them out by its highest bits.

    ``settle`` takes all that the task has gathered and returns what to deal
    (its first array sorted) and what the task has settled alone; the latter
    passes through the same exchange, spread by the hash of its first array.
    """

    schema = pa.schema([("bucket", pa.int32()), ("done", pa.bool_()), ("blob", pa.binary())])
    ddl = "bucket int, done boolean, blob binary"

    def __init__(self, buckets: int, settle, flush: int = 1 << 20):
        # with very many buckets more is gathered before it is dealt, so that a blob holds several entries
        self.bits, self.settle, self.parts, self.n, self.at = buckets.bit_length() - 1, settle, [], 0, min(1 << 22, max(flush, 8 * buckets))

    def add(self, *arrays: np.ndarray):
        self.parts.append(arrays)
        self.n += len(arrays[0])
        if self.n >= self.at:
            yield from self.flush()

    def flush(self):
        if not self.n:
            return
        arrays = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        self.parts, self.n = [], 0
        deal, done = self.settle(*arrays)
        rows = [(b, False, pack(*(a[s] for a in deal))) for b, s in cut_by_bucket(deal[0], self.bits)]
        key = mix(done[0].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        rows += [(b, True, pack(*(a[order[s]] for a in done))) for b, s in cut_by_bucket(key[order], self.bits)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)


def dealt(table: pa.Table, deal: tuple, done: tuple) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A bucket's arrays: those dealt, and those settled before."""
    flag = table["done"].to_numpy()
    return unpack_all(table["blob"].filter(pa.array(~flag)), *deal), unpack_all(table["blob"].filter(pa.array(flag)), *done)
