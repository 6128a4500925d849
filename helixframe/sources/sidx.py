"""Posting files (``.sidx``) as a Spark data source: (h, row_idx), the rows that have each k-mer.

A file has a header, its k-mers in order (32 bits each), where each one's postings begin
(64 bits each, and the end), and the postings: ascending row numbers, as
differences in bytes of seven bits.  Version 3 lacks scheme and k, which were then
``murphy2000_5`` and 11.

Reading: a file's k-mers are cut into partitions; each reads its own ranges of the
three parts, by seeking.  With the option ``keys`` partitions are pruned by the k-mers at
their ends, and only postings that match are read.  It is an option and no pushed
filter, since Spark keeps the partitions of a filtered read of a Python source for
later reads of the same table.

Writing: each task writes a file of its own, complete in itself, beside the target
under a temporary name; the driver renames them once all are there, and deletes
them if the job fails.  The path is one that all workers mount.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

_HEAD, _MORE = struct.Struct("<10sQQQII"), struct.Struct("<I32s")
_SCHEMA = pa.schema([("h", pa.int64()), ("row_idx", pa.int64())])


@dataclass
class Header:
    version: int
    n_seqs: int
    n_hashes: int
    n_encoded: int
    max_freq: int
    n_hash: int
    k: int = 11
    scheme: str = "murphy2000_5"

    @property
    def size(self) -> int:
        return _HEAD.size + (_MORE.size if self.version == 4 else 0)

    def packed(self) -> bytes:
        return _HEAD.pack(b"SKETCHIDX4", self.n_seqs, self.n_hashes, self.n_encoded, self.max_freq, self.n_hash) + _MORE.pack(self.k, self.scheme.encode())


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        magic, n_seqs, n_hashes, n_encoded, max_freq, n_hash = _HEAD.unpack(f.read(_HEAD.size))
        if magic not in (b"SKETCHIDX3", b"SKETCHIDX4"):
            raise ValueError(f"{path} is no posting file")
        out = Header(int(magic[-1:]), n_seqs, n_hashes, n_encoded, max_freq, n_hash)
        if out.version == 4:
            out.k, scheme = _MORE.unpack(f.read(_MORE.size))
            out.scheme = scheme.rstrip(b"\0").decode()
        return out


def encode(lists: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bytes of ascending ``values`` as differences within runs of equal ``lists``, and how many bytes each value takes."""
    new = np.r_[True, lists[1:] != lists[:-1]] if len(lists) else np.empty(0, bool)
    gaps = np.where(new, values, np.diff(values, prepend=0)).astype(np.uint64)
    width = np.ones(len(gaps), np.int64)
    for k in range(1, 5):
        width += gaps >= np.uint64(1 << 7 * k)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        s = width > k
        part = (gaps[s] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[ends[s] - width[s] + k] = part | np.where(width[s] > k + 1, 128, 0).astype(np.uint8)
    return width, out.tobytes()


def decode(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in bytes of seven bits, and where each one begins."""
    last = np.flatnonzero(raw < 128)
    first = np.r_[0, last[:-1] + 1] if len(last) else last
    out = np.zeros(len(last), np.uint64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        s = first + k <= last
        out[s] |= (raw[first[s] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out.astype(np.int64), first


@dataclass
class _Part(InputPartition):
    path: str
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, per: int, wanted: list[int] | None):
        self.path, self.per, self.wanted = path, per, wanted

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, "*.sidx"))) if os.path.isdir(self.path) else [self.path]
        out = []
        for path in files:
            head = read_header(path)
            with open(path, "rb") as f:
                for s in range(0, head.n_hashes, self.per):
                    e = min(head.n_hashes, s + self.per)
                    if self.wanted is not None:
                        low, high = (self._keys(f, head, k, k + 1)[0] for k in (s, e - 1))
                        if not any(low <= w <= high for w in self.wanted):
                            continue
                    out.append(_Part(path, s, e))
        return out or [_Part("", 0, 0)]

    @staticmethod
    def _keys(f, head: Header, s: int, e: int) -> np.ndarray:
        f.seek(head.size + 4 * s)
        return np.frombuffer(f.read(4 * (e - s)), "<u4").astype(np.int64)

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if part.first == part.last:
            return
        head = read_header(part.path)
        with open(part.path, "rb") as f:
            keys = self._keys(f, head, part.first, part.last)
            f.seek(head.size + 4 * head.n_hashes + 8 * part.first)
            at = np.frombuffer(f.read(8 * (len(keys) + 1)), "<u8").astype(np.int64)
            base = head.size + 4 * head.n_hashes + 8 * (head.n_hashes + 1)
            s = 0
            take = np.ones(len(keys), bool) if self.wanted is None else np.isin(keys, self.wanted)
            while s < len(keys):
                if not take[s]:
                    s += 1
                    continue
                # k-mers that stand together and are wanted, some megabytes at a time
                e = s + 1
                while e < len(keys) and take[e] and at[e] - at[s] < 1 << 22:
                    e += 1
                f.seek(base + at[s])
                gaps, begin = decode(np.frombuffer(f.read(int(at[e] - at[s])), np.uint8))
                own = np.searchsorted(at[s : e + 1] - at[s], begin, "right") - 1
                sums = np.cumsum(gaps)
                new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
                before = np.repeat(sums[new] - gaps[new], np.diff(np.r_[new, len(own)]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[s:e][own]), pa.array(sums - before)], schema=_SCHEMA)
                s = e


@dataclass
class _Done(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, options: dict):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        self.head = Header(4, int(options.get("n_seqs", 0)), 0, 0, int(options.get("max_freq", 0)), int(options.get("n_hash", 0)), int(options.get("k", 11)), options.get("scheme", "murphy2000_5"))
        os.makedirs(path, exist_ok=True)
        if os.listdir(path) and not overwrite:
            raise FileExistsError(f"{path} has files")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        pid, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name = os.path.join(self.path, f".{self.job}-{pid}-{attempt}")
        keys, counts, last, held = [], [], None, None
        with open(f"{name}.postings", "wb") as f:
            for batch in iterator:
                h, row = (batch[c].to_numpy(zero_copy_only=False) for c in ("h", "row_idx"))
                if not len(h):
                    continue
                if last is not None and h[0] < last or (np.diff(h) < 0).any():
                    raise ValueError("rows must be in order of h and row_idx")
                # a k-mer that goes on from the batch before: the first gap is from its last row
                on = last == h[0]
                width, raw = encode(np.r_[h[:1], h] if on else h, np.r_[[held], row] if on else row)
                skip = int(width[0]) if on else 0
                f.write(raw[skip:])
                width = width[1:] if on else width
                new = np.flatnonzero(np.r_[not on, h[1:] != h[:-1]])
                sums = np.add.reduceat(width, np.r_[0, new[new > 0]].astype(np.int64))
                if on:
                    counts[-1] += int(sums[0])
                    sums = sums[1:]
                keys += h[new].tolist()
                counts += sums.tolist()
                last, held = h[-1], row[-1]
        self.head.n_hashes, self.head.n_encoded = len(keys), sum(counts)
        with open(f"{name}.tmp", "wb") as out, open(f"{name}.postings", "rb") as f:
            out.write(self.head.packed() + np.array(keys, "<u4").tobytes() + np.cumsum([0, *counts]).astype("<u8").tobytes())
            while block := f.read(8 << 20):
                out.write(block)
        os.remove(f"{name}.postings")
        return _Done(f"{name}.tmp", os.path.join(self.path, f"part-{pid:05d}.sidx"))

    def commit(self, messages) -> None:
        done = [m for m in messages if m]
        if self.overwrite:
            for old in glob.glob(os.path.join(self.path, "*.sidx")):
                os.remove(old)
        for m in done:
            os.replace(m.temporary, m.final)
        self._sweep()

    def abort(self, messages) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """What this job's other attempts left."""
        for left in glob.glob(os.path.join(self.path, f".{self.job}-*")):
            os.remove(left)


def _local(path: str) -> str:
    """A mounted path, also where it is written as a file URL."""
    return path.removeprefix("file://")


class Sidx(DataSource):
    """``spark.read.format("sidx").load(path)``: a file or a folder of files; options ``per``: k-mers in a partition, ``keys``: the only k-mers to read, with commas."""

    @classmethod
    def name(cls) -> str:
        return "sidx"

    def schema(self) -> str:
        return "h bigint, row_idx bigint"

    def reader(self, schema) -> _Reader:
        wanted = self.options.get("keys")
        keys = None if wanted is None else sorted({int(x) for x in wanted.split(",") if x})
        return _Reader(_local(self.options["path"]), int(self.options.get("per", 1 << 20)), keys)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(_local(self.options["path"]), overwrite, dict(self.options))


def read_postings(spark: SparkSession, path: str, keys: Iterable[int] | None = None, per: int = 1 << 20) -> DataFrame:
    """(h, row_idx) of a file or a folder of files; with ``keys`` only these k-mers' ranges are read."""
    spark.dataSource.register(Sidx)
    options = {"per": str(per)} | ({} if keys is None else {"keys": ",".join(map(str, keys))})
    return spark.read.format("sidx").options(**options).load(path)


def write_postings(postings: DataFrame, path: str, mode: str = "append", **meta) -> None:
    """Postings (h, row_idx) as files by ranges of h; ``meta``: n_seqs, max_freq, n_hash, k, scheme."""
    postings.sparkSession.dataSource.register(Sidx)
    rows = postings.select("h", "row_idx").repartitionByRange("h").sortWithinPartitions("h", "row_idx")
    rows.write.format("sidx").mode(mode).options(**meta).save(path)
