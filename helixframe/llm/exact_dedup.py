"""Exact dedup by a tree merge of sorted digest runs.

A partition turns its documents into one sorted run of distinct digests, each
with the best document (most code points, then smallest doc_id) and a count.
Partitions then exchange runs in binomial rounds: in round r, partition p keeps the
digests whose r-th bit equals that bit of p and sends the others to the partition
that differs from p in that bit only (with ``fan`` 2; a larger power of two makes
rounds of several bits).  Each receiver merges the runs it gets in one multiway merge.  After the
last round a partition owns a range of digests.  A digest travels once a
partition and round, however many copies it has.

Equality is verified at each merge on the whole SHA-256 and the normalised length.

Defined cases: an empty table gives none; texts of any length are read whole; null
text counts as empty; null doc_ids come last in ties; rows that repeat doc_id and
text are the same document and share ``kept``, other texts of a doc_id are judged
for themselves; extra columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, input_bytes, lean, pack, runs, slices, unpack_all

_WS = bytes([0x20, *range(0x09, 0x0E)])
_NULL = np.iinfo(np.int64).max
_RUN = (np.uint64, np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64)


def _merge(run: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted by digest and normalised length; of equals the longest text, then the smallest id, and the counts' sum."""
    *digest, size, chars, ids, count = run
    o = np.lexsort((ids, -chars, size, *digest[::-1]))
    *digest, size, chars, ids, count = (a[o] for a in run)
    new = np.zeros(len(o), bool)
    new[:1] = True
    for a in (*digest, size):
        new[1:] |= a[1:] != a[:-1]
    f = np.flatnonzero(new)
    return [*(a[f] for a in (*digest, size, chars, ids)), np.add.reduceat(count, f) if len(f) else count]


def _digests(df: DataFrame) -> DataFrame:
    schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("size", pa.int64()), ("chars", pa.int64())])

    @lean
    def digest(batches):
        part = TaskContext.get().partitionId()
        for batch in batches:
            for rows in slices(batch):
                d, n = [], []
                for text in rows["text"]:
                    raw = text.as_buffer() if text.is_valid else b""
                    raw = bytes(raw).translate(None, _WS)
                    d.append(hashlib.sha256(raw).digest())
                    n.append(len(raw))
                chars = pc.utf8_length(rows["text"].fill_null("")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(d), pa.int32()), rows["doc_id"], pa.array(d, pa.binary()), pa.array(n, pa.int64()), chars], schema=schema)

    return df.mapInArrow(digest, "part int, doc_id long, digest binary, size long, chars long")


def _words(digest: pa.Array) -> list[np.ndarray]:
    raw = np.frombuffer(b"".join(digest.to_pylist()), ">u8").reshape(-1, 4)
    return [raw[:, k].astype(np.uint64) for k in range(4)]


def exact_groups(df: DataFrame, partitions: int | None = None, fan: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each document of ``df``."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shelf, bits = Shelf(df.sparkSession, "exact"), fan.bit_length() - 1
    if fan != 1 << bits or bits < 1:
        raise ValueError("fan must be a power of two")
    rows = shelf.put(_digests(docs))
    wanted, rounds = partitions or max(2, input_bytes(docs) >> 24), 1
    while fan**rounds < wanted:
        rounds += 1
    n = fan**rounds
    ddl, schema = "part int, run binary", pa.schema([("part", pa.int32()), ("run", pa.binary())])

    def send(parts, r):
        """Each run cut by the digest's r-th digit; the pieces' receivers."""
        shift = 64 - bits * (r + 1)
        out = []
        for part, run in parts:
            digit = (run[0] >> np.uint64(shift)) & np.uint64(fan - 1)
            place = bits * (rounds - 1 - r)
            base = part & ~((fan - 1) << place)
            for d in range(fan):
                s = digit == d
                if s.any():
                    out.append((base | d << place, pack(*(a[s] for a in run))))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else ([], []), schema, strict=True)], schema=schema)

    @lean
    def local(batches):
        runs_by, held = {}, 0
        for batch in batches:
            parts = batch["part"].to_numpy()
            cols = [*_words(batch["digest"]), *(batch[c].fill_null(_NULL).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "chars", "doc_id")), np.ones(len(parts), np.int64)]
            for p in np.unique(parts):
                s = parts == p
                run = _merge([a[s] for a in cols])
                p = int(p) % n
                runs_by[p] = _merge([np.concatenate(x) for x in zip(runs_by[p], run, strict=True)]) if p in runs_by else run
                held += len(run[0])
            if held > 1 << 20:
                yield from send(runs_by.items(), 0).to_batches()
                runs_by, held = {}, 0
        yield from send(runs_by.items(), 0).to_batches()

    def exchange(r):
        def merge(table):
            return send([(table["part"][0].as_py(), _merge(unpack_all(table["run"], *_RUN)))], r)

        return merge

    last = pa.schema([("digest", pa.binary()), ("size", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    @lean
    def finish(table):
        *digest, size, _, ids, count = _merge(unpack_all(table["run"], *_RUN))
        raw = np.stack(digest, axis=1).astype(">u8").tobytes()
        ids = pa.array(ids, pa.int64(), mask=ids == _NULL)
        return pa.Table.from_arrays([pa.array([raw[k : k + 32] for k in range(0, len(raw), 32)], pa.binary()), pa.array(size), ids, pa.array(count)], schema=last)

    merged = rows.mapInArrow(local, ddl)
    for r in range(1, rounds):
        merged = merged.groupBy("part").applyInArrow(exchange(r), ddl)
    groups = shelf.put(merged.groupBy("part").applyInArrow(finish, "digest binary, size long, keep_id long, group_size long"))
    shelf.keep(rows, groups)
    out = rows.join(groups.where("group_size > 1"), ["digest", "size"], "left")
    keep = "CASE WHEN group_size IS NULL THEN doc_id ELSE keep_id END"
    return out.selectExpr("doc_id", f"{keep} AS keep_id", "coalesce(group_size, 1L) AS group_size", f"doc_id <=> {keep} AS kept", "lower(hex(digest)) AS text_sha256")
