"""Posting files: round trips, both versions, ranges that a filter reads, jobs that fail."""

import os
import random
import struct

import numpy as np
import pytest

from helixframe.operators import search
from helixframe.sources import sidx


def plain(lists):
    """A version 3 file, byte by byte."""
    body, at = b"", [0]
    for rows in lists.values():
        before = 0
        for r in rows:
            gap, before = r - before, r
            while gap >= 128:
                body += bytes([gap & 127 | 128])
                gap >>= 7
            body += bytes([gap])
        at.append(len(body))
    head = b"SKETCHIDX3" + struct.pack("<QQQII", 7, len(lists), len(body), 3, 100)
    return head + struct.pack(f"<{len(lists)}I", *lists) + struct.pack(f"<{len(at)}Q", *at) + body


def test_version_3_and_partitions(spark, tmp_path):
    rng = random.Random(1)
    lists = {h: sorted(rng.sample(range(1 << 31), rng.randrange(1, 9)) + [0] * (h % 2)) for h in sorted(rng.sample(range(1 << 32), 200))}
    (tmp_path / "old.sidx").write_bytes(plain(lists))
    head = sidx.read_header(str(tmp_path / "old.sidx"))
    assert (head.version, head.n_seqs, head.k, head.scheme) == (3, 7, 11, "murphy2000_5")
    for per in (7, 1000):
        got = sidx.read_postings(spark, str(tmp_path / "old.sidx"), per=per)
        assert got.rdd.getNumPartitions() == -(-200 // per)
        assert sorted(map(tuple, got.collect())) == [(h, r) for h, rows in lists.items() for r in rows]
    (tmp_path / "no.sidx").write_bytes(b"something else".ljust(60))
    with pytest.raises(ValueError):
        sidx.read_header(str(tmp_path / "no.sidx"))


def test_round_trip_of_an_index(spark, tmp_path):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=80))) for i in range(50)], "row_idx long, text string")
    postings = search.build_index(docs, k=4, n=30, max_freq=50)
    path = str(tmp_path / "index")
    sidx.write_postings(postings, path, n_seqs="50", k="4", n_hash="30", max_freq="50")
    assert all(n.endswith(".sidx") for n in os.listdir(path))
    head = sidx.read_header(os.path.join(path, sorted(os.listdir(path))[0]))
    assert (head.version, head.n_seqs, head.k, head.scheme) == (4, 50, 4, "murphy2000_5")
    rows = sorted(map(tuple, postings.collect()))
    assert sorted(map(tuple, sidx.read_postings(spark, path).collect())) == rows
    with pytest.raises(Exception, match="has files"):
        sidx.write_postings(postings, path)
    sidx.write_postings(postings.where("h % 2 = 0"), path, mode="overwrite")
    assert sorted(map(tuple, sidx.read_postings(spark, path).collect())) == [r for r in rows if r[0] % 2 == 0]
    sidx.write_postings(postings.where("false"), str(tmp_path / "none"))
    assert sidx.read_postings(spark, str(tmp_path / "none")).count() == 0


def test_keys_read_their_ranges(spark, tmp_path, monkeypatch):
    rows = [(h, r) for h in range(0, 4000, 4) for r in range(h % 5 + 1)]
    path = str(tmp_path / "p")
    sidx.write_postings(spark.createDataFrame(rows, "h long, row_idx long"), path)
    every = sidx.read_postings(spark, path, per=50)
    hit = sidx.read_postings(spark, path, [8, 3996, 5], per=50)
    assert hit.rdd.getNumPartitions() == 2 and every.rdd.getNumPartitions() >= 20
    assert sorted(map(tuple, hit.collect())) == [r for r in rows if r[0] in (8, 3996, 5)]
    assert sidx.read_postings(spark, path, [9]).count() == sidx.read_postings(spark, path, []).count() == 0
    # of a partition's postings only the ranges of the keys
    read, real = [], sidx.decode
    monkeypatch.setattr(sidx, "decode", lambda raw: read.append(len(raw)) or real(raw))
    reader = sidx._Reader(path, 1 << 20, [8, 3996])
    assert [b.num_rows for part in reader.partitions() for b in reader.read(part)] == [4, 2] and sum(read) == 6


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(sidx.Sidx)
    bad = spark.createDataFrame([(2, 1), (1, 1)], "h long, row_idx long").coalesce(1)
    with pytest.raises(Exception, match="in order"):
        bad.write.format("sidx").mode("append").save(str(tmp_path / "bad"))
    assert os.listdir(tmp_path / "bad") == []


def test_codes_of_any_batches():
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 1 << 32, 3000))
    width, raw = sidx.encode(np.zeros(len(values), int), values)
    gaps, first = sidx.decode(np.frombuffer(raw, np.uint8))
    assert (np.cumsum(gaps) == values).all() and (np.diff(np.r_[first, len(raw)]) == width).all()
    assert len(sidx.decode(np.empty(0, np.uint8))[0]) == 0
