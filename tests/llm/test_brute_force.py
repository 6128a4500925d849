"""Operators that SQL can't express, against plain Python over whole tables or small graphs."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm.common import Shelf
from helixframe.llm.licenses import BASE, FREE, NOTICES, license_scan, scan
from helixframe.llm.mixing import mix_sources, mixture
from helixframe.llm.packing import TOKENIZER, best_fit, certified, lower_bound, pack_documents, pack_pieces
from helixframe.llm.url_filter import filter_urls, propagate

SF = "/root/testdata/sf0.01"


def test_license_scan_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    notice = "x\n# SPDX-License-Identifier: MIT OR GPL-3.0-only\nCreative Commons Attribution-NonCommercial; cc by, CC BY!"
    docs = docs.unionAll(spark.createDataFrame([(-1, notice), (-2, None)], docs.schema))
    found = {r.doc_id: r for r in license_scan(docs).collect()}
    for r in docs.collect():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = defaultdict(list)
        for phrase, label in [*BASE.items(), *NOTICES.items()]:
            p = phrase.split()
            at[phrase in BASE, label] += [i for i in range(len(words)) if words[i : i + len(p)] == p]
        base = sorted(i for (is_base, _), places in at.items() if is_base for i in places)
        labels = {label for (_, label), places in at.items() if places}
        got = found[r.doc_id]
        assert (got.n_words, got.n_base, got.first_word, got.last_word) == (len(words), len(base), base[0] if base else None, base[-1] if base else None)
        assert got.base_labels == ",".join(sorted(label for (is_base, label), places in at.items() if is_base and places))
        if "spdx-license-identifier:" not in low:
            assert got.labels == ",".join(sorted(labels)) and got.score == min([FREE[x] for x in labels], default=1.0)
    assert found[-1].labels == "cc,cc-by,cc-by-nc,gpl-3.0-only,mit" and found[-1].score == 0.2


@pytest.mark.parametrize(
    ("line", "labels", "score"),
    [
        ("see LICENSE file", "", 1.0), ("<id> is the tag", "", 1.0), ("mitten or me", "", 1.0), ("MIT or see LICENSE", "mit", 1.0), ("GPL-3.0+", "gpl-3.0+", 0.4),
        ("(BSD-3-Clause OR LicenseRef-Own) AND see this", "bsd-3-clause,licenseref-own", 1.0), ("GPL-2.0-or-later WITH Classpath-exception-2.0", "classpath-exception-2.0,gpl-2.0-or-later", 0.7),
    ],
)
def test_identifiers_only(line, labels, score):
    got = scan(f"x\nSPDX-License-Identifier: {line}\ny")
    assert got[5] == labels and got[6] == pytest.approx(score)


def _ranks(edges, seeds, damping=0.85):
    out, rank = defaultdict(int), dict(seeds)
    for s, _, n in edges:
        out[s] += n
    for _ in range(400):
        new = defaultdict(float, seeds)
        for s, d, n in edges:
            new[d] += damping * rank.get(s, 0.0) * n / out[s]
        rank = new
    return rank


def test_propagation(spark):
    rng = np.random.default_rng(3)
    hosts = [f"h{i}" for i in range(40)]
    edges = {(a, b): int(rng.integers(1, 5)) for a, b in (rng.choice(hosts, 2, replace=False) for _ in range(160))}
    edges = [(a, b, n) for (a, b), n in edges.items()]
    seeds = {h: float(rng.random()) for h in hosts[:8]}
    got = propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(list(seeds.items()), "host string, seed double"), Shelf(spark, "t"), tolerance=1e-9)
    want = _ranks(edges, seeds)
    for r in got.collect():
        assert r.score == pytest.approx(want[r.host], abs=1e-6)


def test_propagation_over_a_star(spark):
    """What reaches a hub over very many hosts, each of which moves very little, isn't lost."""
    mid = spark.range(20_000).selectExpr("concat('m', id) AS mid")
    edges = mid.selectExpr("'root' AS src", "mid AS dst", "1L AS n").unionAll(mid.selectExpr("mid AS src", "'hub' AS dst", "1L AS n"))
    got = propagate(edges, spark.createDataFrame([("root", 1.0)], "host string, seed double"), Shelf(spark, "t"))
    assert {r.host: r.score for r in got.where("host IN ('root', 'hub')").collect()} == {"root": 1.0, "hub": pytest.approx(0.85**2)}


def test_link_farm(spark):
    page = lambda *to: "".join(f'<a href="http://{h}/x">y</a>' for h in to)
    rows = [("http://bad.net/es/a", ""), ("http://worse.net/fr/b", ""), ("http://good.com/", page("fine.org"))]
    rows += [(f"http://farm{i}.org/", page("bad.net", "worse.net")) for i in range(9)]
    rows += [("http://fine.org/", page("bad.net", "good.com")), ("http://far.org/", page("fine.org")), ("http://bad.net/other", "")]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    verdict = {u: r.verdict for (u, _), r in zip(rows, sorted(filter_urls(pages).collect()), strict=True)}
    assert all(verdict[f"http://farm{i}.org/"] == "block" for i in range(9))
    assert verdict["http://fine.org/"] == verdict["http://good.com/"] == verdict["http://bad.net/other"] == "allow"


def test_packing_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(spark.range(300).selectExpr("CAST(NULL AS LONG)", "''"))
    rows = pack_documents(docs, per_partition=200, fan=3).collect()
    tokenizer, pieces, sequences = Tokenizer.from_file(str(public.path(f"{TOKENIZER}.json"))), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for r in docs.where("doc_id IS NOT NULL").collect():
        ids, at = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for k, (start, length, crc) in enumerate(sorted(pieces[r.doc_id])):
            assert start == at and (length == 2048 or k == 0) and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(pieces[None]) == 300 and len(sequences) <= 1.02 * lower_bound(np.array([r.length for r in rows]), 2048)


@pytest.mark.parametrize(("low", "high"), [(600, 1100), (400, 700), (1, 2047)])
def test_packing_moves_a_bounded_part(spark, low, high):
    """Lengths whose bound no packing meets: few pieces move on, and the result is near that of one task."""
    lengths = np.random.default_rng(5).integers(low, high, 60_000)
    bins, _, opened, gap = certified(lengths[:5_000], 2048, 8, 500)
    filled = np.bincount(bins, lengths[:5_000])
    assert opened.sum() <= 500 and filled[np.unique(bins[opened])].max(initial=0) <= 2048
    rows = [(i, 0, 0, int(x), 0, i) for i, x in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, seq long")
    got = pack_pieces(pieces, Shelf(spark, "t"), per_partition=5_000, fan=4).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k")).collect()
    assert sum(r.k for r in got) == len(lengths) and max(r.n for r in got) <= 2048
    assert len(got) <= 1.01 * (best_fit(lengths, 2048)[0].max() + 1)


def test_mixture_carries_copies(spark):
    rows = [(1, "a b c", "s"), (1, "d e", "s"), (2, "f", "s"), (2, "f", "s"), (None, "g h", None), (3, "i " * 9, "t"), (4, None, "t"), (5, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = F.xxhash64("text").alias("mark")
    want = {(r.doc_id, r.mark): r.n for r in mix_sources(docs).groupBy("doc_id", "mark").agg(F.sum("copies").alias("n")).collect() if r.n}
    got = {(r.doc_id, r.mark): r.n for r in mixture(docs).select("doc_id", key).groupBy("doc_id", "mark").agg(F.count("*").alias("n")).collect()}
    assert got == want and sum(want.values()) >= 5
