"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from helixframe.llm.exact_dedup import exact_groups
from helixframe.llm.jaccard_join import near_duplicates
from helixframe.llm.licenses import license_scan
from helixframe.llm.mixing import mix_sources, mixture
from helixframe.llm.packing import pack_documents
from helixframe.llm.quality import perplexities
from helixframe.llm.substring_dedup import remove_repeats
from helixframe.llm.url_filter import filter_urls
from helixframe.llm.vector_dedup import near_vectors
from helixframe.llm.warc import archive_pages

DDL = "doc_id long, text string, lang string, source string, n_chars long, id long, bucket int, size int, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i % 83}x{i}" for i in range(200))
NEAR = BASE.replace("w5x5 ", "other ")
TEXTS = [
    (1, BASE), (2, NEAR), (3, BASE), (3, BASE), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "ONE two"), (9, "one  two"),
    (10, "start " + " ".join(BASE.split()[20:120]) + " end"), (11, " ".join(["same"] * 120)), (12, " ".join(["same"] * 90)),
    (13, "x" * 300_000), (14, "ßé 漢字 cc by"), (15, " ".join(f"l{i}" for i in range(9_000))), (16, "general public license all rights reserved"), (None, "no id at all"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["de", None, "en"][k % 3], ["a", "b", None][k % 3], None, 1, 2, 3, 4) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def words(text):
    return WORD.findall(text or "")


def test_substring(docs, none):
    first, want = {}, Counter()
    for i, t in TEXTS:
        w = words(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    for i, t in TEXTS:
        w = words(t)
        gone = {k + j for k in range(len(w) - 49) if i is not None and first[tuple(w[k : k + 50])] < i for j in range(50)}
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(docs).collect()) == want
    assert remove_repeats(none).count() == 0


def test_exact(docs, none):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, t in TEXTS:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    keep = {t: min(g)[2] for t, g in groups.items()}
    want = Counter((i, keep[norm(t)], len(groups[norm(t)]), i == keep[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in TEXTS)
    out = exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(map(tuple, out.collect())) == want
    assert exact_groups(none).count() == 0
    assert Counter(map(tuple, exact_groups(docs, partitions=60).select(*out.columns).collect())) == want


def test_near(docs, none):
    def shingles(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t in TEXTS]
    comp = {i: i for i, _ in sets}
    for _ in sets:
        for i, a in sets:
            for j, b in sets:
                if None not in (i, j) and a and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    out = near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == Counter((i, len(s), comp[i]) for i, s in sets)
    assert near_duplicates(none).count() == 0


def test_mixing(docs, none):
    out = mix_sources(docs).collect()
    assert len(out) == len(TEXTS) and out and sum(r["size"] for r in out) == sum(len(words(t)) for _, t in TEXTS)
    assert all(r["copies"] <= 2 for r in out)
    assert sorted(map(repr, out)) == sorted(map(repr, mix_sources(docs.repartition(5)).collect()))
    assert mixture(docs).count() == sum(r["copies"] for r in out) and mixture(docs).columns == docs.columns
    assert mix_sources(none).count() == 0 and mixture(none).count() == 0


def test_packing(docs, none):
    out = pack_documents(docs).collect()
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len({r.doc_id for r in out}) == len({i for i, _ in TEXTS})
    assert pack_documents(none).count() == 0


def test_licenses(docs, none):
    out = {r.doc_id: r for r in license_scan(docs).collect()}
    assert out[14].base_labels == "cc-by" and (out[14].first_word, out[14].n_base) == (2, 1)
    assert out[16].base_labels == "gpl,reserved" and out[16].last_word == 3
    assert (out[4].n_words, out[4].first_word, out[4].base_labels) == (0, None, "") and all(0 <= r.score <= 1 for r in out.values())
    assert license_scan(none).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (7, 0, 1), (None, 1, None), (15, 1, 0)], "doc_id long, quality int, toxic int")
    out = perplexities(docs, labels).collect()
    assert len(out) == len(TEXTS) and all(r.kept and r.perplexity is None for r in out if not r.n_words)
    assert perplexities(none, labels).count() == 0 and perplexities(none, labels.where("false")).count() == 0
    assert all(r.kept and r.perplexity is None for r in perplexities(docs, labels.where("false")).collect())
    near = lambda rows: sorted(f"{r.doc_id} {r.lang} {r.n_words} {r.perplexity and round(r.perplexity, 5)} {r.kept}" for r in rows)
    assert near(out) == near(perplexities(docs.repartition(5), labels).collect()) == near(perplexities(docs, labels, head=1, bloom=12).collect())
    few = perplexities(docs, labels, languages=1).collect()
    assert len(few) == len(TEXTS) and any(r.perplexity for r in few)


def test_pages(spark):
    ddl = "page_id long, url string, html string, host string"
    big = "<p>" + "y" * 2000
    rows = [(1, "http://a.COM/x?q", big, "z"), (2, None, big, None), (3, "no scheme", None, None), (4, "http://es.example.com/en/a", "short", None), (5, "http://www.example.com/en/", "short", None), (6, "x://b.net/es/#f", "", None), (7, "://", big + "é", None)]
    pages = spark.createDataFrame(rows, ddl)
    urls = {r.page_id: (r.host, r.path, r.rule) for r in filter_urls(pages).collect()}
    assert urls[1] == ("a.com", "/x", "com/") and urls[2][:2] == ("", "") and urls[3][:2] == ("", "") and urls[7][:2] == ("", "")
    assert urls[4][2] == "example.com/en/" and urls[5][2] == "www.example.com/en/" and urls[6][2] == "net/es/"
    warc = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in archive_pages(pages).collect()}
    assert warc[1] == (2003, "revisit", 2) and warc[2] == (2003, "response", None) and warc[3] == (0, "response", None) and warc[4][1] == warc[5][1] == "response" and warc[7][0] == 2005
    none = spark.createDataFrame([], ddl)
    assert filter_urls(none).count() == 0 and archive_pages(none).count() == 0


def test_vectors(spark):
    ddl = "vec_id long, embedding array<float>, label int, extra string"
    v = [[1.0, 0.0, 0.0], [0.99, 0.05, 0.0], [0.0, 0.0, 0.0], None, [1.0, None, 0.0], [float("nan"), 1.0, 0.0], [0.0, 1.0, 0.0], [2.0, 0.0, 0.0], [float("inf"), 0.0, 0.0], []]
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame([(i + 1, x, None, "e") for i, x in enumerate(v)], ddl)).collect()}
    assert out == {i: ((2, 1, i == 1) if i in (1, 2, 8) else (0, i, True)) for i in range(1, 11)}
    assert near_vectors(spark.createDataFrame([], ddl)).count() == 0
