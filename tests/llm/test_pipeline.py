"""Each stage of the pipeline and the whole against plain Python."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from helixframe.llm.quality import perplexities

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, _sha string, _gone long"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near(rows):
    """Rows that stay: of each component of links the text of the smallest doc_id."""
    sets, own = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and own[i] != own[j]:
                low, high = sorted((own[i], own[j]))
                own = [low if o == high else o for o in own]
    groups = defaultdict(list)
    for row, o in zip(rows, own, strict=True):
        groups[o].append(row)
    return Counter(min(g, key=lambda r: r[0]) for g in groups.values())


def same(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_near_stage(spark):
    base = [f"w{i}" for i in range(60)]
    edit = lambda *at: " ".join(f"z{i}" if i in at else w for i, w in enumerate(base))
    rows = [(1, edit()), (2, edit(3)), (2, "other words here that link with nothing"), (3, edit(3, 50)), (4, ""), (5, None), (6, "a b"), (7, "a b"), (8, edit(1, 9, 20, 31, 44, 55))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 2) for i, t in rows], DDL)
    out = pipeline.near_dedup(spark, docs, SF)
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    assert out.columns == docs.columns
    assert kept == near([r for r in rows if shingles(r[1])]) + Counter({(4, ""): 1, (5, None): 1})


def test_columns_that_clash(spark):
    """Extra columns named as those that the stages use come through unchanged."""
    rows = [(1, "a b c", "mine"), (2, "abc", "second"), (3, "other words", "third"), (3, "other words", "third"), (4, None, None)]
    names = ("sha", "_sha", "_gone", "_mark", "kept", "mark", "group_size", "count")
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *[v] * len(names)) for i, t, v in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    out = pipeline.exact_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, *r[5:]) for r in out.collect()) == Counter([(i, *[v] * len(names)) for i, v in ((1, "mine"), (3, "third"), (4, None))])
    out = pipeline.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, *r[5:]) for r in out.collect()) == Counter((i, *[v] * len(names)) for i, _, v in rows)


def test_quality_stage(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    bad = perplexities(docs, labels).where("NOT kept").select("doc_id", "mark").collect()
    assert bad
    again = docs.unionAll(docs.where(f"doc_id = {bad[0].doc_id}").withColumn("text", docs["text"].substr(1, 0)))  # an empty text under a rejected doc_id
    out = pipeline.quality(spark, again, SF)
    assert out.columns == docs.columns and out.count() == again.count() - len(bad)
    assert [r.text for r in out.where(f"doc_id = {bad[0].doc_id}").collect()] == [""]


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {(r.doc_id, r.text) for r in pipeline.quality(spark, docs, SF).select("doc_id", "text").collect()}
    groups = defaultdict(list)
    for i, t in kept:
        groups[same(t)].append((-len(t or ""), i, t))
    stay = near(sorted((i, t) for _, i, t in (min(g, key=lambda r: r[:2]) for g in groups.values())))
    out = pipeline.run(spark, SF).collect()
    starts = Counter(r.doc_id for r in out if r.piece == 0)
    assert set(starts) <= {i for i, _ in stay} and max(starts.values()) <= 2
    fill = Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


@pytest.mark.parametrize("order", [1, -1])
def test_repeated_ids_in_both_orders(spark, order):
    one, two = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, one), (1, two), (2, one + " end"), (3, two + " end")][::order]
    out = pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", 1, "x", 2) for i, t in rows], DDL), SF)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(1, one), (1, two)])
