"""The Kneser-Ney model against one in plain Python, and held-out accuracy."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.llm import quality
from helixframe.llm.quality import perplexities

GOOD = [
    "the cat sat on the mat", "the dog sat on the log", "a cat and a dog sat", "the mat and the log", "a cat saw the dog and the dog saw a cat",
    "on the mat the cat sat and the dog sat on the log", "the cat the cat sat", "a log", "the dog", "and the the cat sat on the log log",
]


def sequence(text):
    w = text.split()
    return ["<s>", *(x if i == 0 or x != w[i - 1] else "<again>" for i, x in enumerate(w)), "</s>"]


def kneser_ney(texts, least):
    """log p of a text under an interpolated modified Kneser-Ney model of pairs."""
    pairs = Counter(p for t in texts for w in [sequence(t)] for p in zip(w, w[1:], strict=False) if "<again>" not in p)
    before, after = defaultdict(int), defaultdict(int)
    for (v, w), n in pairs.items():
        before[w] += 1
        after[v] += n

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in range(5)]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = [0.0] + [min(max(k - (k + 1) * y * n[k + 1] / max(n[k], 1), 0), k) for k in (1, 2, 3)]
        return lambda c: d[min(c, 3)]

    d, low = discounts(pairs.values()), discounts(before.values())
    words = {w for w in before if after.get(w, least) >= least}
    total = sum(before.values())
    unknown = max(1 - sum(before[w] - low(before[w]) for w in words) / total, 1e-6) / (len(words) + 1)
    kept = {p: n for p, n in pairs.items() if n >= least}
    known = {v for v in after if after[v] >= least}
    back = {v: max(1 - sum(n - d(n) for (a, _), n in kept.items() if a == v) / after[v], 1e-6) for v in known}

    def p(v, w):
        one = unknown + (max(before[w] - low(before[w]), 0) / total if w in words else 0)
        if v not in known:
            return one
        return (kept[v, w] - d(kept[v, w]) if (v, w) in kept else 0) / after[v] + back[v] * one

    assert abs(sum(p("the", w) for w in words) + p("the", "unseen") - 1) < 1e-9
    return lambda t: sum(math.log(p(v, w)) for s in [sequence(t)] for v, w in zip(s, s[1:], strict=False))


@pytest.mark.parametrize("least,head", [(1, 16), (2, 16), (2, 3)])
def test_perplexity_of_the_model(spark, least, head):
    texts = GOOD + ["the cat saw on zebra log", "zebra zebra zebra", "log mat"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(len(GOOD))], "doc_id long, quality int")
    held = {r.id for r in spark.range(len(GOOD)).where("pmod(xxhash64(id, 17), 4) = 0").collect()}
    logp = kneser_ney([t for i, t in enumerate(GOOD) if i not in held], least)
    out = perplexities(docs, labels, prior=0, least=least, head=head, bloom=16).collect()
    for r in out:
        assert math.log(r.perplexity) == pytest.approx(-logp(texts[r.doc_id]) / (len(texts[r.doc_id].split()) + 1), rel=1e-4)


def test_pairs_seen_once_stay_by_default(spark):
    """Nothing that was counted leaves the model unless it is asked for."""
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(GOOD)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(len(GOOD))], "doc_id long, quality int")
    held = {r.id for r in spark.range(len(GOOD)).where("pmod(xxhash64(id, 17), 4) = 0").collect()}
    logp = kneser_ney([t for i, t in enumerate(GOOD) if i not in held], 1)
    for r in perplexities(docs, labels, prior=0).collect():
        assert math.log(r.perplexity) == pytest.approx(-logp(GOOD[r.doc_id]) / (len(GOOD[r.doc_id].split()) + 1), rel=1e-4)


def test_held_out_accuracy(spark):
    """Labels of a fifth of the documents are kept from the classifier: good ones stay, junk goes."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    hidden = F.expr("pmod(xxhash64(doc_id, 'hidden'), 5) = 0")
    out = perplexities(docs, labels.where(~hidden)).join(labels.where(hidden), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))
    got = {r.quality: (r.n, r.kept) for r in out.collect()}
    assert got[1][1] >= 0.98 * got[1][0] and got[0][1] <= 0.1 * got[0][0], got


def test_repeated_words_go(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(-1, "Orre " * 300, "en"), (-3, "the " * 90, "en"), (-4, "of " * 50 + "is " * 50, "en"), (-2, "THE!! ONES!! ARE!! " * 40, "en")], docs.schema)
    out = perplexities(docs.unionAll(junk), spark.read.parquet(f"{sf}/labels.parquet")).where("doc_id < 0").collect()
    assert not any(r.kept for r in out)


def stages_written(spark):
    """The bytes that each stage has left for the next one."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_a_round_sends_a_share_and_changes_nothing(spark, tmp_path, monkeypatch):
    """Documents are scored in rounds, so that no exchange holds the n-grams of all of them; each row is scored once."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = [(None, "a text without an id", "en"), (None, None, "en"), (None, "the same", None), (7, "another text of this id", "en"), (7, "another text of this id", "en"), (-1, "", "en"), (-2, None, None)]
    docs.unionAll(spark.createDataFrame(odd, docs.schema)).repartition(4).write.parquet(f"{tmp_path}/docs")
    docs, most = spark.read.parquet(f"{tmp_path}/docs"), []

    def scored(*args, f=quality._scored):
        before = stages_written(spark)
        out = f(*args)
        most.append(max(n for k, n in stages_written(spark).items() if k not in before))
        return out

    monkeypatch.setattr(quality, "_scored", scored)
    # a small filter, so that the n-grams are the largest of what is sent
    got, want = (sorted(map(tuple, perplexities(docs, labels, bloom=20, **x).collect()), key=str) for x in ({}, {"rounds": 1}))
    assert len(got) == docs.count() and most[0] < 0.7 * most[1], most
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[6] == b[6] and all(x == y or x == pytest.approx(y, rel=1e-6) for x, y in zip(a[4:6], b[4:6], strict=True)), (a, b)
