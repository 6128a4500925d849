from corpus_pipeline import exact_dedup
from helixframe.llm.jaccard_join import near_duplicates
from helixframe.llm.warc import archive_pages


def test_exact_copies(spark):
    rows = [(1, "one text"), (2, "one text"), (2, "another"), (3, "third"), (3, "third"), (3, "fourth"), (None, "one text"), (4, "one\x0btext")]
    out = exact_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(str, out.collect())) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [(1, "one text"), (2, "another"), (3, "third"), (3, "fourth"), (None, "one text")])


def test_near_copies(spark):
    texts = [" ".join(f"t{j}w{i}" for i in range(100)) for j in range(12)]
    rows = [(1, t) for t in texts] + [(10 + j, t + " end") for j, t in enumerate(texts)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == {1: 1} | {10 + j: 1 for j in range(12)}


def test_pages(spark):
    big, other = "<p>" + "y" * 2000, "<p>" + "z" * 3000
    pages = spark.createDataFrame([(1, "http://a/x", big), (2, "http://a/y", big), (1, "http://a/z", other)], "page_id long, url string, html string")
    out = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in archive_pages(pages).collect())
    assert out == [(1, 2003, "revisit", 2), (1, 3003, "response", None), (2, 2003, "response", None)]
