import random

from helixframe.functions.alignment import ORDER
from helixframe.operators import cascade, search
from helixframe.plans.queries import classes


def test_classes_of_templates(spark):
    rng = random.Random(8)
    seq = lambda n: "".join(rng.choices(ORDER, k=n))
    change = lambda s, p: "".join(rng.choice(ORDER) if rng.random() < p else c for c in s)
    a, b, c, far = seq(200), seq(200), seq(300), seq(150)
    gappy = "".join(x + (seq(4) if k % 20 == 19 else "") for k, x in enumerate(c))
    queries = spark.createDataFrame([(1, a), (2, b), (3, c), (4, far), (5, seq(60)), (6, seq(2500))], "query long, seq string")
    targets = spark.createDataFrame([(1, "MK" + a), (2, b[:90] + b[94:]), (3, change(gappy, 0.15)), (4, change(far, 0.8))], "row_idx long, seq string")
    found = spark.createDataFrame([(1, 1, 90), (2, 2, 80), (3, 3, 70), (4, 4, 9)], "query long, row_idx long, shared long")
    aligned = cascade.aligned_hits(found, queries, targets)
    out = cascade.template_classes(classes(found, queries, targets), aligned, queries).collect()
    assert {r["query"]: (r.row_idx, r["class"]) for r in out} == {1: (1, "A"), 2: (2, "B"), 3: (3, "C1"), 4: (4, "C2"), 5: (None, "D"), 6: (None, "too_long")}
    assert [r["query"] for r in cascade.rescued(aligned).collect()].count(3) == 1


def test_fragment_templates(spark):
    rng = random.Random(6)
    t = ["".join(rng.choices(ORDER, k=400)) for _ in range(6)]
    targets = spark.createDataFrame(list(enumerate(t)), "row_idx long, text string")
    segments = spark.createDataFrame([(1, t[2][100:220]), (2, "".join(rng.choices(ORDER, k=90)))], "query long, text string")
    out = cascade.fragment_templates(segments, search.build_index(targets, n=400), targets.withColumnRenamed("text", "seq")).collect()
    assert [(r["query"], r.row_idx, r.identity, r.coverage) for r in out] == [(1, 2, 1.0, 1.0)]


def test_whole_chain(spark):
    marks = spark.createDataFrame([(1, "|" * 50), (2, "|" * 20 + "." * 30), (3, "")], "ref_id long, marks string")
    assert [r.passes for r in cascade.whole_chain(marks).orderBy("ref_id").collect()] == [True, False, False]


def test_class_tables(spark, tmp_path):
    classes = spark.createDataFrame([(1, 7, "A"), (2, 9, "C1"), (3, None, "D")], "query long, row_idx long, class string")
    found = spark.createDataFrame([(1, 7, 50, 0.5), (1, 8, 40, 0.4), (2, 9, 9, 0.09)], "query long, row_idx long, shared long, containment double")
    path = str(tmp_path / "tables")
    cascade.write_class_tables(cascade.class_rows(found, classes), path)
    got = sorted(((r["query"], r.row_idx, r.shared, r.chosen, r["class"]) for r in cascade.read_class_table(spark, path).collect()), key=str)
    assert got == [(1, 7, 50, True, "A"), (1, 8, 40, False, "A"), (2, 9, 9, True, "C1"), (3, None, None, False, "D")]
    one = cascade.read_class_table(spark, path, "A")
    assert one.count() == 2 and "PartitionFilters: [isnotnull(class" in one._jdf.queryExecution().executedPlan().toString()
