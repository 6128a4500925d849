"""Matrices read row by row, lookups that prune folders, searches over sources in turn."""

import json
import os
import random

import pytest

from helixframe.functions.alignment import ORDER
from helixframe.operators import cascade, lookup, search
from helixframe.sources import readers


@pytest.mark.parametrize("step", [1, 2, 3])
@pytest.mark.parametrize("split", [1 << 27, 200])
def test_matrix_rows(spark, tmp_path, step, split):
    """As the whole-text reader gives them, in files of one split or many, in both layouts."""
    rng = random.Random(4)
    for name, n in (("a", 7), ("b", 12), ("c", 1)):
        m = [[round(rng.uniform(0, 31), 2) for _ in range(n)] for _ in range(n)]
        (tmp_path / f"{name}.json").write_text(json.dumps([{"predicted_aligned_error": m, "max_predicted_aligned_error": 31.75}], indent=1 if name == "b" else None))
    flat = [(i, j) for i in range(5) for j in range(5)]
    (tmp_path / "d.json").write_text(json.dumps([{"residue1": [i + 1 for i, _ in flat], "residue2": [j + 1 for _, j in flat], "distance": [i * 10 + j for i, j in flat], "max_predicted_aligned_error": 31}]))
    (tmp_path / "e.json").write_text('[{"predicted_aligned_error":[]}]')
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(split))
    try:
        got = sorted(map(tuple, readers.read_pae_rows(spark, str(tmp_path), step).collect()))
    finally:
        spark.conf.set(key, before)
    assert got == sorted(map(tuple, readers.read_pae(spark, str(tmp_path), step).collect())) and got


def test_lookup_reads_only_folders_of_its_keys(spark, tmp_path):
    rows = spark.range(4000).selectExpr("md5(CAST(id AS STRING)) AS protein_hash", "CAST(id % 7 AS INT) AS fragment_id", "CAST(id AS INT) AS frag_row")
    path = str(tmp_path / "index")
    lookup.write_prefix_index(rows, path)
    folders = [n for n in os.listdir(path) if n.startswith("prefix=")]
    assert len(folders) == 16
    keys = rows.where("frag_row IN (3, 5) AND fragment_id < 7").select("protein_hash")
    spark.createDataFrame(keys.collect(), "protein_hash string").write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys")).where("protein_hash > ''")
    out = lookup.lookup(lookup.read_prefix_index(spark, path), keys)
    assert sorted(r.frag_row for r in out.collect()) == [3, 5]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    scans = out._jdf.queryExecution().executedPlan()
    found, todo = [], [scans]
    while todo:
        node = todo.pop()
        if "FileSourceScanExec" in node.getClass().getName() and "prefix" in node.toString():
            m = node.metrics().get("numPartitions")
            found += [m.get().value()] if m.isDefined() else []
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        for inner in ("executedPlan", "plan"):
            if hasattr(node, inner) and ("AdaptiveSparkPlan" in node.getClass().getName() or "QueryStage" in node.getClass().getName()):
                try:
                    todo.append(getattr(node, inner)())
                    break
                except Exception:  # noqa: BLE001, S112  a node without it
                    continue
    assert found and max(found) <= 2


def test_fragments_over_sources_in_turn(spark):
    rng = random.Random(6)
    t = ["".join(rng.choices(ORDER, k=400)) for _ in range(6)]
    table = lambda rows: spark.createDataFrame(rows, "row_idx long, text string")
    one, two = table([(0, t[0]), (1, t[1])]), table([(10, t[1]), (11, t[2])])
    sources = {name: (search.build_index(x, n=400), x.withColumnRenamed("text", "seq")) for name, x in (("first", one), ("second", two))}
    segments = spark.createDataFrame([(1, t[1][50:200]), (2, t[2][100:220]), (3, t[4][:90])], "query long, text string")
    out = cascade.fragments_in_turn(segments, sources).collect()
    assert sorted((r["query"], r.source, r.row_idx) for r in out) == [(1, "first", 1), (2, "second", 11)]
    found = cascade.search_in_turn(segments, {k: p for k, (p, _) in sources.items()}).collect()
    assert sorted((r["query"], r.source, r.row_idx) for r in found) == [(1, "first", 1), (2, "second", 11)]
