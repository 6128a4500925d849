"""Template copies and one file a structure."""

import os

import pytest

from helixframe.sources import readers, structure_files


def template(ref, n, side=("N", "CA", "C", "O", "CB", "OG")):
    return [(ref, a, "SER", i + 1, float(i), float(k), -1.25, 50.0 + i) for i in range(n) for k, a in enumerate(side)]


_DDL = "ref_id string, atom string, resname string, res int, x double, y double, z double, plddt double"


def test_copies_and_files(spark, tmp_path):
    atoms = spark.createDataFrame(template("t1", 6) + template("t2", 3), _DDL).repartition(3)
    rows = [("a", "t1", "--MKV"), ("b", "t2", "MKVL"), ("c", "t3", "MK"), ("d", "t1", "M-K"), ("e/1", "t2", "XGW"), ("f", "t1", "MKVLAA--")]
    out, status = structure_files.copied_templates(atoms, spark.createDataFrame(rows, "name string, ref_id string, q string"))
    assert {r.name: r.status for r in status.collect()} == {"a": "ok", "b": "too_short", "c": "no_pdb", "d": "gapped", "e/1": "ok", "f": "ok"}
    structure_files.write_structures(out, str(tmp_path / "pdb"))
    files = {f: os.path.join(d, f) for d, _, names in os.walk(tmp_path / "pdb") for f in names}
    assert set(files) == {"a.pdb", "e_1.pdb", "f.pdb"}
    lines = open(files["a.pdb"]).read().split("\n")
    assert lines[0] == "ATOM      1  N   MET A   3       2.000   0.000  -1.250  1.00 52.00           N"
    assert lines[-4:] == ["ATOM     18  OG  VAL A   5       4.000   5.000  -1.250  1.00 54.00           O", "TER      19      VAL A   5", "END", ""]
    back = readers.pdb_atoms(readers.read_pdb(spark, os.path.dirname(files["a.pdb"]) + "/a.pdb"))
    assert sorted((r.atom, r.resname, r.res, r.x, r.plddt) for r in back.collect()) == sorted((r.atom, r.resname, r.res, r.x, r.plddt) for r in out.where("name = 'a'").collect())
    assert [r.resname for r in out.where("name = 'e/1' AND atom = 'CA'").orderBy("res").collect()] == ["SER", "GLY", "TRP"]
    hits = spark.createDataFrame([("q1", "b", 1), ("q1", "a", 2), ("q1", "f", 3), ("q2", "c", 1)], "query string, name string, rank int")
    assert {r["query"]: r.name for r in structure_files.first_built(status, hits).collect()} == {"q1": "a", "q2": None}


def test_ten_thousand_files(spark, tmp_path):
    spark.dataSource.register(structure_files.TextFiles)
    path = str(tmp_path / "many")
    spark.range(10_000, numPartitions=4).selectExpr("concat('s', id) AS name", "concat('text ', id) AS text").write.format("text_files").mode("append").option("suffix", ".pdb").save(path)
    assert len(os.listdir(path)) == 4 and sum(len(os.listdir(os.path.join(path, d))) for d in os.listdir(path)) == 10_000
    spark.range(3, numPartitions=1).selectExpr("concat('n', id) AS name", "'x' AS text").write.format("text_files").mode("overwrite").save(path)
    assert [sorted(os.listdir(os.path.join(path, d))) for d in os.listdir(path)] == [["n0", "n1", "n2"]]
    with pytest.raises(Exception, match="File exists"):
        spark.range(2, numPartitions=1).selectExpr("'same' AS name", "'x' AS text").write.format("text_files").mode("append").save(path)
    assert len(os.listdir(path)) == 1


def test_no_structures(spark, tmp_path):
    empty = spark.createDataFrame([], "name string, " + _DDL)
    structure_files.write_structures(empty, str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []
