"""Sources and sinks: fallbacks, discovery, matrices, structures, appending, indexed tables."""

import gzip
from importlib.util import find_spec

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import hits
from helixframe.sources import readers


def test_fallbacks(spark, tmp_path):
    one = spark.createDataFrame([(1, "x")], "id int, name string")
    one.write.parquet(str(tmp_path / "tophits"))
    assert readers.read_first(spark, str(tmp_path / "allhits"), str(tmp_path / "tophits")).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.read_first(spark, str(tmp_path / "allhits"))
    assert readers.first_existing(one, "header", "name", "id") == "name"
    with pytest.raises(ValueError):
        readers.first_existing(one, "header")
    assert readers.count_fasta_or_zero(spark, str(tmp_path / "none.fa")) == 0


def test_hit_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("\t".join("abcdefgh") + "\nbad\n")
    (tmp_path / "b.tsv").write_text("")
    (tmp_path / "c.dmnd").write_text("q")
    assert readers.valid_hits(spark, str(tmp_path / "a.tsv")) and not readers.valid_hits(spark, str(tmp_path / "b.tsv"))
    assert [p.rsplit("/", 1)[1] for p in readers.discover(spark, str(tmp_path), ".tsv")] == ["a.tsv", "b.tsv"] and not readers.discover(spark, str(tmp_path), ".x")
    rows = spark.createDataFrame([("q", "s", "90", "80", "1e3"), ("q", "t", "10", "80", "7"), ("q", "u", "?", "90", "1")], readers.HITS)
    out = {r.sseqid: (r.pident, r.db) for r in readers.filter_hits(rows, 50, 70, "afdb").collect()}
    assert out == {"s": (90.0, "afdb"), "u": (None, "afdb")}
    assert hits.at_least(rows, "approx_pident", 30).count() == 3


def test_arrays(spark, tmp_path):
    m = np.arange(25, dtype=np.float32).reshape(5, 5)
    np.save(tmp_path / "first.npy", m)
    np.save(tmp_path / "second.npy", m.T)
    got = {(r.ref_id, r.i, r.j): r.pae for r in readers.pae_arrays(spark, str(tmp_path), 2).collect()}
    assert len(got) == 18 and all(got["first", i, j] == got["second", j, i] == m[2 * i, 2 * j] for i in range(3) for j in range(3))


def test_structures(spark, tmp_path):
    rows = [("p1", k, "ALA" if k % 2 else "GLY", 1.5 * k, -2.0 * k, 0.25, 90.0 + k) for k in range(4)]
    points = spark.createDataFrame(rows, "ref_id string, pos long, resname string, x double, y double, z double, plddt double")
    readers.write_pdb(points, str(tmp_path / "out"))
    (file,) = (tmp_path / "out" / "ref_id=p1").glob("part-*")
    extra = "ATOM      9  N   SER B   1       0.000   0.000   0.000  1.00 10.00           N\nENDMDL\nATOM      1  CA  TRP A   9       0.000   0.000   0.000  1.00  1.00           C\n"
    with gzip.open(tmp_path / "p1.pdb.gz", "wt") as f:
        f.write(file.read_text().replace("END\n", "") + extra)
    atoms = readers.pdb_atoms(readers.read_pdb(spark, str(tmp_path / "p1.pdb.gz")))
    back = sorted((r.res - 1, r.resname, r.x, r.y, r.z, r.plddt) for r in readers.polymer(atoms).collect())
    assert back == [r[1:] for r in rows] and atoms.count() == 5 and atoms.first().ref_id == "p1"
    kept = readers.backbone(atoms).collect()
    assert len(kept) == 4 and all(r.chain == "A" and set(r.atoms) == {"CA"} for r in kept)


def test_append_and_index(spark, tmp_path):
    rows = spark.range(6).select("id", (F.col("id") * 2).alias("v"))
    for most in (4, 6, 6):
        readers.append_rows(rows.where(f"id < {most}"), str(tmp_path / "t"), "id")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == list(range(6))
    readers.create_index_table(rows, "indexed_rows", "id", 4)
    try:
        about = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED indexed_rows").collect()}
        assert spark.table("indexed_rows").where("id = 3").first().v == 6 and about["Bucket Columns"] == about["Sort Columns"] == "[`id`]"
    finally:
        spark.sql("DROP TABLE indexed_rows")


def test_error_matrices_of_a_folder(spark, tmp_path):
    import json

    for name, k in (("one", 1), ("two", 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"predicted_aligned_error": [[k * (3 * i + j) for j in range(3)] for i in range(3)]}]))
    got = {(r.ref_id, r.i, r.j): r.pae for r in readers.read_pae(spark, str(tmp_path)).collect()}
    assert len(got) == 18 and got["two", 2, 1] == 14


def test_blobs(spark):
    import gzip as gz
    import json

    import zstandard

    n = len(readers.ATOM37)
    mask = [[k < 3 for k in range(n)], [k == 1 for k in range(n)]]
    x = {"sequence": "WX", "atom37_mask": mask, "atom37_positions": [[[r, k, 0.5] for k in range(n)] for r in range(2)], "confidence": [0.5, 1.0]}
    pdb = b"HEADER x\nATOM"
    blobs = [("a", pdb), ("b", zstandard.ZstdCompressor().compress(json.dumps(x).encode())), ("c", gz.compress(pdb)), ("d", b"\x00\x01"), ("e", None)]
    blobs += [("f", blobs[1][1][:-9]), ("g", gz.compress(pdb)[:-9]), ("h", b"HEADER \xff"), ("i", b"\x28\xb5\x2f\xfd\xff\xff\xff\xff")]
    other = "broken" if find_spec("brotli") and find_spec("msgpack") else "unreadable"
    decoded = readers.decode_blobs(spark.createDataFrame(blobs, "ref_id string, content binary"))
    assert {r.ref_id: r.kind for r in decoded.collect()} == {"a": "pdb", "b": "json", "c": "pdb", "d": other, "e": "missing"} | dict.fromkeys("fghi", "broken")
    rows = sorted((r.res, r.atom, r.resname, r.x, r.y, r.plddt) for r in readers.atom37_rows(readers.structures_of(decoded)).collect())
    assert rows == [(1, "C", "TRP", 0, 2, 50), (1, "CA", "TRP", 0, 1, 50), (1, "N", "TRP", 0, 0, 50), (2, "CA", "UNK", 1, 1, 100)]
