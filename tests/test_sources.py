import gzip
import json

from pyspark.sql import functions as F

from helixframe.functions import accession, alignment
from helixframe.operators import lookup, search, structures
from helixframe.sources import readers


def test_fasta(spark, tmp_path):
    text = ">a one\nMK\nLV\n\n>b\nAC*\n>c\n"
    (tmp_path / "x.fa").write_text(text)
    with gzip.open(tmp_path / "y.fa.gz", "wt") as f:
        f.write(text)
    for name in ("x.fa", "y.fa.gz"):
        assert sorted(map(tuple, readers.read_fasta(spark, str(tmp_path / name), stop=True).collect())) == [("a", "MKLV"), ("b", "AC"), ("c", "")]
        assert readers.count_fasta(spark, str(tmp_path / name)) == 3
    df = readers.read_fasta(spark, str(tmp_path / "x.fa"))
    readers.write_fasta(df, str(tmp_path / "out"))
    assert sorted(readers.read_fasta(spark, str(tmp_path / "out")).collect()) == sorted(df.collect())


def test_hits(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("# c\n\nq\ts\t90\t80\t1e3\nbad\trow\nq\tt\tx\t80\t7\n")
    assert [r.sseqid for r in readers.read_hits(spark, str(tmp_path / "h.tsv")).collect()] == ["s", "t"]


def test_pae(spark):
    full = json.dumps([{"predicted_aligned_error": [[0, 1, 2], [3, 4, 5], [6, 7, 8]]}])
    pairs = json.dumps([{"residue1": [1] * 9, "distance": list(range(9))}])
    rows = spark.createDataFrame([("a", full), ("b", pairs)], "ref_id string, value string")
    cells = {(r.ref_id, r.i, r.j): r.pae for r in readers.pae_cells(rows).collect()}
    assert all(cells[k, i, j] == 3 * i + j for k in "ab" for i in range(3) for j in range(3)) and len(cells) == 18
    assert sorted((r.i, r.j, r.pae) for r in readers.pae_cells(rows.where("ref_id = 'a'"), 2).collect()) == [(0, 0, 0), (0, 1, 2), (1, 0, 6), (1, 1, 8)]


def test_atoms(spark):
    line = "ATOM      2  CA  MET A   7      11.104   6.134  -6.504  1.00 91.50           C"
    r = readers.pdb_atoms(spark.createDataFrame([("x", line), ("x", "TER")], "ref_id string, value string")).first()
    assert (r.atom, r.resname, r.chain, r.res, r.x, r.z, r.plddt) == ("CA", "MET", "A", 7, 11.104, -6.504, 91.5)


def test_rules(spark):
    rows = spark.createDataFrame([("WWHHP", "WWHHP"), ("WW-HHP", "WWYHHP"), ("---WWHHP", "GAVWWHHP"), ("W" + "-Y" * 9, "WH" * 9 + "W")], "q string, s string")
    assert [r[0] for r in rows.select(alignment.class_b(F.col("q"), F.col("s"))).collect()] == [False, True, False, False]
    rows = spark.createDataFrame([("WW---HHHP",), ("PHHHHH----W",), ("WW--HHHP",)], "s string")
    assert [r[0] for r in rows.select(alignment.fix_hanging(F.col("s"))).collect()] == ["---WWHHHP", "PHHHHHW----", "WW--HHHP"]
    rows = spark.createDataFrame([("db:AF-Z9Y8X7-F2",), ("AF-Z9Y8X7-F2-model_v3",), ("other",)], "s string")
    assert [r[0] for r in rows.select(accession.accession(F.col("s"))).collect()] == ["AF-Z9Y8X7-F2", "AF-Z9Y8X7-F2", None]
    rows = spark.createDataFrame([("abc|12|7",), ("abc|x|7",), ("abc",)], "s string")
    assert [tuple(r[0]) for r in rows.select(accession.composite_id(F.col("s"))).collect()] == [("abc", 12, 7), ("abc", -1, -1), ("abc", -1, -1)]


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "MKLVFACDEFGHIK"), (2, "MKLVFACDEFGHIK"), (3, None)], "row_idx long, text string")
    index = search.build_index(docs)
    search.write_index(index, str(tmp_path / "i"), {"k": "9"})
    back, meta = search.read_index(spark, str(tmp_path / "i"))
    assert meta == {"scheme": "murphy2000_5", "k": "9"} and sorted(back.collect()) == sorted(index.collect())
    got = search.containment_search(back, docs.where("row_idx = 1").selectExpr("row_idx AS query", "text"))
    assert [r.row_idx for r in got.orderBy(F.desc("row_idx")).collect()] == [2, 1]
    assert search.max_frequency(0.001, 1000) == 1 and search.max_frequency(0.001, 5000) == 5 and search.max_frequency(50, 9) == 50
    rows = spark.createDataFrame([("ab", 1, 0), ("cd", 1, 1)], "protein_hash string, fragment_id int, frag_row int")
    lookup.write_prefix_index(rows, str(tmp_path / "p"))
    found = lookup.lookup(lookup.read_prefix_index(spark, str(tmp_path / "p")), rows.where("frag_row = 1"))
    assert [r.protein_hash for r in found.collect()] == ["cd"]
    plan = lookup.read_prefix_index(spark, str(tmp_path / "p")).where("prefix = 'c'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan


def test_expand(spark):
    rows = spark.createDataFrame([(0, 8), (2, 8)], "i int, n int")
    assert [r.pos for r in structures.expand_indices(rows, 3, "n").collect()] == [0, 1, 2, 6, 7]
