"""Queries whose rows go through files of a kind of their own, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import search
from ..sources import readers, sidx, structure_files
from ..sources.stage import shared_folder
from .queries import _HITS, _POINTS, _cells, _db, _points, _q
from .structure_queries import _CELLS


def _path(s, tag: str) -> str:
    return f"{shared_folder(s)}/{tag}-{uuid.uuid4().hex}"


def posting_files(s, d):
    """The index as posting files, of which the k-mers of the queries are looked up."""
    path = _path(s, "postings")
    sidx.write_postings(search.build_index(_db(s, d)), path, k="9", n_hash="100", max_freq="10")
    return sidx.read_postings(s, path).join(search.query_sketches(_q(s, d)).select("h").distinct(), "h", "left_semi")


def matrix_files(s, d):
    """Error matrices as JSON files, of which each second row and column is read."""
    path = _path(s, "matrices")
    rows = _cells(s, d).groupBy("ref_id", "i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "pae"))), lambda c: c["pae"]).alias("row"))
    rows = rows.groupBy("ref_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "row"))), lambda c: c["row"]).alias("predicted_aligned_error"))
    s.dataSource.register(structure_files.TextFiles)
    texts = rows.select(F.col("ref_id").cast("string").alias("name"), F.to_json(F.array(F.struct("predicted_aligned_error"))).alias("text"))
    texts.write.format("text_files").mode("append").option("suffix", ".json").save(path)
    out = readers.read_pae_rows(s, f"{path}/part-*", 2)
    return out.select(F.col("ref_id").cast("long").alias("ref_id"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("pae", 4).alias("pae"))


def chain_files(s, d):
    """Chains as structure files, a file each, and read again."""
    path = _path(s, "chains")
    p = _points(s, d)
    structure_files.write_structures(p.select(F.col("ref_id").cast("string").alias("name"), F.lit("CA").alias("atom"), F.lit("ALA").alias("resname"), (F.col("pos") + 1).alias("res"), "x", "y", "z", F.lit(50.0).alias("plddt")), path)
    atoms = readers.polymer(readers.pdb_atoms(readers.read_pdb(s, f"{path}/part-*")))
    return atoms.select(F.col("ref_id").cast("long").alias("ref_id"), F.col("res").cast("long").alias("res"), "x", "y", "z")


_NAMES = (posting_files, matrix_files, chain_files)
QUERIES = {f.__name__: f for f in _NAMES}

SQL = {
    "posting_files": _HITS + " SELECT h, id AS row_idx FROM p WHERE h IN (SELECT h FROM q)",
    "matrix_files": f"WITH {_CELLS} SELECT ref_id, i // 2 AS i, j // 2 AS j, round(pae, 4) AS pae FROM c WHERE i % 2 = 0 AND j % 2 = 0",
    "chain_files": _POINTS + " SELECT ref_id, pos + 1 AS res, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM p",
}
