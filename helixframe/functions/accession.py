"""Accession, header and file-name columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def accession(seqid: Column) -> Column:
    """``AF-...`` itself or as second ``:`` part, without a model suffix; else NULL."""
    second = F.get(F.split(seqid, ":"), F.lit(1))
    found = F.when(seqid.startswith("AF-"), seqid).when(second.startswith("AF-"), second)
    return F.regexp_replace(found, r"-model_v\d+$", "")


def model_version(acc: Column) -> Column:
    return F.when(acc.rlike(r"^AF-\d{16}$"), 1).otherwise(6)


def composite_id(seqid: Column) -> Column:
    """``hash|fragment|row`` as a struct; -1 for what isn't three parts with two numbers."""
    parts = F.split(seqid, r"\|")
    fid, row = F.get(parts, F.lit(1)).try_cast("int"), F.get(parts, F.lit(2)).try_cast("int")
    good = (F.size(parts) >= 3) & fid.isNotNull() & row.isNotNull()
    return F.struct(F.get(parts, F.lit(0)).alias("protein_hash"), F.when(good, fid).otherwise(-1).alias("fragment_id"), F.when(good, row).otherwise(-1).alias("frag_row"))


def safe_id(name: Column) -> Column:
    return F.regexp_replace(name, r"(?U)[^\w.-]", "_")


def db_type(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("afdb"))


def structure_name(acc: Column) -> Column:
    return F.concat(acc, F.lit("-model_v"), model_version(acc).cast("string"), F.lit(".pdb"))


def db_label(path: Column) -> Column:
    """A database's label by its path: two known families, else the file's name without its last extension."""
    low, name = F.lower(path), F.regexp_extract(path, r"([^/]*)$", 1)
    return F.when(low.contains("esm"), "ESM Atlas").when(low.contains("afdb") | low.contains("alphafold"), "AFDB").otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def stem(path: Column) -> Column:
    """A file's name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]+)[^/]*$", 1)


def file_url(base: str, acc: Column, kind: str) -> Column:
    """Where a model's structure (``model``, pdb) or error matrix (``predicted_aligned_error``, json) is found."""
    return F.concat(F.lit(base.rstrip("/") + "/"), acc, F.lit(f"-{kind}_v"), model_version(acc).cast("string"), F.lit(".pdb" if kind == "model" else ".json"))
