"""Hit tables: annotation, merging, filtering, ranking and the cascade's anti joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def annotate(hits: DataFrame, queries: DataFrame, targets: DataFrame, annotations: DataFrame | None = None, clean: Callable[[Column], Column] | None = None) -> DataFrame:
    """Hits with both sequences (rows without either go) and annotations with defaults.

    ``clean`` makes sequences of what the targets' ``seq`` holds, after the join, so only targets with hits are cleaned.
    """
    out = hits.join(queries.selectExpr("query", "seq AS full_qseq"), "query").join(targets.selectExpr("row_idx", "seq AS full_sseq"), "row_idx")
    if clean is not None:
        out = out.withColumn("full_sseq", clean(F.col("full_sseq")))
    # one predicate over both sides: a filter of the targets alone would go below the join and clean them all
    out = out.where("least(length(full_qseq), length(full_sseq)) > 0").withColumn("qlen", F.length("full_qseq")).withColumn("slen", F.length("full_sseq"))
    if annotations is not None:
        out = out.join(annotations, "row_idx", "left").na.fill(0).na.fill("")
    return out


def merge_by_name(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def best(hits: DataFrame, key: str | list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; the order should break all ties."""
    w = Window.partitionBy(key).orderBy(*order)
    return hits.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def filter_tolerant(hits: DataFrame, **least: float) -> DataFrame:
    """Rows whose fields reach their bounds; fields that are missing or no numbers don't count against a row."""
    for field, bound in least.items():
        if field in hits.columns:
            number = F.col(field).try_cast("double")
            hits = hits.where(number.isNull() | (number >= bound))
    return hits


def select_top(hits: DataFrame, targets: int, field: str) -> DataFrame:
    """Of each query the top targets by a field whose non-numbers count as 0."""
    score = F.coalesce(F.col(field).try_cast("double"), F.lit(0.0))
    return best(hits, "query", score.desc(), F.desc("row_idx"), n=targets).orderBy("query")


def without(rows: DataFrame, *solved: DataFrame, key: str = "query") -> DataFrame:
    """Rows whose key no solved table has."""
    for s in solved:
        rows = rows.join(s.select(key).distinct(), key, "left_anti")
    return rows


def first_seen(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """Each key once, with the first position it stands at."""
    return rows.groupBy(key).agg(F.min(pos).alias(pos))


def first_qualifying(rows: DataFrame, key: str, rank: str, passes: Column, *ties: str) -> DataFrame:
    """Of each key the row with the smallest rank that passes; of equal ranks the first by ``ties``."""
    return best(rows.where(passes), key, *(F.asc(c) for c in (rank, *ties)))


def mask_letter(seq: Column, old: str = "U", new: str = "C") -> Column:
    """The sequence with one letter replaced, and the places (from 0) where it stood."""
    letters = F.split(seq, "")
    at = F.filter(F.transform(letters, lambda c, i: F.when(c == old, i)), lambda i: i.isNotNull())
    return F.struct(F.translate(seq, old, new).alias("masked"), at.alias("at"))


def restore_letter(masked: Column, at: Column, old: str = "U") -> Column:
    """The sequence before ``mask_letter``: the letter again where it stood."""
    return F.array_join(F.transform(F.split(masked, ""), lambda c, i: F.when(F.array_contains(at, i), old).otherwise(c)), "")


def selected_queries(best: DataFrame) -> DataFrame:
    """(row_idx, n, queries): of each target the queries whose best hit it is."""
    rows = best.groupBy("row_idx").agg(F.sort_array(F.collect_list("query")).alias("queries"))
    return rows.select("row_idx", F.size("queries").cast("long").alias("n"), "queries")


def at_least(hits: DataFrame, field: str, bound: float) -> DataFrame:
    """Rows that reach the bound, all rows where the table lacks the field."""
    return hits.where(F.col(field) >= bound) if field in hits.columns else hits


def local_gates(hits: DataFrame, containment: float = 0.08, identity: float = 0.40, coverage: float = 0.70) -> DataFrame:
    """Hits (containment, identity, coverage) good enough to lend a template."""
    return hits.where((F.col("containment") >= containment) & (F.col("identity") >= identity) & (F.col("coverage") >= coverage))


def uncovered(ids: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Ids that no table of results covers with an actual output (``path``)."""
    have = None
    for d in done:
        rows = d.where("path IS NOT NULL AND path <> ''").select(key)
        have = rows if have is None else have.unionAll(rows)
    return ids if have is None else ids.join(have.distinct(), key, "left_anti")


def first_success(rows: DataFrame, key: str, rank: str, ok: Column) -> DataFrame:
    """Of each key the first attempt in rank order that succeeds, with its status; without one, the last attempt's."""
    tried = F.struct(F.when(ok, 0).otherwise(1).alias("failed"), F.when(ok, F.col(rank)).otherwise(-F.col(rank)).alias("at"))
    out = rows.groupBy(key).agg(F.min(tried).alias("x"))
    return out.select(key, F.abs("x.at").alias(rank), F.when(F.col("x.failed") == 0, "ok").otherwise("failed").alias("status"))
