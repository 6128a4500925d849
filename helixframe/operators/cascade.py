"""The exclusive cascade of template classes, and templates for what a template leaves open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignment
from ..sources.stage import staged
from . import hits, search


def aligned_hits(found: DataFrame, queries: DataFrame, targets: DataFrame, local: bool = False, matrix: str = "BLOSUM45", clean: Callable[[Column], Column] | None = None) -> DataFrame:
    """Hits with ``x``, their alignment; null for queries beyond the longest; ``clean`` as in ``hits.annotate``.

    Rows are few bytes and long work, so they go to a fixed number of partitions, which adaptive execution doesn't merge.
    """
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = hits.annotate(found, queries, targets, clean=clean).repartition(parts, "query", "row_idx")
    return rows.withColumn("x", alignment.aligner(local, matrix=matrix)("full_qseq", "full_sseq"))


def pair_shares(q, s):
    """(identity, coverage): equal over paired columns, and paired columns over the query's length without gaps."""

    @F.pandas_udf("pairs long, same long")
    def count(qs, ss):
        import pandas as pd

        rows = [(sum(a != "-" and b != "-" for a, b in zip(q or "", s or "", strict=True)), sum(a == b != "-" for a, b in zip(q or "", s or "", strict=True))) for q, s in zip(qs, ss, strict=True)]
        return pd.DataFrame(rows, columns=["pairs", "same"])

    return count(q, s)


def split_c(aligned: DataFrame, coverage: float = 0.7, identity: float = 0.4) -> DataFrame:
    """(query, row_idx, identity, coverage, part): of each query the alignment that covers most, C1 where both bounds are met, else C2."""
    rows = aligned.where("x.q IS NOT NULL").withColumn("n", pair_shares(F.col("x.q"), F.col("x.s")))
    rows = rows.select("query", "row_idx", "shared", (F.col("n.same") / F.greatest("n.pairs", F.lit(1))).alias("identity"), (F.col("n.pairs") / F.length("full_qseq")).alias("coverage"))
    best = hits.best(rows, "query", F.desc("coverage"), F.desc("shared"), F.desc("row_idx"))
    good = (F.col("coverage") >= coverage) & (F.col("identity") >= identity)
    return best.select("query", "row_idx", "identity", "coverage", F.when(good, "C1").otherwise("C2").alias("part"))


def template_classes(classes: DataFrame, aligned: DataFrame, queries: DataFrame, longest: int = alignment.LONGEST) -> DataFrame:
    """(query, row_idx, class), a row for each query: A and B as classified, C1 or C2 of the others by their best covered hit, D without one, too_long beyond the longest."""
    solved = classes.where("class IN ('A', 'B')")
    rest = split_c(aligned.join(solved.select("query"), "query", "left_anti"))
    done = solved.select("query", "row_idx", "class").unionAll(rest.selectExpr("query", "row_idx", "part AS class"))
    kind = F.when(F.length("seq") > longest, "too_long").otherwise(F.coalesce("class", F.lit("D")))
    return queries.join(done, "query", "left").select("query", "row_idx", kind.alias("class"))


def rescued(aligned: DataFrame, identity: float = 0.4, coverage: float = 0.7) -> DataFrame:
    """Rows without a domain that a local alignment (``x`` of ``aligned_hits`` with ``local``) makes C1 after all."""
    return split_c(aligned, coverage, identity).where("part = 'C1'")


def fragment_templates(segments: DataFrame, postings: DataFrame, targets: DataFrame, top: int = 3, k: int = 9, n: int = 100) -> DataFrame:
    """(query, row_idx, containment, identity, coverage): for segments (query, text) the first of their top hits, by rank, whose local alignment passes the gates."""
    from ..functions import alphabet

    found = search.containment_search(postings, segments, k=k, n=n, top=top)
    seqs = segments.select("query", alphabet.strip(F.col("text")).alias("seq"))
    rows = aligned_hits(found, seqs, targets, local=True, matrix="BLOSUM62").where("x.q IS NOT NULL").withColumn("c", pair_shares(F.col("x.q"), F.col("x.s")))
    rows = rows.withColumns({"identity": F.col("c.same") / F.greatest("c.pairs", F.lit(1)), "coverage": F.col("c.pairs") / F.length("full_qseq")})
    passed = hits.local_gates(rows)
    return hits.best(passed, "query", F.desc("shared"), F.desc("row_idx")).select("query", "row_idx", "containment", "identity", "coverage")


def whole_chain(marks: DataFrame, window: int = 40, threshold: float = 0.8) -> DataFrame:
    """(ref_id, n, passes) where no error matrix gives domains: all positions of the comparison (ref_id, marks) as one."""

    @F.pandas_udf("boolean")
    def run(m):
        return m.map(lambda x: alignment.windows_pass(x or "", window, threshold))

    return marks.select("ref_id", F.length("marks").alias("n"), run("marks").alias("passes"))


def search_in_turn(queries: DataFrame, sources: dict[str, DataFrame], top: int = 5, **how) -> DataFrame:
    """(query, source, row_idx, shared, containment): each source (name, postings) is asked only for the queries that no source before it has a hit for.

    What is left is written between rounds, so a source's search isn't repeated by those after it.
    """
    left, out = queries.select("query", "text"), None
    for name, postings in sources.items():
        found = staged(search.containment_search(postings, left, top=top, **how).withColumn("source", F.lit(name)), "turn")
        out = found if out is None else out.unionAll(found)
        left = left.join(found.select("query").distinct(), "query", "left_anti")
    return out.select("query", "source", "row_idx", "shared", "containment")


def fragments_in_turn(segments: DataFrame, sources: dict[str, tuple[DataFrame, DataFrame]], **how) -> DataFrame:
    """``fragment_templates`` over sources (name: postings and targets) in turn, with ``source``: the later ones see only segments without a template so far."""
    left, out = segments.select("query", "text"), None
    for name, (postings, targets) in sources.items():
        found = staged(fragment_templates(left, postings, targets, **how).withColumn("source", F.lit(name)), "turn")
        out = found if out is None else out.unionAll(found)
        left = left.join(found.select("query"), "query", "left_anti")
    return out


def class_rows(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of the tables that a run leaves: hits (query, row_idx, shared, containment) with ``class``, that of their query, and ``chosen``, whether the hit is the template; queries without a hit have a row of nulls."""
    rows = classes.withColumnRenamed("row_idx", "template").join(found, "query", "left")
    return rows.withColumn("chosen", F.coalesce(F.col("row_idx").eqNullSafe(F.col("template")) & F.col("template").isNotNull(), F.lit(False))).drop("template")


def write_class_tables(rows: DataFrame, path: str) -> None:
    """``class_rows`` as Parquet: a folder a class, written in one pass, so each class is a table of its own."""
    rows.write.partitionBy("class").option("compression", "zstd").parquet(path)


def read_class_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """One class's table, of which alone the files are read, or all."""
    rows = spark.read.parquet(path)
    return rows if name is None else rows.where(F.col("class") == name)
