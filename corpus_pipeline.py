"""A corpus pipeline: quality, exact copies, near copies, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's documents.  All but the last return the columns of
documents.

Defined cases: a stage that drops documents drops rows by doc_id and text, so of
rows that repeat a doc_id each text is judged for itself; rows without a doc_id are
judged by the quality stage and pass the exact and near ones; null and empty texts
pass the quality and near stages, and are equal texts in the exact one; ties go to the smallest doc_id; tables without rows give none; texts of any
length are read whole; extra columns pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import Shelf
from helixframe.llm.exact_dedup import exact_groups
from helixframe.llm.jaccard_join import near_groups
from helixframe.llm.mixing import mixture
from helixframe.llm.packing import pack_documents
from helixframe.llm.quality import perplexities


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of ``docs`` has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def _without(docs: DataFrame, judged: DataFrame, tag: str) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text ``judged`` (doc_id, mark, kept) keeps; the same join at every size, whatever their number."""
    gone = Shelf(docs.sparkSession, tag).put(judged.where("NOT kept").selectExpr("doc_id AS _gone", "mark AS _mark").distinct())
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_mark"])
    return docs.join(gone.hint("merge"), same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity their language's threshold allows; texts of a repeated doc_id count each for itself."""
    return _without(docs, perplexities(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "stage-quality")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts; texts of a repeated doc_id count each for itself."""
    shelf = Shelf(spark, "stage-exact")
    (sha,) = _free(docs, "sha")
    groups = shelf.put(exact_groups(docs).where("doc_id IS NOT NULL").select("doc_id", "group_size", "kept", F.col("text_sha256").alias(sha)))
    gone = shelf.put(groups.where("NOT kept").select("doc_id", sha).distinct())
    again = groups.where("kept AND group_size > 1").groupBy("doc_id", sha).count().where("count > 1").select("doc_id", sha)
    digest = F.sha2(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), " \t\n\x0b\x0c\r", "").cast("binary"), 256)
    out = docs.withColumn(sha, digest).join(gone.hint("merge"), ["doc_id", sha], "left_anti")
    if again.isEmpty():
        return out.select(*docs.columns)
    once = out.join(again, ["doc_id", sha], "left_semi").dropDuplicates(["doc_id", sha])
    return out.join(again, ["doc_id", sha], "left_anti").select(*docs.columns).unionAll(once.select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each component of near copies; those without words stay."""
    return _without(docs, near_groups(docs), "stage-near")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The quality and packing stages go beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shelf, docs = Shelf(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = shelf.put(stage(spark, docs, sf_dir))
    return docs
