"""K-mer document-frequency index, bottom-N sketches, postings and containment search.

Tables: sequences (row_idx, text) and queries (query, text).  The target sketch
is the N smallest kept k-mers, the query sketch the N smallest of all.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.alphabet import DENSE, SCHEMES, distinct_kmers, kmer_frequency


def max_frequency(arg: float, total: int) -> int:
    """Below 1 a fraction of the sequences, at least 1; else absolute."""
    return max(1, math.floor(arg * total)) if arg < 1 else int(arg)


def document_frequency(kmers: DataFrame) -> DataFrame:
    """(h, df) from (row_idx, codes)."""
    return kmers.select(F.explode("codes").alias("h")).groupBy("h").agg(F.count("*").alias("df"))


def keep_band(frequency: DataFrame, most: int) -> DataFrame:
    return frequency.where(F.col("df").between(1, most))


def sketches(kmers: DataFrame, keep: DataFrame, n: int) -> DataFrame:
    """(row_idx, pos, h): the n smallest kept k-mers of each sequence, from 1."""
    rows = kmers.select("row_idx", F.explode("codes").alias("h")).join(keep.select("h"), "h", "left_semi")
    rank = F.row_number().over(Window.partitionBy("row_idx").orderBy("h"))
    return rows.withColumn("pos", rank).where(F.col("pos") <= n).select("row_idx", "pos", "h")


def target_sketches(sequences: DataFrame, k: int = 9, n: int = 100, max_freq: float = 10, scheme: str = "murphy2000_5", segmented: bool = True) -> DataFrame:
    """(row_idx, pos, h): the n smallest k-mers of each sequence within the frequency band.

    Where all codes there can be are few (``DENSE``), only counts are shuffled, one
    for each k-mer and task; the keep list goes to all tasks as a bit for each code, and a
    sequence's sketch is taken where its k-mers are.  Beyond, k-mers are rows that
    join with the keep list.
    """
    most = max_frequency(max_freq, sequences.count() if max_freq < 1 else 0)
    codes = len(SCHEMES[scheme]) ** k
    if codes > DENSE:
        kmers = distinct_kmers(sequences, "row_idx", "text", k, scheme, segmented)
        return sketches(kmers, keep_band(document_frequency(kmers), most), n)
    kept = np.zeros(codes, np.uint8)
    kept[keep_band(kmer_frequency(sequences, "text", k, scheme, segmented), most).select("h").toArrow()["h"].to_numpy()] = 1
    rows = distinct_kmers(sequences, "row_idx", "text", k, scheme, segmented, n, np.packbits(kept, bitorder="little"))
    return rows.select("row_idx", F.posexplode("codes").alias("pos", "h")).select("row_idx", (F.col("pos") + 1).alias("pos"), "h")


def build_index(sequences: DataFrame, k: int = 9, n: int = 100, max_freq: float = 10, scheme: str = "murphy2000_5", segmented: bool = True) -> DataFrame:
    """The postings (h, row_idx)."""
    return target_sketches(sequences, k, n, max_freq, scheme, segmented).select("h", "row_idx")


def query_sketches(queries: DataFrame, k: int = 9, n: int = 100, scheme: str = "murphy2000_5", segmented: bool = True) -> DataFrame:
    return distinct_kmers(queries, "query", "text", k, scheme, segmented, n).select("query", F.explode("codes").alias("h"))


def containment_search(postings: DataFrame, queries: DataFrame, k: int = 9, n: int = 100, top: int = 5, min_shared: int = 2, scheme: str = "murphy2000_5", segmented: bool = True) -> DataFrame:
    """(query, row_idx, shared, containment): of each query its top targets by (shared, row_idx), both descending."""
    hits = query_sketches(queries, k, n, scheme, segmented).join(postings, "h").groupBy("query", "row_idx").agg(F.count("*").alias("shared"))
    hits = hits.where(F.col("shared") >= min_shared)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("shared"), F.desc("row_idx")))
    return hits.withColumn("rank", rank).where(F.col("rank") <= top).select("query", "row_idx", "shared", (F.col("shared") / F.lit(float(n))).alias("containment"))


def posting_lists(postings: DataFrame) -> DataFrame:
    """(h, n, rows): ascending targets of each k-mer; bounded by the frequency band."""
    return postings.groupBy("h").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("row_idx")).alias("rows"))


def write_index(postings: DataFrame, path: str, meta: dict[str, str]) -> None:
    """Postings in order of h, so that row-group statistics prune; parameters beside them."""
    postings.repartitionByRange("h").sortWithinPartitions("h", "row_idx").write.option("compression", "zstd").parquet(f"{path}/postings")
    postings.sparkSession.createDataFrame([(str(k), str(v)) for k, v in meta.items()], "name string, value string").write.parquet(f"{path}/meta")


def read_index(spark, path: str) -> tuple[DataFrame, dict[str, str]]:
    # an index that doesn't name its scheme or length was made with these
    meta = {"scheme": "murphy2000_5", "k": "11"} | {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/meta").limit(100).collect()}
    return spark.read.parquet(f"{path}/postings"), meta


def sketch_arrays(sketches: DataFrame, n: int) -> DataFrame:
    """(row_idx, sketch): each sketch as an array of fixed length, filled up with the largest 32-bit number."""
    rows = sketches.groupBy("row_idx").agg(F.sort_array(F.collect_list("h")).alias("s"))
    return rows.select("row_idx", F.concat("s", F.array_repeat(F.lit((1 << 32) - 1), F.greatest(F.lit(n) - F.size("s"), F.lit(0)))).alias("sketch"))


def write_sketches(sketches: DataFrame, path: str, n: int) -> None:
    sketch_arrays(sketches, n).write.option("compression", "zstd").parquet(path)
