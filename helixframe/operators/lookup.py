"""Hash-prefix-partitioned key lookup, and files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fragment_rows(df: DataFrame, key: str, fragment: str, order: str, pieces: int = 64) -> DataFrame:
    """(protein_hash, fragment_id, frag_row): each key's row number within its fragment, from 0.

    Rows are numbered within pieces of the order's range and moved by what the
    fragment has before the piece, so a fragment of any size is many tasks' work.
    """
    cuts = df.agg(F.percentile_approx(order, [k / pieces for k in range(1, pieces)], 10_000)).first()[0] or []
    piece = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(order))) if cuts else F.lit(0)
    rows = df.select(F.col(key).alias("protein_hash"), F.col(fragment).alias("fragment_id"), F.col(order).alias("at"), piece.alias("piece"))
    n = rows.groupBy("fragment_id", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("fragment_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    first = n.select(F.col("fragment_id").alias("f"), F.col("piece").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("fragment_id", "piece").orderBy("at")) - 1
    rows = rows.withColumn("within", within).join(first, F.col("fragment_id").eqNullSafe(F.col("f")) & (F.col("piece") == F.col("p")))
    return rows.select("protein_hash", "fragment_id", (F.col("first") + F.col("within")).cast("int").alias("frag_row"))


def with_prefix(df: DataFrame, key: str = "protein_hash") -> DataFrame:
    return df.withColumn("prefix", F.substring(key, 1, 1))


def write_prefix_index(df: DataFrame, path: str) -> None:
    """A folder a prefix, each sorted by hash, so that a lookup prunes folders and row groups."""
    out = with_prefix(df).repartition("prefix").sortWithinPartitions("prefix", "protein_hash")
    out.write.partitionBy("prefix").option("compression", "zstd").parquet(path)


def read_prefix_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("protein_hash string, fragment_id int, frag_row int, prefix string").parquet(path)


def lookup(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the index for the keys, joined on prefix and hash: partitions without a key aren't read."""
    return index.join(with_prefix(keys.select("protein_hash").distinct()), ["prefix", "protein_hash"])


def lookup_scan(index: DataFrame, prefix: str) -> DataFrame:
    return index.where(F.col("protein_hash").startswith(prefix))


def todo(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: what an existing output lacks."""
    return df.join(done.select(key), key, "left_anti")


def first_tier(keys: DataFrame, key: str, *tiers: DataFrame) -> DataFrame:
    """Keys with ``tier``, the place of the first table that has them, from 0; null where none does.  Each table is asked only for what those before lack."""
    left, out = keys.select(key).distinct(), None
    for place, tier in enumerate(tiers):
        have = left.join(tier.select(key).distinct(), key, "left_semi").withColumn("tier", F.lit(place))
        out = have if out is None else out.unionAll(have)
        left = left.join(tier.select(key).distinct(), key, "left_anti")
    rest = left.withColumn("tier", F.lit(None).cast("int"))
    return rest if out is None else out.unionAll(rest)
