"""Mixing sources to target weights.

Sizes (words) are summed by source.  Source weights repeat over the sources in
code point order, null last.  Together the targets are ``share`` times all
sizes; a target stops at ``most`` times its source's size and the excess is
shared again by weight until none is above: the level at which
sum(min(most * size, level * weight)) is reached, found by one pass over the
sources in the order of their caps.  A source's rate is its target over its
size; each document comes floor(rate) times and once more with the rate's
fraction as probability.

The extra copies are hash-seeded Bernoulli draws.  Within a stratum (a source,
salted so that no stratum grows with its source) the draws share one hashed
start and step by the fraction over documents from the longest to the shortest:
each draw has exactly that probability, and the words drawn stay within the
stratum's longest document of what they should be.

Only aggregates of sources meet in one task.  Defined cases: null text has size
0; a source of size 0 gets target 0; repeated rows draw each for themselves and
come as often as all of them together; null ids hash as an empty string; documents
of one length stand in the order of their hashes; an empty table gives none; texts
of any length are counted whole; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf

_WORD = r"[^\x20\x09-\x0D]+"


def _unit(expr: str) -> str:
    """[0, 1) from an MD5."""
    return f"conv(substring(md5({expr}), 1, 12), 16, 10) / 281474976710656D"


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target from (source, size)."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(place, F.lit(len(weights))) + 1)
    by = by.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by = by.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    by = by.withColumn("below", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("rest", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    by = by.withColumn("level", (F.col("total") - F.coalesce("below", F.lit(0.0))) / F.col("rest"))
    # of levels that don't fill their source, the first is the highest; without any, all sources are capped
    by = by.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return by.select("source", "source_size", "n", target.alias("target"))


def mix_sources(df: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, stratum: int = 4096, seed: str = "mix") -> DataFrame:
    """doc_id, mark (a hash of the text), source, size, source_size, target and copies of each document of ``df`` (doc_id, text, source)."""
    shelf = Shelf(df.sparkSession, "mix")
    words = f"coalesce(regexp_count(text, '{_WORD.replace(chr(92), chr(92) * 2)}'), 0)"
    sizes = df.select(F.col("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("source"), F.expr(words).cast("long").alias("size"))
    return _mixed(shelf.put(sizes), shelf, weights, share, most, stratum, seed)


def _mixed(sizes: DataFrame, shelf: Shelf, weights, share, most, stratum, seed) -> DataFrame:
    by = shelf.put(targets(sizes, weights, share, most).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    source = by.withColumn("s", F.col("source")).drop("source")
    rows = sizes.join(source, sizes["source"].eqNullSafe(source["s"])).drop("s")
    ident = f"concat_ws(':', '{seed}', doc_id)"
    rows = rows.withColumn("salt", F.expr(f"CAST(floor({_unit(ident)} * ceil(n / {stratum})) AS INT)")).withColumn("draw", F.expr(f"md5({ident})"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("source", "salt").orderBy(F.desc("size"), "draw", "doc_id", "mark")) - 1)
    start = _unit(f"concat_ws(':', '{seed}', coalesce(concat('=', source), ''), salt)")
    rows = rows.withColumn("part", F.expr("rate - floor(rate)")).withColumn("start", F.expr(start))
    extra = "CAST(floor((place + 1) * part + start) - floor(place * part + start) AS INT)"
    return rows.selectExpr("doc_id", "mark", "source", "size", "source_size", "target", f"CAST(floor(rate) AS INT) + {extra} AS copies")


def mixture(df: DataFrame, **how) -> DataFrame:
    """The documents of ``df``, each as often as the mix takes it; rows that repeat doc_id, text and source come as often as all of them together."""
    free = max(map(len, df.columns), default=0) * "_"  # longer than any column's name
    ident, mark, source, times, copy, n = (free + x for x in ("id", "mark", "source", "times", "copy", "n"))
    shelf = Shelf(df.sparkSession, "mixture")
    copies = mix_sources(df, **how).groupBy("doc_id", "mark", "source").agg(F.sum("copies").cast("int").alias(times), F.count("*").alias(n)).where(F.col(times) > 0)
    copies = shelf.put(copies.withColumnsRenamed({"doc_id": ident, "mark": mark, "source": source}))
    same = df["doc_id"].eqNullSafe(F.col(ident)) & (F.xxhash64(df["text"].cast("string")) == F.col(mark)) & df["source"].eqNullSafe(F.col(source))
    one = df.join(copies.where(F.col(n) == 1), same)
    if not copies.where(F.col(n) > 1).isEmpty():
        one = one.unionAll(df.join(copies.where(F.col(n) > 1), same).dropDuplicates([ident, mark, source]))
    return one.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*df.columns)
