"""Points and matrices of structures as rows: distances, breaks, segments, anchors, domains.

Point tables have (ref_id, pos, x, y, z).  Windows are partitioned by structure,
whose length bounds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _chain():
    return Window.partitionBy("ref_id").orderBy("pos")


def _back():
    """The chain from its end: what stands ahead comes first, so that running frames serve both ways."""
    return Window.partitionBy("ref_id").orderBy(F.desc("pos"))

def step_length() -> Column:
    """Distance from the position before."""
    moved = [F.col(c) - F.lag(c).over(_chain()) for c in "xyz"]
    return F.sqrt(moved[0] * moved[0] + moved[1] * moved[1] + moved[2] * moved[2])


def chain_breaks(points: DataFrame, longest: float = 5.5, most: int = 25) -> DataFrame:
    """Points with ``segment``: one more after each step over ``longest``, held at ``most``."""
    jump = points.withColumn("jump", step_length() > longest)
    up_to = _chain().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return jump.withColumn("segment", F.least(F.sum(F.when(F.col("jump"), 1).otherwise(0)).over(up_to), F.lit(most))).drop("jump")


def islands(rows: DataFrame, flag: str) -> DataFrame:
    """(ref_id, start, end, n): maximal runs of consecutive positions where ``flag`` holds."""
    r = rows.where(F.col(flag)).withColumn("g", F.col("pos") - F.row_number().over(_chain()))
    return r.groupBy("ref_id", "g").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n")).drop("g")


def uncovered_segments(rows: DataFrame, covered: str, least: int) -> DataFrame:
    """Runs outside of all domains of at least ``least`` positions, with the covered positions beside them."""
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (_chain(), _back()))
    inside = F.when(F.col(covered), F.col("pos"))
    r = rows.withColumn("prev", F.last(inside, True).over(before)).withColumn("next", F.last(inside, True).over(after)).where(~F.col(covered))
    return r.groupBy("ref_id", "prev", "next").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n")).where(F.col("n") >= least)


def interpolate(points: DataFrame, known: str, column: str, step: float = 3.8) -> DataFrame:
    """``column`` at unknown positions on the line between its neighbours; beyond the last one, ``step`` a position."""
    before, after = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (_chain(), _back()))
    p, v = F.when(F.col(known), F.col("pos")), F.when(F.col(known), F.col(column))
    r = points.withColumn("p0", F.last(p, True).over(before)).withColumn("p1", F.last(p, True).over(after)).withColumn("v0", F.last(v, True).over(before)).withColumn("v1", F.last(v, True).over(after))
    between = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("pos") - F.col("p0")) / (F.col("p1") - F.col("p0"))
    value = F.when(F.col("p0") == F.col("p1"), F.col("v0")).when(F.col("p0").isNotNull() & F.col("p1").isNotNull(), between)
    value = value.when(F.col("p0").isNotNull(), F.col("v0") + step * (F.col("pos") - F.col("p0"))).when(F.col("p1").isNotNull(), F.col("v1") - step * (F.col("p1") - F.col("pos")))
    return r.withColumn(column, value).drop("p0", "p1", "v0", "v1")


def segment_centroids(points: DataFrame) -> DataFrame:
    """Mean point of each segment and the member nearest to it, the smallest position among equals."""
    by = Window.partitionBy("ref_id", "segment")
    off = [F.col(c) - F.avg(c).over(by) for c in "xyz"]
    r = points.withColumn("d", F.round(off[0] * off[0] + off[1] * off[1] + off[2] * off[2], 9))
    return r.groupBy("ref_id", "segment").agg(*(F.avg(c).alias(f"c{c}") for c in "xyz"), F.expr("min(struct(d, pos)).pos").alias("nearest"))


def pae_edges(cells: DataFrame, cutoff: float, power: float = 1.0) -> DataFrame:
    """Edges below the cutoff, each pair once, weighing 1 / pae ** power; errors count as 1e-6 at least."""
    return cells.where((F.col("pae") < cutoff) & (F.col("i") < F.col("j"))).withColumn("weight", 1 / F.pow(F.greatest("pae", F.lit(1e-6)), F.lit(power)))


def expand_indices(rows: DataFrame, step: int, n: str) -> DataFrame:
    """Positions that each subsampled index ``i`` stands for, up to the full length."""
    last = F.least(F.col("i") * step + step, F.col(n)) - 1
    return rows.where(F.col("i") * step < F.col(n)).withColumn("pos", F.explode(F.sequence(F.col("i") * step, last)))


def domain_gate(residues: DataFrame, least: int = 30, plddt: float = 70.0) -> DataFrame:
    """(ref_id, domain_id, n, start, end, plddt) of domains large and sure enough; without values only size counts."""
    d = residues.groupBy("ref_id", "domain_id").agg(F.count("*").alias("n"), F.min("pos").alias("start"), F.max("pos").alias("end"), F.avg("plddt").alias("plddt"))
    return d.where((F.col("n") >= least) & (F.col("plddt").isNull() | (F.col("plddt") >= plddt)))
