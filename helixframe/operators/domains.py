"""Domains of error matrices: components of the graph of small errors, by size, and the best over several cutoffs.

Edges are (ref_id, i, j); a structure's graph is bounded by its length, so one
task takes it whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aligned import best_domain, domain_scores
from .leiden import merged


def _labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component."""
    own = np.arange(n)
    while True:
        low = np.minimum(own[i], own[j])
        new = own.copy()
        np.minimum.at(new, own[i], low)
        np.minimum.at(new, own[j], low)
        new = new[new]
        if (new == own).all():
            return own
        own = new


def domain_components(edges: DataFrame) -> DataFrame:
    """(ref_id, first, pos): nodes with an edge, and the smallest node of their component."""
    schema = pa.schema([("ref_id", pa.int64()), ("first", pa.int64()), ("pos", pa.int64())])

    def label(table):
        nodes, at = np.unique(np.r_[table["i"].to_numpy(), table["j"].to_numpy()], return_inverse=True)
        own = _labels(*np.split(at, 2), len(nodes))
        ref = np.full(len(nodes), table["ref_id"][0].as_py(), np.int64)
        return pa.Table.from_arrays([pa.array(ref), pa.array(nodes[own], pa.int64()), pa.array(nodes, pa.int64())], schema=schema)

    rows = edges.selectExpr("CAST(ref_id AS LONG) AS ref_id", "CAST(i AS LONG) AS i", "CAST(j AS LONG) AS j")
    return rows.groupBy("ref_id").applyInArrow(label, "ref_id long, first long, pos long")


def by_size(components: DataFrame) -> DataFrame:
    """(ref_id, first, n, place): components from the largest, the smaller first node among equals."""
    from pyspark.sql import Window

    n = components.groupBy("ref_id", "first").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("ref_id").orderBy(F.desc("n"), "first")).cast("long"))


def best_over_cutoffs(cells: DataFrame, marks: DataFrame, cutoffs: tuple[float, ...]) -> DataFrame:
    """(ref_id, cutoff, first, n, score): of the components at several cutoffs the one with most equal residues, at the smallest cutoff and first node among equals."""
    cut = F.explode(F.array(*map(F.lit, sorted(set(cutoffs))))).alias("cutoff")
    edges = cells.where((F.col("i") < F.col("j")) & (F.col("pae") < max(cutoffs))).select("ref_id", "i", "j", "pae", cut).where("pae < cutoff")
    # a structure's cutoffs are graphs of their own: their nodes are numbered apart
    place = {c: k for k, c in enumerate(sorted(set(cutoffs)))}
    number = F.coalesce(*(F.when(F.col("cutoff") == c, F.lit(k)) for c, k in place.items()))
    apart = edges.select("ref_id", (F.col("i") * len(place) + number).alias("i"), (F.col("j") * len(place) + number).alias("j"))
    found = domain_components(apart).selectExpr("ref_id", f"first % {len(place)} AS k", f"first DIV {len(place)} AS first", f"pos DIV {len(place)} AS ref_pos")
    widest = 1 << 32
    domains = found.selectExpr("ref_id", f"k * {widest} + first AS domain_id", "ref_pos")
    best = best_domain(domain_scores(marks, domains))
    named = F.element_at(F.array(*map(F.lit, place)), (F.floor(F.col("domain_id") / widest) + 1).cast("int"))
    return best.select("ref_id", named.alias("cutoff"), (F.col("domain_id") % widest).alias("first"), "n", "score")


def qualified(domains: DataFrame, least: int = 30, plddt: float = 70.0) -> DataFrame:
    """Status of each domain (n, plddt): too small, unsure, or qualified; without values only size counts."""
    sure = F.coalesce(F.col("plddt") >= plddt, F.lit(True))
    return domains.withColumn("status", F.when(F.col("n") < least, "domain_too_small").when(~sure, "low_plddt").otherwise("ok"))


def modularity_domains(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(ref_id, first, pos) of weighted edges (ref_id, i, j, weight): communities, merged greedily while that raises the modularity at a resolution.

    Of equal gains the pair with the smallest nodes merges first; a community is
    named by its smallest node.
    """
    schema = pa.schema([("ref_id", pa.int64()), ("first", pa.int64()), ("pos", pa.int64())])

    def merge(table):
        nodes, at = np.unique(np.r_[table["i"].to_numpy(), table["j"].to_numpy()], return_inverse=True)
        i, j = np.split(at, 2)
        own = merged(len(nodes), i, j, table["weight"].to_numpy(), resolution)
        ref = np.full(len(nodes), table["ref_id"][0].as_py(), np.int64)
        return pa.Table.from_arrays([pa.array(ref), pa.array(nodes[own], pa.int64()), pa.array(nodes, pa.int64())], schema=schema)

    rows = edges.selectExpr("CAST(ref_id AS LONG) AS ref_id", "CAST(i AS LONG) AS i", "CAST(j AS LONG) AS j", "CAST(weight AS DOUBLE) AS weight")
    return rows.groupBy("ref_id").applyInArrow(merge, "ref_id long, first long, pos long")


def matched_domain(marks: DataFrame) -> DataFrame:
    """(ref_id, n, start, end): all reference positions that an alignment matches, as one domain."""
    return marks.groupBy("ref_id").agg(F.count("*").alias("n"), F.min("ref_pos").alias("start"), F.max("ref_pos").alias("end"))
