"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(id, component): for each node of the edges (a, b) the smallest node it reaches.  Written to the shelf.

    Rounds are logarithmic in the longest path; a hub's edges are never one
    group in memory, and its joins are left to adaptive skew handling.
    """
    e = shelf.put(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    seen = None
    while True:
        both = e.select("a", "b").unionAll(e.selectExpr("b AS a", "a AS b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.join(low, "a").where("b > a").selectExpr("b AS a", "m AS b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("b AS a", "m AS b").where("a <> b").unionAll(least.selectExpr("a", "m AS b")).distinct()
        new = shelf.put(small)
        shelf.drop(e)
        e = new
        sign = tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if sign == seen:
            break
        seen = sign
    return shelf.put(e.selectExpr("a AS id", "b AS component").unionAll(e.selectExpr("b AS id", "b AS component").distinct()))
