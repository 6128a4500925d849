"""Batches by cost, stop rules and rounds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_batches(items: DataFrame, budget: int) -> DataFrame:
    """(lane, id, length, batch) of items (lane, id, length): shortest first, a batch closes before its number of items times the square of its longest would exceed the budget.

    The rule is a fold, so a lane is one task's work; items are dealt to lanes to keep these bounded.
    """
    schema = pa.schema([("lane", pa.string()), ("id", pa.int64()), ("length", pa.int64()), ("batch", pa.int64())])

    def fold(table):
        table = table.sort_by([("length", "ascending"), ("id", "ascending")])
        batch, size, out = 0, 0, np.empty(table.num_rows, np.int64)
        for k, length in enumerate(table["length"].to_pylist()):
            if size and (size + 1) * length * length > budget:
                batch, size = batch + 1, 0
            size += 1
            out[k] = batch
        return pa.Table.from_arrays([*(table[c].combine_chunks() for c in ("lane", "id", "length")), pa.array(out)], schema=schema)

    rows = items.selectExpr("CAST(lane AS STRING) AS lane", "CAST(id AS LONG) AS id", "CAST(length AS LONG) AS length")
    return rows.groupBy("lane").applyInArrow(fold, "lane string, id long, length long, batch long")


def bounded_lanes(items: DataFrame, most: int = 100_000) -> DataFrame:
    """Items (lane, id, length) with lanes of over ``most`` items dealt into several, by id in turn, named lane/0, lane/1, ...

    Each of these is a fold of its own, so no task takes a whole large lane; that costs one open batch each.
    """
    parts = items.groupBy("lane").agg(F.ceil(F.count("*") / most).alias("parts"))
    rows = items.join(parts.withColumnRenamed("lane", "_lane"), F.col("lane").eqNullSafe(F.col("_lane")))
    part = F.concat(F.coalesce(F.col("lane").cast("string"), F.lit("")), F.lit("/"), F.expr("CAST(pmod(id, parts) AS STRING)"))
    return rows.select(F.when(F.col("parts") > 1, part).otherwise(F.col("lane").cast("string")).alias("lane"), "id", "length")


def batch_costs(batches: DataFrame) -> DataFrame:
    """(lane, batch, items, longest, cost): a batch's cost is its number of items times the square of its longest."""
    out = batches.groupBy("lane", "batch").agg(F.count("*").alias("items"), F.max("length").alias("longest"))
    return out.withColumn("cost", F.col("items") * F.col("longest") * F.col("longest"))


def stops(score: Column, turn: Column, enough: float, most: int, floor: float) -> Column:
    """Whether an item is done: sure enough, out of turns, or hopeless in the first one."""
    return (score >= enough) | (turn >= most) | ((turn == 0) & (score < floor))


def adaptive_rounds(items: DataFrame, predict: Callable[[DataFrame, int], DataFrame], enough: float, most: int, floor: float, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(id, score, turn) of items (id, ...): in each turn those left are predicted (id, score) until they stop; ``keep`` may write a turn's table to cut its lineage."""
    done, left = None, items
    for turn in range(most + 1):
        scored = keep(predict(left, turn).withColumn("turn", F.lit(turn)))
        over = stops(F.col("score"), F.col("turn"), enough, most, floor)
        ended = scored.where(over).select("id", "score", "turn")
        done = ended if done is None else done.unionAll(ended)
        left = left.join(scored.where(~over).select("id"), "id", "left_semi")
    return done


def length_gate(length: Column, longest: int) -> Column:
    return F.when(length > longest, "too_long").otherwise("ok")


def step_by_size(size: Column, large: int = 350_000) -> Column:
    """Every second, of large files every third row and column."""
    return F.when(size > large, 3).otherwise(2)
