"""Streams against static tables: searches by micro-batch, first-seen keys, status counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.search import containment_search


def search_stream(queries: DataFrame, postings: DataFrame, sink: str, checkpoint: str, **how) -> StreamingQuery:
    """Hits of a stream of queries (query, text) among static postings, a folder a micro-batch; a batch that is run again replaces its folder.

    All that is there when the stream starts is worked off, then it ends.
    """

    def found(batch: DataFrame, number: int) -> None:
        containment_search(postings, batch, **how).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(found).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(rows: DataFrame, time: str, delay: str) -> DataFrame:
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def first_seen_stream(rows: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """A stream's rows whose key has not come within the delay; the state forgets older keys."""
    return _timed(rows, time, delay).dropDuplicatesWithinWatermark([key])


def status_counts_stream(rows: DataFrame, status: str, time: str, width: str, delay: str) -> DataFrame:
    """Counts by status and window of time; rows later than the delay are left out."""
    by = _timed(rows, time, delay).groupBy(F.window(time, width), status).agg(F.count("*").alias("n"))
    return by.select(F.col("window.start").alias("start"), status, "n")
