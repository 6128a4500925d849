"""Streams give what the same rows give at once."""

from pyspark.sql import functions as F

from helixframe.operators import search
from helixframe.streaming import search as streams

SF = "/root/testdata/sf0.001"


def test_search_stream(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id AS row_idx", "text")
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id AS query", "text")
    postings = search.build_index(docs, k=5, max_freq=50)
    for part in range(2):
        queries.where(f"query % 2 = {part}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))
    stream = spark.readStream.schema(queries.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.search_stream(stream, postings, str(tmp_path / "out"), str(tmp_path / "ck"), k=5).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = search.containment_search(postings, queries, k=5)
    assert got.select("batch").distinct().count() == 2 and sorted(got.drop("batch").collect()) == sorted(want.collect()) and want.count()


def _run(spark, df, tmp_path, mode):
    name = f"t{abs(hash(str(tmp_path)))}"
    df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_status_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = _run(spark, streams.status_counts_stream(stream, "event_type", "ts", "1 day", "0 seconds"), tmp_path, "complete")
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_first_seen(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = _run(spark, streams.first_seen_stream(stream, "user_id", "ts", "1000 days"), tmp_path, "append")
    assert got.count() == events.select("user_id").distinct().count()
