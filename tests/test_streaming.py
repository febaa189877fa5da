from pyspark.sql import functions as F

from gridsmith.operators import changefeed, dedup
from gridsmith.sources import queue
from gridsmith.streaming import indexer

SCHEMA = "id long, ts timestamp, kind string, live boolean"


def write(spark, tmp_path, n=60):
    df = spark.range(n).select("id", F.timestamp_seconds(F.col("id") * 90).alias("ts"), F.concat(F.lit("k"), F.col("id") % 3).alias("kind"), (F.col("id") % 4 > 0).alias("live"))
    path = str(tmp_path / "q")
    df.repartitionByRange(5, "id").write.parquet(path)
    return df, path


def drained(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windows_as_stream_and_table(spark, rows, tmp_path):
    table, path = write(spark, tmp_path)
    want = rows(indexer.windowed_counts(table, "ts", "kind", "10 minutes"))
    got = rows(drained(indexer.windowed_counts(queue.stream(spark, path, SCHEMA), "ts", "kind", "10 minutes"), "w"))
    # The last windows stay open until the watermark has passed them.
    assert got and set(got) <= set(want)
    assert rows(indexer.windowed_counts(table, "ts", "kind", "10 minutes", "5 minutes"))


def test_distinct_messages(spark, tmp_path):
    _, path = write(spark, tmp_path)
    assert drained(indexer.distinct_messages(queue.stream(spark, path, SCHEMA), "kind", "ts", "10 days"), "dist").count() == 3


def test_indexing_equals_the_batch_and_can_be_resumed(spark, rows, tmp_path):
    table, path = write(spark, tmp_path)
    decode = lambda b: b.select(F.when(F.col("id") != 7, F.col("kind")).alias("key"), F.unix_micros("ts").alias("instant"), F.col("id").alias("tie"), "live")
    out = str(tmp_path / "out")
    for _ in range(2):
        indexer.index_stream(queue.stream(spark, path, SCHEMA, 2), out, decode, str(tmp_path / "cp")).awaitTermination()
    assert rows(indexer.current(spark, out)) == rows(changefeed.live_rows(decode(table)))
    assert [r["tie"] for r in spark.read.parquet(f"{out}/quarantine").collect()] == [7]
    indexer.compact(spark, out)
    assert rows(indexer.current(spark, out)) == rows(changefeed.live_rows(decode(table)))
    late = table.filter("id = 5").select(F.lit(1000).cast("long").alias("id"), F.lit("1970-01-01").cast("timestamp").alias("ts"), "kind", F.lit(True).alias("live"))
    late.coalesce(1).write.mode("append").parquet(path)
    indexer.index_stream(queue.stream(spark, path, SCHEMA, 2), out, decode, str(tmp_path / "cp")).awaitTermination()
    assert rows(indexer.current(spark, out)) == rows(changefeed.live_rows(decode(table.unionByName(late))))


def test_hot_keys(spark, rows):
    """A key with a third of all rows."""
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), ((F.col("id") * 7919) % 30011).alias("instant"), F.col("id").alias("tie"), F.lit(True).alias("live"))
    live = changefeed.live_rows(df)
    last = df.filter("key = 'hot'").orderBy(F.col("instant").desc(), F.col("tie").desc()).first()["tie"]
    assert live.count() == 20001 and live.filter("key = 'hot'").first()["tie"] == last
    first = dedup.first_by_key(df, "key", [F.col("instant"), F.col("tie")], ["tie"])
    assert first.count() == 20001
