"""Keeping a catalogue up to date from a stream of change messages.

Every micro-batch writes its accepted effects and its outcome under a folder of its own number, overwriting what a
failed attempt left: replays are harmless. Messages that cannot be read go to quarantine and can be sent again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridsmith.operators import changefeed


def index_stream(messages: DataFrame, out: str, decode: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Run until the queue is empty. ``decode`` gives key, instant, tie, live; a null key or instant means unreadable."""

    def take(batch: DataFrame, number: int) -> None:
        rows = decode(batch).persist()
        good = F.col("key").isNotNull() & F.col("instant").isNotNull() & F.col("live").isNotNull()
        rows.filter(good).select("key", "instant", "tie", "live").write.mode("overwrite").parquet(f"{out}/changes/batch={number}")
        rows.filter(~good).select("tie").write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
        rows.unpersist()

    return messages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _changes(spark, out: str) -> tuple[DataFrame, int | None]:  # noqa: ANN001
    """The compacted images and all later batches; the last batch's number."""
    batches = spark.read.parquet(f"{out}/changes")
    last = batches.agg(F.max("batch")).first()[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/images")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = sorted(int(p.getPath().getName()[5:]) for p in fs.listStatus(path) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS"))) if fs.exists(path) else []
    columns = ["key", "instant", "tie", "live"]
    if not done:
        return batches.select(*columns), last
    images = spark.read.schema(batches.select(*columns).schema).parquet(f"{out}/images/upto-{done[-1]}")
    return images.unionByName(batches.filter(F.col("batch") > done[-1]).select(*columns)), last


def compact(spark, out: str) -> None:  # noqa: ANN001
    """Fold all batches so far into one image a key (removals stay, so that late changes still meet them); reads get shorter."""
    rows, last = _changes(spark, out)
    if last is not None:
        changefeed.last_images(rows).write.mode("overwrite").parquet(f"{out}/images/upto-{last}")


def current(spark, out: str) -> DataFrame:  # noqa: ANN001
    """The datasets that are live after all batches so far: (key, tie)."""
    return changefeed.live_rows(_changes(spark, out)[0])


def windowed_counts(events: DataFrame, ts: str, group: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per event-time window with a watermark (streams) or without effect of it (tables)."""
    w = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")


def session_counts(events: DataFrame, ts: str, group: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Counts per session of a group: events less than ``gap`` apart, by event time, with a watermark on streams."""
    w = F.session_window(F.col(ts), gap)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")


def first_stream(events: DataFrame, key: str, ts: str, tie: str, out: str) -> StreamingQuery:
    """Each batch's first event of every key, one row a key, under the batch's number; ``firsts`` joins the batches."""

    def take(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.min(F.struct(ts, tie)).alias("f")).select(key, "f.*").write.mode("overwrite").parquet(f"{out}/firsts/batch={number}")

    return events.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def firsts(spark, out: str, key: str, ts: str, tie: str) -> DataFrame:  # noqa: ANN001
    return spark.read.parquet(f"{out}/firsts").groupBy(key).agg(F.min(F.struct(ts, tie)).alias("f")).select(key, "f.*")


def queue_to_catalogue(messages: DataFrame, store, checkpoint: str, name: str = "queue", limit: int | None = None, apply: dict | None = None, **decisions: object) -> StreamingQuery:  # noqa: ANN001
    """Run a queue (seq, body) into a catalogue until it is empty: every micro-batch is decided, archived and indexed as a whole.

    A batch that is replayed after a failure is recognised by its number and changes nothing. Failed messages go to the
    store's quarantine with their reason. ``decisions`` go to ``intake.decide``, ``apply`` to the store.
    """
    from gridsmith.operators import intake

    def take(batch: DataFrame, number: int) -> None:
        from gridsmith.session import materialise

        decided = materialise(intake.decide(batch if limit is None else batch.orderBy("seq").limit(limit), **decisions), "decided")
        intake.run(decided, store, (name, number), **(apply or {}))
        store.quarantine(decided.filter("verdict = 'fail'").select(F.col("seq").cast("string").alias("id"), "uri", "reason"))

    return messages.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_messages(events: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """A stream without repeats of a key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
