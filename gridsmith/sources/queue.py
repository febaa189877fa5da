"""Message queues as tables and streams: envelopes, batches, moving messages back, a file-backed stream source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsmith.functions.text import complete_json
from gridsmith.session import materialise

ENVELOPE = "struct<Type:string,MessageId:string,TopicArn:string,Message:string,Timestamp:string,MessageAttributes:map<string,struct<Type:string,Value:string>>>"
NOTIFICATION = "array<struct<eventTime:string,eventName:string,s3:struct<bucket:struct<name:string>,object:struct<key:string>>>>"


def queues(catalogue: DataFrame, prefix: str | None = None, contains: str | None = None) -> DataFrame:
    """Queues by prefix and part of the name."""
    out = catalogue if prefix is None else catalogue.filter(F.col("name").startswith(prefix))
    return out if contains is None else out.filter(F.col("name").contains(contains))


def limited(messages: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The first ``limit`` messages; a limit below one is an error."""
    if limit is None:
        return messages
    if limit < 1:
        raise ValueError("limit must be a positive number")
    return messages.orderBy(*order).limit(limit)


def decoded(messages: DataFrame, body: str = "body") -> DataFrame:
    """Envelope and inner document of raw bodies: message_id, action, document, error. Only ``Value`` attributes count."""
    e = F.from_json(F.col(body), ENVELOPE)
    df = messages.withColumn("__e", e)
    doc = F.when(complete_json(F.col("__e.Message")) & F.col("__e.Message").rlike(r"^\s*\{"), F.col("__e.Message"))
    return df.select(*messages.columns, F.col("__e.MessageId").alias("message_id"), F.col("__e.MessageAttributes")["action"]["Value"].alias("action"), doc.alias("document"), F.when(doc.isNull(), "unreadable message").alias("error"))


def notified_objects(messages: DataFrame, body: str = "body", last_only: bool = False) -> DataFrame:
    """(columns, url): objects named by bucket notifications; ``last_only`` keeps a message's last record."""
    r = F.from_json(F.get_json_object(F.col(body), "$.Records"), NOTIFICATION)
    r = F.filter(r, lambda x: x["s3"]["bucket"]["name"].isNotNull() & x["s3"]["object"]["key"].isNotNull())
    if last_only:
        r = F.slice(r, -1, 1)
    return messages.select(*messages.columns, F.explode(r).alias("__r")).select(*messages.columns, F.concat(F.lit("s3://"), "__r.s3.bucket.name", F.lit("/"), "__r.s3.object.key").alias("url"))


def numbered(df: DataFrame, order: str, parts: int = 64) -> DataFrame:
    """Add ``n``: the row's number (from 1) in the order of a numeric column without ties, without one task seeing all rows.

    Boundaries of ``parts`` ranges and the ranges' sizes (at most ``parts`` numbers each) are gathered; rows are numbered within a range.
    """
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    ranged = df.withColumn("__part", part)
    sizes = {r[0]: r[1] for r in ranged.groupBy("__part").count().toLocalIterator()}
    before, total = [], 0
    for k in range(len(cuts) + 1):
        before.append(F.lit(total).cast("long"))
        total += sizes.get(k, 0)
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return ranged.withColumn("n", F.get(F.array(*before), F.col("__part")) + nth).drop("__part")


def batches(messages: DataFrame, order: str, size: int = 10) -> DataFrame:
    """Add ``batch``: consecutive messages in groups of ``size``, numbered from 0."""
    return numbered(messages, order).withColumn("batch", F.expr(f"(n - 1) div {size}")).drop("n")


def redrive(dead: DataFrame, live: DataFrame, order: str, limit: int | None = None, dry_run: bool = False) -> tuple[int, DataFrame, DataFrame]:
    """(moved, dead after, live after): messages go back to the live queue; a dry run only counts."""
    moving = limited(dead, limit, order)
    n = moving.count()
    if dry_run or n == 0:
        return n, dead, live
    return n, dead.join(moving.select(order), order, "left_anti"), live.unionByName(moving.select(*live.columns))


def redrive_folders(spark: SparkSession, dead: str, live: str, order: str, limit: int | None = None, dry_run: bool = False) -> int:
    """Move messages between queues that are folders of Parquet files: sent first, deleted after; the number moved.

    ``order`` identifies a message. If the run ends between the two steps messages are in both queues (at least once), never in none.
    """
    rows = spark.read.parquet(dead)
    moving = limited(rows, limit, order)
    if dry_run:
        return moving.count()
    moving = materialise(moving, "moving")
    n = moving.count()
    if n:
        moving.write.mode("append").parquet(live)
        rest = f"{dead.rstrip('/')}.rest"
        rows.join(moving.select(order), order, "left_anti").select(*rows.columns).write.mode("overwrite").parquet(rest)
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(dead).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path(dead), True)
        fs.rename(path(rest), path(dead))
    return n


def stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """Messages that land as Parquet files, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
