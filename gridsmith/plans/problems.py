"""Queries of the general data-preparation problems (P1, P3-P7) over the tables of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.functions.timestamps import is_canonical, with_instant
from gridsmith.operators import changefeed, dedup, drift, nested
from gridsmith.session import broadcast_if_small, load, scratch
from gridsmith.sources import archive


def clocks(spark: SparkSession, d: str) -> DataFrame:
    """(product, zone, date_order) of each product's producer."""
    product, producer = load(spark, d, "product"), load(spark, d, "producer")
    joined = product.join(producer, "producer_name").select(F.col("product_name").alias("product"), F.col("time_zone").alias("zone"), "date_order")
    return broadcast_if_small(joined)


def messages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Messages with ``sent`` (UTC microseconds), their normalised ``key``, file position and further ``columns``."""
    df = dedup.with_positions(load(spark, d, "sqs_message")).select("delivery_id", "message_id", "sent_timestamp", "product", "_file_path", "_row_index", *columns)
    df = with_instant(df.join(clocks(spark, d), "product", "left"), "sent_timestamp", "sent", "zone", "date_order")
    return df.withColumn("key", dedup.message_key(F.col("message_id")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Datasets live after all kept changes and the delivery that set their last state."""
    action = F.col("message_attributes")["action"]["attr_value"].alias("action")
    df = messages(spark, d, "message", action).withColumn("dataset", F.expr("try_variant_get(try_parse_json(message), '$.id', 'string')"))
    df = df.withColumn("live", changefeed.is_live(F.col("action")))
    # The kept delivery of each message, as in P6, on narrow rows.
    own = F.encode(F.concat(F.lit("\u0000"), F.col("delivery_id").cast("string")), "UTF-8")
    narrow = df.select(F.coalesce("key", own).alias("k"), "sent", "delivery_id", F.lower(F.trim("dataset")).alias("key"), "live")
    kept = dedup.first_by_key(narrow, "k", [F.col("sent"), F.col("delivery_id")], ["key", "sent", "delivery_id", "live"])
    changes = kept.filter("live IS NOT NULL AND key <> ''").select("key", F.col("sent").alias("instant"), F.col("delivery_id").alias("tie"), "live")
    return changefeed.live_rows(changes).select(F.col("key").alias("dataset_id"), F.col("tie").alias("delivery_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Measurements with their path and grid, linked by interval containment."""
    return nested.measurement_grids(load(spark, d, "odc_document").select("doc_no", "href", "doc"))


def p3_lineage(spark: SparkSession, d: str) -> DataFrame:
    """The flat lineage table: dataset, label and parent dataset."""
    return nested.flatten(load(spark, d, "odc_document"), ["lineage"])["lineage"].select("doc_no", "dataset_id", "label", "parent_id")


def p3_properties(spark: SparkSession, d: str) -> DataFrame:
    """The flat property table: dataset, name and JSON text of each scalar property."""
    return nested.flatten(load(spark, d, "odc_document"), ["property"])["property"].select("doc_no", "dataset_id", "name", "value")


def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every flat table that lie inside the interval of the dataset they name (all of them must)."""
    tables = nested.flatten(load(spark, d, "odc_document"))
    sets = tables["dataset"].select("doc_no", "dataset_pre", F.col("post").alias("end")).distinct()
    out = tables["dataset"].select(F.lit("dataset").alias("kind"), F.lit(True).alias("inside"))
    for kind, t in tables.items():
        if kind != "dataset":
            out = out.unionByName(t.join(sets, ["doc_no", "dataset_pre"], "left").select(F.lit(kind).alias("kind"), F.coalesce((F.col("dataset_pre") < F.col("pre")) & (F.col("post") < F.col("end")), F.lit(False)).alias("inside")))
    return out.groupBy("kind", "inside").agg(F.count("*").alias("n"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of fields between a file and the one before it in its stream."""
    return drift.changes(load(spark, d, "metadata_line").select("stream_no", "file_no", "written_at", "payload"))


def p4_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the values of every path (also below the top level): lines and files."""
    n = drift.statistics(load(spark, d, "metadata_line").select("file_no", "payload"), ["file_no"], depth=4).filter("kind IS NOT NULL")
    return n.groupBy(F.col("field").alias("path"), "kind").agg(F.sum("n").alias("n_values"), F.count("*").alias("n_files"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    """All lines as one typed table of all properties, its columns and types from the statistics of all files.

    ``failed_casts`` names the fields that did not fit their column, ``rest`` (``field=JSON``, by line) holds what no column does.
    """
    source, keys = load(spark, d, "metadata_line"), ["line_key", "file_no"]
    lines = source.groupBy("file_no", "line_no", "payload").agg(F.min("line_key").alias("line_key"))
    target = drift.columns(source, [*keys, "failed_casts", "rest"])
    rest = F.array_join(F.array_sort(F.transform(F.map_entries("rest"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\n")
    return drift.project(lines, target, keys, rest="rest").withColumn("failed_casts", F.array_join("failed_casts", ",")).withColumn("rest", rest)


#: Bytes of a container here; the tables are small, and every core shall have one to read.
CONTAINER_BYTES = 4 << 20


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return archive.pack(load(spark, d, "tiny_file"), scratch(spark, "archive"), block_bytes=CONTAINER_BYTES)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (href, etag) of all complete records, read back from the archive containers."""
    return archive.records(_packed(spark, d)).select("href", "etag").distinct()


def p5_files(spark: SparkSession, d: str) -> DataFrame:
    """Every packed file after a round trip through the containers: path, bytes and digest."""
    return archive.unpack(_packed(spark, d)).select("file_no", "path", F.length("body").cast("bigint").alias("n_bytes"), F.md5("body").alias("digest"))


def p5_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Files asked for by path, found in the index and read by their byte ranges."""
    asked = load(spark, d, "tiny_file").filter("href LIKE '%day=2017-%'").select("href")
    return archive.lookup(_packed(spark, d), asked).select("file_no", "path", F.md5("body").alias("digest"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = messages(spark, d)
    return load(spark, d, "sqs_message"), dedup.winner_bitmaps(m, F.col("key"), [F.col("sent"), F.col("delivery_id")])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries that don't remain: the rows that the deletion vectors strike out."""
    source, bits = _vectors(spark, d)
    return dedup.apply_vectors(source, bits, ["delivery_id"], keep=False)


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """The remaining deliveries with their payload."""
    source, bits = _vectors(spark, d)
    kept = dedup.apply_vectors(source, bits, ["delivery_id", "message_id", "product", "message"])
    return kept.select("delivery_id", "message_id", "product", F.md5(F.col("message").cast("binary")).alias("digest"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """UTC microseconds of every text that denotes an instant and isn't canonical already."""
    records = load(spark, d, "dataset_record").select(
        F.lit("dataset_record").alias("table_name"), F.col("record_no").alias("row_no"), "product",
        F.explode(F.create_map(F.lit("datetime_text"), F.col("datetime_text"), F.lit("processing_datetime_text"), F.col("processing_datetime_text"))).alias("field", "text"),
    )
    sent = load(spark, d, "sqs_message").select(F.lit("sqs_message").alias("table_name"), F.col("delivery_id").alias("row_no"), "product", F.lit("sent_timestamp").alias("field"), F.col("sent_timestamp").alias("text"))
    texts = records.unionByName(sent).filter(F.col("text").isNotNull() & ~is_canonical(F.col("text")))
    read = with_instant(texts.join(clocks(spark, d), "product", "left"), "text", "utc_micros", "zone", "date_order")
    return read.filter("utc_micros IS NOT NULL").select("table_name", "row_no", "field", "utc_micros")


from gridsmith.plans.oracles import ORACLES  # noqa: E402

QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_lineage, p3_properties, p3_tables, p4_found, p4_statistics, p4_table, p5_found, p5_files, p5_lookup, p6_found, p6_kept, p7_found)}
