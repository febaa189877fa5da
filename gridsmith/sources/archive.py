"""Far too many small files: indexed archive containers.

``pack`` writes the original bytes of many small files end to end into large container files and, beside them, one index table with
a row per file: path, container, offset, length and CRC-32. Every input task fills its own containers, so that packing moves
no contents between tasks; only index rows are sorted by path, which lets a look-up skip most of the index. ``unpack``
gives every file back unchanged, ``lookup`` only chosen ones by reading their byte ranges, and ``records`` reads all JSON
records in parallel, a container at a time.

The index decides what there is: a container has the name of the attempt that wrote it, and only rows of attempts that Spark
committed are in the index. If executors are lost, containers without rows may remain (``sweep`` removes them), but no
file is lost or there twice.

Defined results: null bodies are kept as null (length -1) and empty ones as empty; a file listed twice is packed twice; a
checksum that differs raises; an empty table gives an empty index.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.session import broadcast_if_small, materialise
from gridsmith.sources import files

INDEX = T.StructType([
    T.StructField("file_no", T.LongType()), T.StructField("path", T.StringType()), T.StructField("container", T.StringType()),
    T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("checksum", T.LongType()),
])
FILE = T.StructType([T.StructField("file_no", T.LongType()), T.StructField("path", T.StringType()), T.StructField("body", T.BinaryType())])


def pack(small: DataFrame, folder: str, file_no: str | None = "file_no", path: str = "href", body: str = "body", block_bytes: int = 128 << 20) -> DataFrame:
    """Pack a table of small files (text or binary bodies) into ``folder``; the index.

    Containers have about ``block_bytes``: inputs are joined into tasks of at least that size (as the planner estimates
    it), and a task that has more starts another container.
    """
    spark = small.sparkSession
    narrow = small.select((F.col(file_no) if file_no else F.lit(None)).cast("long").alias("file_no"), F.col(path).alias("path"), F.col(body).cast("binary").alias("body"))
    size = int(narrow._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # Joins inputs only where there are more than this many; an unknown size is taken as a very large one.
    narrow = narrow.coalesce(min(max(1, -(-size // block_bytes)), 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.taskcontext import TaskContext

        schema, context = to_arrow_schema(INDEX), TaskContext.get()
        fs, root = files.resolve(f"{folder.rstrip('/')}/containers")
        fs.create_dir(root, recursive=True)
        out, name, at, n = None, "", 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for no, p, data in zip(*(batch.column(c).to_pylist() for c in ("file_no", "path", "body"))):
                if out is None:
                    name, at, n = f"{context.partitionId():06d}-{n:06d}-{context.taskAttemptId()}.pack", 0, n + 1
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                rows.append((no, p, name, at, -1 if data is None else len(data), zlib.crc32(data or b"")))
                if data:
                    out.write(data)
                    at += len(data)
                if at >= block_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], type=f.type) for f in schema], schema=schema)
        if out is not None:
            out.close()

    # Sorting by ranges takes a sample first: it must not pack everything a second time.
    rows = materialise(narrow.mapInArrow(run, INDEX), "index")
    rows.repartitionByRange(min(max(1, size // (64 * block_bytes)), 1_000), "path").sortWithinPartitions("path").write.parquet(f"{folder}/index")
    return index(spark, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of a packed folder; ``folder`` goes with it, so that its rows can be read anywhere."""
    return spark.read.schema(INDEX).parquet(f"{folder}/index").withColumn("folder", F.lit(folder))


def sweep(spark: SparkSession, folder: str) -> int:
    """Remove containers that no row of the index names; how many there were."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/containers")
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    there = spark.createDataFrame([(f.getPath().getName(),) for f in (fs.listStatus(at) if fs.exists(at) else [])], "container string")
    gone = [r[0] for r in there.join(index(spark, folder).select("container").distinct(), "container", "left_anti").collect()]
    for name in gone:
        fs.delete(sc._jvm.org.apache.hadoop.fs.Path(at, name), False)
    return len(gone)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None, bytes | None]]:
    """(file_no, path, bytes) of index rows, each container opened once as long as its rows follow one another."""
    name, f = None, None
    for batch in batches:
        for no, path, container, offset, length, checksum, folder in zip(*(batch.column(c).to_pylist() for c in (*INDEX.names, "folder"))):
            if (folder, container) != name:
                if f is not None:
                    f.close()
                name, f = (folder, container), files.open_input(f"{folder.rstrip('/')}/containers/{container}")
            data = None
            if length >= 0:
                f.seek(offset)
                data = f.read(length)
            if zlib.crc32(data or b"") != checksum:
                raise ValueError(f"checksum of {path} differs")
            yield no, path, data
    if f is not None:
        f.close()


def _read(rows: DataFrame, schema: T.StructType, made: Callable[[int | None, str | None, bytes | None], Iterator[tuple]]) -> DataFrame:
    """``made`` of every indexed file: a container's rows go to one task in the order of their offsets."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(n, "container").sortWithinPartitions("folder", "container", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        got: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*got), arrow)], schema=arrow)

        for no, path, data in _members(batches):
            got += made(no, path, data)
            size += len(data or b"") + 100
            if got and size > 8 << 20:
                yield flush()
                got, size = [], 0
        if got:
            yield flush()

    return placed.mapInArrow(run, schema)


def unpack(rows: DataFrame) -> DataFrame:
    """(file_no, path, body): the files of an index, byte for byte."""
    return _read(rows, FILE, lambda no, path, data: iter([(no, path, data)]))


def lookup(rows: DataFrame, paths: Sequence[str] | DataFrame) -> DataFrame:
    """(file_no, path, body) of chosen files: their index rows are found (a list is pushed down to the sorted index), then their bytes read."""
    if isinstance(paths, DataFrame):
        return unpack(rows.join(broadcast_if_small(paths.select(F.col(paths.columns[0]).alias("path")).distinct()), "path", "left_semi").select(*rows.columns))
    return unpack(rows.filter(F.col("path").isin(list(paths))))


_DECODER = json.JSONDecoder()


def complete_records(text: str) -> Iterator[dict]:
    """Every complete JSON object of a text in which records may be cut off, listed, wrapped or one a line."""
    at = text.find("{")
    while at >= 0:
        try:
            value, end = _DECODER.raw_decode(text, at)
        except (ValueError, RecursionError):
            at = text.find("{", at + 1)
            continue
        stack = [value]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                yield x
                stack.extend(x.values())
            elif isinstance(x, list):
                stack.extend(x)
        at = text.find("{", end)


def records(rows: DataFrame) -> DataFrame:
    """(file_no, path, href, etag, size, last_modified): all complete listing records of the packed files, with repeats."""
    schema = T.StructType([T.StructField("file_no", T.LongType()), T.StructField("path", T.StringType()), T.StructField("href", T.StringType()),
                           T.StructField("etag", T.StringType()), T.StructField("size", T.LongType()), T.StructField("last_modified", T.StringType())])

    def made(no: int | None, path: str | None, data: bytes | None) -> Iterator[tuple]:
        for r in complete_records(data.decode("utf-8", "replace")) if data else ():
            href, etag = r.get("href"), r.get("etag")
            if isinstance(href, str) and isinstance(etag, str) and href and etag.strip('"'):
                size, modified = r.get("size"), r.get("last_modified")
                yield no, path, href, etag.strip('"'), size if isinstance(size, int) and abs(size) < 2**63 else None, modified if isinstance(modified, str) else None

    return _read(rows, schema, made)
