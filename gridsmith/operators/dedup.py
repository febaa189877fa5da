"""Messages delivered more than once: position-only shuffle, then per-file deletion vectors.

``winner_bitmaps`` shuffles nothing but identifier, delivery order and file-row position. Each identifier's first
delivery is chosen by one aggregation (partial on the map side, so an identifier that holds a third of all rows sends
one row per map task), and the winners' positions become bitmaps of 32,768 rows per file. ``apply_vectors`` then reads the
wide columns, a row group at a time, and keeps (or, inverted, returns) the rows by their bit: payloads are never shuffled.

Defined results: rows without an identifier are equal to none and all remain; a null order value sorts last; exact
repeats of a row differ in position only, the first position remains; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.sources import files

BLOCK = 32768


def message_key(identifier: Column) -> Column:
    """The identifier without case, punctuation and wrapping, as bytes; null for none. 32 hex digits take 16 bytes."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(identifier), r"^\s*urn:uuid:", ""), r"[^\p{L}\p{N}]", "")
    bare = F.when(F.length(bare) > 0, bare)
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.unhex(bare)).otherwise(F.encode(bare, "UTF-8"))


def first_by_key(df: DataFrame, key: str, order: Sequence[Column], carry: Sequence[str]) -> DataFrame:
    """One row for each value of ``key``: ``carry`` of the row that is least in ``order`` (nulls last)."""
    ranked = [x for i, o in enumerate(order) for x in (o.isNull().alias(f"n{i}"), o.alias(f"o{i}"))]
    best = df.groupBy(key).agg(F.min(F.struct(*ranked, F.struct(*[F.col(c) for c in carry]).alias("row"))).alias("best"))
    return best.select(key, "best.row.*")


def file_key(path: Column) -> Column:
    """A file's number; spellings of the scheme (``file:/x``, ``file:///x``) are equal."""
    return F.xxhash64(F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/"))


def winner_bitmaps(df: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """(file, block, bits): the rows that remain of a table read from files, a bit per row position.

    ``df`` must come straight from a Parquet scan; ``key`` and ``order`` are expressions over its columns.
    """
    narrow = df.select(
        key.alias("k"),
        *[o.alias(f"o{i}") for i, o in enumerate(order)],
        file_key(F.col("_file_path")).alias("file"),
        F.col("_row_index").alias("pos"),
    )
    # A row without an identifier gets one of its own, so that no null group forms.
    own = F.concat(F.lit("\u0000").cast("binary"), F.encode(F.concat_ws(":", "file", "pos"), "UTF-8"))
    narrow = narrow.withColumn("k", F.coalesce("k", own))
    orders = [F.col(f"o{i}") for i in range(len(order))] + [F.col("file"), F.col("pos")]
    winners = first_by_key(narrow, "k", orders, ["file", "pos"])
    return winners.groupBy("file", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.bitmap_construct_agg(F.col("pos") % BLOCK).alias("bits"))


def with_positions(df: DataFrame) -> DataFrame:
    """Expose a scan's file path and row position as columns."""
    return df.select("*", F.col("_metadata.file_path").alias("_file_path"), F.col("_metadata.row_index").alias("_row_index"))


def row_groups(source: DataFrame) -> DataFrame:
    """(file, path, row_group, first, n): the row groups behind a Parquet scan, from the files' footers, read by the tasks."""
    paths = source.select(F.col("_metadata.file_path").alias("path")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                with files.open_input(path) as f:
                    footer, first = pq.ParquetFile(f).metadata, 0
                    for g in range(footer.num_row_groups):
                        rows.append((path, g, first, footer.row_group(g).num_rows))
                        first += footer.row_group(g).num_rows
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)]], names=["path", "row_group", "first", "n"])

    return paths.mapInArrow(run, "path string, row_group long, first long, n long").withColumn("file", file_key(F.col("path")))


def apply_vectors(source: DataFrame, bitmaps: DataFrame, columns: Sequence[str], keep: bool = True, partitions: int | None = None) -> DataFrame:
    """Read ``columns`` of the files behind ``source``; rows whose bit is set are kept (``keep``) or dropped.

    The unit of work is a row group: each meets the bitmaps of its blocks (a bit a row is all that is shuffled), and a task
    streams the batches of one row group at a time. ``partitions`` is the number of such tasks (shuffle partitions).
    """
    spark = source.sparkSession
    schema = T.StructType([source.schema[c] for c in columns])
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = row_groups(source).filter("n > 0").withColumn("block", F.explode(F.expr(f"sequence(first div {BLOCK}, (first + n - 1) div {BLOCK})")))
    plan = blocks.join(bitmaps, ["file", "block"], "left").select("path", "row_group", "first", "n", "block", "bits")
    plan = plan.repartition(n, "path", "row_group").sortWithinPartitions("path", "row_group", "block")
    names, out_schema = list(columns), schema

    def emit(key: tuple[str, int, int, int], bits: dict[int, bytes | None], target: pa.Schema) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        path, group, first, n_rows = key
        whole = np.zeros(n_rows, dtype=bool)
        for b, packed in bits.items():
            if packed is not None:
                lo, hi = max(first, b * BLOCK), min(first + n_rows, (b + 1) * BLOCK)
                whole[lo - first : hi - first] = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), bitorder="little")[lo - b * BLOCK : hi - b * BLOCK]
        if not keep:
            whole = ~whole
        if not whole.any():
            return
        at = 0
        with files.open_input(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=BLOCK, row_groups=[group], columns=names):
                mask = whole[at : at + batch.num_rows]
                at += batch.num_rows
                if mask.any():
                    yield from pa.Table.from_batches([batch]).filter(pa.array(mask)).select(names).cast(target).to_batches()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out_schema)
        key, bits = None, {}
        for batch in batches:
            for *k, block, packed in zip(*(batch.column(c).to_pylist() for c in ("path", "row_group", "first", "n", "block", "bits"))):
                if tuple(k) != key:
                    if key is not None:
                        yield from emit(key, bits, target)
                    key, bits = tuple(k), {}
                bits[block] = packed
        if key is not None:
            yield from emit(key, bits, target)

    return plan.mapInArrow(read, schema)
