"""Session helpers: table loading, size-checked broadcasts and shared scratch space."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data directory; pruning and pushdown are left to Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets one of its own and any other session an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridsmith-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes with ``discard`` or when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(discard)
    _SCRATCH.append((spark, path))
    return path


def discard() -> None:
    """Remove everything written to scratch paths so far; DataFrames over it must not be used afterwards."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            sc = spark.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001, S112 - the session may have ended already
            continue


def materialise(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder; it survives the loss of executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    kept = T.StructType([f for f in df.schema if f.name not in partition_by] + [f for f in df.schema if f.name in partition_by])
    return spark.read.schema(kept).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 32 << 20) -> DataFrame:
    """Mark ``df`` for broadcast only if it has at most ``max_rows`` rows and ``max_bytes`` bytes (as JSON text).

    Beyond that the planner's own join is used. The sizes are taken from the data, at most one row more than allowed.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, n_bytes = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and n_bytes <= max_bytes else df
