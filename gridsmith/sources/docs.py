"""Documents: text and binary files, JSON and YAML, tar archives in and out."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.functions.text import complete_json, yaml_documents
from gridsmith.sources import files


def lines(spark: SparkSession, path: str, skip_empty: bool = False) -> DataFrame:
    """(value): stripped lines."""
    df = spark.read.text(path).select(F.trim("value").alias("value"))
    return df.filter(F.length("value") > 0) if skip_empty else df


def whole(spark: SparkSession, path: str, binary: bool = False, pattern: str | None = None) -> DataFrame:
    """(uri, content): whole files as text or bytes; hidden and empty files are left out (``listing.documents`` has them)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (r.option("pathGlobFilter", pattern) if pattern else r).load(path).select(F.col("path").alias("uri"), "content")
    return df if binary else df.withColumn("content", F.decode("content", "UTF-8"))


def parsed(raw: DataFrame, uri: str = "uri", content: str = "content") -> DataFrame:
    """(uri, doc, error): JSON text of each document; ``.json`` is JSON, everything else YAML (all documents of a file)."""
    df = raw.select(F.col(uri).alias("uri"), F.col(content).cast("string").alias("content"))
    as_json = df.filter(F.lower("uri").endswith(".json")).select("uri", F.when(complete_json(F.col("content")), F.col("content")).alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(u, d) for u, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for d in (yaml_documents(c) or [None])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["uri", "doc"])

    as_yaml = df.filter(~F.lower("uri").endswith(".json")).mapInArrow(run, "uri string, doc string")
    return as_json.unionByName(as_yaml).withColumn("error", F.when(F.col("doc").isNull(), "unreadable document"))


BATCH_BYTES = 8 << 20


def _member_batches(archive: str, keep: Callable[[tarfile.TarInfo], bool] | None) -> Iterator[pa.RecordBatch]:
    names: list[str] = []
    data: list[bytes] = []
    with files.open_input(archive) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
        for m in tar:
            if m.isfile() and (keep is None or keep(m)):
                names.append(m.name)
                data.append(tar.extractfile(m).read())
                if sum(map(len, data)) > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([archive] * len(names)), pa.array(names), pa.array(data, pa.binary())], names=["archive", "name", "content"])
                    names, data = [], []
    if names:
        yield pa.RecordBatch.from_arrays([pa.array([archive] * len(names)), pa.array(names), pa.array(data, pa.binary())], names=["archive", "name", "content"])


def tar_members(spark: SparkSession, path: str, keep: Callable[[tarfile.TarInfo], bool] | None = None) -> DataFrame:
    """(archive, name, content): regular files of tar archives (any compression); ``keep`` sees name, size and mtime of an entry.

    Tasks stream the archives, so that an archive may be of any size; a member must fit into memory.
    """
    # The bytes are not among the columns read: Spark only lists the archives.
    listed = spark.read.format("binaryFile").load(path).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield from _member_batches(p, keep)

    return listed.mapInArrow(run, "archive string, name string, content binary")


def tar_mode(gzip: bool = False, xz: bool = False, pipe: bool = False) -> str:
    """Suffix of the open mode; gzip wins over xz, xz over a pipe."""
    return ":gz" if gzip else ":xz" if xz else "|" if pipe else ""


def write_tars(docs: DataFrame, folder: str, gzip: bool = True, mtime: int = 0) -> DataFrame:
    """One tar per partition in a shared folder, from (name, content); rows without content are left out.

    Files are written under a temporary name and renamed, so a lost task leaves no half archive. Returns (path, n).
    """
    suffix = ".tar.gz" if gzip else ".tar"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.taskcontext import TaskContext

        fs, root = files.resolve(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        path, n = f"{root}/part-{part:05d}{suffix}", 0
        temp = f"{path}.{TaskContext.get().taskAttemptId()}.tmp"
        with fs.open_output_stream(temp, compression=None) as out, tarfile.open(fileobj=out, mode="w|gz" if gzip else "w|") as tar:
            for batch in batches:
                for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if data is not None:
                        info = tarfile.TarInfo(name)
                        info.size, info.mode, info.mtime = len(data), 0o644, mtime
                        tar.addfile(info, io.BytesIO(data))
                        n += 1
        fs.move(temp, path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n"])

    return docs.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, n long")
