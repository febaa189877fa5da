"""Files on the file system that a path names, opened inside tasks: local, HDFS, object stores."""

from __future__ import annotations

from urllib.parse import unquote

# Hadoop's names of schemes and those of Arrow's file systems.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss", "gs": "gs", "viewfs": "hdfs"}


def resolve(path: str):  # noqa: ANN201
    """(file system, path within it) of a path as Spark writes it (``s3a://…``, ``hdfs://…``, ``file:/…``, ``/…``)."""
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + unquote(path[5:]).lstrip("/")
    scheme, sep, rest = path.partition("://")
    if not sep:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def open_input(path: str):  # noqa: ANN201
    """A seekable file for reading."""
    fs, inner = resolve(path)
    return fs.open_input_file(inner)
