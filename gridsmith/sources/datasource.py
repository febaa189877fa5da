"""A live object listing as a data source: ``spark.read.format("object_listing").option("path", folder).load()``.

The folder's upper levels are split, a partition per sub-folder; hidden files are objects like any other. A prefix condition on ``url`` is taken over by the
reader (with ``spark.sql.python.filterPushdown.enabled``): sub-folders that cannot match are never listed.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, StringStartsWith

from gridsmith.sources import files

SPLIT, LEVELS = 32, 3
SCHEMA = "url string, size long, last_modified timestamp, etag string"


def _list(path: str, recursive: bool) -> list:
    import pyarrow.fs as pafs

    fs, inner = files.resolve(path)
    return fs.get_file_info(pafs.FileSelector(inner, recursive=recursive, allow_not_found=True))


class ListingPartition(InputPartition):
    """Folders (path, whether with all below) that one task lists."""

    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


class ListingReader(DataSourceReader):
    def __init__(self, root: str, pattern: str = "*", recursive: bool = True):
        self.root, self.prefix, self.pattern, self.recursive = root.rstrip("/"), "", pattern, recursive

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("url",) and len(f.value) > len(self.prefix):
                self.prefix = f.value
            # Spark checks the condition again: within a sub-folder it is not applied here.
            yield f

    def partitions(self) -> list[InputPartition]:
        """At most ``SPLIT`` tasks over the folders of the upper levels, which are opened until there are enough of them."""
        open_, flat = [self.root], []
        for _ in range(LEVELS if self.recursive else 0):
            if len(open_) >= SPLIT:
                break
            below = [f"{f}/{i.base_name}" for f in open_ for i in _list(f, False) if not i.is_file]
            below = [f for f in below if f"{f}/".startswith(self.prefix) or self.prefix.startswith(f"{f}/")]
            flat, open_ = [*flat, *open_], below
        folders = [*[(f, False) for f in flat], *[(f, self.recursive) for f in open_]]
        return [ListingPartition(folders[i::SPLIT]) for i in range(min(SPLIT, len(folders)))]

    def read(self, partition: ListingPartition) -> Iterator[tuple]:
        for base, deep in partition.folders:
            inner = files.resolve(base)[1].rstrip("/")
            for i in _list(base, deep):
                if i.is_file and fnmatch.fnmatchcase(i.base_name, self.pattern):
                    yield base + i.path[len(inner) :], i.size, i.mtime, None


class ObjectListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "object_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ListingReader(self.options["path"], self.options.get("pattern", "*"), self.options.get("recursive", "true") != "false")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ObjectListing)
