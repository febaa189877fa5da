"""URLs, object keys and byte ranges as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scheme(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.lit(""))


def host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1), F.lit(""))


def key(url: Column) -> Column:
    """Path without leading slash; empty for a bare host."""
    return F.when(scheme(url).isNotNull(), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/*(.*)$", 1))


def object_address(url: Column) -> Column:
    """struct(bucket, key) of an ``s3`` URL; null for any other URL."""
    return F.when(scheme(url) == "s3", F.struct(F.coalesce(host(url), F.lit("")).alias("bucket"), key(url).alias("key")))


def parent(url: Column) -> Column:
    """Directory of a URL, with its slash."""
    return F.regexp_replace(url, "[^/]*$", "")


def range_header(start: Column, stop: Column) -> Column:
    """HTTP header of the half-open byte range; null for open, negative or empty ranges."""
    ok = (start >= 0) & (stop > start)
    return F.when(ok, F.concat(F.lit("bytes="), start.cast("string"), F.lit("-"), (stop - 1).cast("string")))


def relative_path(href: Column, self_link: Column) -> Column:
    """``href`` relative to the directory of ``self_link``, if both hosts begin with the same label and it lies below; else ``href``."""
    first = lambda u: F.split_part(F.coalesce(host(u), F.lit("")), F.lit("."), F.lit(1))
    base = F.concat(F.lit("/"), parent(key(self_link)))
    path = F.concat(F.lit("/"), key(href))
    below = (first(href) == first(self_link)) & path.startswith(base)
    return F.when(self_link.isNull(), href).when(below, F.substring(path, F.length(base) + 1, F.length(path))).otherwise(href)
