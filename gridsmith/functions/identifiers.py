"""Deterministic and checked identifiers as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace in which dataset identifiers are derived.
NAMESPACE = "6f34c6f4-13d6-43c0-8e4e-42b6c13203af"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Version-5 UUID of ``name`` (null for null)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def dataset_uuid(algorithm: Column | str, version: str, sources: Column, deployment: str = "", tags: Mapping[str, Column] | None = None) -> Column:
    """Identifier of a derived dataset; the order of sources and tags does not matter, neither does case.

    Lines of algorithm, version and deployment, then sorted ``key=value`` tags, then sorted sources, in lower case.
    """
    algorithm = F.lit(algorithm) if isinstance(algorithm, str) else algorithm
    named = F.array_sort(F.array(*[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in (tags or {}).items()])) if tags else F.expr("CAST(array() AS array<string>)")
    lines = F.concat(F.array(algorithm, F.lit(version), F.lit(deployment)), named, F.array_sort(sources))
    return uuid5(F.lower(F.array_join(lines, "\n")))


def canonical_uuid(text: Column) -> Column:
    """Lower-case canonical form of anything that reads as a UUID: without dashes, in braces, as a URN; else null."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(text, "urn:|uuid:", ""), r"^[{}]+|[{}]+$", ""))
    bare = F.replace(bare, F.lit("-"), F.lit(""))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def is_uuid(text: Column) -> Column:
    return F.coalesce(canonical_uuid(text).isNotNull(), F.lit(False))
