"""The best representative of each group of duplicates, field by field, in a single aggregation.

Each field's survivor is the maximum of a composite struct (source priority, instant, tie-break, value) over the records
that have a value; records without one contribute null and are ignored by the maximum. All fields are decided in one pass
and one shuffle on the group key, with partial maxima on the map side, so that a group of any size sends a row per task.

Defined results: a null, NaN, blank or stand-in value is missing; a field that no record has is null; unreadable instants
sort last; ties go to the smaller record number; exact repeats of a record count once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words and signs that stand for no value (compared in lower case without outer blanks).
MISSING_WORDS = ["", "-", "--", "---", ".", "?", "n/a", "na", "n.a.", "nan", "nil", "none", "null", "missing", "not available", "pending", "tba", "tbd", "undefined", "unknown"]


def text_present(value: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(value)).isin(MISSING_WORDS), F.lit(False))


def number_present(value: Column, test: Column) -> Column:
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & test, F.lit(False))


def region_key(region: Column) -> Column:
    """One spelling for a grid square (``01JGK``) or a path and row (``002199``); null if it is neither."""
    bare = F.upper(F.trim(region))
    path = F.regexp_extract(bare, r"^P?(\d{1,3})[^0-9A-Z]*R?(\d{1,3})$", 1)
    row = F.regexp_extract(bare, r"^P?(\d{1,3})[^0-9A-Z]*R?(\d{1,3})$", 2)
    square = F.regexp_replace(F.regexp_replace(bare, r"[^0-9A-Z]", ""), r"^(?:MGRS)?T?(?=\d)", "")
    return F.when(path != "", F.concat(F.lpad(path, 3, "0"), F.lpad(row, 3, "0"))).when(square.rlike(r"^\d{1,2}[A-Z]{3}$"), F.lpad(square, 5, "0"))


def maturity_rank(maturity: Column) -> Column:
    """Source priority: final, interim, nrt, absent (or any other word)."""
    word = F.lower(F.trim(maturity))
    return F.when(word == "final", 3).when(word == "interim", 2).when(word == "nrt", 1).otherwise(0)


def survivors(df: DataFrame, group: Sequence[str], fields: Mapping[str, Column], priority: Column, instant: Column, record: str) -> DataFrame:
    """A row per group: the group columns, first and last record number, and a struct (record, value) per field.

    ``fields`` maps a column name to the test of whether its value is present.
    """
    best = [
        F.max(
            F.when(present, F.struct(priority.alias("p"), F.coalesce(instant, F.lit(-(2**63))).alias("t"), (-F.col(record)).alias("r"), F.col(name).alias("v")))
        ).alias(name)
        for name, present in fields.items()
    ]
    grouped = df.groupBy(*group).agg(F.min(record).alias("first_record"), F.max(record).alias("last_record"), *best)
    out = [F.when(F.col(name).isNotNull(), F.struct((-F.col(f"{name}.r")).alias("record"), F.col(f"{name}.v").alias("value"))).alias(name) for name in fields]
    return grouped.select(*group, "first_record", "last_record", *out)
