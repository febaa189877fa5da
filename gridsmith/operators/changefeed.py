"""A stream of inserts, updates and deletes as a signed multiset.

Every (deduplicated) change contributes its after-image with multiplicity +1 and the image it replaces, its
before-image, with -1. The base table's rows have multiplicity +1. Summing multiplicities per image leaves exactly the
last image of every key with a positive count; a deletion's image is a tombstone, which is dropped at the end.

The sums telescope, so they are taken in two rounds: first within salted parts of each key, where the before-image is
the preceding change of the same part, then over the at most ``salts`` images that are left of a key. A key with a third of
all changes is thereby spread over ``salts`` tasks and never gathered in one.

Defined results: changes without key or instant change nothing; equal instants are decided by the tie column (greater
wins), equal ties too by the state (live wins); exact repeats of a change collapse; an empty feed returns the base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _round(images: DataFrame, part: list[str]) -> DataFrame:
    """One telescoping round: +1 for each image, -1 for the one before it in its part; positive sums remain."""
    previous = Window.partitionBy(*part).orderBy("instant", "tie", "live")
    signed = images.withColumn("before", F.lag(F.struct("instant", "tie", "live")).over(previous))
    after = F.struct("instant", "tie", "live", F.lit(1).alias("n"))
    before = F.when(F.col("before").isNotNull(), F.struct("before.instant", "before.tie", "before.live", F.lit(-1).alias("n")))
    signed = signed.select(*part, F.explode(F.filter(F.array(after, before), lambda x: x.isNotNull())).alias("i")).select(*part, "i.*")
    # Grouping by a superset of the window's partitioning needs no further exchange.
    return signed.groupBy(*part, "instant", "tie", "live").agg(F.sum("n").alias("n")).filter("n > 0").drop("n")


def last_images(changes: DataFrame, salts: int = 64) -> DataFrame:
    """(key, instant, tie, live): the image that set each key's last state, removals included."""
    images = changes.select("key", "instant", "tie", "live").filter("key IS NOT NULL AND instant IS NOT NULL AND tie IS NOT NULL")
    images = images.withColumn("salt", F.pmod(F.xxhash64("tie", "instant"), F.lit(salts)))
    return _round(_round(images, ["key", "salt"]).drop("salt"), ["key"])


def live_rows(changes: DataFrame, base: DataFrame | None = None, salts: int = 64) -> DataFrame:
    """The rows that are live after all changes: (key, tie) of the image that set each key's last state.

    ``changes``: key, instant (bigint), tie (bigint), live (boolean; false removes). ``base``: key, tie of rows already there.
    """
    if base is not None:
        changes = changes.select("key", "instant", "tie", "live").unionByName(base.select("key", F.lit(-(2**63)).alias("instant"), "tie", F.lit(True).alias("live")))
    return last_images(changes, salts).filter("live").select("key", "tie")


def is_live(action: Column) -> Column:
    """ADDED, UPDATED and an absent action make a dataset live, ARCHIVED removes it; other words change nothing (null)."""
    word = F.upper(F.trim(action))
    return F.when(action.isNull() | (word == ""), F.lit(True)).when(word.isin("ADDED", "UPDATED"), F.lit(True)).when(word == "ARCHIVED", F.lit(False))
