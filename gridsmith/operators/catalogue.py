"""The catalogue of datasets: matching, adding, updating, archiving, querying and exporting, set by set.

A catalogue table has at least ``id, product, region_code, center_time, maturity, uri, archived_time``. Statuses of a whole batch
are computed first; only accepted effects are written. A row of the batch gets one of the statuses added, updated, skipped, failed.

Defined results: a row without uri or id fails; of several rows of one id in a batch the first (by ``seq``) is judged against
the catalogue and the others against it: with ``update`` or ``update_if_exists`` they are updates, else skipped. A null maturity takes no
part in maturity checks. Archived datasets count as existing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsmith.session import broadcast_if_small

# Maturity words from least to most mature.
MATURITIES = ["nrt", "interim", "final"]


def maturity_rank(c: Column) -> Column:
    return F.when(F.array_position(F.array(*[F.lit(m) for m in MATURITIES]), F.lower(F.trim(c))) > 0, F.array_position(F.array(*[F.lit(m) for m in MATURITIES]), F.lower(F.trim(c))) - 1)


def near_in_time(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, within_ms: int) -> DataFrame:
    """Equi-join on ``keys`` with |left_time - right_time| <= within_ms, by buckets: no range join within a key.

    ``left`` is copied to its three neighbouring buckets, so a pair meets exactly once. Column names must differ but for ``keys``.
    """
    width = max(within_ms, 1) * 1000
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / width).cast("long")
    a = left.withColumn("__b", F.explode(F.sequence(bucket(left_time) - 1, bucket(left_time) + 1)))
    b = right.withColumn("__b", bucket(right_time))
    gap = F.abs(F.unix_micros(F.col(left_time).cast("timestamp")) - F.unix_micros(F.col(right_time).cast("timestamp")))
    return a.join(b, [*keys, "__b"]).filter(gap <= within_ms * 1000).drop("__b")


def maturity_pairs(incoming: DataFrame, catalogue: DataFrame, within_ms: int) -> DataFrame:
    """(in_id, old_id, in_rank, old_rank): live datasets of the same product, region and time as incoming ones."""
    new = incoming.filter("region_code IS NOT NULL").select("product", "region_code", F.col("id").alias("in_id"), F.col("center_time").alias("in_time"), maturity_rank(F.col("maturity")).alias("in_rank"))
    old = catalogue.filter("archived_time IS NULL AND region_code IS NOT NULL").select("product", "region_code", F.col("id").alias("old_id"), F.col("center_time").alias("old_time"), maturity_rank(F.col("maturity")).alias("old_rank"))
    pairs = near_in_time(new.filter("in_rank IS NOT NULL AND in_time IS NOT NULL"), old.filter("old_rank IS NOT NULL AND old_time IS NOT NULL"), ["product", "region_code"], "in_time", "old_time", within_ms)
    return pairs.filter("in_id <> old_id").select("in_id", "old_id", "in_rank", "old_rank")


def less_mature(pairs: DataFrame) -> DataFrame:
    """Catalogue datasets that a more mature incoming one replaces: (in_id, old_id)."""
    return pairs.filter("old_rank < in_rank").select("in_id", "old_id").distinct()


def blocked(pairs: DataFrame) -> DataFrame:
    """Incoming datasets that an equally or more mature one already stands for: (in_id)."""
    return pairs.filter("old_rank >= in_rank").select("in_id").distinct()


def statuses(incoming: DataFrame, catalogue: DataFrame, update: bool = False, update_if_exists: bool = False, allow_unsafe: bool = False,
             archive_less_mature: int | None = None, seq: str = "seq") -> DataFrame:
    """The decision of every incoming row: its columns, ``status`` and ``reason``.

    A safe update changes neither product nor, if both have it, region; other updates fail without ``allow_unsafe``.
    """
    there = catalogue.select("id", F.lit(True).alias("__there"), F.col("product").alias("__product"), F.col("region_code").alias("__region")).dropDuplicates(["id"])
    df = incoming.join(there, "id", "left")
    # Later rows of an id by an aggregation and a join (its large side can be split), not by a window that gathers the id.
    firsts = incoming.filter("id IS NOT NULL").groupBy("id").agg(F.min(seq).alias("__first"))
    df = df.join(firsts, "id", "left")
    exists = F.coalesce(F.col("__there"), F.lit(False)) | F.coalesce(F.col(seq) > F.col("__first"), F.lit(False))
    safe = (F.col("__product").isNull() | F.col("__product").eqNullSafe(F.col("product"))) & (F.col("__region").isNull() | F.col("__region").eqNullSafe(F.col("region_code")))
    stop = F.lit(False)
    if archive_less_mature is not None:
        block = blocked(maturity_pairs(incoming, catalogue, archive_less_mature)).withColumn("__blocked", F.lit(True))
        df = df.join(block, df["id"] == block["in_id"], "left").drop("in_id")
        stop = F.coalesce(F.col("__blocked"), F.lit(False)) & ~exists
    wants = F.lit(update or update_if_exists)
    reason = (
        F.when(F.col("id").isNull() | F.col("uri").isNull(), "failed:unusable document")
        .when(stop, "skipped:as mature dataset exists")
        .when(exists & wants & (safe | F.lit(allow_unsafe)), "updated:")
        .when(exists & wants, "failed:unsafe change")
        .when(exists, "skipped:already exists")
        .when(F.lit(update), "failed:doesn't exist")
        .otherwise("added:")
    )
    df = df.withColumn("__r", reason).withColumn("status", F.split_part("__r", F.lit(":"), F.lit(1))).withColumn("reason", F.nullif(F.split_part("__r", F.lit(":"), F.lit(2)), F.lit("")))
    return df.drop("__r", "__there", "__product", "__region", "__first", "__blocked")


def counts(judged: DataFrame) -> DataFrame:
    """(status, n) of a batch."""
    return judged.groupBy("status").agg(F.count("*").alias("n"))


def apply(judged: DataFrame, catalogue: DataFrame, now: Column, archive_less_mature: int | None = None, seq: str = "seq") -> DataFrame:
    """The catalogue after a judged batch: a new snapshot of the catalogue's columns.

    Added and updated rows win over stored ones (the last of an id by ``seq``); datasets less mature than accepted ones get ``archived_time``.
    """
    cols = catalogue.columns
    accepted = judged.filter(F.col("status").isin("added", "updated"))
    last = accepted.groupBy("id").agg(F.max(F.struct(F.col(seq).alias("__seq"), *[F.col(c) for c in accepted.columns if c in cols and c != "id"])).alias("r"))
    last = last.select("id", "r.*")
    last = last.select(*[F.col(c) if c in last.columns else F.lit(None).cast(catalogue.schema[c].dataType).alias(c) for c in cols])
    out = catalogue.join(last.select("id"), "id", "left_anti").select(*cols).unionByName(last)
    if archive_less_mature is not None:
        gone = less_mature(maturity_pairs(judged.filter("status = 'added'"), catalogue, archive_less_mature)).select(F.col("old_id").alias("id")).distinct().withColumn("__gone", F.lit(True))
        out = out.join(gone, "id", "left").withColumn("archived_time", F.when(F.col("__gone") & F.col("archived_time").isNull(), now).otherwise(F.col("archived_time"))).select(*cols)
    return out


def archive(catalogue: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Set the archived time of the live datasets in ``ids``."""
    gone = ids.select("id").distinct().withColumn("__gone", F.lit(True))
    return catalogue.join(gone, "id", "left").withColumn("archived_time", F.when(F.col("__gone") & F.col("archived_time").isNull(), now).otherwise(F.col("archived_time"))).select(*catalogue.columns)


def events(judged: DataFrame, catalogue: DataFrame, archive_less_mature: int | None = None) -> DataFrame:
    """(n, id, action): what is published, for each added dataset the datasets it archives before itself; updates publish nothing."""
    added = judged.filter("status = 'added'").select("id", F.col("id").alias("cause"), F.lit("ADDED").alias("action"), F.lit(1).alias("n"))
    if archive_less_mature is None:
        return added.select("cause", "n", "id", "action")
    gone = less_mature(maturity_pairs(judged.filter("status = 'added'"), catalogue, archive_less_mature))
    return added.select("cause", "n", "id", "action").unionByName(gone.select(F.col("in_id").alias("cause"), F.lit(0).alias("n"), F.col("old_id").alias("id"), F.lit("ARCHIVED").alias("action")))


def publications(events_: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, message, attributes) of events: the item document (id, item) of each dataset and what subscribers filter by."""
    from gridsmith.functions import items

    rows = events_.join(documents.select("id", F.col("item").alias("message")), "id")
    p = F.from_json(F.get_json_object("message", "$.properties"), "map<string,string>")
    return rows.select("id", "message", items.event_attributes(F.col("action"), p, F.get_json_object("message", "$.collection")).alias("attributes"))


def missing(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Requested keys that are not known (must be empty for a run to start)."""
    return requested.select(key).distinct().join(known.select(key), key, "left_anti")


def allow_list(df: DataFrame, allowed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) rows by a list of allowed keys."""
    a = broadcast_if_small(allowed.select(key).distinct())
    return df.join(a, key, "left_semi"), df.join(a, key, "left_anti")


def restricted(df: DataFrame, products: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> DataFrame:
    out = df if products is None else df.filter(F.col("product").isin(list(products)))
    return out if not exclude else out.filter(~F.col("product").isin(list(exclude)))


def product_sync(listed: DataFrame, definitions: DataFrame, known: DataFrame, update_if_exists: bool = False) -> DataFrame:
    """(product, status) of a product list: rows ``names`` (``;``-separated) and ``definition``.

    ``definitions``: (definition, product) of the documents behind each row. Names must be equal to the documents' names as
    multisets; otherwise the whole entry fails. New products are added; existing ones are updated only if asked, else unchanged.
    """
    docs = definitions.groupBy("definition").agg(F.array_sort(F.collect_list("product")).alias("found"))
    names = F.transform(F.split("names", ";"), lambda x: F.trim(x))
    rows = listed.withColumn("names_list", F.array_sort(names)).join(docs, "definition", "left")
    good = F.coalesce(F.col("names_list") == F.col("found"), F.lit(False))
    each = rows.select(F.explode(F.when(good, F.col("names_list")).otherwise(F.array("names"))).alias("product"), good.alias("good"))
    there = known.select("product").distinct().withColumn("there", F.lit(True))
    status = F.when(~F.col("good"), "failed").when(F.col("there").isNull(), "added").when(F.lit(update_if_exists), "updated").otherwise("unchanged")
    return each.join(there, "product", "left").select("product", status.alias("status"))


def register(wanted: DataFrame, definitions: DataFrame, known: DataFrame) -> DataFrame:
    """(product, status, doc) of products to be registered from their definitions (product, doc): known, registered or unknown.

    The ``registered`` rows are what is appended to the products; an unknown product must stop the run.
    """
    docs = definitions.filter("product IS NOT NULL").groupBy("product").agg(F.min("doc").alias("doc"))
    there = known.select("product").distinct().withColumn("__there", F.lit(True))
    rows = wanted.select("product").distinct().join(docs, "product", "left").join(there, "product", "left")
    status = F.when(F.col("__there"), "known").when(F.col("doc").isNotNull(), "registered").otherwise("unknown")
    return rows.select("product", status.alias("status"), F.when(F.col("__there").isNull(), F.col("doc")).alias("doc"))


def match_products(datasets: DataFrame, products: DataFrame) -> DataFrame:
    """(id, product) by band sets: a dataset belongs to each product all of whose bands it has.

    ``datasets``: id, bands; ``products``: product, bands. Joined on the band, counted, compared with the product's number of bands.
    """
    need = products.select("product", F.explode(F.array_distinct("bands")).alias("band"), F.size(F.array_distinct("bands")).alias("n_bands"))
    have = datasets.select("id", F.explode(F.array_distinct("bands")).alias("band"))
    return have.join(broadcast_if_small(need), "band").groupBy("id", "product", "n_bands").agg(F.count("*").alias("n")).filter("n = n_bands").select("id", "product")


def missing_parents(edges: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Lineage edges (child, label, parent) whose parent is not in the catalogue."""
    return edges.join(catalogue.select(F.col("id").alias("parent")), "parent", "left_anti")


def differing_parents(embedded: DataFrame, stored: DataFrame) -> DataFrame:
    """(id): embedded parent documents that differ from the stored ones (as canonical JSON)."""
    canon = lambda c: F.to_json(F.try_parse_json(c))
    a, b = embedded.select("id", canon("doc").alias("a")), stored.select("id", canon("doc").alias("b"))
    return a.join(b, "id").filter(~F.col("a").eqNullSafe(F.col("b"))).select("id")


def search(catalogue: DataFrame, product: str | None = None, box: tuple[float, float, float, float] | None = None, start: object = None, stop: object = None,
           limit: int | None = None) -> DataFrame:
    """Live datasets by product, overlapping box (left, bottom, right, top) and half-open time range; ``limit`` takes the earliest."""
    from gridsmith.functions.geo import boxes_overlap

    out = catalogue.filter("archived_time IS NULL")
    if product is not None:
        out = out.filter(F.col("product") == product)
    if box is not None:
        out = out.filter(boxes_overlap({c: F.col(c) for c in ("left", "bottom", "right", "top")}, *box))
    if start is not None:
        out = out.filter(F.col("center_time") >= F.lit(start))
    if stop is not None:
        out = out.filter(F.col("center_time") < F.lit(stop))
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    return out if limit is None else out.orderBy("center_time", "id").limit(limit)


def view(found: DataFrame, most: int = 2000) -> tuple[int, DataFrame | None]:
    """(count, rows): the rows of a search are only handed out if there are fewer than ``most``."""
    n = found.count()
    return n, found if n < most else None


def drawable(found: DataFrame, group: str, most: int = 2000) -> DataFrame:
    """(group, n, shown): which groups of a search are few enough to be drawn (fewer than ``most``)."""
    return found.groupBy(group).agg(F.count("*").alias("n")).withColumn("shown", F.col("n") < most)


def point_in_time(catalogue: DataFrame, x: float, y: float) -> DataFrame:
    """Datasets whose box holds a point, numbered in time order (``n``; ties by id).

    One point has few datasets; their order comes from a ranked array per year, so that no task sees all of them.
    """
    hit = catalogue.filter((F.col("left") <= x) & (F.col("right") >= x) & (F.col("bottom") <= y) & (F.col("top") >= y))
    return numbered_by(hit, F.year("center_time"), "center_time", "id")


def numbered_by(df: DataFrame, part: Column, *order: str) -> DataFrame:
    """Add ``n``, the row's place in ``order``: numbered within the parts (which must rise with the order), parts after one another."""
    ranged = df.withColumn("__part", F.coalesce(part, F.lit(-(2**31))))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size"))
    total = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(total), F.lit(0)).alias("__start"))
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(broadcast_if_small(starts), "__part").withColumn("n", F.col("__start") + nth).drop("__part", "__start")


def progress(df: DataFrame, part: Column, order: str, every: int, *ties: str) -> DataFrame:
    """Every ``every``-th row of a run in ``order``: (n, order, elapsed seconds since the first). ``part`` must rise with the order."""
    if every < 1:
        raise ValueError("every must be positive")
    first = df.agg(F.min(order).alias("first")).first()["first"]
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = numbered_by(df, part, order, *ties).filter(F.col("n") % every == 0)
    return rows.select("n", order, ((micros(F.col(order)) - micros(F.lit(first).cast(df.schema[order].dataType))) / 1e6).alias("elapsed"))


def empty(df: DataFrame, result: str) -> DataFrame:
    """Rows whose result (an array or map) is empty or absent: the list of failures of a step."""
    return df.filter(F.coalesce(F.size(result), F.lit(0)) <= 0)


def gauges(counts_: DataFrame, name: str, **tags: str) -> DataFrame:
    """(line): a gauge report of each outcome, ``name:value|g|#tag:value,…``."""
    said = ",".join([f"{k}:{v}" for k, v in sorted(tags.items())])
    return counts_.select(F.concat(F.lit(f"{name}:"), F.col("n").cast("string"), F.lit("|g|#"), F.lit(said + "," if said else ""), F.lit("action:"), F.col("status")).alias("line"))


def summaries(catalogue: DataFrame, *groups: str) -> DataFrame:
    """Total, live, temporal and spatial extent per product (or other groups)."""
    groups = groups or ("product",)
    live = F.col("archived_time").isNull()
    out = [F.count("*").alias("n_total"), F.count_if(live).alias("n_live"), F.min("center_time").alias("first_time"), F.max("center_time").alias("last_time")]
    if "left" in catalogue.columns:
        out += [F.min("left").alias("left"), F.min("bottom").alias("bottom"), F.max("right").alias("right"), F.max("top").alias("top")]
    return catalogue.groupBy(*groups).agg(*out)


def rates(df: DataFrame, group: str, ts: str) -> DataFrame:
    """n, elapsed seconds and rows per second (0 for no elapsed time)."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    g = df.groupBy(group).agg(F.count("*").alias("n"), ((F.max(micros) - F.min(micros)) / 1e6).alias("elapsed"))
    return g.withColumn("fps", F.when(F.col("elapsed") > 0, F.col("n") / F.col("elapsed")).otherwise(F.lit(0.0)))
