"""An item API read page by page: ``<address>/<collection>`` answers with features and a link to the next page.

A collection's pages form a chain, so a task follows a chain while others follow theirs; filters and limits are applied to the items
as they come. Pages are files here (any file system, or a folder mounted for an address).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.functions import geo, items
from gridsmith.sources import listing


def write_pages(rows: DataFrame, address: str, roots: dict[str, str] | None = None, page: int = 100) -> None:
    """Serve items (collection, seq, item) as pages in the order of ``seq``; pages hold at most ``page`` items each."""
    from pyspark.sql import Window

    order = Window.partitionBy("collection").orderBy("seq")
    numbered = rows.withColumn("page", F.expr(f"(n - 1) div {page}") if "n" in rows.columns else F.floor((F.row_number().over(order) - 1) / page))
    grouped = numbered.groupBy("collection", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "item"))).alias("xs"))
    last = grouped.groupBy("collection").agg(F.max("page").alias("last"))
    url = lambda n: F.concat(F.lit(f"{address}/"), "collection", F.lit("/"), n.cast("string"), F.lit(".json"))
    next_ = F.when(F.col("page") < F.col("last"), F.concat(F.lit('{"rel":"next","href":"'), url(F.col("page") + 1), F.lit('"}'))).otherwise(F.lit(""))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("xs", lambda x: x["item"]), ","), F.lit('],"links":['), next_, F.lit("]}"))
    listing.put(grouped.join(last, "collection").select(url(F.col("page")).alias("url"), text.alias("data")), roots).agg(F.count("*")).first()


def features(spark: SparkSession, addresses: Sequence[str], roots: dict[str, str] | None = None, most: int | None = None) -> DataFrame:
    """(address, n, item, error): the features of each chain of pages from its first address, numbered from 1; at most ``most`` of each."""
    first = spark.createDataFrame([(a,) for a in addresses], "address string").repartition(max(1, min(len(addresses), 1000)), "address")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for address in batch.column(0).to_pylist():
                n, at, seen = 0, address, set()
                while at and at not in seen and (most is None or n < most):
                    seen.add(at)
                    data, error = listing._read(listing._local(roots, at), None, None, 3, 0.2)
                    try:
                        tree = json.loads(data) if data is not None else {}
                    except ValueError:
                        tree, error = {}, "unreadable page"
                    got = tree.get("features") or []
                    got = got if most is None else got[: most - n]
                    texts = [json.dumps(x, ensure_ascii=False) for x in got] + [None] * (error is not None)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([address] * len(texts)), pa.array(range(n + 1, n + 1 + len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array([None] * len(got) + [error] * (len(texts) - len(got)), pa.string())],
                        names=["address", "n", "item", "error"],
                    )
                    n += len(got)
                    at = next((x.get("href") for x in tree.get("links") or [] if x.get("rel") == "next"), None)

    return first.mapInArrow(run, "address string, n long, item string, error string")


def search(spark: SparkSession, address: str, collections: Sequence[str], bbox: tuple[float, float, float, float] | None = None, datetime: str | None = None,
           max_items: int | None = None, roots: dict[str, str] | None = None) -> DataFrame:
    """(collection, n, item): items of collections by overlapping box and half-open ``start/stop`` (each part may be empty).

    ``max_items`` takes the first ones in the order of collections and pages. Collections that don't answer have no items.
    """
    first = [f"{address.rstrip('/')}/{c}/0.json" for c in collections]
    found = features(spark, first, roots, max_items if bbox is None and datetime is None else None).filter("item IS NOT NULL")
    found = found.select(F.element_at(F.split("address", "/"), -2).alias("collection"), "n", "item")
    if datetime is not None:
        start, _, stop = datetime.partition("/")
        at = F.get_json_object("item", "$.properties.datetime")
        found = found.filter(F.lit(True) if not start else at >= start).filter(F.lit(True) if not stop else at < stop)
    if bbox is not None:
        b = F.from_json(F.get_json_object("item", "$.bbox"), "array<double>")
        found = found.filter(geo.boxes_overlap({c: F.get(b, F.lit(i)) for i, c in enumerate(("left", "bottom", "right", "top"))}, *bbox))
    return found if max_items is None else found.orderBy("collection", "n").limit(max_items)


def index(store, found: DataFrame, rename_product: str | None = None, **options: object) -> dict[str, int]:  # noqa: ANN001
    """Found items as datasets of the catalogue ``store``; nothing found changes nothing. An item's address is its canonical link, else
    the one to itself, else its place in the search."""
    from gridsmith.operators import intake
    from gridsmith.operators.store import dataset_rows

    named = found.withColumn("item", items.renamed_product(F.col("item"), rename_product)) if rename_product else found
    links = F.from_json(F.get_json_object("item", "$.links"), "array<struct<rel:string,href:string>>")
    named = named.withColumn("uri", F.coalesce(items.item_uri(links), F.concat("collection", F.lit("#"), F.col("n").cast("string"))))
    made = items.to_datasets(named.withColumn("key", F.struct("uri", F.xxhash64("collection", "n").alias("seq"))), "key").select("key.uri", "key.seq", intake.dataset_text().alias("doc"))
    return store.index(dataset_rows(made), **options)


