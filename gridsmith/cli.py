"""Console commands: ``python -m gridsmith.cli COMMAND ...``. Exit code 1 if anything failed."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.functions import geo, items, text
from gridsmith.operators import catalogue, export, intake
from gridsmith.operators.store import Store, dataset_rows
from gridsmith.sources import docs, item_api, listing, queue
from gridsmith.streaming import indexer

COMMANDS: dict[str, tuple[Callable, str, tuple[str, ...], dict[str, object]]] = {}
INDEXING = {"update": False, "update_if_exists": False, "allow_unsafe": False, "archive_less_mature": 0, "stac": False, "rename_product": None}


def command(help_: str, *args: str, **flags: object):  # noqa: ANN201
    """Register a function as the command of its name; False makes a switch, null an optional text."""

    def add(f: Callable) -> Callable:
        COMMANDS[f.__name__.replace("_", "-")] = (f, help_, args, flags)
        return f

    return add


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridsmith")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (_, help_, args, flags) in COMMANDS.items():
        c = sub.add_parser(name, help=help_)
        for a in args:
            c.add_argument(a)
        for f, default in flags.items():
            kind = {"action": "store_true"} if default is False else {"type": type(default) if default is not None else str, "default": default}
            c.add_argument("--" + f.replace("_", "-"), **kind)
    return p


def show(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print(*[v for v in r if v is not None], sep="\t")


def _box(a: argparse.Namespace) -> tuple[float, ...] | None:
    box = tuple(float(v) for v in a.box.split(",")) if a.box else None
    if box is not None and len(box) != 4:
        raise ValueError("a box has four numbers: left,bottom,right,top")
    return box


def _index(spark: SparkSession, a: argparse.Namespace, raw: DataFrame, always_items: bool = False) -> int:
    """Documents or items (uri, content) into the catalogue; prints the counts and the gauges to report."""
    if a.stac or always_items:
        content = F.col("content").cast("string")
        raw = raw.withColumn("content", items.renamed_product(content, a.rename_product) if a.rename_product else content)
        parsed = items.to_datasets(raw, "uri", "content").select("uri", intake.dataset_text().alias("doc"))
    else:
        parsed = docs.parsed(raw)
    counts = Store(spark, a.catalogue).index(dataset_rows(parsed), update=a.update, update_if_exists=a.update_if_exists, allow_unsafe=a.allow_unsafe, archive_less_mature=a.archive_less_mature or None)
    print(json.dumps(counts))
    return int(counts.get("failed", 0) > 0)


@command("URLs under a folder that a query finds", "folder", "query")
def find(spark: SparkSession, a: argparse.Namespace) -> None:
    show(listing.find(listing.scan(spark, a.folder), a.query).select("url"))


@command("keys of an inventory", "manifest", "folder", prefix="", suffix="", contains="", regex=None, glob=None)
def inventory(spark: SparkSession, a: argparse.Namespace) -> None:
    df = listing.inventory(spark, listing.read_manifest(spark, a.manifest), lambda k: f"{a.folder.rstrip('/')}/{k}")
    show(listing.key_filter(df, "Key", a.prefix, a.suffix, a.contains, a.regex, a.glob).select("Bucket", "Key"))


def _blobs(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Files of a folder whose names (the last segment) start and end as asked."""
    name = F.regexp_extract("url", "([^/]*)$", 1)
    return listing.scan(spark, a.folder).filter(name.startswith(a.prefix) & name.endswith(a.suffix))


def _tar(found: DataFrame, out: str) -> int:
    made, failed = listing.to_tar(found, out)
    print(made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    gone = failed.collect()
    for r in gone:
        print(r["url"], r["error"], sep="\t", file=sys.stderr)
    return int(bool(gone))


@command("files of a folder into tar archives", "folder", "out", pattern="*")
def to_tar(spark: SparkSession, a: argparse.Namespace) -> int:
    return _tar(listing.scan(spark, a.folder, a.pattern), a.out)


@command("URLs of a text file into tar archives", "urls", "out")
def urls_to_tar(spark: SparkSession, a: argparse.Namespace) -> int:
    return _tar(docs.lines(spark, a.urls, skip_empty=True).withColumnRenamed("value", "url"), a.out)


@command("blobs by prefix and suffix into tar archives", "folder", "out", prefix="", suffix="")
def blobs_to_tar(spark: SparkSession, a: argparse.Namespace) -> int:
    return _tar(_blobs(spark, a), a.out)


@command("a crawled catalogue's entries into tar archives", "folder", "out", select=".*", skip=None)
def crawl_to_tar(spark: SparkSession, a: argparse.Namespace) -> int:
    return _tar(listing.crawl(listing.scan(spark, a.folder), [a.skip] if a.skip else [], [a.select]), a.out)


@command("add or update documents of a folder", "folder", "catalogue", pattern=None, **INDEXING)
def index(spark: SparkSession, a: argparse.Namespace) -> int:
    return _index(spark, a, docs.whole(spark, a.folder, pattern=a.pattern))


@command("add or update item documents (JSON) of a folder", "folder", "catalogue", pattern=None, **INDEXING)
def index_items(spark: SparkSession, a: argparse.Namespace) -> int:
    return _index(spark, a, docs.whole(spark, a.folder, pattern=a.pattern), always_items=True)


@command("add or update documents of tar archives", "folder", "catalogue", **INDEXING)
def index_tar(spark: SparkSession, a: argparse.Namespace) -> int:
    m = docs.tar_members(spark, a.folder)
    return _index(spark, a, m.select(F.concat("archive", F.lit("!"), "name").alias("uri"), F.decode("content", "UTF-8").alias("content")))


@command("add or update documents by prefix and suffix of their names", "folder", "catalogue", prefix="", suffix="", **INDEXING)
def index_blobs(spark: SparkSession, a: argparse.Namespace) -> int:
    return _index(spark, a, listing.documents(_blobs(spark, a)))


@command("add documents of a crawled catalogue that could be read", "folder", "catalogue", select=".*", skip=None, **INDEXING)
def index_crawl(spark: SparkSession, a: argparse.Namespace) -> int:
    got = listing.documents(listing.crawl(listing.scan(spark, a.folder), [a.skip] if a.skip else [], [a.select]))
    return _index(spark, a, got.filter("error IS NULL"))


@command("add or update items of an item API", "address", "catalogue", collections="", box=None, datetime=None, limit=0, options=None, **INDEXING)
def index_api(spark: SparkSession, a: argparse.Namespace) -> int:
    more = {r["k"]: r["v"] for r in spark.range(1).select(F.explode(text.options(F.lit(a.options))).alias("k", "v")).collect()} if a.options else {}
    names = (more.get("collections") or a.collections).split(",")
    found = item_api.search(spark, a.address, names, _box(a), more.get("datetime") or a.datetime, int(more.get("max_items") or a.limit) or None)
    counts = item_api.index(Store(spark, a.catalogue), found, a.rename_product, update_if_exists=a.update_if_exists, allow_unsafe=True, archive_less_mature=a.archive_less_mature or None)
    print(json.dumps(counts))
    return int(counts.get("failed", 0) > 0)


@command("add, update and archive by the messages of a queue folder (seq, body) until it is empty", "queue", "catalogue", "checkpoint", archive=False, record_path=None, metadata_link=None, regions=None, limit=0, **INDEXING)
def index_queue(spark: SparkSession, a: argparse.Namespace) -> int:
    store = Store(spark, a.catalogue)
    decisions: dict[str, object] = {"archive": a.archive, "stac": a.stac, "metadata_link": a.metadata_link, "record_path": a.record_path.split(",") if a.record_path else None}
    if a.regions:
        decisions["regions"] = docs.lines(spark, a.regions, skip_empty=True).select(F.explode(F.split("value", ",")).alias("region_code"))
        if decisions["regions"].limit(1).count() == 0:
            raise ValueError(f"no region codes in {a.regions}")
    options = {"update": a.update, "update_if_exists": a.update_if_exists, "allow_unsafe": a.allow_unsafe, "archive_less_mature": a.archive_less_mature or None}
    run_ = indexer.queue_to_catalogue(queue.stream(spark, a.queue, "seq long, body string"), store, a.checkpoint, limit=a.limit or None, apply=options, **decisions)
    run_.awaitTermination()
    print(store.read().filter("archived_time IS NULL").count())
    return 0


@command("add or update the tiles of a global raster", "catalogue", product="dem_30", url="{tile}.tif", step=1, pixels=3600, band="elevation", start="1900-01-01", end="2100-01-01", box=None, limit=0, **INDEXING)
def index_tiles(spark: SparkSession, a: argparse.Namespace) -> int:
    made = items.tile_items(geo.tiles(spark, _box(a), a.step, a.limit or None), a.product, a.url, a.step, a.pixels, a.band, a.start, a.end)
    return _index(spark, a, made.select("uri", F.col("item").alias("content")), always_items=True)


@command("tiles that cover a box left,bottom,right,top or ranges of columns and rows", box=None, step=1, limit=0, url=None, range="")
def tiles(spark: SparkSession, a: argparse.Namespace) -> None:
    (x0, x1), (y0, y1) = text.range_2d_option(a.range) if a.range else ((0, 0), (0, 0))
    found = geo.tiles(spark, (x0, y0, x1, y1) if a.range else _box(a), a.step, a.limit or None)
    show(items.tile_items(found, "tiles", a.url, a.step).select("tile", "uri") if a.url else found.select("tile"))


@command("archive by id (a file of ids)", "ids", "catalogue")
def archive(spark: SparkSession, a: argparse.Namespace) -> None:
    print(Store(spark, a.catalogue).archive(docs.lines(spark, a.ids, skip_empty=True).withColumnRenamed("value", "id")))


@command("move messages of a queue folder to another", "dead", "live", "order", limit=0, dry_run=False)
def redrive(spark: SparkSession, a: argparse.Namespace) -> None:
    print(queue.redrive_folders(spark, a.dead, a.live, a.order, a.limit or None, a.dry_run))


def _definitions(spark: SparkSession, folder: str) -> DataFrame:
    return docs.parsed(docs.whole(spark, folder)).select(F.regexp_extract("uri", "([^/]*)$", 1).alias("definition"), F.get_json_object("doc", "$.name").alias("product"), "doc")


@command("compare a product list (CSV) with definitions (YAML folder)", "csv", "folder", "catalogue", update_if_exists=False)
def sync_products(spark: SparkSession, a: argparse.Namespace) -> int:
    listed = spark.read.option("header", True).csv(a.csv).select(F.col("product").alias("names"), F.regexp_extract("definition", "([^/]*)$", 1).alias("definition"))
    store, found = Store(spark, a.catalogue), _definitions(spark, a.folder)
    known = store.products().select("product").unionByName(store.read().select("product"))
    got = catalogue.product_sync(listed, found, known, a.update_if_exists)
    show(got)
    store.register(got.filter("status = 'added'").select("product"), found)
    return int(got.filter("status = 'failed'").limit(1).count() > 0)


@command("a new catalogue with the products of a folder of definitions", "catalogue", "folder")
def bootstrap(spark: SparkSession, a: argparse.Namespace) -> int:
    store, found = Store(spark, a.catalogue), _definitions(spark, a.folder)
    number, manifest = store.head()
    if number == 0:
        store.commit(0, manifest, store.read(manifest), set())
    counts = store.register(found.filter("product IS NOT NULL").select("product"), found)
    print(json.dumps(counts))
    return int(counts.get("unknown", 0) > 0)


@command("live datasets of a product as documents, a YAML file each", "catalogue", "out", product=None, limit=0, bands=None, grids=None, shared_grids=False)
def export_(spark: SparkSession, a: argparse.Namespace) -> int:
    live = catalogue.search(Store(spark, a.catalogue).read(), a.product, limit=a.limit or None)
    datasets = export.from_catalogue(live, F.current_timestamp())
    every = F.array_distinct(F.flatten(F.collect_list(F.map_keys("measurements")))) if not a.bands else F.first(F.array(*[F.lit(b) for b in a.bands.split(",")]))
    bands = datasets.groupBy("product").agg(every.alias("bands"))
    got = export.write(export.documents(datasets, bands, text.yaml_setting(a.grids) if a.grids else None, a.shared_grids), a.out)
    done = {r[0]: r[1] for r in got.groupBy("written").count().collect()}
    print(done.get(True, 0))
    return int(bool(done.get(False)))


@command("extents by product", "catalogue")
def summary(spark: SparkSession, a: argparse.Namespace) -> None:
    show(catalogue.summaries(Store(spark, a.catalogue).read()))


COMMANDS["export"] = COMMANDS.pop("export-")


def run(spark: SparkSession, argv: list[str]) -> int:
    a = parser().parse_args(argv)
    return COMMANDS[a.command][0](spark, a) or 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("gridsmith").config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1:]))
