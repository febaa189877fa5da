"""A catalogue on disk: immutable bucket files and numbered manifests, with outbox and quarantine beside it.

Datasets lie in ``BUCKETS`` buckets by a hash of their id. A commit writes the buckets it touches and the events it causes under a
name of its own, then creates the next manifest, which names the files of every bucket. Creating a file that must not exist yet
is atomic, so of two writers one gets a conflict; it judges its batch again on what the other wrote. Events count only if
a manifest names them: they appear together with the change that caused them, or not at all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.operators import catalogue
from gridsmith.session import materialise

SCHEMA = "id string, product string, region_code string, center_time timestamp, maturity string, uri string, archived_time timestamp, doc string"
EVENTS = "cause string, n int, id string, action string"
PRODUCTS = "product string, doc string"
BUCKETS = 64
ATTEMPTS = 10


class Conflict(RuntimeError):
    """Another writer has committed first."""


def bucket(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(BUCKETS)).cast("int")


class Store:
    """``root`` may lie on any file system Spark reaches. A reader sees the old or the new state, never a part."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.root}/manifest-*.json"))
        return sorted(int(p.getPath().getName()[9:-5]) for p in found or [])

    def _manifest(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifest-{number:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def head(self) -> tuple[int, dict]:
        """(number, manifest) of the current state."""
        numbers = self._numbers()
        return (numbers[-1], self._manifest(numbers[-1])) if numbers else (0, {"buckets": {}, "batches": {}, "events": None})

    def read(self, manifest: dict | None = None, only: set[int] | None = None) -> DataFrame:
        """All datasets, or those of some buckets."""
        buckets = (manifest or self.head()[1])["buckets"]
        paths = [f"{self.root}/{p}" for b, p in sorted(buckets.items()) if only is None or int(b) in only]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def outbox(self) -> DataFrame:
        """All published events, with the number of the commit that caused them."""
        out = self.spark.createDataFrame([], f"commit_no long, {EVENTS}")
        names = [(n, e) for n in self._numbers() if (e := self._manifest(n)["events"])]
        if not names:
            return out
        rows = self.spark.read.schema(EVENTS).parquet(*[f"{self.root}/{e}" for _, e in names]).withColumn("__dir", F.regexp_extract(F.input_file_name(), "(events-[0-9a-f]+)", 1))
        numbered = self.spark.createDataFrame([(e, n) for n, e in names], "__dir string, commit_no long")
        return rows.join(F.broadcast(numbered), "__dir").select("commit_no", *rows.columns[:-1])

    def commit(self, number: int, manifest: dict, rows: DataFrame, touched: set[int], events: DataFrame | None = None, batch: tuple[str, int] | None = None) -> None:
        """Replace the ``touched`` buckets by ``rows`` on top of manifest ``number``; raises Conflict if there is a newer one."""
        name = uuid.uuid4().hex
        if touched:
            rows.withColumn("bucket", bucket(F.col("id"))).repartition(min(len(touched), BUCKETS), "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data-{name}")
        if events is not None:
            events.select(*[c.split()[0] for c in EVENTS.split(", ")]).write.parquet(f"{self.root}/events-{name}")
        there = lambda b: self._fs.exists(self._path(f"{self.root}/data-{name}/bucket={b}"))
        buckets = {b: p for b, p in manifest["buckets"].items() if int(b) not in touched} | {str(b): f"data-{name}/bucket={b}" for b in touched if there(b)}
        new = {"buckets": buckets, "batches": manifest["batches"] | (dict([batch]) if batch else {}), "events": f"events-{name}" if events is not None else None}
        try:
            out = self._fs.create(self._path(f"{self.root}/manifest-{number + 1:012d}.json"), False)
        except Exception as x:
            if "exist" in str(x):
                raise Conflict(self.root) from None
            raise
        out.write(bytearray(json.dumps(new).encode()))
        out.close()

    def products(self) -> DataFrame:
        """(product, doc) of the registered products."""
        there = self._fs.exists(self._path(f"{self.root}/products"))
        return self.spark.read.schema(PRODUCTS).parquet(f"{self.root}/products") if there else self.spark.createDataFrame([], PRODUCTS)

    def register(self, wanted: DataFrame, definitions: DataFrame) -> dict[str, int]:
        """Register wanted products from their definitions (product, doc); counts of known, registered and unknown ones."""
        judged = materialise(catalogue.register(wanted, definitions, self.products()), "products")
        judged.filter("status = 'registered'").select("product", "doc").coalesce(1).write.mode("append").parquet(f"{self.root}/products")
        return {r[0]: r[1] for r in judged.groupBy("status").count().collect()}

    def quarantine(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/quarantine")

    def _retried(self, change):  # noqa: ANN001, ANN202
        for left in range(ATTEMPTS - 1, -1, -1):
            try:
                return change()
            except Conflict:
                if not left:
                    raise
        return None

    def index(self, incoming: DataFrame, batch: tuple[str, int] | None = None, **options: object) -> dict[str, int]:
        """Judge and apply a batch (columns of SCHEMA and ``seq``); counts by status.

        ``batch`` (stream, number) makes the call repeatable: a batch that is in already changes nothing and counts nothing.
        """
        within = options.get("archive_less_mature")
        # Fetching gives rows in any order: what is judged and what is written must be the same rows.
        incoming = materialise(incoming, "incoming")

        def change() -> dict[str, int]:
            number, manifest = self.head()
            if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
                return {}
            old = self.read(manifest)
            judged = catalogue.statuses(incoming, old, **options).cache()
            try:
                counts = {r["status"]: r["n"] for r in catalogue.counts(judged).collect()}
                if counts.get("added", 0) + counts.get("updated", 0):
                    events = catalogue.events(judged, old, within).cache()
                    ids = judged.filter("status IN ('added', 'updated')").select("id").unionByName(events.filter("n = 0").select("id"))
                    touched = {r[0] for r in ids.select(bucket(F.col("id"))).distinct().collect()}
                    rows = catalogue.apply(judged, self.read(manifest, touched), F.current_timestamp(), within)
                    self.commit(number, manifest, rows, touched, events, batch)
                    events.unpersist()
                elif batch:
                    self.commit(number, manifest, old.limit(0), set(), None, batch)
                if counts.get("failed", 0):
                    self.quarantine(judged.filter("status = 'failed'").select("id", "uri", "reason"))
                return counts
            finally:
                judged.unpersist()

        return self._retried(change)

    def archive(self, ids: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Archive live datasets by id and publish it; the number of those that were live."""

        def change() -> int:
            number, manifest = self.head()
            if batch and manifest["batches"].get(batch[0], -1) >= batch[1]:
                return 0
            live = self.read(manifest).filter("archived_time IS NULL").select("id").join(ids.select("id").distinct(), "id", "left_semi").cache()
            try:
                n = {r[0]: r[1] for r in live.groupBy(bucket(F.col("id"))).count().collect()}
                if n or batch:
                    rows = catalogue.archive(self.read(manifest, set(n)), live, F.current_timestamp())
                    events = live.select(F.col("id").alias("cause"), F.lit(0).alias("n"), "id", F.lit("ARCHIVED").alias("action")) if n else None
                    self.commit(number, manifest, rows, set(n), events, batch)
                return sum(n.values())
            finally:
                live.unpersist()

        return self._retried(change)


def dataset_rows(parsed: DataFrame) -> DataFrame:
    """Catalogue rows of parsed documents (uri, doc): what the documents say of themselves; unreadable ones have no id."""
    v = F.try_parse_json("doc")
    get = lambda p: F.try_variant_get(v, p, "string")
    seq = F.col("seq") if "seq" in parsed.columns else F.monotonically_increasing_id()
    return parsed.select(
        get("$.id").alias("id"), get("$.product.name").alias("product"), get('$.properties["odc:region_code"]').alias("region_code"),
        F.try_to_timestamp(get("$.properties.datetime")).alias("center_time"), get('$.properties["dea:dataset_maturity"]').alias("maturity"),
        F.when(F.col("doc").isNotNull(), F.col("uri")).alias("uri"), F.lit(None).cast("timestamp").alias("archived_time"), F.col("doc").alias("doc"), seq.alias("seq"),
    )
