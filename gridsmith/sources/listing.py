"""Object listings: finding, walking and listing objects over a table of (url, size, last_modified, etag)."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.functions import globs
from gridsmith.sources import files

OBJECTS = "url string, size long, last_modified timestamp, etag string"


def objects(df: DataFrame, bucket: Column, key: Column, size: Column, last_modified: Column, etag: Column, *columns: str) -> DataFrame:
    """Listing records of raw entries; quotation marks around the tag fall away. Missing parts are null."""
    return df.select(F.concat(F.lit("s3://"), bucket, F.lit("/"), key).alias("url"), size.alias("size"), last_modified.alias("last_modified"), F.trim(etag, F.lit('"')).alias("etag"), *columns)


def volume(listing: DataFrame) -> DataFrame:
    """(n, n_bytes, gib) of a listing."""
    total = F.sum(F.col("size").cast("bigint"))
    return listing.agg(F.count("*").alias("n"), total.alias("n_bytes"), (total / 1073741824.0).alias("gib"))


def scan(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """A listing of files on any file system, by tasks that list a folder each; contents are not read."""
    from gridsmith.sources import datasource

    datasource.register(spark)
    root = path if ":" in path.split("/", 1)[0] else f"file:{path}"
    return spark.read.format("object_listing").option("path", root).option("pattern", pattern).option("recursive", str(recursive).lower()).load()


def find(listing: DataFrame, query: str) -> DataFrame:
    """Objects of a URL query (see ``globs.parse_query``); directories for a query of fixed depth that ends in a slash."""
    q = globs.parse_query(query)
    if q.depth is not None and q.depth >= 0 and q.file is None and q.glob is None:
        return dirs(listing, q)
    return listing.filter(globs.predicate(F.col("url"), q))


def dirs(listing: DataFrame, q: globs.Query) -> DataFrame:
    """(url): distinct directories exactly ``q.depth`` levels below the base; depth 0 gives the base itself."""
    spark = listing.sparkSession
    depth = q.depth or 0
    if depth == 0:
        return spark.createDataFrame([(q.base,)], "url string")
    url = F.col("url")
    rel = F.split(F.substr(url, F.lit(len(q.base) + 1)), "/")
    keep = url.startswith(q.base) & (F.size(rel) > depth)
    for i, level in enumerate(q.levels):
        keep = keep & F.get(rel, F.lit(i)).rlike(globs.level_regex(level))
    return listing.filter(keep).select(F.concat(F.lit(q.base), F.array_join(F.slice(rel, 1, depth), "/"), F.lit("/")).alias("url")).distinct()


def dirs_at_depth(listing: DataFrame, base: str, depth: int) -> DataFrame:
    return dirs(listing, globs.Query(base.rstrip("/") + "/", depth, None, None, ("*",) * depth))


def one_level(listing: DataFrame, base: str, keep: Column | None = None) -> DataFrame:
    """(url, is_dir): directories and files directly below ``base``; ``keep`` applies to files only."""
    base = base.rstrip("/") + "/"
    below = listing.filter(F.col("url").startswith(base) & (F.length("url") > len(base)))
    rest = F.substr(F.col("url"), F.lit(len(base) + 1))
    at = F.instr(rest, "/")
    folders = below.filter(at > 0).select(F.concat(F.lit(base), F.substring(rest, F.lit(1), at)).alias("url"), F.lit(True).alias("is_dir")).distinct()
    files = below.filter(at == 0)
    files = (files if keep is None else files.filter(keep)).select("url", F.lit(False).alias("is_dir"))
    return folders.unionByName(files)


def keys(listing: DataFrame, prefix: str) -> DataFrame:
    """Keys below a prefix, without it."""
    return listing.filter(F.col("url").startswith(prefix)).select(F.substr(F.col("url"), F.lit(len(prefix) + 1)).alias("key"))


def matching(listing: DataFrame, keep: Column | None = None, glob: str | None = None) -> DataFrame:
    """Objects for which a predicate and a whole-URL glob hold; without either all objects (a choice of ours)."""
    out = listing if keep is None else listing.filter(keep)
    return out if glob is None else out.filter(F.col("url").rlike(globs.url_regex(glob)))


def matched_counts(listing: DataFrame, keep: Column) -> DataFrame:
    """(n_total, n_matched) of a listing."""
    return listing.agg(F.count("*").alias("n_total"), F.count_if(keep).alias("n_matched"))


def heads(requested: DataFrame, listing: DataFrame) -> DataFrame:
    """Metadata of requested URLs; ``error`` tells which do not exist."""
    got = requested.select("url").join(listing.withColumn("__there", F.lit(True)), "url", "left")
    return got.withColumn("error", F.when(F.col("__there").isNull(), "not found")).drop("__there")


def walk(listing: DataFrame, base: str, guide: Column) -> DataFrame:
    """Guided walk over a flat listing. ``guide`` maps each directory below base (columns dir, depth) to ``dir`` (go on one
    level), ``deep`` (everything below) or ``skip``; any other word is an error."""
    base = base.rstrip("/") + "/"
    parts = F.split(F.substr(F.col("url"), F.lit(len(base) + 1)), "/")
    rows = listing.filter(F.col("url").startswith(base)).withColumn("__p", parts)
    levels = rows.select("url", F.posexplode(F.slice(F.col("__p"), 1, F.greatest(F.size("__p") - 1, F.lit(0)))).alias("depth", "__d"), "__p")
    levels = levels.withColumn("dir", F.concat(F.lit(base), F.array_join(F.slice("__p", F.lit(1), F.col("depth") + 1), "/"), F.lit("/"))).withColumn("__g", guide)
    checked = F.when(F.col("__g").isin("dir", "deep", "skip"), F.col("__g")).otherwise(F.raise_error(F.concat(F.lit("bad guide: "), F.coalesce(F.col("__g"), F.lit("null")))))
    # The shallowest word that is not ``dir`` decides: skip drops the file, deep keeps it.
    verdict = levels.withColumn("__g", checked).groupBy("url").agg(F.min(F.when(F.col("__g") != "dir", F.struct("depth", "__g"))).alias("v"))
    return listing.filter(F.col("url").startswith(base)).join(verdict, "url", "left").filter(F.coalesce(F.col("v.__g") != "skip", F.lit(True))).drop("v")


def blobs(listing: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """Names that start and end as given."""
    return listing.filter(F.col("url").startswith(prefix) & F.col("url").endswith(suffix))


def crawl(listing: DataFrame, skips: Sequence[str], select: Sequence[str]) -> DataFrame:
    """Catalogue entries that match any of ``select`` and none of ``skips`` (regular expressions)."""
    hit = lambda ps: F.lit(False) if not ps else F.col("url").rlike("|".join(f"(?:{p})" for p in ps))
    return listing.filter(hit(list(select)) & ~hit(list(skips)))


CONNECTIONS = 24


def _read(url: str, start: int | None, stop: int | None, attempts: int, pause: float) -> tuple[bytes | None, str | None]:
    """(bytes, error) of one object or byte range; passing failures are tried again, a missing object is not."""
    if (start is None) != (stop is None) or (start is not None and (start < 0 or stop <= start)):
        return None, "bad range"
    for left in range(attempts - 1, -1, -1):
        try:
            with files.open_input(url) as f:
                if start is None:
                    return f.read(), None
                f.seek(start)
                return f.read(stop - start), None
        except FileNotFoundError:
            return None, "not found"
        except Exception as x:  # noqa: BLE001
            error = str(x) or type(x).__name__
            if left:
                time.sleep(pause * 2 ** (attempts - 1 - left))
    return None, error


def fetch(requests: DataFrame, roots: dict[str, str] | None = None, connections: int = CONNECTIONS, attempts: int = 3, pause: float = 0.2) -> DataFrame:
    """(url, start, stop, data, error) of (url[, start, stop]): one row per request, in any order, errors as values, never raised.

    A task keeps ``connections`` reads under way and twice as many requested. ``roots`` maps URL prefixes to mounted folders.
    """
    cols = requests.columns
    narrow = requests.select("url", *[(F.col(c) if c in cols else F.lit(None)).cast("long").alias(c) for c in ("start", "stop")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

        def made(done: set) -> pa.RecordBatch:
            rows = [(*under_way.pop(f), *f.result()) for f in done]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["url", "start", "stop", "data", "error"])

        with ThreadPoolExecutor(connections) as pool:
            under_way: dict = {}
            for batch in batches:
                for request in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    under_way[pool.submit(_read, _local(roots, request[0]), *request[1:], attempts, pause)] = request
                    if len(under_way) >= 2 * connections:
                        yield made(wait(under_way, return_when=FIRST_COMPLETED).done)
            while under_way:
                yield made(wait(under_way, return_when=FIRST_COMPLETED).done)

    return narrow.mapInArrow(run, "url string, start long, stop long, data binary, error string")


def documents(listing: DataFrame, roots: dict[str, str] | None = None, **options: object) -> DataFrame:
    """(uri, content, error): the objects of a listing, fetched; what could not be read has its error and no content."""
    return fetch(listing.select("url"), roots, **options).select(F.col("url").alias("uri"), F.col("data").alias("content"), "error")


def _local(roots: dict[str, str] | None, url: str | None) -> str:
    for prefix, root in (roots or {}).items():
        if url and url.startswith(prefix):
            return root.rstrip("/") + "/" + url[len(prefix) :].lstrip("/")
    return url or ""


def put(objects_: DataFrame, roots: dict[str, str] | None = None) -> DataFrame:
    """(url, written, error): write objects (url, data); each appears whole or not at all, rows without data are not written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in batches:
            rows = []
            for url, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                error = None if data is not None else "no data"
                try:
                    if data is not None:
                        fs, path = files.resolve(_local(roots, url))
                        folder = path.rpartition("/")[0]
                        fs.create_dir(folder, recursive=True)
                        temp = f"{folder}/.{uuid.uuid4().hex}"
                        with fs.open_output_stream(temp, compression=None) as out:
                            out.write(data)
                        fs.move(temp, path)
                except Exception as x:  # noqa: BLE001
                    error = str(x) or type(x).__name__
                rows.append((url, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] is None for r in rows]), pa.array([r[1] for r in rows], pa.string())], names=["url", "written", "error"])

    return objects_.select("url", F.col("data").cast("binary").alias("data")).mapInArrow(run, "url string, written boolean, error string")


def download(requests: DataFrame, folder: str, roots: dict[str, str] | None = None, chunk: int = 10 << 20) -> DataFrame:
    """(url, path, error): copy objects into ``folder`` under the last segment of their key, ``chunk`` bytes at a time.

    Objects of one name overwrite each other, as files of one name do; a copy is renamed when it is complete.
    """
    narrow = requests.select("url", (F.col("name") if "name" in requests.columns else F.regexp_extract("url", "([^/]*)$", 1)).alias("name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, root = files.resolve(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            rows = []
            for url, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                temp, path, error = f"{root}/.{uuid.uuid4().hex}", f"{root}/{name}", None
                try:
                    with files.open_input(_local(roots, url)) as source, fs.open_output_stream(temp, compression=None) as out:
                        while data := source.read(chunk):
                            out.write(data)
                    fs.move(temp, path)
                except Exception as x:  # noqa: BLE001
                    path, error = None, str(x) or type(x).__name__
                rows.append((url, path, error))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["url", "path", "error"])

    return narrow.mapInArrow(run, "url string, path string, error string")


def to_tar(found: DataFrame, out: str, roots: dict[str, str] | None = None, **options: object) -> tuple[DataFrame, DataFrame]:
    """Fetch found objects into tar archives in ``out``, a tar per task: ((path, n), (url, error)).

    Members are named by their URL without its scheme; objects that cannot be fetched are not written but listed. Every object is
    fetched once: what was fetched is written to the shared folder first.
    """
    from gridsmith.session import materialise
    from gridsmith.sources import docs

    got = materialise(fetch(found.select("url"), roots, **options), "fetched")
    members = got.filter("error IS NULL").select(F.regexp_replace("url", "^[A-Za-z][A-Za-z0-9+.-]*://", "").alias("name"), F.col("data").alias("content"))
    return docs.write_tars(members, out), got.filter("error IS NOT NULL").select("url", "error")


def latest_manifest(listing: DataFrame, prefix: str) -> DataFrame:
    """(url): the greatest directory below ``prefix`` whose name ends in ``Z``; empty text if there is none."""
    folders = one_level(listing, prefix).filter(F.col("is_dir") & F.col("url").endswith("Z/"))
    return folders.agg(F.coalesce(F.max("url"), F.lit("")).alias("url"))


MANIFEST_KEYS = ["fileFormat", "fileSchema", "files", "destinationBucket"]


def missing_keys(document: Column, required: Sequence[str] = MANIFEST_KEYS) -> Column:
    """The required members that a JSON document doesn't have (all of them if it is no object)."""
    return F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(F.json_object_keys(document), F.array().cast("array<string>")))


def inventory(spark: SparkSession, manifest: dict, locate, prefix: str = "", suffix: str = "", contains: str = "") -> DataFrame:  # noqa: ANN001
    """All records of an inventory manifest (gzipped CSV parts, all columns text), filtered by key."""
    missing = [k for k in MANIFEST_KEYS if k not in manifest]
    if missing:
        raise ValueError(f"manifest lacks {', '.join(missing)}")
    if manifest["fileFormat"] != "CSV":
        raise ValueError("only CSV inventories")
    schema = ", ".join(f"`{c.strip()}` string" for c in manifest["fileSchema"].split(","))
    df = spark.read.schema(schema).option("escape", '"').csv([locate(f["key"]) for f in manifest["files"]])
    return key_filter(df, "Key", prefix, suffix, contains)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest at ``path``, or the one in the latest dated folder below it if it names a folder."""
    import json

    if not path.endswith(".json"):
        found = scan(spark, path, "manifest.json").select("url")
        latest = found.filter(F.col("url").rlike("Z/manifest.json$")).agg(F.max("url")).first()[0]
        if latest is None:
            raise ValueError(f"no manifest below {path}")
        path = latest
    return json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def key_filter(df: DataFrame, key: str, prefix: str = "", suffix: str = "", contains: str = "", regex: str | None = None, glob: str | None = None) -> DataFrame:
    """Rows by key: prefix (a leading slash falls away), suffix, part, and a regular expression from the start or a glob."""
    if regex and glob:
        raise ValueError("regex and glob exclude each other")
    k = F.col(key)
    p = k.startswith(prefix.lstrip("/")) & k.endswith(suffix) & k.contains(contains)
    if regex:
        p = p & k.rlike(f"^(?:{regex})")
    if glob:
        p = p & k.rlike(globs.url_regex(glob))
    return df.filter(p)


def record_paths(df: DataFrame, key: str, patterns: Sequence[str]) -> DataFrame:
    """Rows whose key matches any right-anchored path pattern."""
    p = F.lit(False)
    for x in patterns:
        p = p | F.col(key).rlike(globs.path_regex(x))
    return df.filter(p)
