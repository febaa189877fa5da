"""Queries of fetching, archives, inventories, message intake, indexing and export, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.functions import geo, globs, items
from gridsmith.operators import catalogue, export, intake
from gridsmith.operators.store import Store, dataset_rows
from gridsmith.plans.reference import objects
from gridsmith.plans.registry import query
from gridsmith.session import load, scratch
from gridsmith.sources import archive, docs, item_api, listing, queue

# --- objects: put, list, fetch, download --------------------------------------------------------------------------------

_STORED = "stored AS (SELECT href AS url, arg_max(body, file_no) AS body FROM tiny_file WHERE body IS NOT NULL GROUP BY href)"


def _stored(s: SparkSession, d: str) -> DataFrame:
    """The last body of every listed file."""
    return load(s, d, "tiny_file").filter("body IS NOT NULL").groupBy(F.col("href").alias("url")).agg(F.max_by("body", "file_no").alias("data"))


def _bucket(s: SparkSession, d: str) -> dict[str, str]:
    """Those files as objects of a mounted bucket; the mapping of URL prefixes to its folder."""
    roots = {"s3://": scratch(s, "bucket")}
    listing.put(_stored(s, d), roots).agg(F.count_if("written")).first()
    return roots


def _listed(s: SparkSession, roots: dict[str, str]) -> DataFrame:
    """The mounted bucket's listing, under the objects' own URLs."""
    folder = roots["s3://"]
    found = listing.scan(s, folder)
    return found.withColumn("url", F.concat(F.lit("s3://"), F.regexp_replace("url", r"^.*?/" + folder.rsplit("/", 1)[1] + "/", "")))


@query(f"WITH {_STORED} SELECT url, CAST(octet_length(encode(body)) AS bigint) AS size FROM stored")
def put_objects(s: SparkSession, d: str) -> DataFrame:
    """Objects written one by one and listed again."""
    return _listed(s, _bucket(s, d)).select("url", "size")


@query(f"""WITH {_STORED}, asked AS (SELECT DISTINCT href AS url FROM tiny_file UNION ALL SELECT DISTINCT href || '.none' FROM tiny_file WHERE file_no % 7 = 0)
    SELECT a.url, md5(body) AS digest, CASE WHEN s.url IS NULL THEN 'not found' END AS error FROM asked a LEFT JOIN stored s ON s.url = a.url""")
def fetch_objects(s: SparkSession, d: str) -> DataFrame:
    """Whole objects, with those that are not there as errors."""
    f = load(s, d, "tiny_file")
    asked = f.select(F.col("href").alias("url")).distinct().unionByName(f.filter("file_no % 7 = 0").select(F.concat("href", F.lit(".none")).alias("url")).distinct())
    return listing.fetch(asked, _bucket(s, d)).select("url", F.md5("data").alias("digest"), "error")


@query(f"""WITH {_STORED} SELECT url, CASE WHEN octet_length(encode(body)) > 60 THEN md5(substr(body, 11, 50)) END AS digest, CASE WHEN octet_length(encode(body)) <= 60 THEN 'bad range' END AS error FROM stored
    WHERE octet_length(encode(body)) = length(body)""")
def fetch_ranges(s: SparkSession, d: str) -> DataFrame:
    """A byte range of each object of one-byte characters; objects too short for it are asked for an empty range."""
    short = F.octet_length("data") <= 60
    asked = _stored(s, d).filter(F.octet_length("data") == F.length("data")).select("url", F.lit(10).alias("start"), F.when(short, 10).otherwise(60).alias("stop"))
    return listing.fetch(asked, _bucket(s, d)).select("url", F.md5("data").alias("digest"), "error")


@query(f"""WITH {_STORED}, named AS (SELECT *, regexp_extract(url, '([^/]*)$', 1) AS name FROM stored), single AS (SELECT * FROM named WHERE name IN (SELECT name FROM named GROUP BY name HAVING count(*) = 1))
    SELECT name, md5(body) AS digest FROM single""")
def download_objects(s: SparkSession, d: str) -> DataFrame:
    """Objects copied to a folder under their last segment (of names that are no other object's)."""
    roots, out = _bucket(s, d), scratch(s, "download")
    named = _listed(s, roots).select("url", F.regexp_extract("url", "([^/]*)$", 1).alias("name"))
    single = named.join(named.groupBy("name").count().filter("count = 1"), "name", "left_semi")
    listing.download(single, out, roots, chunk=1000).agg(F.count("path")).first()
    return listing.documents(listing.scan(s, out)).select(F.regexp_extract("uri", "([^/]*)$", 1).alias("name"), F.md5("content").alias("digest"))


@query(f"WITH {_STORED} SELECT url AS path, CAST(octet_length(encode(body)) AS bigint) AS n_bytes, md5(body) AS digest FROM stored")
def pack_objects(s: SparkSession, d: str) -> DataFrame:
    """Objects of a bucket, fetched and packed into containers, then taken out again."""
    roots = _bucket(s, d)
    rows = archive.pack(listing.documents(_listed(s, roots), roots), scratch(s, "archive"), None, "uri", "content", 1 << 18)
    return archive.unpack(rows).select("path", F.length("body").cast("bigint").alias("n_bytes"), F.md5("body").alias("digest"))


@query("SELECT substr(href, 15) AS key FROM tiny_file WHERE href LIKE 's3://tn-lists/%'")
def list_keys(s: SparkSession, d: str) -> DataFrame:
    """Keys below a prefix, without it."""
    return listing.keys(objects(s, d), "s3://tn-lists/")


@query(r"SELECT file_no FROM tiny_file WHERE n_bytes > 500 AND regexp_full_match(href, '.*part-0000[0-3]-[^!]*\.json')")
def match_listing(s: SparkSession, d: str) -> DataFrame:
    """A predicate and a whole-URL glob together."""
    return listing.matching(objects(s, d), F.col("size") > 500, "*part-0000[0-3]-*.json").select("file_no")


@query("SELECT product, CASE WHEN count(*) = 1 AND bool_and(contains(href, '5')) THEN 'query' ELSE 'list' END AS way FROM (SELECT DISTINCT product, href FROM dataset_record WHERE href LIKE '%://%' AND product IS NOT NULL AND gsd = 60 AND cloud_cover < 3) GROUP BY product")
def query_or_list(s: SparkSession, d: str) -> DataFrame:
    """Whether the addresses given for each product are one query or a list of objects."""
    r = load(s, d, "dataset_record").filter("href LIKE '%://%' AND product IS NOT NULL AND gsd = 60 AND cloud_cover < 3").select("product", F.replace("href", F.lit("5"), F.lit("*")).alias("href"))
    g = r.groupBy("product").agg(F.array_sort(F.collect_set("href")).alias("uris"))
    return g.select("product", F.when(globs.is_query("uris"), "query").otherwise("list").alias("way"))


# --- archives -----------------------------------------------------------------------------------------------------------


def _tarred(s: SparkSession, found: DataFrame, roots: dict[str, str]) -> DataFrame:
    out = scratch(s, "tars")
    made, failed = listing.to_tar(found, out, roots)
    made.agg(F.sum("n")).first()
    members = docs.tar_members(s, f"{out}/*.tar.gz").select("name", F.md5("content").alias("digest"))
    return members.unionByName(failed.select(F.col("url").alias("name"), F.col("error").alias("digest")))


@query(f"""WITH {_STORED} SELECT substr(url, 6) AS name, md5(body) AS digest FROM stored WHERE regexp_full_match(url, 's3://tn-lists/.*part-0000[0-2]-.*\\.json') UNION ALL SELECT 's3://tn-lists/none.json', 'not found'""")
def bucket_to_tar(s: SparkSession, d: str) -> DataFrame:
    """Objects that a query finds, fetched into archives; one that is gone by then is listed as a failure."""
    roots = _bucket(s, d)
    found = listing.find(_listed(s, roots), "s3://tn-lists/**/*part-0000[0-2]-*.json").select("url")
    return _tarred(s, found.unionByName(s.createDataFrame([("s3://tn-lists/none.json",)], "url string")), roots)


@query(f"WITH {_STORED} SELECT substr(url, 6) AS name, md5(body) AS digest FROM stored WHERE url LIKE 's3://tn-lists/vd%' AND url LIKE '%5.json'")
def blobs_to_tar(s: SparkSession, d: str) -> DataFrame:
    """Blobs by prefix and suffix, into archives."""
    roots = _bucket(s, d)
    return _tarred(s, listing.blobs(_listed(s, roots), "s3://tn-lists/vd", "5.json"), roots)


@query(f"WITH {_STORED} SELECT substr(url, 6) AS name, md5(body) AS digest FROM stored WHERE regexp_matches(url, 'part-') AND NOT regexp_matches(url, '_gm_|day=2015')")
def crawl_to_tar(s: SparkSession, d: str) -> DataFrame:
    """A crawled catalogue's entries, into archives."""
    roots = _bucket(s, d)
    return _tarred(s, listing.crawl(_listed(s, roots), ["_gm_", "day=2015"], ["part-"]), roots)


@query("SELECT * FROM (VALUES (false, false, false, ''), (false, false, true, '|'), (false, true, false, ':xz'), (false, true, true, ':xz'), (true, false, false, ':gz'), (true, false, true, ':gz'), (true, true, false, ':gz'), (true, true, true, ':gz')) v(gzip, xz, pipe, mode)")
def tar_modes(s: SparkSession, d: str) -> DataFrame:
    every = [(g, x, p, docs.tar_mode(g, x, p)) for g in (False, True) for x in (False, True) for p in (False, True)]
    return s.createDataFrame(every, "gzip boolean, xz boolean, pipe boolean, mode string")


@query("SELECT href AS name, CAST(count(*) AS bigint) AS n FROM tiny_file WHERE body IS NOT NULL AND octet_length(encode(body)) > 400 AND href NOT LIKE '%_gm_%' GROUP BY href")
def tar_predicate(s: SparkSession, d: str) -> DataFrame:
    """Members of archives chosen by what their entries say."""
    out = scratch(s, "tars")
    f = load(s, d, "tiny_file").select(F.col("href").alias("name"), F.col("body").alias("content"))
    docs.write_tars(f.filter("content IS NOT NULL"), out, gzip=False).agg(F.sum("n")).first()
    return docs.tar_members(s, f"{out}/*.tar", lambda m: m.size > 400 and "_gm_" not in m.name).groupBy("name").agg(F.count("*").alias("n"))


# --- inventories --------------------------------------------------------------------------------------------------------


def _manifest(s: SparkSession, d: str) -> str:
    """An inventory of the listed files: gzipped CSV parts and a manifest in a dated folder; the folder above."""
    root = scratch(s, "inventory")
    rows = objects(s, d).select(F.lit("tn-lists").alias("Bucket"), F.regexp_replace("url", "^s3://[^/]*/", "").alias("Key"), F.col("size").cast("string").alias("Size"), F.col("etag").alias("ETag"))
    rows.write.option("compression", "gzip").option("quoteAll", True).option("escape", '"').csv(f"{root}/data")
    parts = listing.scan(s, f"{root}/data", "*.csv.gz").select(F.regexp_extract("url", "([^/]*)$", 1)).collect()
    for stamp, files in (("2020-01-01T00-00Z", []), ("2021-05-02T00-00Z", [{"key": f"data/{r[0]}"} for r in parts])):
        text = json.dumps({"fileFormat": "CSV", "fileSchema": "Bucket, Key, Size, ETag", "files": files, "destinationBucket": "arn:inv"})
        listing.put(s.createDataFrame([(f"{root}/{stamp}/manifest.json", text)], "url string, data string")).collect()
    return root


@query(r"SELECT regexp_replace(href, '^s3://[^/]*/', '') AS key, CAST(n_bytes AS bigint) AS size FROM tiny_file WHERE regexp_replace(href, '^s3://[^/]*/', '') LIKE 'vd%' AND href LIKE '%.json' AND href LIKE '%day=20%'")
def inventory_manifest(s: SparkSession, d: str) -> DataFrame:
    """The latest manifest below a folder and all its gzipped parts, filtered by prefix, suffix and part of the key."""
    root = _manifest(s, d)
    found = listing.inventory(s, listing.read_manifest(s, root), lambda k: f"{root}/{k}", "vd", ".json", "day=20")
    return found.select(F.col("Key").alias("key"), F.col("Size").cast("bigint").alias("size"))


@query("""SELECT doc_no, array_to_string(list_filter(['crs', 'grids', 'id', 'measurements', 'product'], lambda k: NOT list_contains(coalesce(CASE WHEN json_type(try_cast(doc AS json)) = 'OBJECT' THEN json_keys(try_cast(doc AS json)) END, []), k)), ',') AS missing FROM odc_document
    WHERE try_cast(doc AS json) IS NOT NULL OR doc IS NULL""")
def required_keys(s: SparkSession, d: str) -> DataFrame:
    """The required members that each readable document lacks."""
    r = load(s, d, "odc_document").filter(F.col("doc").isNull() | F.try_parse_json("doc").isNotNull())
    return r.select("doc_no", F.array_join(F.array_sort(listing.missing_keys(F.col("doc"), ["crs", "grids", "id", "measurements", "product"])), ",").alias("missing"))


# --- documents ----------------------------------------------------------------------------------------------------------

_TEXTS = "texts AS (SELECT doc_no, doc, try_cast(doc AS json) AS j FROM odc_document WHERE doc IS NOT NULL)"


def _folder(s: SparkSession, d: str) -> tuple[str, dict[str, str]]:
    """The documents as files of a mounted bucket, named by number."""
    roots = {"doc://": scratch(s, "documents")}
    rows = load(s, d, "odc_document").filter("doc IS NOT NULL").select(F.concat(F.lit("doc://store/"), F.col("doc_no") % 9, F.lit("/"), "doc_no", F.lit(".json")).alias("url"), F.col("doc").alias("data"))
    listing.put(rows, roots).agg(F.count_if("written")).first()
    return roots["doc://"], roots


@query(f"WITH {_TEXTS} SELECT doc_no, CASE WHEN json_type(j) = 'OBJECT' THEN j->>'$.id' END AS id, CASE WHEN j IS NULL THEN 'unreadable document' END AS error FROM texts WHERE (j IS NULL) = (json_valid(ltrim(doc, chr(65279))) = false)")
def fetch_documents(s: SparkSession, d: str) -> DataFrame:
    """Addresses to parsed documents: fetched, then read as their suffix says (texts whose readings by both engines agree)."""
    _, roots = _folder(s, d)
    asked = load(s, d, "odc_document").filter("doc IS NOT NULL AND NOT startswith(doc, '﻿')").select(F.concat(F.lit("doc://store/"), F.col("doc_no") % 9, F.lit("/"), "doc_no", F.lit(".json")).alias("url"))
    got = docs.parsed(listing.documents(asked, roots))
    return got.select(F.regexp_extract("uri", r"/(\d+)\.json$", 1).cast("bigint").alias("doc_no"), F.get_json_object("doc", "$.id").alias("id"), "error")


@query(f"WITH {_TEXTS} SELECT count(*) AS n, CAST(sum(octet_length(encode(doc))) AS bigint) AS n_bytes FROM texts WHERE doc_no % 9 = 3")
def folder_scan(s: SparkSession, d: str) -> DataFrame:
    """Whole files below a folder, by a pattern of their names."""
    folder, _ = _folder(s, d)
    found = docs.whole(s, f"{folder}/store/3", pattern="*.json")
    return found.agg(F.count("*").alias("n"), F.sum(F.octet_length("content").cast("bigint")).alias("n_bytes"))


@query(r"SELECT trim(replace(payload, chr(10), ' ')) AS line, count(*) AS n FROM metadata_line WHERE trim(replace(payload, chr(10), ' ')) <> '' GROUP BY 1")
def read_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines of text files, stripped, without empty ones."""
    path = scratch(s, "lines")
    load(s, d, "metadata_line").select(F.concat(F.lit("  "), F.regexp_replace(F.coalesce("payload", F.lit("")), "[\n\r]", " "), F.lit("  \n")).alias("value")).write.text(path)
    return docs.lines(s, path, skip_empty=True).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("SELECT record_no, coalesce(try_cast(CASE WHEN regexp_full_match(trim(region_code), '[+-]?[0-9]+') THEN trim(region_code) END AS int), -1) AS n FROM dataset_record")
def read_int(s: SparkSession, d: str) -> DataFrame:
    """Whole numbers from texts, with a default."""
    from gridsmith.functions import text

    return load(s, d, "dataset_record").select("record_no", text.to_int(F.col("region_code"), -1).alias("n"))


_YAML = "concat('name: ', product_name, chr(10), 'description: >', chr(10), '  made by', chr(10), '  ', producer_name, chr(10), 'storage: {gsd: ', CAST(gsd AS string), ', tags: [a, \"b\"]}', chr(10), '---', chr(10), 'name: ', product_name, '_summary', chr(10))"


@query("""SELECT product_name || '.yaml' AS uri, product_name AS name, 'made by ' || producer_name || chr(10) AS description, gsd, 'b' AS tag FROM product
    UNION ALL SELECT product_name || '.yaml', product_name || '_summary', NULL, NULL, NULL FROM product UNION ALL SELECT 'bad.yaml', NULL, NULL, NULL, NULL""")
def yaml_products(s: SparkSession, d: str) -> DataFrame:
    """Product definitions: all YAML documents of each file, unreadable files as errors."""
    y = load(s, d, "product").select(F.concat("product_name", F.lit(".yaml")).alias("uri"), F.expr(_YAML).alias("content")).unionByName(s.createDataFrame([("bad.yaml", "a: [")], "uri string, content string"))
    g = lambda p: F.get_json_object("doc", p)
    return docs.parsed(y).select("uri", g("$.name").alias("name"), g("$.description").alias("description"), g("$.storage.gsd").cast("double").alias("gsd"), g("$.storage.tags[1]").alias("tag"))


@query("SELECT product_name, product_name AS a, CAST(gsd AS double) AS b FROM product")
def yaml_inline(s: SparkSession, d: str) -> DataFrame:
    """Settings given as inline YAML."""
    from gridsmith.functions import text

    y = load(s, d, "product").select("product_name", text.yaml_json(F.concat(F.lit("{a: "), "product_name", F.lit(", b: "), F.col("gsd").cast("string"), F.lit("}")))[0].alias("y"))
    return y.select("product_name", F.get_json_object("y", "$.a").alias("a"), F.get_json_object("y", "$.b").cast("double").alias("b"))


# --- item API -----------------------------------------------------------------------------------------------------------


def _api(s: SparkSession, d: str) -> tuple[str, dict[str, str]]:
    """The messages' items as pages of an item API, a chain of pages per collection; (address, mapping)."""
    roots = {"api://": scratch(s, "api")}
    m = load(s, d, "sqs_message").select("delivery_id", "message", F.get_json_object("message", "$.collection").alias("c")).filter("c IS NOT NULL")
    item_api.write_pages(m.select(F.col("c").alias("collection"), F.col("delivery_id").alias("seq"), F.trim("message").alias("item")), "api://items", roots, page=100)
    return "api://items", roots


_FEATURES = "features AS (SELECT delivery_id, try_cast(message AS json)->>'$.id' AS id, try_cast(message AS json)->>'$.collection' AS collection, try_cast(message AS json)->>'$.properties.datetime' AS taken FROM sqs_message WHERE try_cast(message AS json)->>'$.collection' IS NOT NULL)"


@query(f"WITH {_FEATURES} SELECT collection, count(*) AS n, count(DISTINCT id) AS n_ids FROM features WHERE collection LIKE 'vd%' AND taken >= '2016' AND taken < '2019' GROUP BY 1")
def item_api_search(s: SparkSession, d: str) -> DataFrame:
    """Items of some collections and years, page after page."""
    at, roots = _api(s, d)
    names = [r[0] for r in load(s, d, "product").filter("product_name LIKE 'vd%'").select("product_name").collect()]
    found = item_api.search(s, at, names, datetime="2016/2019", roots=roots)
    return found.groupBy("collection").agg(F.count("*").alias("n"), F.count_distinct(F.get_json_object("item", "$.id")).alias("n_ids"))


@query(f"WITH {_FEATURES} SELECT collection, id FROM (SELECT *, row_number() OVER (ORDER BY collection, delivery_id) AS k FROM features WHERE collection LIKE 'tn%') WHERE k <= 25")
def item_api_limit(s: SparkSession, d: str) -> DataFrame:
    """At most 25 items, in the order of the pages."""
    at, roots = _api(s, d)
    names = [r[0] for r in load(s, d, "product").filter("product_name LIKE 'tn%'").select("product_name").collect()]
    return item_api.search(s, at, names, max_items=25, roots=roots).select("collection", F.get_json_object("item", "$.id").alias("id"))


@query(f"""WITH {_FEATURES}, f AS (SELECT * FROM features WHERE collection LIKE 'kx%')
    SELECT 'renamed' AS product, (SELECT count(DISTINCT id) FROM f) AS added, (SELECT count(id) - count(DISTINCT id) FROM f) AS skipped, (SELECT count(*) FROM f WHERE id IS NULL) AS failed""")
def item_api_index(s: SparkSession, d: str) -> DataFrame:
    """Items of an API as datasets of a renamed product in a new catalogue."""
    at, roots = _api(s, d)
    names = [r[0] for r in load(s, d, "product").filter("product_name LIKE 'kx%'").select("product_name").collect()]
    store = Store(s, scratch(s, "catalogue"))
    counts = item_api.index(store, item_api.search(s, at, names, roots=roots), rename_product="renamed")
    one = store.read().select("product").distinct()
    return one.select("product", *[F.lit(counts.get(k, 0)).cast("bigint").alias(k) for k in ("added", "skipped", "failed")])


# --- messages to the catalogue ------------------------------------------------------------------------------------------


def _envelopes(s: SparkSession, d: str, links: bool = True) -> DataFrame:
    """(seq, body, key): the messages as bodies, items with a link to themselves for nine in ten."""
    m = load(s, d, "sqs_message")
    attributes = F.transform_values("message_attributes", lambda _, v: F.struct(v["attr_type"].alias("Type"), F.upper(F.trim(v["attr_value"])).alias("Value")))
    own = F.concat(F.lit(',"links":[{"rel":"self","href":"s3://x/0.json"},{"rel":"odc_yaml","href":"s3://y/'), "delivery_id", F.lit('.yaml"},{"rel":"self","href":"s3://x/'), "delivery_id", F.lit('.json"}]}'))
    text = F.regexp_replace("message", r"\s+$", "")
    with_links = F.when(F.try_parse_json("message").isNotNull() & F.get_json_object("message", "$.id").isNotNull() & (F.col("delivery_id") % 10 > 0), F.concat(F.substr(text, F.lit(1), F.length(text) - 1), own)).otherwise(F.col("message"))
    body = F.to_json(F.struct(F.col("message_id").alias("MessageId"), (with_links if links else F.col("message")).alias("Message"), attributes.alias("MessageAttributes")))
    return m.select(F.col("delivery_id").alias("seq"), body.alias("body"))


_UUID_RE = "^(?:[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12})$"
_DECIDED = f"""said AS (
    SELECT delivery_id AS seq, CASE WHEN json_type(try_cast(message AS json)) = 'OBJECT' THEN try_cast(message AS json) END AS j, upper(trim(message_attributes['action'].attr_value)) AS action FROM sqs_message
), known AS (
    SELECT *, j->>'$.id' AS id, j->>'$.properties."odc:region_code"' AS region, regexp_matches(lower(j->>'$.id'), '{_UUID_RE}') AS is_uuid FROM said
), decided AS (
    SELECT seq, CASE WHEN j IS NULL OR json_keys(j) = [] THEN 'fail' WHEN action = 'ARCHIVED' THEN CASE WHEN is_uuid THEN 'archive' ELSE 'fail' END
        WHEN id IS NULL OR seq % 10 = 0 THEN 'skip' ELSE 'index' END AS verdict, id, region, is_uuid FROM known)"""


@query(f"WITH {_DECIDED} SELECT seq, verdict, CASE WHEN verdict = 'archive' THEN lower(id) WHEN verdict = 'index' THEN id END AS id, CASE WHEN verdict = 'index' THEN 's3://x/' || seq || '.json' END AS uri FROM decided")
def queue_decisions(s: SparkSession, d: str) -> DataFrame:
    """What each message asks for; of several links to itself an item's last one is its address."""
    return intake.decide(_envelopes(s, d)).select("seq", "verdict", "id", "uri")


@query(f"""WITH {_DECIDED}, allowed AS (SELECT DISTINCT region_code FROM dataset_record WHERE maturity = 'final' AND region_code IS NOT NULL)
    SELECT CASE WHEN verdict IN ('index', 'skip') AND (region IS NULL OR region NOT IN (SELECT region_code FROM allowed)) THEN 'skip' ELSE verdict END AS verdict, count(*) AS n FROM decided GROUP BY 1""")
def queue_regions(s: SparkSession, d: str) -> DataFrame:
    """Messages of allowed regions only; the others leave the queue unindexed."""
    allowed = load(s, d, "dataset_record").filter("maturity = 'final'").select("region_code")
    return intake.decide(_envelopes(s, d), regions=allowed).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {_DECIDED}, i AS (SELECT * FROM decided WHERE verdict = 'index')
    SELECT * FROM (VALUES ('success', (SELECT count(*) FROM decided WHERE verdict = 'archive') + (SELECT count(DISTINCT id) FROM i)), ('failed', (SELECT count(*) FROM decided WHERE verdict = 'fail')),
        ('skipped', (SELECT count(*) FROM decided WHERE verdict = 'skip') + (SELECT count(*) - count(DISTINCT id) FROM i))) v(outcome, n)""")
def queue_index(s: SparkSession, d: str) -> DataFrame:
    """All messages carried out on a new catalogue: counts of success, failure and skipping."""
    decided = intake.decide(_envelopes(s, d))
    counts = intake.run(decided, Store(s, scratch(s, "catalogue")))
    return s.createDataFrame(list(counts.items()), "outcome string, n long")


@query(f"""WITH {_DECIDED}, there AS (SELECT DISTINCT id FROM decided WHERE verdict = 'index'), gone AS (SELECT DISTINCT lower(id) AS id FROM decided WHERE verdict = 'archive')
    SELECT action, id FROM (SELECT 'ADDED' AS action, id FROM there UNION ALL SELECT 'ARCHIVED', id FROM there WHERE id IN (SELECT id FROM gone))""")
def queue_events(s: SparkSession, d: str) -> DataFrame:
    """What is published: additions, then the archiving of those that were live."""
    decided, store = intake.decide(_envelopes(s, d)), Store(s, scratch(s, "catalogue"))
    store.index(dataset_rows(decided.filter("verdict = 'index'").select("uri", "doc", "seq")))
    store.archive(decided.filter("verdict = 'archive'").select("id"))
    return store.outbox().select("action", "id")


@query(f"""WITH {_DECIDED}, there AS (SELECT DISTINCT id FROM decided WHERE verdict = 'index'), gone AS (SELECT DISTINCT lower(id) AS id FROM decided WHERE verdict = 'archive')
    SELECT id, id IN (SELECT id FROM gone) AS archived FROM there""")
def queue_archive(s: SparkSession, d: str) -> DataFrame:
    """The catalogue after indexing and archiving messages."""
    decided, store = intake.decide(_envelopes(s, d)), Store(s, scratch(s, "catalogue"))
    store.index(dataset_rows(decided.filter("verdict = 'index'").select("uri", "doc", "seq")))
    store.archive(decided.filter("verdict = 'archive'").select("id"))
    return store.read().select("id", F.col("archived_time").isNotNull().alias("archived"))


@query(f"""WITH {_DECIDED} SELECT seq, CASE WHEN verdict IN ('skip', 'index') THEN CASE WHEN id IS NULL OR seq % 10 = 0 THEN 'link not found' ELSE 'link not readable' END
        WHEN verdict = 'fail' THEN CASE WHEN (SELECT count(*) FROM known k WHERE k.seq = decided.seq AND (k.j IS NULL OR json_keys(k.j) = [])) > 0 THEN 'unreadable message' ELSE 'no id to archive' END END AS reason FROM decided""")
def queue_links(s: SparkSession, d: str) -> DataFrame:
    """Items that name their dataset document by a link; here none of the documents is there."""
    got = intake.decide(_envelopes(s, d), metadata_link="STAC-LINKS-REL:odc_yaml", roots={"s3://": scratch(s, "empty")})
    return got.select("seq", "reason")


@query(f"""WITH {_DECIDED}, come AS (SELECT id, min(seq) AS first FROM decided WHERE verdict = 'index' GROUP BY id), gone AS (SELECT lower(id) AS id, max(seq) AS last FROM decided WHERE verdict = 'archive' GROUP BY 1)
    SELECT id, coalesce(last > first, false) AS archived FROM come LEFT JOIN gone USING (id)""")
def queue_stream(s: SparkSession, d: str) -> DataFrame:
    """The queue as a stream into a catalogue until it is empty: as if message after message had been carried out."""
    from gridsmith.streaming import indexer

    at = scratch(s, "queue")
    _envelopes(s, d).write.parquet(f"{at}/messages")
    store = Store(s, scratch(s, "catalogue"))
    indexer.queue_to_catalogue(queue.stream(s, f"{at}/messages", "seq long, body string"), store, f"{at}/checkpoint").awaitTermination()
    return store.read().select("id", F.col("archived_time").isNotNull().alias("archived"))


def _notifications(s: SparkSession, d: str) -> tuple[DataFrame, dict[str, str]]:
    """(seq, body): a bucket notification for each document, some of an older form, without a key or of another path."""
    _, roots = _folder(s, d)
    key = F.concat(F.lit("store/"), F.col("doc_no") % 9, F.lit("/"), "doc_no", F.lit(".json"))
    record = lambda k: F.struct(F.struct(F.struct(F.lit("docs").alias("name")).alias("bucket"), F.struct(k.alias("key")).alias("object")).alias("s3"))
    two = F.array(record(F.concat(F.lit("store/0/x"), key)), record(F.when(F.col("doc_no") % 11 != 0, key)))
    message = F.when(F.col("doc_no") % 13 == 0, F.lit('{"Event": "test"}')).otherwise(F.to_json(F.struct(two.alias("Records"))))
    rows = load(s, d, "odc_document").select(F.col("doc_no").alias("seq"), F.to_json(F.struct(message.alias("Message"))).alias("body"))
    return rows, {"s3://docs/": roots["doc://"]}


_TOLD = """told AS (SELECT doc_no AS seq, doc, CASE WHEN json_type(try_cast(doc AS json)) = 'OBJECT' THEN try_cast(doc AS json)->>'$.id' END AS id, CASE WHEN doc_no % 13 = 0 THEN 'fail:no records' WHEN doc_no % 11 = 0 THEN 'fail:no bucket or key'
    WHEN doc_no % 9 = 5 THEN 'skip:no such record path' END AS early FROM odc_document)"""


@query("SELECT doc_no AS seq, 's3://docs/store/' || (doc_no % 9) || '/' || doc_no || '.json' AS url FROM odc_document WHERE doc_no % 13 <> 0 AND doc_no % 11 <> 0 UNION ALL SELECT doc_no, 's3://docs/store/0/x' || 'store/' || (doc_no % 9) || '/' || doc_no || '.json' FROM odc_document WHERE doc_no % 13 <> 0")
def notified_objects(s: SparkSession, d: str) -> DataFrame:
    """Every object that a bucket notification names."""
    rows, _ = _notifications(s, d)
    return queue.notified_objects(rows.select("seq", F.get_json_object("body", "$.Message").alias("body"))).select("seq", "url")


@query(f"""WITH {_TOLD} SELECT seq, split_part(early, ':', 1) AS verdict, split_part(early, ':', 2) AS reason FROM told WHERE early IS NOT NULL
    UNION ALL SELECT seq, CASE WHEN try_cast(doc AS json) IS NULL THEN 'fail' ELSE 'index' END, CASE WHEN try_cast(doc AS json) IS NULL THEN 'object not readable' END FROM told WHERE early IS NULL AND NOT coalesce(starts_with(doc, chr(65279)), false)""")
def queue_notifications(s: SparkSession, d: str) -> DataFrame:
    """Bucket notifications: records checked, paths matched, the last object of each fetched and read."""
    rows, roots = _notifications(s, d)
    marked = load(s, d, "odc_document").filter("startswith(doc, '﻿') AND doc_no % 13 <> 0 AND doc_no % 11 <> 0 AND doc_no % 9 <> 5").select(F.col("doc_no").alias("seq"))
    got = intake.decide(rows, record_path=[f"{k}/*.json" for k in (0, 1, 2, 3, 4, 6, 7, 8)] + ["store/5/none"], roots=roots)
    return got.join(marked, "seq", "left_anti").select("seq", "verdict", "reason")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY record_no) AS k FROM dataset_record WHERE loaded_at >= TIMESTAMP '2019-07-01')
    SELECT id, 'ADDED' AS action, product, datetime_text AS datetime, nullif(maturity, '') AS maturity FROM r WHERE k = 1 AND id IS NOT NULL AND href IS NOT NULL
        AND id NOT IN (SELECT id FROM dataset_record WHERE loaded_at < TIMESTAMP '2019-07-01' AND id IS NOT NULL) AND product IS NOT NULL AND datetime_text IS NOT NULL""")
def published_messages(s: SparkSession, d: str) -> DataFrame:
    """The messages of a batch's events: documents and attributes; the maturity only where there is one."""
    from gridsmith.plans.reference import _catalogue

    old, new = _catalogue(s, d)
    events = catalogue.events(catalogue.statuses(new, old), old)
    properties = F.struct(F.col("datetime_text").alias("datetime"), F.col("maturity").alias("dea:dataset_maturity"))
    item = F.to_json(F.struct("id", F.col("product").alias("collection"), properties.alias("properties")))
    first = load(s, d, "dataset_record").filter("loaded_at >= '2019-07-01'").groupBy("id").agg(F.min_by(F.struct("id", "product", "datetime_text", "maturity"), "record_no").alias("r")).select("r.*")
    sent = catalogue.publications(events, first.filter("product IS NOT NULL AND datetime_text IS NOT NULL").select("id", item.alias("item")))
    return sent.select("id", *[F.col("attributes")[k].alias(k) for k in ("action", "product", "datetime", "maturity")])


@query("""SELECT moved, count(*) AS n, min(delivery_id) AS first_id FROM (SELECT delivery_id, row_number() OVER (ORDER BY delivery_id) <= 57 AS moved FROM sqs_message) GROUP BY moved""")
def redrive_queue(s: SparkSession, d: str) -> DataFrame:
    """57 messages moved from a dead queue to the live one: appended there, then deleted here."""
    dead, live = scratch(s, "dead"), scratch(s, "live")
    load(s, d, "sqs_message").select("delivery_id", "message").write.parquet(dead)
    queue.redrive_folders(s, dead, live, "delivery_id", limit=57)
    there = s.read.parquet(live).withColumn("moved", F.lit(True)).unionByName(s.read.parquet(dead).withColumn("moved", F.lit(False)))
    return there.groupBy("moved").agg(F.count("*").alias("n"), F.min("delivery_id").alias("first_id"))


# --- indexing -----------------------------------------------------------------------------------------------------------

_COUNTED = "d AS (SELECT doc_no, CASE WHEN json_type(try_cast(doc AS json)) = 'OBJECT' THEN try_cast(doc AS json)->>'$.id' END AS id FROM odc_document WHERE doc IS NOT NULL AND NOT starts_with(doc, chr(65279)))"
_OUTCOMES = f"WITH {_COUNTED} SELECT * FROM (VALUES ('added', (SELECT count(DISTINCT id) FROM d)), ('skipped', (SELECT count(id) - count(DISTINCT id) FROM d)), ('failed', (SELECT count(*) FROM d WHERE id IS NULL))) v(status, n) WHERE n > 0"


@query(_OUTCOMES)
def index_from_tar(s: SparkSession, d: str) -> DataFrame:
    """Documents put into archives, read from them and indexed into a new catalogue."""
    out = scratch(s, "tars")
    f = load(s, d, "odc_document").filter("doc IS NOT NULL AND NOT startswith(doc, '﻿')").select(F.concat(F.col("doc_no").cast("string"), F.lit(".json")).alias("name"), F.col("doc").alias("content"))
    docs.write_tars(f, out).agg(F.sum("n")).first()
    m = docs.tar_members(s, f"{out}/*.tar.gz").select(F.concat("archive", F.lit("!"), "name").alias("uri"), F.decode("content", "UTF-8").alias("content"))
    counts = Store(s, scratch(s, "catalogue")).index(dataset_rows(docs.parsed(m)))
    return s.createDataFrame(list(counts.items()), "status string, n long")


@query(_OUTCOMES)
def index_folder(s: SparkSession, d: str) -> DataFrame:
    """Documents of a bucket: listed, fetched, parsed and indexed."""
    _, roots = _folder(s, d)
    asked = load(s, d, "odc_document").filter("doc IS NOT NULL AND NOT startswith(doc, '﻿')").select(F.concat(F.lit("doc://store/"), F.col("doc_no") % 9, F.lit("/"), "doc_no", F.lit(".json")).alias("url"))
    counts = Store(s, scratch(s, "catalogue")).index(dataset_rows(docs.parsed(listing.documents(asked, roots))))
    return s.createDataFrame(list(counts.items()), "status string, n long")


_LISTS = "lists AS (SELECT file_no, href, try_cast(body AS json)->>'$.etag' AS id, body FROM tiny_file WHERE body IS NOT NULL AND href IN (SELECT href FROM tiny_file WHERE body IS NOT NULL GROUP BY href HAVING count(*) = 1))"


def _single(s: SparkSession, d: str, roots: dict[str, str]) -> DataFrame:
    """Listed objects that were written once."""
    once = load(s, d, "tiny_file").filter("body IS NOT NULL").groupBy(F.col("href").alias("url")).count().filter("count = 1").select("url")
    return _listed(s, roots).join(once, "url", "left_semi")


@query(f"""WITH {_LISTS}, w AS (SELECT *, json_type(try_cast(body AS json)) = 'OBJECT' AND regexp_full_match(body, '\\s*\\{{[^{{}}]*\\}}\\s*') AS ok FROM lists WHERE href LIKE 's3://tn-lists/vd%' AND href LIKE '%.json')
    SELECT 'blob' AS product, count(DISTINCT href) FILTER (ok) AS added, count(*) FILTER (NOT coalesce(ok, false)) AS failed FROM w""")
def index_blobs(s: SparkSession, d: str) -> DataFrame:
    """Blobs by prefix and suffix as items of a renamed product: fetched, transformed, indexed; unreadable ones fail."""
    roots = _bucket(s, d)
    got = listing.documents(listing.blobs(_single(s, d, roots), "s3://tn-lists/vd", ".json"), roots)
    text_ = F.col("content").cast("string")
    item = F.when(text_.rlike(r"^\s*\{[^{}]*\}\s*\z") & F.try_parse_json(text_).isNotNull(), items.renamed_product(F.concat(F.lit('{"id":"'), F.md5("uri"), F.lit('","properties":{}}')), "blob"))
    made = items.to_datasets(got.select("uri", item.alias("item")), "uri").select("uri", intake.dataset_text().alias("doc"))
    store = Store(s, scratch(s, "catalogue"))
    counts = store.index(dataset_rows(made))
    return store.read().select("product").distinct().select("product", *[F.lit(counts.get(k, 0)).cast("bigint").alias(k) for k in ("added", "failed")])


@query(f"""WITH {_LISTS}, w AS (SELECT * FROM lists WHERE regexp_matches(href, 'part-0000[01]') AND NOT regexp_matches(href, '_gm_|day=2015')) SELECT count(*) AS n FROM w""")
def index_crawl(s: SparkSession, d: str) -> DataFrame:
    """A crawled catalogue's entries, fetched and added; failed downloads are left out (there are none but the one asked for)."""
    roots = _bucket(s, d)
    asked = listing.crawl(_single(s, d, roots), ["_gm_", "day=2015"], ["part-0000[01]"]).select("url").unionByName(s.createDataFrame([("s3://tn-lists/part-00000-none.json",)], "url string"))
    got = listing.documents(asked, roots).filter("error IS NULL")
    rows = got.select("uri", F.concat(F.lit('{"id":"'), F.md5("uri"), F.lit('","product":{"name":"crawled"}}')).alias("doc"))
    store = Store(s, scratch(s, "catalogue"))
    store.index(dataset_rows(rows))
    return store.read().agg(F.count("*").alias("n"))


@query("SELECT 's3://tiles/' || lower(r_name) || '/item.json' AS url FROM region")
def listed_urls(s: SparkSession, d: str) -> DataFrame:
    """Addresses made of the names in a text file."""
    path = scratch(s, "names")
    load(s, d, "region").select(F.concat(F.lit(" "), F.lower("r_name"), F.lit(" \n")).alias("value")).write.text(path)
    return docs.lines(s, path, skip_empty=True).select(F.format_string("s3://tiles/%s/item.json", "value").alias("url"))


@query("""WITH r AS (SELECT record_no AS seq, id, product, region_code, lower(trim(maturity)) AS maturity, loaded_at AS t, href FROM dataset_record),
    ranked AS (SELECT *, CASE maturity WHEN 'nrt' THEN 0 WHEN 'interim' THEN 1 WHEN 'final' THEN 2 END AS k FROM r),
    old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS z FROM ranked WHERE t < TIMESTAMP '2019-07-01') WHERE z = 1),
    new AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS z FROM ranked WHERE t >= TIMESTAMP '2019-07-01')
    SELECT n.seq, CASE WHEN n.id IS NULL OR n.href IS NULL THEN 'failed' WHEN o.id IS NOT NULL OR n.z > 1 THEN 'skipped'
        WHEN EXISTS (SELECT 1 FROM old m WHERE m.product = n.product AND m.region_code = n.region_code AND m.id <> n.id AND m.k >= n.k AND abs(epoch_us(m.t) - epoch_us(n.t)) <= 2592000000000) THEN 'skipped' ELSE 'added' END AS status
    FROM new n LEFT JOIN old o ON o.id = n.id""")
def statuses_maturity(s: SparkSession, d: str) -> DataFrame:
    """Decisions where an equally or more mature dataset of the same product, region and month stands in the way."""
    from gridsmith.plans.reference import _catalogue

    old, new = _catalogue(s, d)
    return catalogue.statuses(new, old, archive_less_mature=30 * 86_400_000).select("seq", "status")


@query("""WITH listed AS (SELECT product_name AS product, gsd FROM product) SELECT product, CASE WHEN gsd = 60 THEN 'known' ELSE 'registered' END AS status FROM listed WHERE gsd > 10 UNION ALL SELECT 'ghost', 'unknown'""")
def register_products(s: SparkSession, d: str) -> DataFrame:
    """Wanted products registered from their definitions; known ones stay, one without a definition is unknown."""
    p = load(s, d, "product")
    wanted = p.filter("gsd > 10").select(F.col("product_name").alias("product")).unionByName(s.createDataFrame([("ghost",)], "product string"))
    definitions = docs.parsed(p.select(F.concat("product_name", F.lit(".yaml")).alias("uri"), F.concat(F.lit("name: "), "product_name").alias("content"))).select(F.get_json_object("doc", "$.name").alias("product"), "doc")
    return catalogue.register(wanted, definitions, p.filter("gsd = 60").select(F.col("product_name").alias("product"))).select("product", "status")


# --- tiles --------------------------------------------------------------------------------------------------------------


def _tiles_sql(left: int, bottom: int, right: int, top: int, step: int) -> str:
    ew, ns = "CASE WHEN x < 0 THEN 'W' ELSE 'E' END || lpad(CAST(abs(x) AS varchar), 3, '0')", "CASE WHEN y < 0 THEN 'S' ELSE 'N' END || lpad(CAST(abs(y) AS varchar), 2, '0')"
    return f"t AS (SELECT x, y, {ew} AS ew, {ns} AS ns, {ew} || '_' || {ns} AS tile FROM range({left}, {right}, {step}) a(x), range({bottom}, {top}, {step}) b(y))"


@query(f"WITH {_tiles_sql(-18, -39, 63, 39, 3)} SELECT tile, 's3://cover/v200/2021/' || ns || ew || '_Map.tif' AS uri FROM t")
def tile_urls(s: SparkSession, d: str) -> DataFrame:
    """Tiles of a continent's box, snapped outward to multiples of three, with the addresses of a release."""
    release = dict(zip(("algo", "year"), items.MAP_VERSIONS["2021"]))
    t = geo.tiles(s, (-18.0, -38.4, 60.1, 38.0), 3)
    return items.tile_items(t, "cover_2021", f"s3://cover/{release['algo']}/{release['year']}/{{ns}}{{ew}}_Map.tif", 3, 36000, "classification").select("tile", "uri")


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1996 THEN 'v200' ELSE 'v100' END AS algo, CASE WHEN year(o_orderdate) = 1996 THEN '2021' ELSE '2020' END AS year FROM orders")
def map_versions(s: SparkSession, d: str) -> DataFrame:
    """The release that a year stands for; others keep the first one."""
    v = items.map_version((F.year("o_orderdate") + 25).cast("string"))
    return load(s, d, "orders").select("o_orderkey", v.alias("v")).select("o_orderkey", "v.*")


@query(f"WITH {_tiles_sql(-20, -40, 60, 40, 1)} SELECT tile FROM t ORDER BY x, y LIMIT 123")
def tile_limit(s: SparkSession, d: str) -> DataFrame:
    """The first tiles of a box, x-major."""
    return geo.tiles(s, (-20.0, -40.0, 60.0, 40.0), 1, limit=123).select("tile")


@query(f"WITH {_tiles_sql(5, 5, 15, 9, 1)} SELECT 'added' AS status, count(*) AS n FROM t WHERE x >= 7 UNION ALL SELECT 'skipped', count(*) FROM t WHERE x < 7")
def index_tiles(s: SparkSession, d: str) -> DataFrame:
    """A tiled elevation model indexed box by box; tiles that are in already are skipped."""
    store = Store(s, scratch(s, "catalogue"))
    item = lambda box: items.tile_items(geo.tiles(s, box), "dem_30", "s3://dem/{ns}_{ew}.tif")
    counts = {}
    for box in ((5, 5, 7, 9), (5, 5, 15, 9)):
        made = items.to_datasets(item(box), "uri").select("uri", intake.dataset_text().alias("doc"))
        counts = store.index(dataset_rows(made))
    return s.createDataFrame(list(counts.items()), "status string, n long")


# --- search and export --------------------------------------------------------------------------------------------------

_BOXED = "c AS (SELECT record_no, product, loaded_at, (record_no * 37 % 3600) / 10.0 - 180 AS lon, (record_no * 53 % 1800) / 10.0 - 90 AS lat, lower(trim(maturity)) = 'nrt' AS gone FROM dataset_record)"


def _boxed(s: SparkSession, d: str) -> DataFrame:
    lon, lat = (F.col("record_no") * 37 % 3600) / 10.0 - 180, (F.col("record_no") * 53 % 1800) / 10.0 - 90
    gone = F.when(F.lower(F.trim("maturity")) == "nrt", F.col("loaded_at"))
    return load(s, d, "dataset_record").select(F.col("record_no").alias("id"), "product", F.col("loaded_at").alias("center_time"), gone.alias("archived_time"), lon.alias("left"), lat.alias("bottom"), (lon + 1).alias("right"), (lat + 1).alias("top"))


_HIT = "NOT coalesce(gone, false) AND lon <= 60.05 AND lon + 1 >= -30.05 AND lat <= 50.05 AND lat + 1 >= -40.05 AND loaded_at >= TIMESTAMP '2016-01-01' AND loaded_at < TIMESTAMP '2021-01-01'"


@query(f"WITH {_BOXED} SELECT product, count(*) AS n FROM c WHERE {_HIT} GROUP BY product")
def search_count(s: SparkSession, d: str) -> DataFrame:
    """Live datasets by product in a box and a time range."""
    found = catalogue.search(_boxed(s, d), box=(-30.05, -40.05, 60.05, 50.05), start="2016-01-01", stop="2021-01-01")
    return found.groupBy("product").agg(F.count("*").alias("n"))


@query(f"WITH {_BOXED} SELECT record_no AS id FROM c WHERE {_HIT} ORDER BY loaded_at, record_no LIMIT 40")
def search_limit(s: SparkSession, d: str) -> DataFrame:
    """The earliest datasets of a search."""
    return catalogue.search(_boxed(s, d), box=(-30.05, -40.05, 60.05, 50.05), start="2016-01-01", stop="2021-01-01", limit=40).select("id")


@query(f"WITH {_BOXED}, n AS (SELECT product, count(*) AS n FROM c WHERE NOT coalesce(gone, false) AND product IS NOT NULL GROUP BY product) SELECT product, n, n < 65 AS shown FROM n")
def view_guard(s: SparkSession, d: str) -> DataFrame:
    """Which products are few enough to be drawn: counted, and drawn only below the bound."""
    found = catalogue.search(_boxed(s, d)).filter("product IS NOT NULL")
    return catalogue.drawable(found, "product", 65)


@query(f"WITH {_BOXED} SELECT record_no AS id, lon >= -30 AND lon + 1 <= 60 AND lat >= -40 AND lat + 1 <= 50 AS inside FROM c")
def box_contains(s: SparkSession, d: str) -> DataFrame:
    """Whether the polygon of a query holds each dataset's box."""
    return _boxed(s, d).select("id", geo.box_within({c: F.col(c) for c in ("left", "bottom", "right", "top")}, geo.box_polygon(-30, -40, 60, 50)).alias("inside"))


@query("SELECT product, count(*) AS n FROM dataset_record WHERE product LIKE 'vd%' AND product NOT LIKE '%fc%' GROUP BY product")
def restricted_products(s: SparkSession, d: str) -> DataFrame:
    """Some products without the excluded ones."""
    names = [r[0] for r in load(s, d, "product").select("product_name").collect()]
    r = catalogue.restricted(load(s, d, "dataset_record"), [n for n in names if n.startswith("vd")], [n for n in names if "fc" in n])
    return r.groupBy("product").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT doc_no, doc, try_cast(doc AS json)->>'$.id' AS id, replace(doc, 'epsg:3260', 'epsg:9990') AS other FROM odc_document WHERE json_type(try_cast(doc AS json)) = 'OBJECT' AND try_cast(doc AS json)->>'$.id' IS NOT NULL),
    one AS (SELECT id, min(doc_no) AS a, max(doc_no) AS b FROM o GROUP BY id)
    SELECT one.id FROM one JOIN o x ON x.doc_no = one.a JOIN o y ON y.doc_no = one.b
    WHERE (SELECT list_sort(list((fullkey, type, atom))) FROM json_tree(CAST(x.doc AS json))) IS DISTINCT FROM (SELECT list_sort(list((fullkey, type, atom))) FROM json_tree(CAST(y.other AS json)))""")
def lineage_differences(s: SparkSession, d: str) -> DataFrame:
    """Embedded documents that differ from the stored ones, whatever the order of their members (some had their system changed)."""
    o = load(s, d, "odc_document").withColumn("id", F.get_json_object("doc", "$.id")).filter("id IS NOT NULL AND try_parse_json(doc) IS NOT NULL").select("id", "doc", "doc_no")
    pair = o.groupBy("id").agg(F.min_by("doc", "doc_no").alias("stored"), F.replace(F.max_by("doc", "doc_no"), F.lit("epsg:3260"), F.lit("epsg:9990")).alias("embedded"))
    return catalogue.differing_parents(pair.select("id", F.col("embedded").alias("doc")), pair.select("id", F.col("stored").alias("doc")))


_BANDS = {"ir": ["nir", "swir"], "pan": ["pan"]}


def _exportable(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(datasets with bands, bands of products) from the flat records."""
    n = F.col("record_no")
    shape = lambda a, b: F.array(F.lit(a).cast("long"), F.lit(b).cast("long"))
    transform = lambda size: F.array(*[F.lit(float(v)) for v in (size, 0, 300000, 0, -size, 5000000)])
    m = lambda path, band, layer, sh, tr: F.struct(F.concat("label", F.lit(path)).alias("path"), band.cast("int").alias("band"), layer.cast("string").alias("layer"), sh.alias("shape"), tr.alias("transform"))
    none = F.lit(None)
    measurements = F.create_map(
        F.lit("red"), m("_red.tif", F.lit(1), none, F.when(n % 5 > 0, shape(100, 200)), transform(30)), F.lit("swir"), m("_swir.tif", n % 4, none, F.when(n % 3 > 0, shape(50, 100)), transform(60)),
        F.lit("nir"), m("_nir.tif", F.lit(0), F.when(n % 2 > 0, "l1"), F.when(n % 3 > 0, shape(51, 101)), transform(60)), F.lit("extra"), m("_x.tif", F.lit(1), none, none.cast("array<bigint>"), none.cast("array<double>")),
    )
    r = load(s, d, "dataset_record").filter("product IS NOT NULL AND label IS NOT NULL")
    out = r.select(
        n.alias("record_no"), F.concat(F.lit("d"), F.lpad(n.cast("string"), 9, "0")).alias("id"), "product", F.split_part("crs", F.lit(":"), F.lit(2)).alias("epsg"), F.when(F.col("href").isNotNull(), F.array("href")).otherwise(F.array().cast("array<string>")).alias("uris"),
        F.when(n % 2 > 0, "GeoTIFF").alias("format"), F.lit(None).cast("string").alias("geometry"), F.col("loaded_at").alias("center_time"), F.col("loaded_at").alias("indexed_time"), transform(1).alias("transform"), measurements.alias("measurements"),
        F.create_map(F.lit("ard"), F.col("id")).alias("sources"), F.to_json(F.struct(F.struct("platform").alias("satellite"))).alias("metadata"),
    )
    bands = load(s, d, "product").select(F.col("product_name").alias("product"), F.when(F.col("gsd") > 20, F.array(F.lit("red"), F.lit("swir"), F.lit("nir"))).otherwise(F.array(F.lit("red"), F.lit("nir"))).alias("bands"))
    return out, bands


_EXPORTED = """r AS (SELECT r.*, record_no AS n, p.gsd > 20 AS wide FROM dataset_record r JOIN product p ON r.product = p.product_name WHERE r.label IS NOT NULL AND r.href IS NOT NULL)"""
_SHAPES = "CASE WHEN n % 3 > 0 THEN '51x101' ELSE '1x1' END || ' ' || CASE WHEN n % 5 > 0 THEN '100x200' ELSE '1x1' END || ' 1x1'"


def _shape(j: str) -> str:
    return f"concat(get_json_object(document, '$.grids.{j}.shape[0]'), 'x', get_json_object(document, '$.grids.{j}.shape[1]'))"


@query(f"""WITH {_EXPORTED} SELECT 'd' || lpad(CAST(n AS varchar), 9, '0') || '-metadata.yaml' AS file, 'EPSG:' || split_part(crs, ':', 2) AS crs, href AS location, CASE WHEN n % 2 > 0 THEN 'GeoTIFF' ELSE '' END AS format,
    strftime(loaded_at, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS taken, {_SHAPES} AS shapes, CASE WHEN wide THEN 'nir,red,swir' ELSE 'nir,red' END AS bands, CASE WHEN wide AND n % 4 > 1 THEN n % 4 END AS swir_band,
    CASE WHEN n % 2 > 0 THEN 'l1' END AS nir_layer, 'ir' AS nir_grid, label || '_red.tif' AS red_path, id AS parent, platform FROM r""")
def export_documents(s: SparkSession, d: str) -> DataFrame:
    """Documents of all datasets with grids of their own: configured grids and the default one, bands, layers, offsets."""
    got = export.documents(*_exportable(s, d), band_grids=_BANDS, offsets={"odc:platform": "satellite/platform"})
    g = lambda p: F.get_json_object("document", p)
    keys = F.array_join(F.array_sort(F.json_object_keys(g("$.measurements"))), ",")
    return got.select(
        "file", g("$.crs").alias("crs"), g("$.location[0]").alias("location"), g("$.file_format").alias("format"), g("$.properties.datetime").alias("taken"), F.expr(f"concat_ws(' ', {_shape('ir')}, {_shape('default')}, {_shape('pan')})").alias("shapes"), keys.alias("bands"),
        g("$.measurements.swir.band").cast("bigint").alias("swir_band"), g("$.measurements.nir.layer").alias("nir_layer"), g("$.measurements.nir.grid").alias("nir_grid"), g("$.measurements.red.path").alias("red_path"), g("$.lineage.ard").alias("parent"), g("$.properties['odc:platform']").alias("platform"),
    )


_OWN_SHAPE = "CASE WHEN {0} % 5 > 0 THEN '100x200' WHEN {0} % 3 > 0 THEN '51x101' ELSE '1x1' END"


@query(f"""WITH {_EXPORTED}, f AS (SELECT product, min(n) FILTER (n % 5 > 0 OR n % 3 > 0) AS first FROM r GROUP BY product)
    SELECT 'd' || lpad(CAST(n AS varchar), 9, '0') AS id, CASE WHEN n > first THEN {_OWN_SHAPE.format("first")} ELSE {_OWN_SHAPE.format("n")} END AS shape
    FROM (SELECT r.*, f.first FROM r JOIN f USING (product))""")
def export_shared_grids(s: SparkSession, d: str) -> DataFrame:
    """Ingested products: the first known grid of a product holds for all its later datasets (bands in the order of their names)."""
    datasets, bands = _exportable(s, d)
    red_first = datasets.withColumn("measurements", F.map_from_entries(F.transform(F.map_entries("measurements"), lambda e: F.struct(F.when(e["key"] == "red", "a_red").otherwise(e["key"]).alias("k"), F.when(e["key"] == "swir", F.lit(None)).otherwise(e["value"]).alias("v")))))
    marked = red_first.withColumn("measurements", F.map_filter("measurements", lambda k, v: v.isNotNull()))
    got = export.documents(marked, bands, shared_grids=True)
    return got.select("id", F.expr(_shape("default")).alias("shape"))


@query(f"WITH {_EXPORTED} SELECT 'd' || lpad(CAST(n AS varchar), 9, '0') || '-metadata.yaml' AS file, id AS parent, label || '_nir.tif' AS nir_path FROM r WHERE product LIKE 'vd%'")
def export_files(s: SparkSession, d: str) -> DataFrame:
    """The documents of some products as YAML files, read back."""
    datasets, bands = _exportable(s, d)
    out = scratch(s, "export")
    export.write(export.documents(datasets.filter("product LIKE 'vd%'"), bands), out).agg(F.count_if("written")).first()
    back = docs.parsed(docs.whole(s, out, pattern="*.yaml"))
    return back.select(F.regexp_extract("uri", "([^/]*)$", 1).alias("file"), F.get_json_object("doc", "$.lineage.ard").alias("parent"), F.get_json_object("doc", "$.measurements.nir.path").alias("nir_path"))
