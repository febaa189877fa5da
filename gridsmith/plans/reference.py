"""Queries of the catalogue operators, each with its SQL, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.functions import geo, identifiers, items, raster, text, urls
from gridsmith.operators import catalogue, nested
from gridsmith.plans.registry import query
from gridsmith.session import broadcast_if_small, load, scratch
from gridsmith.sources import docs, listing, queue

def objects(s: SparkSession, d: str) -> DataFrame:
    """The small files as a listing: raw entries of buckets made listing records."""
    f = load(s, d, "tiny_file")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("body", F.lit("")).cast("binary")), F.lit('"'))
    entries = f.select("file_no", F.regexp_extract("href", "^s3://([^/]*)", 1).alias("bucket"), F.regexp_replace("href", "^s3://[^/]*/", "").alias("key"), F.col("n_bytes").alias("bytes"), F.col("written_at").alias("at"), tag.alias("tag"))
    return listing.objects(entries, F.col("bucket"), F.col("key"), F.col("bytes"), F.col("at"), F.col("tag"), "file_no")


# --- listings ---------------------------------------------------------------------------------------------------------


@query("SELECT href AS url, n_bytes AS size, md5(coalesce(body, '')) AS etag FROM tiny_file")
def object_listing(s: SparkSession, d: str) -> DataFrame:
    return objects(s, d).select("url", "size", "etag")


@query(r"""SELECT record_no, nullif(regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), '') AS scheme, nullif(regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)', 1), '') AS bucket,
    CASE WHEN href LIKE '%://%' THEN regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/*(.*)$', 1) END AS key FROM dataset_record""")
def url_parse(s: SparkSession, d: str) -> DataFrame:
    h = F.col("href")
    return load(s, d, "dataset_record").select("record_no", urls.scheme(h).alias("scheme"), urls.host(h).alias("bucket"), urls.key(h).alias("key"))


@query("""SELECT DISTINCT 's3://tn-lists/' || split_part(substr(href, 15), '/', 1) || '/' AS url, true AS is_dir FROM tiny_file WHERE href LIKE 's3://tn-lists/%/%'
    UNION ALL SELECT href, false FROM tiny_file WHERE href LIKE 's3://tn-lists/%' AND href NOT LIKE 's3://tn-lists/%/%'""")
def list_one_level(s: SparkSession, d: str) -> DataFrame:
    return listing.one_level(objects(s, d), "s3://tn-lists")


@query("""SELECT DISTINCT 's3://tn-lists/' || split_part(substr(href, 15), '/', 1) || '/' || split_part(substr(href, 15), '/', 2) || '/' AS url FROM tiny_file WHERE href LIKE 's3://tn-lists/%/%/%'""")
def dirs_at_depth(s: SparkSession, d: str) -> DataFrame:
    return listing.dirs_at_depth(objects(s, d), "s3://tn-lists/", 2)


@query(r"SELECT file_no, href AS url FROM tiny_file WHERE href LIKE 's3://tn-lists/%' AND regexp_full_match(href, '.*part-0000[0-2]-.*\.json')")
def find_recursive_glob(s: SparkSession, d: str) -> DataFrame:
    return listing.find(objects(s, d), "s3://tn-lists/**/*part-0000[0-2]-*.json").select("file_no", "url")


@query(r"SELECT file_no, href AS url FROM tiny_file WHERE regexp_full_match(href, 's3://tn-lists/[^/]*ard[^/]*/day=201[56]-[^/]*/[^/]*') AND regexp_full_match(href, '.*part-0000[01].*\.json')")
def find_fixed_depth_glob(s: SparkSession, d: str) -> DataFrame:
    return listing.find(objects(s, d), "s3://tn-lists/*ard*/day=201[56]-*/*part-0000[01]*.json").select("file_no", "url")


@query("SELECT f.file_no, f.href AS url FROM tiny_file f WHERE f.href LIKE '%/' || (SELECT min(regexp_extract(href, '([^/]*)$', 1)) FROM tiny_file)")
def find_named_file(s: SparkSession, d: str) -> DataFrame:
    o = objects(s, d)
    name = o.agg(F.min(F.regexp_extract("url", "([^/]*)$", 1))).first()[0]
    return listing.find(o, f"s3://tn-lists/**/{name}").select("file_no", "url")


@query(r"SELECT DISTINCT regexp_extract(href, '^(s3://tn-lists/[^/]*/day=[^/]*-01/)', 1) AS url FROM tiny_file WHERE regexp_matches(href, '^s3://tn-lists/[^/]*/day=[^/]*-01/')")
def find_dirs_only(s: SparkSession, d: str) -> DataFrame:
    return listing.find(objects(s, d), "s3://tn-lists/*/day=*-01/")


@query(r"SELECT file_no FROM tiny_file WHERE regexp_matches(href, '(^|/)day=2016-[^/]*/part-00000-[^/]*\.json$')")
def record_path_match(s: SparkSession, d: str) -> DataFrame:
    return listing.record_paths(objects(s, d), "url", ["day=2016-*/part-00000-*.json"]).select("file_no")


@query(r"SELECT file_no, substr(href, 6) AS key FROM tiny_file WHERE starts_with(substr(href, 6), 'tn-lists/') AND href LIKE '%.json' AND href LIKE '%day=2017%' AND regexp_matches(substr(href, 6), '^(?:tn-lists/[a-z]+_s2)')")
def inventory_filter(s: SparkSession, d: str) -> DataFrame:
    rows = objects(s, d).select("file_no", F.substr(F.col("url"), F.lit(6)).alias("key"))
    return listing.key_filter(rows, "key", "/tn-lists/", ".json", "day=2017", regex="tn-lists/[a-z]+_s2")


@query("SELECT count(*) AS n, CAST(sum(n_bytes) AS bigint) AS n_bytes, round(sum(n_bytes) / 1073741824.0, 6) AS gib FROM tiny_file")
def inventory_summary(s: SparkSession, d: str) -> DataFrame:
    return listing.volume(objects(s, d)).withColumn("gib", F.round("gib", 6))


@query("SELECT coalesce(max('s3://inv/' || strftime(written_at, '%Y-%m-%dT%H-%MZ') || '/'), '') AS url FROM tiny_file")
def latest_manifest(s: SparkSession, d: str) -> DataFrame:
    stamp = F.date_format("last_modified", "yyyy-MM-dd'T'HH-mm'Z'")
    inv = objects(s, d).select(F.concat(F.lit("s3://inv/"), stamp, F.lit("/manifest.json")).alias("url"))
    return listing.latest_manifest(inv.unionByName(objects(s, d).select(F.concat(F.lit("s3://inv/data/"), "etag").alias("url"))), "s3://inv/")


@query("""SELECT file_no, CASE WHEN n_bytes > 0 THEN 'bytes=0-' || (n_bytes - 1) END AS whole, CASE WHEN n_bytes > 100 THEN 'bytes=100-' || (n_bytes - 1) END AS tail FROM tiny_file""")
def byte_range_header(s: SparkSession, d: str) -> DataFrame:
    return objects(s, d).select("file_no", urls.range_header(F.lit(0), F.col("size")).alias("whole"), urls.range_header(F.lit(100), F.col("size")).alias("tail"))


@query("SELECT f.file_no, (SELECT count(*) FROM tiny_file g WHERE g.href = f.href) AS n, CASE WHEN f.n_bytes IS NULL THEN 'x' END AS error FROM tiny_file f")
def head_objects(s: SparkSession, d: str) -> DataFrame:
    o = objects(s, d)
    heads = listing.heads(o, o.groupBy("url").agg(F.count("*").alias("n")))
    return heads.withColumn("k", F.xxhash64("url")).join(o.select("file_no", "url").withColumnRenamed("url", "u"), F.col("url") == F.col("u")).select("file_no", "n", "error").distinct()


@query("SELECT count(*) AS n_total, count(*) FILTER (n_bytes > 500) AS n_matched FROM tiny_file")
def listing_counts(s: SparkSession, d: str) -> DataFrame:
    return listing.matched_counts(objects(s, d), F.coalesce(F.col("size") > 500, F.lit(False)))


@query("SELECT file_no FROM tiny_file WHERE href LIKE 's3://tn-lists/%' AND NOT regexp_matches(href, '^s3://tn-lists/[^/]*_gm_[^/]*/') AND NOT (NOT regexp_matches(href, '^s3://tn-lists/[^/]*_ard_[^/]*/') AND regexp_matches(href, 'day=2015'))")
def guided_walk(s: SparkSession, d: str) -> DataFrame:
    guide = F.when(F.col("depth") == 0, F.when(F.col("dir").contains("_gm_"), "skip").when(F.col("dir").contains("_ard_"), "deep").otherwise("dir")).otherwise(F.when(F.col("dir").contains("day=2015"), "skip").otherwise("deep"))
    return listing.walk(objects(s, d), "s3://tn-lists/", guide).select("file_no")


@query("SELECT file_no FROM tiny_file WHERE href LIKE 's3://tn-lists/vd%' AND href LIKE '%5.json'")
def find_blobs(s: SparkSession, d: str) -> DataFrame:
    return listing.blobs(objects(s, d), "s3://tn-lists/vd", "5.json").select("file_no")


@query("SELECT file_no FROM tiny_file WHERE regexp_matches(href, 'part-') AND NOT regexp_matches(href, '_gm_|day=2015')")
def catalogue_crawl(s: SparkSession, d: str) -> DataFrame:
    return listing.crawl(objects(s, d), ["_gm_", "day=2015"], ["part-"]).select("file_no")


# --- identifiers and messages -----------------------------------------------------------------------------------------

_NS = identifiers.NAMESPACE.replace("-", "")
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(f"""WITH g AS (SELECT product, label, list_sort(list(id)) AS ids FROM dataset_record WHERE id IS NOT NULL AND label IS NOT NULL GROUP BY ALL),
    h AS (SELECT *, sha1(unhex('{_NS}') || encode(lower(array_to_string(list_concat(['stack', '1.0', '', 'label=' || label, 'product=' || product], ids), chr(10))))) AS h FROM g)
    SELECT product, label, {_UUID} AS id FROM h""")
def deterministic_uuid(s: SparkSession, d: str) -> DataFrame:
    """Identifiers of what is derived from the records of one label; the sources of an identifier are few, as one document names them all."""
    g = load(s, d, "dataset_record").filter("id IS NOT NULL AND label IS NOT NULL").groupBy("product", "label").agg(F.collect_list("id").alias("ids"))
    return g.select("product", "label", identifiers.dataset_uuid("stack", "1.0", F.col("ids"), tags={"product": F.col("product"), "label": F.col("label")}).alias("id"))


@query(r"""SELECT delivery_id, coalesce(regexp_matches(x, '^[0-9a-f]{32}$'), false) AS valid FROM (
    SELECT delivery_id, replace(regexp_replace(lower(regexp_replace(message_id, 'urn:|uuid:', '', 'g')), '^[{}]+|[{}]+$', '', 'g'), '-', '') AS x FROM sqs_message)""")
def uuid_validity(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "sqs_message").select("delivery_id", identifiers.is_uuid(F.col("message_id")).alias("valid"))


@query("""SELECT delivery_id, CASE WHEN json_type(try_cast(message AS json)) = 'OBJECT' THEN try_cast(message AS json)->>'$.id' END AS dataset_id,
    CASE WHEN json_type(try_cast(message AS json)) = 'OBJECT' THEN NULL ELSE 'unreadable message' END AS error FROM sqs_message""")
def message_decode(s: SparkSession, d: str) -> DataFrame:
    attributes = F.transform_values("message_attributes", lambda _, v: F.struct(v["attr_type"].alias("Type"), v["attr_value"].alias("Value")))
    body = F.to_json(F.struct(F.col("message_id").alias("MessageId"), F.col("message").alias("Message"), attributes.alias("MessageAttributes")))
    got = queue.decoded(load(s, d, "sqs_message").select("delivery_id", body.alias("body")))
    return got.select("delivery_id", F.get_json_object("document", "$.id").alias("dataset_id"), "error")


@query("""SELECT coalesce(message_attributes['action'].attr_value, 'ADDED') AS action, coalesce(message_attributes['product'].attr_value, try_cast(message AS json)->>'$.collection') AS product, count(*) AS n
    FROM sqs_message GROUP BY ALL""")
def message_action(s: SparkSession, d: str) -> DataFrame:
    """Actions and products of messages, from their envelopes."""
    attributes = F.transform_values("message_attributes", lambda _, v: F.struct(v["attr_type"].alias("Type"), v["attr_value"].alias("Value")))
    body = F.to_json(F.struct(F.col("message_id").alias("MessageId"), F.col("message").alias("Message"), attributes.alias("MessageAttributes")))
    m = queue.decoded(load(s, d, "sqs_message").select(F.col("message_attributes")["product"]["attr_value"].alias("p"), "message", body.alias("body")))
    p = F.create_map(F.lit("odc:product"), F.coalesce("p", F.lit("")), F.lit("datetime"), F.lit(""))
    a = items.event_attributes(F.coalesce("action", F.lit("ADDED")), p, F.get_json_object("message", "$.collection"))
    return m.select(a.alias("a")).groupBy(F.col("a")["action"].alias("action"), F.col("a")["product"].alias("product")).agg(F.count("*").alias("n"))


@query("""WITH allowed AS (SELECT region_code FROM dataset_record WHERE maturity = 'final' GROUP BY region_code)
    SELECT m.region IN (SELECT region_code FROM allowed WHERE region_code IS NOT NULL) AND m.region IS NOT NULL AS kept, count(*) AS n
    FROM (SELECT try_cast(message AS json)->>'$.properties."odc:region_code"' AS region FROM sqs_message) m GROUP BY ALL""")
def region_allowlist(s: SparkSession, d: str) -> DataFrame:
    m = load(s, d, "sqs_message").select(F.get_json_object("message", "$.properties['odc:region_code']").alias("region_code"))
    allowed = load(s, d, "dataset_record").filter("maturity = 'final' AND region_code IS NOT NULL").select("region_code")
    kept, skipped = catalogue.allow_list(m, allowed, "region_code")
    return kept.agg(F.lit(True).alias("kept"), F.count("*").alias("n")).unionByName(skipped.agg(F.lit(False).alias("kept"), F.count("*").alias("n"))).filter("n > 0")


@query("SELECT product_name AS product FROM product WHERE product_name NOT IN (SELECT product FROM dataset_record WHERE maturity = 'interim' AND gsd = 20 AND product IS NOT NULL)")
def missing_products(s: SparkSession, d: str) -> DataFrame:
    known = load(s, d, "dataset_record").filter("maturity = 'interim' AND gsd = 20")
    return catalogue.missing(load(s, d, "product").select(F.col("product_name").alias("product")), known, "product")


# --- catalogue maintenance --------------------------------------------------------------------------------------------

_DOCS = r"""WITH parsed AS (SELECT doc_no, try_cast(ltrim(doc, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) AS json) AS j FROM odc_document),
    datasets AS (SELECT doc_no, unnest(CASE WHEN json_type(j) = 'ARRAY' THEN j->'$[*]' WHEN json_type(j->'datasets') = 'ARRAY' THEN j->'$.datasets[*]' ELSE [j] END) AS ds FROM parsed WHERE j IS NOT NULL)"""

_CUT = "2019-07-01"
_ROWS = f"""rows AS (SELECT record_no AS seq, id, product, region_code, href AS uri, lower(trim(maturity)) AS maturity, loaded_at AS center_time, loaded_at FROM dataset_record),
    catalogue AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS k FROM rows WHERE loaded_at < TIMESTAMP '{_CUT}') WHERE k = 1),
    incoming AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM rows WHERE loaded_at >= TIMESTAMP '{_CUT}')"""
_JUDGED = f"""WITH {_ROWS}, judged AS (
    SELECT i.*, CASE WHEN i.id IS NULL OR i.uri IS NULL THEN 'failed' WHEN (c.id IS NOT NULL OR i.k > 1)
        THEN CASE WHEN (c.product IS NULL OR c.product IS NOT DISTINCT FROM i.product) AND (c.region_code IS NULL OR c.region_code IS NOT DISTINCT FROM i.region_code) THEN 'updated' ELSE 'failed' END
        ELSE 'added' END AS status
    FROM incoming i LEFT JOIN catalogue c ON c.id = i.id)"""


def _catalogue(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(datasets loaded before the cut, records that come after it)."""
    rows = load(s, d, "dataset_record").select(F.col("record_no").alias("seq"), "id", "product", "region_code", F.col("href").alias("uri"), F.lower(F.trim("maturity")).alias("maturity"), F.col("loaded_at").alias("center_time"), F.lit(None).cast("timestamp").alias("archived_time"))
    before = F.col("center_time") < F.lit(_CUT).cast("timestamp_ntz")
    best = rows.filter(before).groupBy("id").agg(F.max(F.struct("seq", *[c for c in rows.columns if c not in ("seq", "id")])).alias("r"))
    return best.select("id", *[f"r.{c}" for c in rows.columns if c != "id"]).select(*rows.columns), rows.filter(~before)


@query(f"{_JUDGED} SELECT seq, status FROM judged")
def upsert_status(s: SparkSession, d: str) -> DataFrame:
    old, new = _catalogue(s, d)
    return catalogue.statuses(new, old, update_if_exists=True).select("seq", "status")


@query(f"""{_JUDGED}, last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS z FROM judged WHERE status IN ('added', 'updated'))
    SELECT id, seq FROM last WHERE z = 1 UNION ALL SELECT id, seq FROM catalogue WHERE id IS NULL OR id NOT IN (SELECT id FROM last WHERE id IS NOT NULL)""")
def upsert_snapshot(s: SparkSession, d: str) -> DataFrame:
    old, new = _catalogue(s, d)
    return catalogue.apply(catalogue.statuses(new, old, update_if_exists=True), old, F.lit("2030-01-01").cast("timestamp")).select("id", "seq")


@query(f"{_JUDGED} SELECT status, count(*) AS n FROM judged GROUP BY status")
def outcome_counts(s: SparkSession, d: str) -> DataFrame:
    old, new = _catalogue(s, d)
    return catalogue.counts(catalogue.statuses(new, old, update_if_exists=True))


_PAIRS = """WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 END AS rank FROM orders),
    pairs AS (SELECT a.o_orderkey AS in_id, b.o_orderkey AS old_id, a.rank AS in_rank, b.rank AS old_rank FROM o a JOIN o b USING (o_custkey, o_orderpriority)
        WHERE abs(epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate)) <= 5184000000000 AND a.o_orderkey <> b.o_orderkey)"""
_WINDOW_MS = 60 * 86_400_000


def _order_pairs(s: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "nrt").when(F.col("o_orderstatus") == "P", "interim").when(F.col("o_orderstatus") == "F", "final")
    o = load(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("product"), F.col("o_orderpriority").alias("region_code"), F.col("o_orderdate").alias("center_time"), status.alias("maturity"), F.lit(None).cast("timestamp").alias("archived_time"))
    return catalogue.maturity_pairs(o, o, _WINDOW_MS)


@query(f"{_PAIRS} SELECT DISTINCT in_id, old_id FROM pairs WHERE old_rank < in_rank")
def maturity_archive(s: SparkSession, d: str) -> DataFrame:
    return catalogue.less_mature(_order_pairs(s, d))


@query(f"{_PAIRS} SELECT DISTINCT in_id FROM pairs WHERE old_rank >= in_rank")
def maturity_blocked(s: SparkSession, d: str) -> DataFrame:
    return catalogue.blocked(_order_pairs(s, d))


@query("""WITH listed AS (SELECT producer_name AS definition, list_sort(list(product_name)) AS names FROM product GROUP BY 1),
    docs AS (SELECT producer_name AS definition, list_sort(list(product_name)) AS found FROM product WHERE NOT (producer_name < 'k' AND gsd > 20) GROUP BY 1),
    each AS (SELECT unnest(CASE WHEN names = found THEN names ELSE [array_to_string(names, ';')] END) AS product, coalesce(names = found, false) AS good FROM listed LEFT JOIN docs USING (definition))
    SELECT product, CASE WHEN NOT good THEN 'failed' WHEN product IN (SELECT product FROM dataset_record WHERE product IS NOT NULL AND gsd = 60) THEN 'unchanged' ELSE 'added' END AS status FROM each""")
def product_sync(s: SparkSession, d: str) -> DataFrame:
    p = load(s, d, "product")
    listed = p.groupBy(F.col("producer_name").alias("definition")).agg(F.array_join(F.array_sort(F.collect_list("product_name")), ";").alias("names"))
    found = p.filter("NOT (producer_name < 'k' AND gsd > 20)").select(F.col("producer_name").alias("definition"), F.col("product_name").alias("product"))
    return catalogue.product_sync(listed, found, load(s, d, "dataset_record").filter("gsd = 60").select("product"))


@query("SELECT l_orderkey AS child, 'part' AS label, l_partkey AS parent FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def lineage_missing(s: SparkSession, d: str) -> DataFrame:
    edges = load(s, d, "lineitem").select(F.col("l_orderkey").alias("child"), F.lit("part").alias("label"), F.col("l_partkey").alias("parent"))
    return catalogue.missing_parents(edges, load(s, d, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("id"))).select("child", "label", "parent")


@query(rf"""{_DOCS} SELECT CASE WHEN json_type(ds->'product') = 'OBJECT' THEN ds->>'$.product.name' ELSE ds->>'product' END AS product, count(*) AS n
    FROM datasets WHERE json_type(ds, '$.id') = 'VARCHAR' GROUP BY 1""")
def count_by_product(s: SparkSession, d: str) -> DataFrame:
    one = nested.flatten(load(s, d, "odc_document"), ["dataset"])["dataset"].select(F.col("dataset_id").alias("id"), "product")
    return one.filter("id IS NOT NULL").groupBy("product").agg(F.count("*").alias("n"))


@query("""SELECT product, count(*) AS n_total, count(*) FILTER (lower(trim(maturity)) IS DISTINCT FROM 'nrt') AS n_live, min(loaded_at) AS first_time, max(loaded_at) AS last_time,
    min(gsd) AS "left", min(gsd) AS bottom, max(gsd) AS "right", max(gsd) AS top FROM dataset_record GROUP BY product""")
def product_extents(s: SparkSession, d: str) -> DataFrame:
    archived = F.when(F.lower(F.trim("maturity")) == "nrt", F.col("loaded_at"))
    r = load(s, d, "dataset_record").select("product", F.col("loaded_at").alias("center_time"), archived.alias("archived_time"), *[F.col("gsd").alias(c) for c in ("left", "bottom", "right", "top")])
    return catalogue.summaries(r)


@query("""WITH need AS (SELECT producer_name AS product, gsd AS band FROM product GROUP BY ALL), n AS (SELECT product, count(*) AS n FROM need GROUP BY 1),
    have AS (SELECT region_code AS id, gsd AS band FROM dataset_record WHERE region_code IS NOT NULL GROUP BY ALL)
    SELECT id, product FROM have JOIN need USING (band) JOIN n USING (product) GROUP BY id, product, n.n HAVING count(*) = n.n""")
def match_by_bands(s: SparkSession, d: str) -> DataFrame:
    have = load(s, d, "dataset_record").filter("region_code IS NOT NULL AND gsd IS NOT NULL").groupBy(F.col("region_code").alias("id")).agg(F.collect_set("gsd").alias("bands"))
    need = load(s, d, "product").groupBy(F.col("producer_name").alias("product")).agg(F.collect_set("gsd").alias("bands"))
    return catalogue.match_products(have, need)


@query(f"""WITH {_ROWS}, ranked AS (SELECT *, CASE maturity WHEN 'nrt' THEN 0 WHEN 'interim' THEN 1 WHEN 'final' THEN 2 END AS m FROM rows),
    old AS (SELECT c.id, c.product, c.region_code, c.center_time, CASE c.maturity WHEN 'nrt' THEN 0 WHEN 'interim' THEN 1 WHEN 'final' THEN 2 END AS m FROM catalogue c),
    near AS (SELECT i.seq, i.id AS in_id, o.id AS old_id, CASE i.maturity WHEN 'nrt' THEN 0 WHEN 'interim' THEN 1 WHEN 'final' THEN 2 END AS im, o.m FROM incoming i JOIN old o ON o.product = i.product AND o.region_code = i.region_code AND o.id <> i.id
        AND abs(epoch_us(o.center_time) - epoch_us(i.center_time)) <= 2592000000000),
    added AS (SELECT id FROM incoming i WHERE id IS NOT NULL AND uri IS NOT NULL AND k = 1 AND id NOT IN (SELECT id FROM catalogue WHERE id IS NOT NULL) AND id NOT IN (SELECT in_id FROM near WHERE m >= im))
    SELECT id AS cause, 'ADDED' AS action, id FROM added UNION ALL SELECT DISTINCT in_id, 'ARCHIVED', old_id FROM near WHERE m < im AND in_id IN (SELECT id FROM added)""")
def published_events(s: SparkSession, d: str) -> DataFrame:
    """What a batch publishes: less mature datasets archived on account of an addition, then the addition."""
    old, new = _catalogue(s, d)
    within = 30 * 86_400_000
    return catalogue.events(catalogue.statuses(new, old, archive_less_mature=within), old, within).select("cause", "action", "id")


# --- items and geometry -----------------------------------------------------------------------------------------------


@query("""SELECT delivery_id, j->>'$.properties."odc:processing_datetime"' AS processed, coalesce(j->>'$.properties."odc:file_format"', 'GeoTIFF') AS file_format, j->>'$.properties."eo:cloud_cover"' AS cloud,
    j->>'$.properties.datetime' AS taken FROM (SELECT delivery_id, try_cast(message AS json) AS j FROM sqs_message) WHERE json_type(j) = 'OBJECT'""")
def stac_properties(s: SparkSession, d: str) -> DataFrame:
    m = items.read_items(load(s, d, "sqs_message").select("delivery_id", "message"), "message").filter("it.properties IS NOT NULL")
    p = items.properties(F.col("it.properties"))
    return m.select("delivery_id", p.alias("p")).select("delivery_id", F.col("p")["odc:processing_datetime"].alias("processed"), F.col("p")["odc:file_format"].alias("file_format"), F.col("p")["eo:cloud_cover"].alias("cloud"), F.col("p")["datetime"].alias("taken"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN l_linestatus ELSE CASE WHEN l_suppkey < 1000 THEN lpad(CAST(l_suppkey AS varchar), 3, '0') ELSE CAST(l_suppkey AS varchar) END
    || lpad(CAST(l_linenumber AS varchar), 3, '0') END AS region FROM lineitem""")
def region_code(s: SparkSession, d: str) -> DataFrame:
    p = F.create_map(F.lit("odc:region_code"), F.when(F.col("l_returnflag") == "A", F.col("l_linestatus")), F.lit("landsat:wrs_path"), F.col("l_suppkey").cast("string"), F.lit("landsat:wrs_row"), F.col("l_linenumber").cast("string"))
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", items.region_code(p).alias("region"))


@query(r"""WITH r AS (SELECT record_no, href, record_no % 3 AS way, regexp_replace(href, '[^/]*/[^/]*$', '') AS above FROM dataset_record)
    SELECT record_no, CASE WHEN way = 0 AND href LIKE '%://%/%/%' THEN substr(href, length(above) + 1) ELSE href END AS path FROM r""")
def relative_path(s: SparkSession, d: str) -> DataFrame:
    """Addresses below the item's folder, in a folder beside it and of another host."""
    way = F.col("record_no") % 3
    base = F.when(way == 0, F.regexp_replace("href", "[^/]*/[^/]*$", "item.json")).when(way == 1, F.regexp_replace("href", "[^/]*$", "sub/item.json")).otherwise(F.lit("s3://elsewhere/x/item.json"))
    below = F.when(F.col("href").rlike("://.*/.*/"), urls.relative_path(F.col("href"), base)).otherwise(F.col("href"))
    return load(s, d, "dataset_record").select("record_no", below.alias("path"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'g' || p_size || 'm' WHEN 1 THEN 'g' || regexp_replace(CAST(CAST(p_size / 4.0 AS decimal(9,2)) AS varchar), '\\.?0+$', '') || 'm'
    WHEN 2 THEN 'g' || printf('%g', p_size / 600000.0) || 'm' ELSE 'g' || printf('%g', p_size * 100000.0) || 'm' END AS grid FROM part WHERE p_size IS NOT NULL""")
def grid_names(s: SparkSession, d: str) -> DataFrame:
    """Names of grids from very small to very large pixels."""
    n = F.col("p_size")
    size = F.when(n % 4 == 0, n.cast("double")).when(n % 4 == 1, n / 4.0).when(n % 4 == 2, n / 600000.0).otherwise(n * 100000.0)
    return load(s, d, "part").select("p_partkey", items.grid_name(F.array(size)).alias("grid"))


@query("""SELECT p_partkey, CAST(p_size * 10.0 AS double) AS "left", CAST(5000.0 - 30.0 * p_size AS double) AS bottom, CAST(p_size * 40.0 AS double) AS "right", CAST(5000.0 AS double) AS top FROM part""")
def geom_from_transform(s: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("double")
    box = geo.box_of_transform(F.array(F.lit(30.0), F.lit(0.0), n * 10, F.lit(0.0), F.lit(-30.0), F.lit(5000.0)), F.array(n, n))
    return load(s, d, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.*")


def _tile_sql(step: int) -> str:
    lx, ly = "CASE WHEN x < 0 THEN 'W' ELSE 'E' END || lpad(CAST(abs(x) AS varchar), 3, '0')", "CASE WHEN y < 0 THEN 'S' ELSE 'N' END || lpad(CAST(abs(y) AS varchar), 2, '0')"
    return f"SELECT x, y, {lx} || '_' || {ly} AS tile FROM range(-180, 180, {step}) a(x), range(-90, 90, {step}) b(y)"


@query(_tile_sql(1))
def dem_tiles(s: SparkSession, d: str) -> DataFrame:
    return geo.tiles(s, None, 1)


@query(f"SELECT * FROM ({_tile_sql(3)}) WHERE x BETWEEN -18 AND 60 AND y BETWEEN -39 AND 36")
def worldcover_tiles(s: SparkSession, d: str) -> DataFrame:
    """A box that is no multiple of three on any side, snapped outward."""
    return geo.tiles(s, (-17.9, -38.2, 60.4, 36.1), 3)


_POINTS = "SELECT c_custkey AS id, c_mktsegment AS product, (c_custkey * 37 % 3600) / 10.0 - 180 AS lon, (c_custkey * 53 % 1800) / 10.0 - 90 AS lat, c_nationkey FROM customer"


def _points(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("product"), ((F.col("c_custkey") * 37 % 3600) / 10.0 - 180).alias("lon"), ((F.col("c_custkey") * 53 % 1800) / 10.0 - 90).alias("lat"), "c_nationkey")


@query(f"""WITH p AS ({_POINTS}) SELECT product, round(min(lon), 6) AS "left", round(min(lat), 6) AS bottom, round(max(lon) + 1, 6) AS "right", round(max(lat) + 1, 6) AS top,
    CAST(floor(log2(greatest(360.0 / (max(lon) + 1 - min(lon)), 180.0 / (max(lat) + 1 - min(lat))))) AS int) AS zoom FROM p GROUP BY product""")
def bbox_union(s: SparkSession, d: str) -> DataFrame:
    b = _points(s, d).groupBy("product").agg(F.min("lon").alias("left"), F.min("lat").alias("bottom"), (F.max("lon") + 1).alias("right"), (F.max("lat") + 1).alias("top"))
    zoom = geo.zoom_level(F.col("right") - F.col("left"), F.col("top") - F.col("bottom"))
    return b.select("product", *[F.round(c, 6).alias(c) for c in ("left", "bottom", "right", "top")], zoom.alias("zoom"))


@query(f"WITH p AS ({_POINTS}) SELECT product, count(*) AS n FROM p WHERE lon <= 20.05 AND lon + 1 >= -30.05 AND lat <= 40.05 AND lat + 1 >= -10.05 GROUP BY product")
def view_count(s: SparkSession, d: str) -> DataFrame:
    p = _points(s, d)
    inside = geo.boxes_overlap({"left": F.col("lon"), "bottom": F.col("lat"), "right": F.col("lon") + 1, "top": F.col("lat") + 1}, -30.05, -10.05, 20.05, 40.05)
    return p.filter(inside).groupBy("product").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS day, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m') AS month,
    CAST(year(o_orderdate) + 1 AS varchar) AS year FROM orders""")
def period_step(s: SparkSession, d: str) -> DataFrame:
    t = lambda f: geo.period_step(F.date_format("o_orderdate", f))
    return load(s, d, "orders").select("o_orderkey", t("yyyy-MM-dd").alias("day"), t("yyyy-MM").alias("month"), t("yyyy").alias("year"))


_SCENES_AT = "SELECT record_no AS id, loaded_at AS center_time, (record_no * 37 % 3600) / 10.0 - 180 AS lon, (record_no * 53 % 1800) / 10.0 - 90 AS lat FROM dataset_record"


@query(f"WITH p AS ({_SCENES_AT}) SELECT id, row_number() OVER (ORDER BY center_time, id) AS n FROM p WHERE lon <= 10.05 AND lon + 25 >= 10.05 AND lat <= 20.05 AND lat + 25 >= 20.05")
def pixel_drill(s: SparkSession, d: str) -> DataFrame:
    """The datasets that hold one point, numbered in time order."""
    n = F.col("record_no")
    lon, lat = (n * 37 % 3600) / 10.0 - 180, (n * 53 % 1800) / 10.0 - 90
    boxes = load(s, d, "dataset_record").select(n.alias("id"), F.col("loaded_at").alias("center_time"), lon.alias("left"), (lon + 25).alias("right"), lat.alias("bottom"), (lat + 25).alias("top"))
    return catalogue.point_in_time(boxes, 10.05, 20.05).select("id", "n")


@query("""SELECT CAST(ts + to_microseconds(CAST((user_id % 360 - 180) * 240000000 AS bigint)) AS date) AS day, count(*) AS n FROM events GROUP BY 1""")
def solar_day_groups(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").groupBy(geo.solar_day(F.col("ts"), (F.col("user_id") % 360 - 180).cast("double")).alias("day")).agg(F.count("*").alias("n"))


@query(f"WITH p AS ({_POINTS}) SELECT CAST(floor(lon / 10) AS bigint) AS tx, CAST(floor(lat / 10) AS bigint) AS ty, count(*) AS n, array_to_string(list_sort(list(id)), ',') AS members FROM p GROUP BY 1, 2")
def tile_binning(s: SparkSession, d: str) -> DataFrame:
    """Points binned to tiles of ten degrees, with their members."""
    g = geo.binned(_points(s, d), F.col("lon"), F.col("lat"), 10.0, "id")
    return g.select("tx", "ty", "n", F.array_join("members", ",").alias("members"))


@query(f"""WITH p AS (SELECT DISTINCT product, lon, lat FROM ({_POINTS})),
    slopes AS (SELECT a.product, a.lon, a.lat, atan2(b.lat - a.lat, b.lon - a.lon) AS w FROM p a JOIN p b ON a.product = b.product AND (a.lon <> b.lon OR a.lat <> b.lat)),
    gaps AS (SELECT product, lon, lat, w, lead(w) OVER (PARTITION BY product, lon, lat ORDER BY w) - w AS gap, min(w) OVER (PARTITION BY product, lon, lat) + 2 * pi() - max(w) OVER (PARTITION BY product, lon, lat) AS round FROM slopes)
    SELECT product, lon, lat FROM gaps GROUP BY ALL HAVING greatest(max(gap), max(round)) > pi() + 1e-9""")
def footprint_hulls(s: SparkSession, d: str) -> DataFrame:
    """Corners of the hull of each product's points. A point is a corner if all others lie within less than half a turn of it."""
    rings = geo.footprints(_points(s, d), "product", "lon", "lat")
    return rings.select("product", F.explode(F.array_distinct("ring")).alias("p")).select("product", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))


@query("""WITH t AS (SELECT x, y FROM range(-2, 7, 1) a(x), range(-1, 7, 1) b(y)),
    f AS (SELECT printf('%+d,%+d', x, y) AS title, x, y, '[[' || x || ',' || y || '],[' || (x + 1) || ',' || y || '],[' || (x + 1) || ',' || (y + 1) || '],[' || x || ',' || (y + 1) || '],[' || x || ',' || y || ']]' AS ring FROM t)
    SELECT title, ring FROM f""")
def grid_geojson(s: SparkSession, d: str) -> DataFrame:
    """The tile grid of a box as one GeoJSON document, its features taken apart again."""
    doc = geo.feature_collection(geo.tiles(s, (-1.5, -1, 7, 7)))
    feature = F.explode(F.from_json(F.get_json_object("geojson", "$.features"), "array<struct<properties:struct<title:string>,geometry:struct<coordinates:array<array<array<int>>>>>>")).alias("f")
    return doc.filter(F.get_json_object("geojson", "$.type") == "FeatureCollection").select(feature).select(F.col("f.properties.title").alias("title"), F.to_json(F.col("f.geometry.coordinates")[0]).alias("ring"))


# --- queues -----------------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT delivery_id, row_number() OVER (ORDER BY delivery_id) AS n FROM sqs_message), b AS (SELECT CAST(floor((n - 1) / 10) AS bigint) AS batch, delivery_id FROM n)
    SELECT batch, count(*) AS n, min(delivery_id) AS first_id FROM b GROUP BY batch""")
def redrive_batches(s: SparkSession, d: str) -> DataFrame:
    return queue.batches(load(s, d, "sqs_message").select("delivery_id"), "delivery_id").groupBy("batch").agg(F.count("*").alias("n"), F.min("delivery_id").alias("first_id"))


@query("SELECT delivery_id FROM sqs_message ORDER BY received_at, delivery_id LIMIT 35")
def queue_limit(s: SparkSession, d: str) -> DataFrame:
    return queue.limited(load(s, d, "sqs_message"), 35, "received_at", "delivery_id").select("delivery_id")


@query("SELECT topic_arn AS name, count(*) AS n FROM sqs_message WHERE topic_arn LIKE 'arn:aws:sns:%' AND topic_arn LIKE '%vd%' GROUP BY 1")
def queue_search(s: SparkSession, d: str) -> DataFrame:
    return queue.queues(load(s, d, "sqs_message").select(F.col("topic_arn").alias("name")), "arn:aws:sns:", "vd").groupBy("name").agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS elapsed, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS fps FROM events GROUP BY 1""")
def rate_stats(s: SparkSession, d: str) -> DataFrame:
    return catalogue.rates(load(s, d, "events"), "event_type", "ts").select("event_type", "n", F.round("elapsed", 3).alias("elapsed"), F.round("fps", 9).alias("fps"))


_LIVE = "WITH k AS (SELECT user_id AS key, event_id AS tie, epoch_us(ts) AS instant, event_type <> 'click' AS live, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)"


@query(f"{_LIVE} SELECT key, tie FROM k WHERE n = 1 AND live")
def stream_index(s: SparkSession, d: str) -> DataFrame:
    """Events through the streaming indexer until the queue is empty; must equal the batch result."""
    from gridsmith.streaming import indexer

    out = scratch(s, "stream")
    load(s, d, "events").repartitionByRange(4, "ts").write.parquet(f"{out}/queue")
    decode = lambda b: b.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("instant"), F.col("event_id").alias("tie"), (F.col("event_type") != "click").alias("live"))
    messages = queue.stream(s, f"{out}/queue", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", 2)
    indexer.index_stream(messages, out, decode, f"{out}/checkpoint").awaitTermination()
    return indexer.current(s, out)


# --- raster -----------------------------------------------------------------------------------------------------------


@query("SELECT count(*) FILTER (l_tax <= 0.04 AND l_discount > 0.05) AS added, count(*) FILTER (l_tax > 0.04 AND l_discount <= 0.05) AS removed FROM lineitem")
def mask_changes(s: SparkSession, d: str) -> DataFrame:
    added, removed = raster.mask_changes(F.col("l_tax") > 0.04, F.col("l_discount") > 0.05)
    return load(s, d, "lineitem").agg(F.count_if(added).alias("added"), F.count_if(removed).alias("removed"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity = 1 AS none, CAST(least(greatest(floor(l_quantity * 255.0 / 40.0), 0), 255) AS int) AS v FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN none THEN 255 ELSE v END AS r, CASE WHEN none THEN 0 ELSE v END AS g, CASE WHEN none THEN 255 ELSE v END AS b FROM b""")
def rgba_scale(s: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    px = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", raster.rgba(q, q, q, F.lit(40.0), F.lit(1.0)).alias("px"))
    return px.select("l_orderkey", "l_linenumber", raster.opaque(F.col("px")).alias("o")).select("l_orderkey", "l_linenumber", "o.*")


@query("""SELECT l_orderkey, l_linenumber, c.r, c.g, c.b, c.a FROM (SELECT *, CAST(l_quantity AS int) % 7 AS class FROM lineitem) l
    LEFT JOIN (VALUES (0, 0, 0, 0, 0), (1, 255, 0, 0, 255), (2, 0, 255, 0, 255), (3, 10, 20, 30, 128)) c(class, r, g, b, a) USING (class)""")
def class_colours(s: SparkSession, d: str) -> DataFrame:
    """Classes of pixels as colours; a class without a colour has none."""
    colours = {0: (0, 0, 0, 0), 1: (255, 0, 0, 255), 2: (0, 255, 0, 255), 3: (10, 20, 30, 128)}
    px = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", raster.coloured(F.col("l_quantity").cast("int") % 7, colours).alias("px"))
    return px.select("l_orderkey", "l_linenumber", "px.*")


@query("""WITH g AS (SELECT l_returnflag AS image, list_sort(list(DISTINCT l_linenumber)) AS xs, list_sort(list(DISTINCT CAST(l_quantity AS bigint))) AS ys FROM lineitem GROUP BY 1)
    SELECT image, CAST(len(ys) AS int) AS height, CAST(len(xs) AS int) AS width, round(len(xs) / len(ys), 9) AS aspect, xs[1] - (xs[2] - xs[1]) / 2 AS "left", ys[1] - (ys[2] - ys[1]) / 2 AS bottom,
    xs[-1] + (xs[2] - xs[1]) / 2 AS "right", ys[-1] + (ys[2] - ys[1]) / 2 AS top FROM g""")
def pixel_bounds(s: SparkSession, d: str) -> DataFrame:
    cells = load(s, d, "lineitem").select(F.col("l_returnflag").alias("image"), F.col("l_linenumber").alias("x"), F.col("l_quantity").cast("bigint").alias("y")).distinct()
    b = raster.pixel_bounds(cells, ["image"])
    return b.withColumn("aspect", F.round("aspect", 9))


@query("""WITH RECURSIVE e AS (SELECT label, vec_id, CAST(embedding AS double[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
    x AS (SELECT label, vec_id, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM e),
    m(step, label, i, c) AS (
        SELECT 0, label, i, avg(c) FROM x GROUP BY label, i
        UNION ALL
        SELECT any_value(w.step) + 1, x.label, x.i, sum(x.c * w.w) / sum(w.w)
        FROM x JOIN (SELECT m.step, x.label, x.vec_id, 1 / greatest(sqrt(sum((x.c - m.c) ** 2)), 1e-12) AS w FROM x JOIN m USING (label, i) WHERE m.step < 60 GROUP BY ALL) w USING (label, vec_id) GROUP BY x.label, x.i
    )
    SELECT label, CAST(i - 1 AS int) AS i, round(c, 5) + 0.0 AS c FROM m WHERE step = (SELECT max(step) FROM m)""")
def geomedian_by_label(s: SparkSession, d: str) -> DataFrame:
    """Geometric median of each label's vectors, iterated until no group moves."""
    e = load(s, d, "embeddings").select("label", F.col("embedding").cast(T.ArrayType(T.DoubleType())).alias("v"))
    return raster.geomedian_over(e, "label", "v", eps=1e-9).select("label", F.posexplode("median").alias("i", "c")).select("label", "i", (F.round("c", 5) + 0.0).alias("c"))


# --- documents --------------------------------------------------------------------------------------------------------


@query()
def yaml_documents(s: SparkSession, d: str) -> DataFrame:
    """The YAML files of the corpus as JSON documents, unreadable ones as errors."""
    y = load(s, d, "documents").filter("lang = 'yaml'").select(F.concat(F.col("doc_id").cast("string"), F.lit(".yaml")).alias("uri"), F.col("text").alias("content"))
    return docs.parsed(y).select("uri", F.md5(F.col("doc").cast("binary")).alias("digest"), "error")


@query("SELECT product_name AS name, producer_name AS owner, gsd FROM product")
def group_text_parse(s: SparkSession, d: str) -> DataFrame:
    """Nested key-value text of each product, read back."""
    mtl = F.concat(F.lit('GROUP = P\nNAME = "'), "product_name", F.lit('"\nGROUP = Q\nOWNER = "'), "producer_name", F.lit('"\nGSD = '), F.col("gsd").cast("string"), F.lit("\nEND_GROUP = Q\nEND_GROUP = P\nEND\n"))
    j = load(s, d, "product").select(text.group_text_json(mtl).alias("j"))
    return j.select(F.get_json_object("j", "$.P.NAME").alias("name"), F.get_json_object("j", "$.P.Q.OWNER").alias("owner"), F.get_json_object("j", "$.P.Q.GSD").cast("double").alias("gsd"))


@query("SELECT file_no, href AS name, md5(coalesce(body, '')) AS digest FROM tiny_file WHERE body IS NOT NULL")
def tar_round_trip(s: SparkSession, d: str) -> DataFrame:
    """All small files written to tar archives, one per partition, and read back."""
    out = scratch(s, "tars")
    f = load(s, d, "tiny_file").select(F.concat_ws("#", "file_no", F.substr(F.col("href"), F.lit(6))).alias("name"), F.col("body").alias("content"))
    docs.write_tars(f, out).agg(F.sum("n")).first()
    m = docs.tar_members(s, f"{out}/*.tar.gz")
    return m.select(F.split_part("name", F.lit("#"), F.lit(1)).cast("bigint").alias("file_no"), F.concat(F.lit("s3://"), F.regexp_replace("name", "^[0-9]+#", "")).alias("name"), F.md5("content").alias("digest"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS int) AS start, CAST(l_suppkey AS int) AS stop FROM lineitem""")
def range_parse(s: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(":"), F.col("l_suppkey").cast("string"))
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.int_range(t).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS bigint) AS k FROM events")
def options_parse(s: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.lit("k="), F.get_json_object("props", "$.k"), F.lit("#bad#x=1=2#type="), "event_type")
    return load(s, d, "events").select("event_id", text.options(t)["k"].cast("bigint").alias("k"))


@query(f"""{_DOCS}, g AS (SELECT doc_no, ds, unnest(json_keys(ds->'grids')) AS grid FROM datasets WHERE json_type(ds->'grids') = 'OBJECT')
    SELECT grid, count(*) AS n, count(*) FILTER (json_extract(ds, '$.grids."' || grid || '".crs') IS NOT NULL) AS n_crs FROM g GROUP BY grid""")
def grids_by_name(s: SparkSession, d: str) -> DataFrame:
    g = nested.flatten(load(s, d, "odc_document"), ["grid"])["grid"]
    return g.groupBy(F.col("grid_name").alias("grid")).agg(F.count("*").alias("n"), F.count("crs").alias("n_crs"))


@query(f"""WITH t AS ({_tile_sql(3)}), h AS (SELECT *, sha1(unhex('{_NS}') || encode(lower('land_cover_stac_process' || chr(10) || '1.0.0' || chr(10) || chr(10) || tile))) AS h FROM t)
    SELECT tile, {_UUID} AS id, 'land_cover' AS product, tile AS region, 's3://cover/' || tile || '.tif' AS path, 'epsg:4326' AS crs, CAST(x AS double) AS x0, CAST(y + 3 AS double) AS y0 FROM h""")
def tile_datasets(s: SparkSession, d: str) -> DataFrame:
    """Dataset documents of all tiles of a global raster."""
    made = items.to_datasets(items.tile_items(geo.tiles(s, None, 3), "land_cover", "s3://cover/{tile}.tif", 3, 36000, "map"), "tile")
    grid = F.col("grids")["default"]["transform"]
    return made.select("tile", "id", "product", F.col("properties")["odc:region_code"].alias("region"), F.col("measurements")["map"]["path"].alias("path"), "crs", F.get(grid, F.lit(2)).alias("x0"), F.get(grid, F.lit(5)).alias("y0"))


# --- relational surface -----------------------------------------------------------------------------------------------


@query("SELECT n_name, o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS decimal(18,2))) AS decimal(28,2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderstatus)")
def rollup_orders(s: SparkSession, d: str) -> DataFrame:
    j = load(s, d, "orders").join(load(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(broadcast_if_small(load(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_name", "o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS bigint) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lines(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return load(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT p_partkey, s_suppkey FROM (SELECT p_partkey FROM part WHERE p_size < 10) FULL JOIN (SELECT s_suppkey FROM supplier) ON p_partkey = s_suppkey")
def join_full(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "part").filter("p_size < 10").select("p_partkey").join(load(s, d, "supplier").select("s_suppkey"), F.col("p_partkey") == F.col("s_suppkey"), "full")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_anti(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "customer").join(load(s, d, "orders").filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT event_id, user_id, lag(event_id) OVER w AS before, rank() OVER w AS r, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bigint) AS n
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_events(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(s, d, "events").select("event_id", "user_id", F.lag("event_id").over(w).alias("before"), F.rank().over(w).cast("bigint").alias("r"), F.count("*").over(w.rowsBetween(-2, 0)).alias("n"))


@query("""WITH b AS (SELECT user_id, event_id AS b_id, ts AS b_ts FROM events WHERE event_type = 'click')
    SELECT e.event_id, b.b_id FROM events e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts >= b.b_ts WHERE e.event_type = 'purchase'""")
def asof_join(s: SparkSession, d: str) -> DataFrame:
    """The latest click before each purchase: both sides in one sorted pass per user, no pairs."""
    from pyspark.sql import Window

    e = load(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("b_id", last).filter("event_type = 'purchase'").select("event_id", "b_id")


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def tumbling_counts(s: SparkSession, d: str) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "6 hours")
    return load(s, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(s: SparkSession, d: str) -> DataFrame:
    a = load(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(load(s, d, "supplier").select(F.col("s_nationkey").alias("k")))
    return a.subtract(load(s, d, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("k")))


