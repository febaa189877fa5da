"""Queries of items, texts, rasters, progress and windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.functions import geo, identifiers, items, raster, text
from gridsmith.operators import catalogue
from gridsmith.plans.registry import query
from gridsmith.session import load
from gridsmith.streaming import indexer

# --- items --------------------------------------------------------------------------------------------------------------

_NS = identifiers.NAMESPACE.replace("-", "")
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


def _records(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "dataset_record").filter("product IS NOT NULL AND label IS NOT NULL")


def scene_items(s: SparkSession, d: str) -> DataFrame:
    """(record_no, item): an item for each flat record, of several families of products, with bands on two grids and accessories."""
    n, c = F.col("record_no"), F.col
    family = n % 4  # a scene of its own id, one with a title, a land scene, a scene of the second family
    grid = lambda size, x: F.array(*[F.lit(v).cast("double") for v in (size, 0)], F.lit(x).cast("double"), F.lit(0.0), F.lit(-size).cast("double"), F.lit(5000000.0))
    kept = lambda cond, v: F.when(cond, v)
    properties = F.struct(
        c("datetime_text").alias("datetime"), c("processing_datetime_text").alias("created"), kept(family == 2, F.lit("LANDSAT_8")).alias("platform"), kept(n % 3 == 0, c("gsd")).alias("gsd"), kept(n % 5 == 0, F.lit(7)).alias("eo:gsd"),
        kept(n % 2 == 0, F.array(F.lit("oli"), F.lit("tirs"))).alias("instruments"), kept(family < 2, c("region_code")).alias("odc:region_code"), kept(family == 2, F.lit("90")).alias("landsat:wrs_path"), kept(family == 2, F.lit(81)).alias("landsat:wrs_row"),
        kept(family == 3, F.lit("Sentinel 2")).alias("constellation"), kept(family == 3, F.lit("U")).alias("mgrs:latitude_band"), kept(family == 3, F.lit("MU")).alias("mgrs:grid_square"), kept(family == 3, c("label")).alias("sentinel:product_id"),
        F.lit(32632).alias("proj:epsg"), F.array(F.lit(100), F.lit(200)).alias("proj:shape"), grid(30, 300000).alias("proj:transform"), kept(n % 7 == 0, F.create_map(F.lit("ard"), F.array("id"))).alias("odc:lineage"),
    )
    asset = lambda href, kind, *more: F.struct(href.alias("href"), F.lit(kind).alias("type"), *more)
    base = F.concat(F.lit("s3://scenes/"), c("label"), F.lit("/"))
    assets = F.struct(
        asset(F.concat(base, F.lit("q.jpg")), "image/jpeg").alias("quick"), asset(F.concat(base, F.lit("b1.tif")), "image/tiff; application=geotiff").alias("b1"),
        asset(F.concat(base, F.lit("sub/b2.jp2")), "image/jp2", F.lit(2).alias("band"), F.array(F.lit(300), F.lit(600)).alias("proj:shape"), grid(10, 300010).alias("proj:transform")).alias("b2"),
        asset(F.lit("s3://other/b3.tif"), "image/tiff; geotiff", grid(10, 5).alias("proj:transform")).alias("b3"), asset(F.concat(base, F.lit("t.tif")), "image/tiff; geotiff", F.array(F.lit("thumbnail")).alias("roles")).alias("th"),
    )
    links = F.array(F.struct(F.lit("self").alias("rel"), F.concat(base, F.lit("item.json")).alias("href")))
    collection = F.when(family == 2, "landsat-c2l2-sr").when(family == 3, "sentinel-2-l2a").otherwise(F.replace("product", F.lit("_"), F.lit("-")))
    item = F.struct(F.when(family == 0, c("label")).otherwise(c("id")).alias("id"), kept(family == 1, c("label")).alias("title"), collection.alias("collection"), properties.alias("properties"), assets.alias("assets"), links.alias("links"))
    return _records(s, d).select("record_no", F.to_json(item).alias("item"))


_ITEMS = f"""r AS (SELECT *, record_no % 4 AS family FROM dataset_record WHERE product IS NOT NULL AND label IS NOT NULL),
    named AS (SELECT *, CASE family WHEN 2 THEN 'ls8_c2l2_sr' WHEN 3 THEN 's2_l2a' ELSE product END AS made FROM r),
    keyed AS (SELECT *, coalesce(regexp_matches(replace(lower(id), '-', ''), '^[0-9a-f]{{32}}$'), false) AS uuid, sha1(unhex('{_NS}') || encode(lower(CASE family WHEN 3 THEN 'sentinel-2' ELSE made END || '_stac_process' || chr(10) || '1.0.0' || chr(10) || chr(10) ||
        CASE WHEN family IN (0, 3) THEN label ELSE id END))) AS h FROM named)"""


@query(f"""WITH {_ITEMS} SELECT record_no, CASE WHEN family > 0 AND uuid THEN id ELSE {_UUID} END AS id, made AS product, CASE WHEN family IN (0, 1, 3) THEN label END AS label, 'epsg:32632' AS crs,
    CASE family WHEN 2 THEN '090081' WHEN 3 THEN '32UMU' ELSE region_code END AS region, CASE WHEN record_no % 5 = 0 THEN '7' WHEN record_no % 3 = 0 AND NOT isnan(gsd) THEN CAST(gsd AS varchar) END AS gsd,
    coalesce(nullif(processing_datetime_text, ''), nullif(datetime_text, '')) AS processed, CASE WHEN record_no % 2 = 0 THEN 'OLI_TIRS' END AS instrument, CASE WHEN record_no % 7 = 0 THEN id END AS parent,
    CASE WHEN family = 3 THEN 'b1 b1.tif g30m,b2 sub/b2.jp2 -,b3 s3://other/b3.tif -' ELSE 'b1 b1.tif -,b2 sub/b2.jp2 g10m,b3 s3://other/b3.tif g10m' END AS bands,
    CASE WHEN family = 3 THEN 'default 300 300010,g30m 100 300000' ELSE 'default 100 300000,g10m 300 300010' END AS grids, 'quick q.jpg,th t.tif' AS others, '300000 303000 4994000 5000000' AS box
    FROM keyed WHERE id IS NOT NULL AND (gsd IS NULL OR record_no % 3 > 0 OR record_no % 5 = 0 OR NOT isnan(gsd))""")
def items_to_datasets(s: SparkSession, d: str) -> DataFrame:
    """Items of four families as dataset documents: names, regions, bands, grids, accessories, properties, lineage, footprints."""
    made = items.to_datasets(scene_items(s, d), "record_no", "item").join(_records(s, d).filter("id IS NOT NULL AND (gsd IS NULL OR record_no % 3 > 0 OR record_no % 5 = 0 OR NOT isnan(gsd))").select("record_no"), "record_no", "left_semi")
    p = F.col("properties")
    listed = lambda m, f: F.array_join(F.array_sort(F.transform(F.map_entries(m), f)), ",")
    ring = F.from_json(F.get_json_object("geometry", "$.coordinates[0]"), "array<array<double>>")
    edge = lambda i, f: f(F.transform(ring, lambda q: q[i])).cast("bigint").cast("string")
    return made.select(
        "record_no", "id", "product", "label", "crs", p["odc:region_code"].alias("region"), p["eo:gsd"].alias("gsd"), p["odc:processing_datetime"].alias("processed"), p["eo:instrument"].alias("instrument"), F.col("lineage")["ard"][0].alias("parent"),
        listed("measurements", lambda e: F.concat_ws(" ", e["key"], e["value"]["path"], F.coalesce(e["value"]["grid"], F.lit("-")))).alias("bands"),
        listed("grids", lambda e: F.concat_ws(" ", e["key"], e["value"]["shape"][0].cast("string"), e["value"]["transform"][2].cast("bigint").cast("string"))).alias("grids"),
        listed("accessories", lambda e: F.concat_ws(" ", e["key"], e["value"]["path"])).alias("others"), F.concat_ws(" ", edge(0, F.array_min), edge(0, F.array_max), edge(1, F.array_min), edge(1, F.array_max)).alias("box"),
    )


@query("""SELECT record_no, label AS id, replace(product, '-', '_') AS product, CASE WHEN record_no % 5 = 0 THEN '7' END AS gsd, 's3://scenes/' || label || '/b1.tif' AS b1, 's3://other/b3.tif' AS b3, 's3://scenes/' || label || '/t.tif' AS th, 's3://scenes/' || label || '/d.yaml' AS self
    FROM dataset_record WHERE product IS NOT NULL AND label IS NOT NULL AND record_no % 4 = 0""")
def datasets_to_items(s: SparkSession, d: str) -> DataFrame:
    """Datasets as items again: names of properties turned back, addresses made whole."""
    of = _records(s, d).filter("record_no % 4 = 0").select("record_no", "label")
    made = items.to_datasets(scene_items(s, d).join(of.select("record_no"), "record_no", "left_semi"), "record_no", "item").join(of.withColumnRenamed("label", "own"), "record_no")
    made = made.withColumn("uri", F.concat(F.lit("s3://scenes/"), "own", F.lit("/d.yaml"))).withColumn("id", F.concat_ws("#", F.col("record_no").cast("string"), "own"))
    j = items.to_items(made.withColumn("properties", F.map_filter("properties", lambda k, _: (k != "eo:gsd") | (F.col("record_no") % 5 == 0))))
    g = lambda p: F.get_json_object("item", p)
    return j.select(
        F.split_part("id", F.lit("#"), F.lit(1)).cast("bigint").alias("record_no"), F.split_part("id", F.lit("#"), F.lit(2)).alias("id"), g("$.properties['odc:product']").alias("product"), g("$.properties.gsd").alias("gsd"),
        g("$.assets.b1.href").alias("b1"), g("$.assets.b3.href").alias("b3"), g("$.assets.th.href").alias("th"), g("$.links[0].href").alias("self"),
    )


@query("""SELECT record_no, CASE record_no % 4 WHEN 0 THEN 'c' WHEN 1 THEN 's2' WHEN 2 THEN 'c' END AS uri, CASE record_no % 4 WHEN 1 THEN 's1' WHEN 0 THEN 's1' END AS self, CASE record_no % 4 WHEN 1 THEN 's2' WHEN 0 THEN 's1' END AS last,
    CASE record_no % 4 WHEN 0 THEN 'c' WHEN 2 THEN 'c' END AS odc FROM dataset_record""")
def item_links(s: SparkSession, d: str) -> DataFrame:
    """An item's address: the first canonical link, else the last one to itself; links by relation, first and last."""
    links = F.when(F.col("record_no") % 4 == 0, '[{"rel":"self","href":"s1"},{"rel":"canonical","href":"c"},{"rel":"canonical","href":"d"}]').when(F.col("record_no") % 4 == 1, '[{"rel":"self","href":"s1"},{"rel":"self","href":"s2"}]')
    links = links.when(F.col("record_no") % 4 == 2, '[{"rel":"canonical","href":"c"}]').otherwise('[{"rel":"parent","href":"p"}]')
    df = load(s, d, "dataset_record").select("record_no", F.concat(F.lit('{"links":'), links, F.lit("}")).alias("item")).withColumn("l", F.from_json(F.get_json_object("item", "$.links"), "array<struct<rel:string,href:string>>"))
    first = items.metadata_link(F.col("item"), "links/0/href")
    odc = F.get(F.filter("l", lambda x: x["rel"] == "canonical"), F.lit(0))["href"]
    return df.select("record_no", items.item_uri(F.col("l")).alias("uri"), items.self_href(F.col("l")).alias("self"), items.link(F.col("l"), "self").alias("last"), F.coalesce(odc, first).alias("odc"))


@query("SELECT record_no, CASE record_no % 5 WHEN 0 THEN 'ls5-c2l2-sr' WHEN 1 THEN 'ls7-c2l2-sr' WHEN 2 THEN 'ls8-c2l2-sr' WHEN 3 THEN 'ls9-c2l2-sr' END AS product FROM dataset_record")
def platform_products(s: SparkSession, d: str) -> DataFrame:
    """Products of land platforms by name; none for an unknown one."""
    platform = F.element_at(F.array(*[F.lit(x) for x in ("LANDSAT_5", "LANDSAT_7", "LANDSAT_8", "LANDSAT_9", "LANDSAT_1")]), (F.col("record_no") % 5 + 1).cast("int"))
    return load(s, d, "dataset_record").select("record_no", items.platform_product(platform).alias("product"))


@query("""SELECT record_no, 'renamed' AS product, try_cast(gsd AS varchar) AS gsd, id FROM dataset_record WHERE id IS NOT NULL AND NOT isnan(coalesce(gsd, 0))""")
def renamed_items(s: SparkSession, d: str) -> DataFrame:
    """Items whose product is renamed, everything else kept."""
    r = load(s, d, "dataset_record").filter("id IS NOT NULL AND NOT isnan(coalesce(gsd, 0))")
    item = F.to_json(F.struct("id", F.struct(F.col("product").alias("odc:product"), F.col("gsd").cast("string").alias("gsd")).alias("properties")))
    j = r.select("record_no", items.renamed_product(item, "renamed").alias("j"))
    return j.select("record_no", F.get_json_object("j", "$.properties['odc:product']").alias("product"), F.get_json_object("j", "$.properties.gsd").alias("gsd"), F.get_json_object("j", "$.id").alias("id"))


# WGS84 to UTM by the classic series of the meridian arc, another than the operator's.
_UTM = """k AS (SELECT id, lon, lat, radians(lat) AS f, radians(lon - 9) AS dl, 6378137.0 AS a, 0.0066943799901413165 AS e2 FROM p),
    s AS (SELECT *, e2 / (1 - e2) AS ep, a / sqrt(1 - e2 * sin(f) ** 2) AS n, tan(f) ** 2 AS t, e2 / (1 - e2) * cos(f) ** 2 AS c, dl * cos(f) AS u,
        a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * f - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * f) + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * f) - 35 * e2 ** 3 / 3072 * sin(6 * f)) AS m FROM k)"""


@query(f"""WITH p AS (SELECT c_custkey AS id, 6.5 + (c_custkey % 500) / 100.0 AS lon, 40 + (c_custkey % 911) / 50.0 AS lat FROM customer), {_UTM}
    SELECT id, CAST(floor((0.9996 * n * (u + (1 - t + c) * u ** 3 / 6 + (5 - 18 * t + t ** 2 + 72 * c - 58 * ep) * u ** 5 / 120) + 500000) / 10 + 0.05) AS bigint) AS east,
        CAST(floor(0.9996 * (m + n * tan(f) * (u ** 2 / 2 + (5 - t + 9 * c + 4 * c ** 2) * u ** 4 / 24 + (61 - 58 * t + t ** 2 + 600 * c - 330 * ep) * u ** 6 / 720)) / 10 + 0.05) AS bigint) AS north FROM s""")
def project_points(s: SparkSession, d: str) -> DataFrame:
    """Footprints in degrees brought to a UTM zone (compared in tens of metres)."""
    c = F.col("c_custkey")
    g = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(6.5 + (c % 500) / 100.0, 40 + (c % 911) / 50.0).alias("coordinates")))
    out = load(s, d, "customer").select(c.alias("id"), geo.projected(g, F.lit(32632)).alias("g"))
    at = lambda i: F.floor(F.get_json_object("g", f"$.coordinates[{i}]").cast("double") / 10 + 0.05)
    return out.select("id", at(0).alias("east"), at(1).alias("north"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE 5 END AS n, CASE WHEN c_custkey % 3 = 0 THEN '[[0.0,0.0],[4.0,0.0],[4.0,3.0],[0.0,0.0]]' ELSE '[[0.0,0.0],[4.0,0.0],[4.0,3.0],[2.0,5.0],[0.0,0.0]]' END AS ring FROM customer""")
def simplified_footprints(s: SparkSession, d: str) -> DataFrame:
    """Footprints as GeoJSON with points next to their neighbours' line left out."""
    third = F.array(F.lit(2.0), F.when(F.col("c_custkey") % 3 == 0, 1.5004).otherwise(5.0))
    ring = F.array(*[F.array(*[F.lit(float(v)) for v in q]) for q in ((0, 0), (2, 0.0005), (4, 0), (4, 3))], third, F.array(F.lit(0.0), F.lit(0.0)))
    out = load(s, d, "customer").select(F.col("c_custkey").alias("id"), geo.simplified(ring, F.lit(0.001)).alias("ring"))
    return out.select("id", F.size("ring").alias("n"), F.to_json("ring").alias("ring"))


# --- texts --------------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS int) AS a0, CAST(l_suppkey AS int) AS a1, CAST(l_linenumber AS int) AS b0, 7 AS b1 FROM lineitem")
def range_2d_parse(s: SparkSession, d: str) -> DataFrame:
    """Two ranges in one text."""
    t = F.concat_ws("", F.col("l_quantity").cast("int"), F.lit(":"), F.col("l_suppkey"), F.lit(","), F.col("l_linenumber"), F.lit(":7"))
    r = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.int_range_2d(t).alias("r"))
    return r.select("l_orderkey", "l_linenumber", F.col("r.a.start").alias("a0"), F.col("r.a.stop").alias("a1"), F.col("r.b.start").alias("b0"), F.col("r.b.stop").alias("b1"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 IN (0, 1) THEN l_linenumber END AS start, CASE WHEN l_linenumber % 4 IN (1, 2) THEN CAST(l_suppkey AS int) END AS stop, CASE WHEN l_linenumber % 4 = 0 THEN 2 END AS step FROM lineitem""")
def slice_parse(s: SparkSession, d: str) -> DataFrame:
    """Slices with absent ends and steps; a text that is none gives nothing."""
    n, k = F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")
    t = F.when(F.col("l_linenumber") % 4 == 0, F.concat(n, F.lit("::2"))).when(F.col("l_linenumber") % 4 == 1, F.concat(n, F.lit(":"), k)).when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit(":"), k)).otherwise(n)
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", text.slice_of(t).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@query("SELECT event_id, event_type IN ('click', 'purchase') AS yes FROM events")
def flags(s: SparkSession, d: str) -> DataFrame:
    """Settings that mean yes."""
    word = F.when(F.col("event_type") == "click", "yes").when(F.col("event_type") == "purchase", "T").when(F.col("event_type") == "view", "off")
    return load(s, d, "events").select("event_id", text.flag(word).alias("yes"))


# --- rasters ------------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' AND l_quantity <> 1 THEN round(l_quantity * 0.5 + 10, 6) END AS v, CASE WHEN l_returnflag <> 'R' AND l_quantity <> 1 THEN CAST(l_quantity AS int) ELSE -999 END AS back FROM lineitem""")
def scale_and_back(s: SparkSession, d: str) -> DataFrame:
    """Valid cells as numbers, and numbers as cells again with their no-data value."""
    v = raster.scaled(F.col("l_quantity"), F.col("l_returnflag") != "R", F.lit(1.0), 0.5, 10.0)
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(v, 6).alias("v"), raster.unscaled(v, -999, 0.5, 10.0).alias("back"))


@query("SELECT p_partkey, 'data:text/plain;base64,' || base64(encode(p_name)) AS uri FROM part")
def data_uris(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "part").select("p_partkey", raster.data_uri(F.encode("p_name", "UTF-8"), "text/plain").alias("uri"))


_IMAGE = "SELECT l_returnflag AS image, l_linenumber AS x, CAST(l_quantity AS int) AS y, CAST(max(l_suppkey) % 256 AS int) AS r, CAST(min(l_partkey) % 256 AS int) AS g, CAST(count(*) % 256 AS int) AS b FROM lineitem GROUP BY 1, 2, 3"


def _cells(s: SparkSession, d: str) -> DataFrame:
    g = load(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("image"), F.col("l_linenumber").alias("x"), F.col("l_quantity").cast("int").alias("y"))
    return g.agg((F.max("l_suppkey") % 256).cast("int").alias("r"), (F.min("l_partkey") % 256).cast("int").alias("g"), (F.count("*") % 256).cast("int").alias("b"))


@query(_IMAGE)
def png_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Images as PNG bytes, decoded again to their pixels."""
    return raster.pixels_of(raster.image_bytes(_cells(s, d), ["image"]), ["image"], "png", F.lit(1), F.lit(1))


@query(f"SELECT image, CAST(count(DISTINCT x) AS int) AS width, CAST(count(DISTINCT y) AS int) AS height, 'ffd8' AS head, 'ffd9' AS tail FROM ({_IMAGE}) GROUP BY image")
def jpeg_images(s: SparkSession, d: str) -> DataFrame:
    """Images as JPEG bytes: marks at both ends and the size in the frame header."""
    j = raster.image_bytes(_cells(s, d), ["image"], quality=95).select("image", F.lower(F.hex("jpeg")).alias("h"))
    frame = F.regexp_extract("h", "ffc0....08(........)", 1)
    size = lambda i: F.conv(F.substring(frame, i, 4), 16, 10).cast("int")
    return j.select("image", size(5).alias("width"), size(1).alias("height"), F.substring("h", 1, 4).alias("head"), F.right("h", F.lit(4)).alias("tail"))


@query("SELECT product, count(*) AS n FROM dataset_record WHERE product IS NOT NULL GROUP BY product HAVING max(cloud_cover) IS NULL OR NOT bool_or(cloud_cover BETWEEN 20 AND 21.5)")
def failed_groups(s: SparkSession, d: str) -> DataFrame:
    """Products for which a step gave nothing."""
    g = load(s, d, "dataset_record").filter("product IS NOT NULL").groupBy("product").agg(F.collect_set(F.when(F.col("cloud_cover").between(20, 21.5), F.col("record_no"))).alias("m"), F.count("*").alias("n"))
    return catalogue.empty(g, "m").select("product", "n")


# --- progress and streams ----------------------------------------------------------------------------------------------


@query("""SELECT n, ts, round((epoch_us(ts) - epoch_us((SELECT min(ts) FROM events))) / 1e6, 6) AS elapsed FROM (SELECT ts, row_number() OVER (ORDER BY ts, event_id) AS n FROM events) WHERE n % 100 = 0""")
def progress_marks(s: SparkSession, d: str) -> DataFrame:
    """Every hundredth event of a run with the time since its start."""
    e = load(s, d, "events")
    return catalogue.progress(e, F.dayofyear("ts") + 366 * F.year("ts"), "ts", 100, "event_id").select("n", "ts", F.round("elapsed", 6).alias("elapsed"))


@query("SELECT 'catalogue_index:' || count(*) || '|g|#app:queue,action:' || lower(trim(maturity)) AS line FROM dataset_record WHERE trim(maturity) <> '' GROUP BY lower(trim(maturity))")
def gauge_lines(s: SparkSession, d: str) -> DataFrame:
    """Counts as gauge reports."""
    judged = load(s, d, "dataset_record").filter("trim(maturity) <> ''").select(F.lower(F.trim("maturity")).alias("status"))
    return catalogue.gauges(catalogue.counts(judged), "catalogue_index", app="queue")


@query("""WITH w AS (SELECT event_type, ts, unnest(generate_series(0, 1)) AS k FROM events)
    SELECT time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 30 MINUTE AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2""")
def sliding_counts(s: SparkSession, d: str) -> DataFrame:
    """Events in windows of an hour that start every half hour."""
    e = load(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return indexer.windowed_counts(e, "at", "event_type", "1 hour", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(s: SparkSession, d: str) -> DataFrame:
    """Sessions of users: events less than an hour apart."""
    e = load(s, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return indexer.session_counts(e, "at", "user_id", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, min(event_id) AS first_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1 GROUP BY user_id")
def stream_first(s: SparkSession, d: str) -> DataFrame:
    """Each user's first event, kept as state over a stream in order of time."""
    from gridsmith.session import scratch
    from gridsmith.sources import queue

    out = scratch(s, "first")
    load(s, d, "events").repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{out}/queue")
    messages = queue.stream(s, f"{out}/queue", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", 2)
    indexer.first_stream(messages, "user_id", "ts", "event_id", out).awaitTermination()
    return indexer.firsts(s, out, "user_id", "ts", "event_id").select("user_id", F.col("event_id").alias("first_id"))
