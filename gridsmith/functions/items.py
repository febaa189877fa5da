"""Item documents (STAC) to dataset documents and back, as expressions over JSON text.

Properties are read as ``map<string,string>`` with document order kept; structured values stay JSON text. The item's parts
are read once by :func:`read_items`; every rule is a Column built on those parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.functions import identifiers, urls
from gridsmith.functions.text import last_wins

# Names of item properties in dataset documents, product rules, region candidates.
RENAMED = {
    "end_datetime": "dtr:end_datetime",
    "start_datetime": "dtr:start_datetime",
    "gsd": "eo:gsd",
    "instruments": "eo:instrument",
    "platform": "eo:platform",
    "constellation": "eo:constellation",
    "view:off_nadir": "eo:off_nadir",
    "view:azimuth": "eo:azimuth",
    "view:sun_azimuth": "eo:sun_azimuth",
    "view:sun_elevation": "eo:sun_elevation",
}
REGION_KEYS = ["odc:region_code", "s2:mgrs_tile", "io:supercell_id"]
SENTINEL_COLLECTIONS = ["s2_l2a", "sentinel_s2_l2a_cogs", "sentinel-s2-l2a-cogs", "sentinel-2-l2a", "s2_l2a_c1"]
LANDSAT_PRODUCTS = ["ga_ls8c_ard_3", "ga_ls7e_ard_3", "ga_ls8t_ard_3"]
LANDSAT_PLATFORMS = {"LANDSAT_5": "ls5-c2l2-sr", "LANDSAT_7": "ls7-c2l2-sr", "LANDSAT_8": "ls8-c2l2-sr", "LANDSAT_9": "ls9-c2l2-sr"}

ASSET = "struct<href:string,type:string,roles:array<string>,band:int,`proj:shape`:array<bigint>,`proj:transform`:array<double>>"
ITEM = (
    "struct<id:string,title:string,collection:string,geometry:string,bbox:array<double>,properties:map<string,string>,"
    f"assets:map<string,{ASSET}>,links:array<struct<rel:string,href:string>>>"
)
# The releases of the land-cover map.
MAP_VERSIONS = {"2020": ("v100", "2020"), "2021": ("v200", "2021")}


def map_version(year: Column) -> Column:
    """struct(algo, year) of a release of the land-cover map; any other word means the first release."""
    release = lambda y: F.struct(*[F.lit(v).alias(n) for n, v in zip(("algo", "year"), MAP_VERSIONS[y])])
    return F.when(year == "2021", release("2021")).otherwise(release("2020"))


def once(value: Column) -> Column:
    """The value, kept as a column of its own: the optimizer would copy it (and a whole parse) into everything that uses it.

    The partition test is always true; being non-deterministic it must not be copied.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def read_items(df: DataFrame, text: str = "item") -> DataFrame:
    """Add ``it``, the parsed parts of an item; null if the text is no JSON object."""
    return df.withColumn("it", once(F.from_json(F.col(text), ITEM)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once a row, however often (and in whatever lambda) it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def self_href(links: Column) -> Column:
    """The first link to the item itself."""
    return F.get(F.filter(links, lambda x: x["rel"] == "self"), F.lit(0))["href"]


def link(links: Column, rel: str) -> Column:
    """The last link of a relation."""
    return F.try_element_at(F.filter(links, lambda x: x["rel"] == rel), F.lit(-1))["href"]


def item_uri(links: Column) -> Column:
    """Canonical link if there is one, else the link to the item itself."""
    return F.coalesce(F.get(F.filter(links, lambda x: x["rel"] == "canonical"), F.lit(0))["href"], link(links, "self"))


def metadata_link(document: Column, way: str) -> Column:
    """The URL of a dataset document that an item names: ``STAC-LINKS-REL:<relation>`` or a path of member names with slashes."""
    relation = way.removeprefix("STAC-LINKS-REL:")
    if relation != way:
        return link(F.from_json(F.get_json_object(document, "$.links"), "array<struct<rel:string,href:string>>"), relation)
    return F.get_json_object(document, "$" + "".join(f"['{k}']" for k in way.split("/")))


def renamed_product(item: Column, product: str) -> Column:
    """An item document whose product is ``product``, whatever it said before."""
    rest = F.map_filter(F.from_json(item, "map<string,variant>"), lambda k, _: k != "properties")
    own = F.map_filter(F.from_json(F.get_json_object(item, "$.properties"), "map<string,variant>"), lambda k, _: k != "odc:product")
    name = F.create_map(F.lit("odc:product"), F.parse_json(F.lit(f'"{product}"')))
    return F.to_json(F.map_concat(rest, F.create_map(F.lit("properties"), F.to_variant_object(F.map_concat(own, name)))))


def region_code(p: Column) -> Column:
    """First known region property, else six digits of path and row; null if those are no numbers."""
    number = lambda k: F.try_to_number(p[k], F.lit("999999")).cast("int")
    path, row = number("landsat:wrs_path"), number("landsat:wrs_row")
    digits = lambda n: F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
    return F.coalesce(*[p[k] for k in REGION_KEYS], F.concat(digits(path), digits(row)))


def platform_product(platform: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LANDSAT_PLATFORMS.items() for x in kv])[platform]


def with_product(df: DataFrame) -> DataFrame:
    """Add ``source_id``, ``label``, ``product``, ``region`` and ``default_grid`` to parsed items."""
    p, it = F.col("it.properties"), "it"
    constellation = F.replace(F.lower(F.coalesce(F.nullif(p["constellation"], F.lit("")), F.nullif(p["eo:constellation"], F.lit("")))), F.lit(" "), F.lit("-"))
    known = F.when(F.col("it.collection") == "landsat-c2l2-sr", platform_product(p["platform"])).otherwise(p["odc:product"])
    df = df.withColumn("__known", known)
    sentinel = F.coalesce(F.col("__known").isNull() & (constellation == "sentinel-2") & F.col("it.collection").isin(SENTINEL_COLLECTIONS), F.lit(False))
    df = df.withColumn("__sentinel", sentinel)
    zone = F.right(p["proj:epsg"], F.lit(2))
    square = F.coalesce(F.concat(zone, p["mgrs:latitude_band"], p["mgrs:grid_square"]), F.concat(zone, p["sentinel:latitude_band"], p["sentinel:grid_square"]))
    product = F.when(F.col("__sentinel"), F.when(F.col("it.collection") == "s2_l2a_c1", "s2_l2a_c1").otherwise("s2_l2a")).otherwise(F.coalesce("__known", F.col(f"{it}.collection")))
    df = df.withColumn("product", F.replace(product, F.lit("-"), F.lit("_")))
    landsat = F.col("product").isin(LANDSAT_PRODUCTS)
    source = F.when(F.col("__sentinel"), F.coalesce(F.nullif(p["sentinel:product_id"], F.lit("")), p["s2:granule_id"], F.col("it.id"))).otherwise(F.col("it.id"))
    stem = F.regexp_replace(F.replace(F.regexp_extract(self_href(F.col("it.links")), "([^/]*)$", 1), F.lit(".stac-item"), F.lit("")), r"\.[^.]*$", "")
    df = df.withColumn("source_id", source)
    label = F.nullif(F.when(landsat, stem).otherwise(F.col("it.title")), F.lit(""))
    own = F.when(~identifiers.is_uuid(F.col("source_id")) & ~F.col("source_id").rlike(r"^\d+$"), F.col("source_id"))
    return (
        df.withColumn("label", F.coalesce(label, own))
        .withColumn("region", F.when(F.col("__sentinel"), F.coalesce(region_code(p), square)).otherwise(region_code(p)))
        .withColumn("default_grid", F.when(landsat, "g30m").when(F.col("__sentinel"), "g10m"))
        .drop("__known", "__sentinel")
    )


def dataset_id(df_product: Column, item_id: Column, source_id: Column) -> Column:
    """The item's id if it is a UUID, else one derived from product and source id."""
    algorithm = F.when(df_product == "s2_l2a", "sentinel-2_stac_process").otherwise(F.concat(df_product, F.lit("_stac_process")))
    return F.when(identifiers.is_uuid(item_id), item_id).when(source_id.isNotNull() & df_product.isNotNull(), identifiers.dataset_uuid(algorithm, "1.0.0", F.array(source_id)))


def properties(p: Column) -> Column:
    """Renamed properties with processing time and file format filled in; instruments joined in upper case; lineage removed.

    Of two spellings of one property the last in the document stands.
    """
    renamed = F.create_map(*[F.lit(x) for kv in RENAMED.items() for x in kv])
    instruments = F.from_json(p["instruments"], "array<string>")
    joined = F.when(F.size(instruments) > 0, F.array_join(F.transform(instruments, lambda x: F.upper(x)), "_"))
    entry = lambda c: lambda e: F.struct(F.coalesce(F.try_element_at(renamed, e["key"]), e["key"]).alias("k"), F.when(e["key"] == "instruments", c).otherwise(e["value"]).alias("v"))
    moved = let(let(joined, lambda c: F.transform(F.map_entries(p), entry(c))), last_wins)
    filled = lambda c: F.nullif(c, F.lit(""))
    made = F.coalesce(filled(p["odc:processing_datetime"]), filled(p["created"]), filled(p["datetime"]))
    rest = F.map_filter(moved, lambda k, _: ~k.isin("odc:lineage", "odc:processing_datetime", "odc:file_format"))
    extra = F.map_filter(
        F.create_map(F.lit("odc:processing_datetime"), F.coalesce(p["odc:processing_datetime"], made), F.lit("odc:file_format"), F.coalesce(p["odc:file_format"], F.lit("GeoTIFF"))),
        lambda _, v: v.isNotNull(),
    )
    return F.map_concat(rest, extra)


def grid_name(transform: Column) -> Column:
    """``g10m``, ``g0.000277778m``, ``g8.33333e-05m``: the pixel size in six significant digits, with an exponent below 1e-4 and from 1e6."""
    size = F.get(transform, F.lit(0)).cast("double")
    parts = F.split(F.format_string("%.5e", size), "e")
    mantissa, exponent = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = bare(F.format_string("%.5e", size).cast("decimal(30,12)").cast("string"))
    return F.concat(F.lit("g"), F.when(size == 0, "0").when(exponent.cast("int").between(-4, 5), plain).otherwise(F.concat(bare(mantissa), F.lit("e"), exponent)), F.lit("m"))


def _assets(it: Column) -> Column:
    """The assets of an item in document order: name, path, is_band, band, grid, shape, transform."""
    numbers = lambda k, t: F.from_json(it["properties"][k], t)
    own = F.struct(numbers("proj:transform", "array<double>").alias("transform"), numbers("proj:shape", "array<bigint>").alias("shape"), self_href(it["links"]).alias("link"))

    def one(e: Column, item: Column) -> Column:
        a = e["value"]
        image = F.coalesce(a["type"].contains("jp2") | a["type"].contains("geotiff"), F.lit(False)) & ~F.coalesce(F.array_contains(a["roles"], "thumbnail"), F.lit(False))
        made = lambda transform: F.struct(
            e["key"].alias("name"), urls.relative_path(a["href"], item["link"]).alias("path"), image.alias("is_band"), a["band"].alias("band"), grid_name(transform).alias("grid"),
            F.coalesce(a["proj:shape"], item["shape"]).alias("shape"), transform.alias("transform"),
        )
        return let(F.coalesce(a["proj:transform"], item["transform"]), made)

    return let(own, lambda item: F.transform(F.map_entries(it["assets"]), lambda e: one(e, item)))


def with_bands(df: DataFrame) -> DataFrame:
    """Add measurements, grids and accessories of parsed items (``it``, ``default_grid``): arrays taken apart in place, no exchange.

    The first grid of a band is the default one unless the product names one; of two assets of one name the last stands.
    """
    entry = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    df = df.withColumn("__all", once(_assets(F.col("it")))).withColumn("__b", once(F.filter("__all", lambda a: a["is_band"])))
    df = df.withColumn("__on", F.coalesce("default_grid", F.get("__b", F.lit(0))["grid"]))
    measured = F.transform("__b", lambda a: entry(a["name"], F.struct(a["path"].alias("path"), a["band"].alias("band"), F.when(a["grid"] != F.col("__on"), a["grid"]).alias("grid"))))
    firsts = F.filter("__b", lambda a, i: a["grid"].isNotNull() & ~F.exists(F.slice("__b", F.lit(1), i), lambda o: o["grid"] == a["grid"]))
    grids = F.transform(firsts, lambda a: entry(F.when(a["grid"] == F.col("__on"), "default").otherwise(a["grid"]), F.struct(a["shape"].alias("shape"), a["transform"].alias("transform"))))
    others = F.transform(F.filter("__all", lambda a: ~a["is_band"]), lambda a: entry(a["name"], F.struct(a["path"].alias("path"))))
    return df.select("*", last_wins(measured).alias("measurements"), F.map_from_entries(grids).alias("grids"), last_wins(others).alias("accessories")).drop("__all", "__b", "__on")


def to_datasets(df: DataFrame, key: str, text: str = "item") -> DataFrame:
    """Dataset documents of a table of items: (key, id, label, product, crs, geometry, grids, measurements, accessories, properties, lineage).

    Row by row, without an exchange; equal keys stay apart. Reprojects footprints to the item's own reference system;
    without a usable footprint the box of the grid is taken. Unreadable items and items without a product give null fields.
    """
    from gridsmith.functions import geo

    items = with_bands(with_product(read_items(df.select(key, text), text)))
    p = F.col("it.properties")
    epsg = p["proj:epsg"].try_cast("int")
    box = geo.box_of_transform(F.from_json(p["proj:transform"], "array<double>"), F.from_json(p["proj:shape"], "array<double>"))
    ring = F.array(F.array(box["left"], box["bottom"]), F.array(box["left"], box["top"]), F.array(box["right"], box["top"]), F.array(box["right"], box["bottom"]), F.array(box["left"], box["bottom"]))
    from_grid = F.when(box["left"].isNotNull(), F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))))
    items = items.withColumn("__p", once(properties(p)))
    own = F.map_filter("__p", lambda k, _: F.col("region").isNull() | (k != "odc:region_code"))
    return items.select(
        key, dataset_id(F.col("product"), F.col("it.id"), F.col("source_id")).alias("id"), "label", F.lower("product").alias("product"),
        F.concat(F.lit("epsg:"), p["proj:epsg"]).alias("crs"), geo.projected(F.col("it.geometry"), epsg).alias("projected"), from_grid.alias("from_grid"),
        F.when(F.col("region").isNotNull(), F.map_concat(own, F.create_map(F.lit("odc:region_code"), F.col("region")))).otherwise(own).alias("properties"),
        F.from_json(p["odc:lineage"], "map<string,array<string>>").alias("lineage"), "measurements", "grids", "accessories",
    ).withColumn("geometry", F.coalesce("projected", "from_grid")).drop("projected", "from_grid")


def to_items(datasets: DataFrame) -> DataFrame:
    """Item documents (JSON text) of dataset rows with id, product, uri, properties, measurements and accessories."""
    back = F.create_map(*[F.lit(x) for k, v in RENAMED.items() for x in (v, k)])
    named = F.transform(F.map_entries("properties"), lambda e: F.struct(F.coalesce(F.try_element_at(back, e["key"]), e["key"]).alias("k"), e["value"].alias("v")))
    p = last_wins(F.concat(named, F.array(F.struct(F.lit("odc:product").alias("k"), F.col("product").alias("v")))))
    base = urls.parent(F.col("uri"))
    href = lambda v: F.when(v["path"].rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), v["path"]).otherwise(F.concat(base, v["path"]))
    asset = lambda col: F.transform(F.map_entries(col), lambda e: F.struct(e["key"].alias("k"), F.struct(href(e["value"]).alias("href")).alias("v")))
    links = F.array(F.struct(F.lit("self").alias("rel"), F.col("uri").alias("href")))
    return datasets.select(
        "id",
        F.when(F.col("uri").isNotNull(), F.to_json(F.struct(F.lit("Feature").alias("type"), F.lit("1.0.0").alias("stac_version"), "id", F.col("product").alias("collection"), p.alias("properties"), last_wins(F.concat(asset("measurements"), asset("accessories"))).alias("assets"), links.alias("links")))).alias("item"),
    )


def event_attributes(action: Column | str, p: Column, collection: Column) -> Column:
    """Attributes of a published event: action, product, datetime and, if given, maturity."""
    action = F.lit(action) if isinstance(action, str) else action
    product = F.coalesce(F.nullif(p["odc:product"], F.lit("")), collection)
    m = F.create_map(F.lit("action"), action, F.lit("product"), product, F.lit("datetime"), p["datetime"], F.lit("maturity"), F.nullif(p["dea:dataset_maturity"], F.lit("")))
    return F.map_filter(m, lambda k, v: (k != "maturity") | v.isNotNull())


def tile_items(tiles: DataFrame, product: str, url: str, step: int = 1, pixels: int = 3600, band: str = "elevation",
               start: str = "1900-01-01", end: str = "2100-01-01") -> DataFrame:
    """Item documents (tile, uri, item) of a tiled global raster: one geotiff asset per tile.

    ``url`` has ``{tile}`` for the tile's label or ``{ns}`` and ``{ew}`` for its halves. Such rasters have no acquisition
    time; unless told otherwise their items hold from 1900 to 2100.
    """
    uri = F.replace(F.replace(F.replace(F.lit(url), F.lit("{tile}"), F.col("tile")), F.lit("{ns}"), F.split_part("tile", F.lit("_"), F.lit(2))), F.lit("{ew}"), F.split_part("tile", F.lit("_"), F.lit(1)))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    size = step / pixels
    ring = F.array(F.array(x, y), F.array(x + step, y), F.array(x + step, y + step), F.array(x, y + step), F.array(x, y))
    grid = F.array(F.lit(size), F.lit(0.0), x, F.lit(0.0), F.lit(-size), y + step)
    properties_ = F.struct(
        F.lit(product).alias("odc:product"), F.col("tile").alias("odc:region_code"), F.lit(4326).alias("proj:epsg"),
        F.lit(start).alias("start_datetime"), F.lit(end).alias("end_datetime"),
    )
    asset = F.struct(uri.alias("href"), F.lit("image/tiff; application=geotiff").alias("type"), F.array(F.lit(pixels), F.lit(pixels)).alias("proj:shape"), grid.alias("proj:transform"))
    item = F.struct(F.col("tile").alias("id"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), properties_.alias("properties"), F.struct(asset.alias(band)).alias("assets"))
    return tiles.select("tile", uri.alias("uri"), F.to_json(item).alias("item"))
