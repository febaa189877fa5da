"""Datasets of a catalogue as metadata documents, one YAML file each.

``datasets`` has id, product, epsg, uris (array), format, geometry (JSON), center_time, indexed_time, transform (array),
measurements (map of band → path, band, layer, shape, transform) and sources (map of classifier → id). Defined results: datasets
without a uri are left out; measurements the product doesn't define are left out; a grid takes shape and transform of its first
measurement that has both (by name), else ``[1, 1]`` and the dataset's transform.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASUREMENT = "struct<path:string,band:int,layer:string,shape:array<bigint>,transform:array<double>>"


def defined(measurements: Column, bands: Column) -> Column:
    """Measurements that a product defines."""
    return F.map_filter(measurements, lambda k, _: F.array_contains(bands, k))


def band_grid(band: Column, band_grids: Mapping[str, Sequence[str]]) -> Column:
    """The grid that a configuration of grid → bands gives a band; null on the default grid."""
    pairs = {b: g for g, bands in band_grids.items() if g != "default" for b in bands}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), band) if pairs else F.lit(None).cast("string")


def shape_and_transform(measurements: Column, bands: Column, fallback: Column) -> Column:
    """struct(shape, transform) of the first of ``bands`` that has both."""
    usable = F.filter(F.transform(F.array_sort(bands), lambda b: F.try_element_at(measurements, b)), lambda m: m["shape"].isNotNull() & m["transform"].isNotNull())
    first = F.get(usable, F.lit(0))
    none = F.struct(F.array(F.lit(1).cast("long"), F.lit(1).cast("long")).alias("shape"), fallback.alias("transform"))
    return F.coalesce(F.when(first.isNotNull(), F.struct(first["shape"].alias("shape"), first["transform"].alias("transform"))), none)


def grids(measurements: Column, fallback: Column, band_grids: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Map of grid → (shape, transform): the configured grids, and ``default`` for the bands that none of them names (if any)."""
    every = F.map_keys(measurements)
    if not band_grids:
        return F.map_from_arrays(F.array(F.lit("default")), F.array(shape_and_transform(measurements, every, fallback)))
    named = [b for bands in band_grids.values() for b in bands]
    out = F.map_from_arrays(
        F.array(*[F.lit(g) for g in band_grids]),
        F.array(*[shape_and_transform(measurements, F.array(*[F.lit(b) for b in bands]) if bands else F.array_except(every, every), fallback) for bands in band_grids.values()]),
    )
    if band_grids.get("default"):
        return out
    left = F.array_except(every, F.array(*[F.lit(b) for b in named]))
    kept = F.map_filter(out, lambda k, _: k != "default")
    return F.when(F.size(left) > 0, F.map_concat(kept, F.map_from_arrays(F.array(F.lit("default")), F.array(shape_and_transform(measurements, left, fallback))))).otherwise(out)


def known(grids_: Column) -> Column:
    """Whether every grid has a real shape."""
    one = F.array(F.lit(1).cast("long"), F.lit(1).cast("long"))
    return F.forall(F.map_values(grids_), lambda g: g["shape"] != one)


def documents(datasets: DataFrame, product_bands: DataFrame, band_grids: Mapping[str, Sequence[str]] | None = None, shared_grids: bool = False, offsets: Mapping[str, str] | None = None) -> DataFrame:
    """(file, id, document): JSON text of each dataset's document, file names ``<id>-metadata.yaml``.

    ``product_bands``: product, bands. ``shared_grids`` is for ingested products: the grids of each product's first dataset
    (by id) whose grids are all known, else of its last, hold for all its datasets from there on, as they do when grids are
    worked out once. ``offsets`` adds properties from paths of a ``metadata`` column (JSON).
    """
    df = datasets.filter(F.size("uris") > 0).join(product_bands.select("product", "bands"), "product", "left")
    df = df.withColumn("__grids", grids(F.col("measurements"), F.col("transform"), band_grids))
    if shared_grids:
        when = F.when(known(F.col("__grids")), F.col("id"))
        done = df.groupBy("product").agg(F.min(when).alias("__first"), F.min_by("__grids", when).alias("__kept"))
        df = df.join(done, "product", "left").withColumn("__grids", F.when(F.col("id") > F.col("__first"), F.col("__kept")).otherwise(F.col("__grids"))).drop("__first", "__kept")
    number = F.col("measurements")
    kept = F.transform_values(
        defined(number, F.coalesce("bands", F.expr("CAST(array() AS array<string>)"))),
        lambda k, m: F.struct(m["path"].alias("path"), F.when(~m["band"].isin(0, 1), m["band"]).alias("band"), m["layer"].alias("layer"), band_grid(k, band_grids or {}).alias("grid")),
    )
    more = {name: F.get_json_object("metadata", "$" + "".join(f"['{k}']" for k in path.split("/"))) for name, path in (offsets or {}).items()}
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    properties = F.struct(stamp(F.col("center_time").cast("timestamp")).alias("datetime"), stamp(F.col("indexed_time").cast("timestamp")).alias("odc:processing_datetime"), *[c.alias(n) for n, c in more.items()])
    doc = F.struct(
        "id", F.concat(F.lit("EPSG:"), F.col("epsg").cast("string")).alias("crs"), F.col("uris").alias("location"), F.coalesce("format", F.lit("")).alias("file_format"),
        F.from_json("geometry", "struct<type:string,coordinates:array<array<array<double>>>>").alias("geometry"), F.col("__grids").alias("grids"), kept.alias("measurements"), properties.alias("properties"), F.col("sources").alias("lineage"),
    )
    return df.select(F.concat("id", F.lit("-metadata.yaml")).alias("file"), "id", F.to_json(doc).alias("document"))


_DOCUMENT = (
    "struct<crs:string,geometry:string,format:string,grids:map<string,struct<shape:array<bigint>,transform:array<double>>>,"
    "measurements:map<string,struct<path:string,band:int,layer:string,grid:string>>,lineage:map<string,array<string>>>"
)


def from_catalogue(rows: DataFrame, indexed_time: Column) -> DataFrame:
    """Exportable datasets of catalogue rows (id, product, uri, center_time, doc): shapes come from the grids of their documents."""
    d = F.from_json("doc", _DOCUMENT)
    df = rows.withColumn("d", d)
    grid = lambda m: F.try_element_at(F.col("d.grids"), F.coalesce(m["grid"], F.lit("default")))
    measured = F.transform_values("d.measurements", lambda _, m: F.struct(m["path"].alias("path"), m["band"].alias("band"), m["layer"].alias("layer"), grid(m)["shape"].alias("shape"), grid(m)["transform"].alias("transform")))
    return df.select(
        "id", "product", F.regexp_extract("d.crs", r"(\d+)$", 1).alias("epsg"), F.array_compact(F.array("uri")).alias("uris"), F.col("d.format").alias("format"), F.col("d.geometry").alias("geometry"), "center_time", indexed_time.alias("indexed_time"),
        F.try_element_at(F.col("d.grids"), F.lit("default"))["transform"].alias("transform"), measured.alias("measurements"), F.transform_values("d.lineage", lambda _, v: F.get(v, F.lit(0))).alias("sources"), F.col("doc").alias("metadata"),
    )


def write(documents_: DataFrame, folder: str) -> DataFrame:
    """Write each document as a YAML file of its own into ``folder``: (file, written, error)."""
    from gridsmith.sources import listing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        import yaml

        for batch in batches:
            text = [yaml.safe_dump(json.loads(d), default_flow_style=False, sort_keys=True).encode() for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.binary())], names=["url", "data"])

    made = documents_.select(F.concat(F.lit(folder.rstrip("/") + "/"), "file").alias("url"), "document").mapInArrow(run, "url string, data binary")
    return listing.put(made).select(F.regexp_extract("url", "([^/]*)$", 1).alias("file"), "written", "error")
