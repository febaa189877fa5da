import argparse
import fnmatch
import json
import uuid
from pathlib import PurePosixPath

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsmith.functions import geo, globs, identifiers, items, raster, text, urls
from gridsmith.operators import catalogue
from gridsmith.sources import docs, listing, queue


def values(spark, column, *data, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(d,) for d in data], schema).select(column).collect()]


def test_uuid5(spark):
    names = ["", "abc", "naïve ☃", "x" * 500]
    ns = uuid.UUID(identifiers.NAMESPACE)
    assert values(spark, identifiers.uuid5(F.col("x")), *names) == [str(uuid.uuid5(ns, n)) for n in names]
    one, two = (spark.range(1).select(identifiers.dataset_uuid("Algo", "1", F.array(*[F.lit(v) for v in vs]), tags={"t": F.lit("v")})).first()[0] for vs in (["a", "b"], ["b", "a"]))
    assert one == two == str(uuid.uuid5(ns, "algo\n1\n\nt=v\na\nb"))


def test_canonical_uuid(spark):
    u = "8b1f2f5e-3c5a-4d3e-9a53-0f4a6d9b1c11"
    forms = [u, u.upper(), "{" + u + "}", "urn:uuid:" + u, u.replace("-", "")]
    assert values(spark, identifiers.canonical_uuid(F.col("x")), *forms, "nope", None) == [u] * 5 + [None, None]


def test_urls(spark):
    assert values(spark, urls.object_address(F.col("x"))["key"], "s3://b/a/c", "s3://b", "https://b/a", None) == ["a/c", "", None, None]
    df = spark.createDataFrame([("s3://b/x/y/a.tif", "s3://b/x/item.json"), ("s3://c/x/a.tif", "s3://b/x/item.json"), ("s3://b/z/a.tif", "s3://b/x/item.json"), ("q", None)], "h string, s string")
    assert [r[0] for r in df.select(urls.relative_path(F.col("h"), F.col("s"))).collect()] == ["y/a.tif", "s3://c/x/a.tif", "s3://b/z/a.tif", "q"]


def test_parse_query():
    q = globs.parse_query
    assert q("s3://store/one/two") == globs.Query("s3://store/one/two/", None, None, None)
    assert q("s3://b/p/*/*/") == globs.Query("s3://b/p/", 2, None, None, ("*", "*"))
    assert q("s3://b/p/*/*/f.yaml") == globs.Query("s3://b/p/", 2, "f.yaml", None, ("*", "*"))
    assert q("s3://b/p/**/*.yaml") == globs.Query("s3://b/p/", -1, None, "*.yaml", ())
    assert q("s3://b") == q("s3://b/") == globs.Query("s3://b/", None, None, None)
    assert q("s3://b/x[ab]/mid/l.json") == globs.Query("s3://b/", 2, "l.json", None, ("x[ab]", "mid")) and q("s3://b/p/**/f.json") == globs.Query("s3://b/p/", -1, "f.json", None, ())
    assert q("s3://b/p/*.yaml") == globs.Query("s3://b/p/", 0, None, "*.yaml", ())
    with pytest.raises(ValueError):
        q("s3://b/p/**/x/*.yaml")


def test_globs_against_fnmatch(spark):
    urls_ = ["s3://b/a/foo1.yaml", "foo.yaml", "s3://b/foo[1].yaml", "s3://b/x y.json", "s3://b/a\nb"]
    for pattern in ["*.yaml", "foo*", "*foo?.yaml", "*[0-9].y*", "*[!0-9].yaml", "*[[]1].yaml", "*", "s3://b/a+b"]:
        got = values(spark, F.col("x").rlike(globs.url_regex(pattern)), *urls_)
        assert got == [fnmatch.fnmatchcase(u, pattern) for u in urls_], pattern
    keys = ["a/b/c.json", "/b/c.json", "b/c.json", "x/c.json", "a/b/c/c.json"]
    for pattern in ["b/*.json", "*.json", "/b/*.json", "b/?.json"]:
        assert values(spark, F.col("x").rlike(globs.path_regex(pattern)), *keys) == [PurePosixPath(k).match(pattern) for k in keys], pattern


def test_text(spark):
    assert values(spark, text.int_range(F.col("x"))["stop"], "1:2", "a:2", "1", None) == [2, None, None, None]
    assert values(spark, text.slice_of(F.col("x"))["step"], "1::3", ":4", "x") == [3, None, None]
    assert values(spark, text.options(F.col("x")), "a=1#b=2#c#d=1=2") == [{"a": "1", "b": "2"}]
    assert values(spark, text.options(F.col("x")), "a=1#b=2#a=3#a=", "", None) == [{"b": "2", "a": ""}, {}, None]
    assert values(spark, text.flag(F.col("x")), "yes", "T", "0", None) == [True, True, False, False]
    assert values(spark, text.complete_json(F.col("x")), '{"x":1}', ' [1] \n', '{"x":1} junk', '{"x":1}\n{"y":2}', '{"x":1},{"y":2}', '{"x":1}] [1]', '{"x":1}} {', "", None) == [True, True, *[False] * 7]
    assert text.yaml_setting("{a: [1, b]}") == {"a": [1, "b"]} and text.range_2d_option("1:2,-3:4") == ((1, 2), (-3, 4)) and text.slice_option("1::3") == slice(1, None, 3)
    for call in (lambda: text.yaml_setting("nofile"), lambda: text.range_2d_option("1:2"), lambda: text.slice_option("a:b")):
        with pytest.raises((OSError, argparse.ArgumentTypeError)):
            call()
    assert json.loads(text.group_text('GROUP = A\nX = -1.5e3\nY = 2015-01-01\nEND_GROUP = A\n')) == {"A": {"X": -1500.0, "Y": "2015-01-01"}}
    assert json.loads(text.group_text('GROUP = A\nX = 1\nY = "q"\nEND_GROUP = A\nEND\n')) == {"A": {"X": 1, "Y": "q"}}
    for bad in ("GROUP = A\nEND_GROUP = B", "END_GROUP = A", "X = 1\nX = 2", "junk"):
        assert text.group_text(bad) is None
    assert text.yaml_documents("a: 1\n---\nb: [2]") == ['{"a": 1}', '{"b": [2]}'] and text.yaml_documents("a: [") is None


def test_geo(spark):
    assert geo.tiles(spark, (5, 5, 7, 7)).count() == 4
    assert geo.tiles(spark, (-20, -40, 60, 40), 1, limit=5).count() == 5
    assert geo.tiles(spark, (-18, -38, 60, 30), 3).first()["tile"] == "W018_S39"
    with pytest.raises(ValueError):
        geo.tiles(spark, (7, 5, 5, 7))
    assert values(spark, geo.period_step(F.col("x")), "2019", "2019-12", "2019-12-31", "zz") == ["2020", "2020-01", "2020-01-01", None]
    assert geo.hull([[0, 0], [2, 0], [1, 1], [2, 2], [0, 2], [1, 0]]) == [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    assert geo.simplify([(0, 0), (1, 0.0001), (2, 0), (2, 5)], 0.01) == [(0, 0), (2, 0), (2, 5)]
    east, north = geo.transverse_mercator(3.0, 0.0, 31, False)
    assert abs(east - 500000) < 1e-6 and abs(north) < 1e-6
    g = {"type": "MultiPolygon", "coordinates": [[[[9, 48], [9.1, 48], [9.1, 48.1], [9, 48]]]]}
    assert geo.project_geometry(g, 32632)["type"] == "Polygon" and geo.project_geometry(g, 2154) is None
    # The origin, and the worked example of the projection's definition (NAD 27 there; the ellipsoid moves it by tens of metres).
    assert all(abs(x) < 1e-6 for x in geo.equal_area_conic(132, 0, 3577)) and abs(geo.equal_area_conic(-75, 35, 5070)[0] - 1885427) < 100
    x, y = geo.equal_area_conic(149.1, -35.3, 3577)
    assert abs(x - 1_550_000) < 10_000 and abs(y + 3_960_000) < 20_000
    assert [round(v) for v in geo.web_mercator(180, 0)] == [20037508, 0]


def test_geomedian_over_converges(spark, monkeypatch):
    far = [[0.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.2, 1.1], [900.0, 700.0], [800.0, 950.0]]
    near = [[0.0, 0.0], [0.0, 2.0], [2.0, 0.0], [2.0, 2.0]]
    df = spark.createDataFrame([("far", v) for v in far] + [("near", v) for v in near] + [("near", None)], "g string, v array<double>")
    got = {r["g"]: np.array(r["median"]) for r in raster.geomedian_over(df, "g", "v", eps=1e-5).collect()}
    assert np.abs(got["far"] - raster.geometric_median(np.array(far), eps=1e-12, most=10_000)).max() < 1e-3
    assert np.abs(got["near"] - 1.0).max() < 1e-9
    with pytest.raises(RuntimeError):
        raster.geomedian_over(df, "g", "v", steps=3)
    monkeypatch.setattr(raster, "MOST_CENTRES", 1)
    joined = {r["g"]: np.array(r["median"]) for r in raster.geomedian_over(df, "g", "v", eps=1e-5).collect()}
    assert all(np.abs(joined[g] - got[g]).max() < 1e-9 for g in got)


def test_raster(spark):
    df = spark.createDataFrame([(0.0,), (20.0,), (90.0,), (-9.0,)], "v double")
    assert [tuple(r[0]) for r in df.select(raster.rgba(F.col("v"), F.col("v"), F.col("v"), F.lit(40.0), F.lit(-9.0))).collect()] == [(0, 0, 0, 255), (127, 127, 127, 255), (255, 255, 255, 255), (0, 0, 0, 0)]
    assert raster.png(np.zeros((2, 3, 3), np.uint8))[:4] == b"\x89PNG"
    rnd = np.random.default_rng(3)
    smooth = np.clip(np.add.outer(np.arange(37) * 5, np.arange(50) * 2)[:, :, None] + np.array([0, 20, 40]) + rnd.normal(0, 3, (37, 50, 3)), 0, 255).astype(np.uint8)
    assert (raster.png_pixels(raster.png(smooth)) == smooth).all() and (raster.png_pixels(raster.png(smooth[:, :, 0])) == smooth[:, :, :1]).all()

    def decoded(data):
        """By Java's own decoder."""
        jvm = spark.sparkContext._jvm
        im = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
        return np.array([[[im.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(im.getWidth())] for y in range(im.getHeight())])

    noise = rnd.integers(0, 256, (9, 17, 3)).astype(np.uint8)
    assert np.abs(decoded(raster.jpeg(smooth, 95)).astype(int) - smooth).mean() < 2.5 and np.abs(decoded(raster.jpeg(noise, 100)).astype(int) - noise).mean() < 3
    assert np.abs(decoded(raster.jpeg(smooth, 30)).astype(int) - smooth).mean() < 12 and decoded(raster.jpeg(smooth[:, :, 0], 90)).shape == (37, 50, 3)
    clear = np.concatenate([smooth[:8, :8], np.zeros((8, 8, 1), np.uint8)], axis=2)
    assert np.abs(decoded(raster.jpeg(clear, 95, (10, 200, 30))) - np.array([10, 200, 30])).max() < 6
    m = raster.geometric_median(np.array([[0.0, 0], [0, 0.1], [0.1, 0], [50, 50]]))
    assert np.linalg.norm(m) < 1
    px = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 2.0]), (2, None)], "p int, v array<double>")
    assert [r["p"] for r in raster.geomedian_pixels(px, ["p"], "v").collect()] == [1]
    im = spark.createDataFrame([("i", 0, 0, 1, 2, 3), ("i", 1, 0, 4, 5, 6)], "k string, x int, y int, r int, g int, b int")
    assert raster.image_bytes(im, ["k"]).first()["png"][1:4] == b"PNG"


ITEM = {
    "id": "S2X", "collection": "sentinel-2-l2a", "links": [{"rel": "self", "href": "s3://b/x/i.json"}, {"rel": "canonical", "href": "s3://b/c.json"}],
    "geometry": {"type": "Polygon", "coordinates": [[[9, 48], [9.1, 48], [9.1, 48.1], [9, 48]]]},
    "properties": {"constellation": "Sentinel 2", "proj:epsg": 32632, "mgrs:latitude_band": "U", "mgrs:grid_square": "MU", "datetime": "2020-01-01T00:00:00Z", "instruments": ["msi"], "gsd": 10, "odc:lineage": {"a": ["b"]}},
    "assets": {
        "b2": {"href": "s3://b/x/b2.tif", "type": "image/tiff; geotiff", "proj:shape": [5, 5], "proj:transform": [20, 0, 1, 0, -20, 2]},
        "b1": {"href": "s3://b/x/b1.tif", "type": "image/jp2", "band": 2, "proj:shape": [9, 9], "proj:transform": [10, 0, 1, 0, -10, 2]},
        "th": {"href": "s3://b/x/t.jp2", "type": "image/jp2", "roles": ["thumbnail"]},
    },
}


def test_items(spark):
    plain = ITEM | {"id": str(uuid.uuid4()), "collection": "some-coll", "properties": {"odc:region_code": "r", "proj:epsg": 4326, "landsat:wrs_path": "x"}}
    df = spark.createDataFrame([(1, json.dumps(ITEM)), (2, json.dumps(plain)), (3, "broken"), (4, None)], "k int, item string")
    out = {r["k"]: r for r in items.to_datasets(df, "k").collect()}
    a, b = out[1], out[2]
    assert (a["product"], a["label"], a["crs"]) == ("s2_l2a", "S2X", "epsg:32632") and len(a["id"]) == 36
    assert a["properties"]["odc:region_code"] == "32UMU" and a["properties"]["eo:instrument"] == "MSI" and a["properties"]["odc:file_format"] == "GeoTIFF" and "odc:lineage" not in a["properties"]
    assert set(a["grids"]) == {"default", "g20m"} and a["measurements"]["b2"]["grid"] == "g20m" and a["measurements"]["b1"]["grid"] is None and a["measurements"]["b1"]["band"] == 2
    assert a["accessories"]["th"]["path"] == "t.jp2" and a["lineage"] == {"a": ["b"]} and json.loads(a["geometry"])["type"] == "Polygon"
    assert b["product"] == "some_coll" and b["id"] == plain["id"] and set(b["grids"]) == {"default", "g10m"}
    assert out[3]["product"] is None and out[4]["id"] is None
    uri = spark.createDataFrame([(json.dumps(ITEM),)], "item string")
    assert items.read_items(uri).select(items.item_uri(F.col("it.links"))).first()[0] == "s3://b/c.json"
    back = items.to_items(items.to_datasets(df.filter("k = 1"), "k").withColumn("uri", F.lit("s3://b/x/d.yaml"))).first()["item"]
    twice = spark.createDataFrame([(7, json.dumps(ITEM | {"properties": {"gsd": 1, "eo:gsd": 2, "proj:epsg": 1}}))] * 2 + [(7, json.dumps(ITEM | {"properties": {"eo:gsd": 2, "gsd": 1}}))], "k int, item string")
    assert sorted(r["properties"]["eo:gsd"] for r in items.to_datasets(twice, "k").collect()) == ["1", "2", "2"]
    names = values(spark, items.grid_name(F.array("x")), 10.0, 0.5, 1 / 3600, 1 / 12000, 1e6, 123456.7, 1234567.0, 0.0001, 0.00001, 30.0, -10.0, 0.0, schema="x double")
    assert names == [f"g{x:g}m" for x in (10.0, 0.5, 1 / 3600, 1 / 12000, 1e6, 123456.7, 1234567.0, 0.0001, 0.00001, 30.0, -10.0, 0.0)]
    renamed = values(spark, items.renamed_product(F.col("x"), "new"), json.dumps(ITEM))[0]
    assert json.loads(renamed) == ITEM | {"properties": ITEM["properties"] | {"odc:product": "new"}}
    assert values(spark, items.metadata_link(F.col("x"), "STAC-LINKS-REL:canonical"), json.dumps(ITEM)) == ["s3://b/c.json"] and values(spark, items.metadata_link(F.col("x"), "properties/datetime"), json.dumps(ITEM)) == ["2020-01-01T00:00:00Z"]
    assert json.loads(back)["properties"]["gsd"] == "10" and json.loads(back)["assets"]["b1"]["href"] == "s3://b/x/b1.tif"


CAT = "id string, product string, region_code string, center_time timestamp, maturity string, uri string, archived_time timestamp, seq long"


def cat(spark, *data):
    df = spark.createDataFrame([(i, "p", "r", t, m, u, n) for n, (i, t, m, u) in enumerate(data)], "id string, product string, region_code string, t long, maturity string, uri string, seq long")
    return df.withColumn("center_time", F.timestamp_seconds("t")).withColumn("archived_time", F.lit(None).cast("timestamp")).drop("t")


def test_decisions(spark):
    old = cat(spark, ("a", 0, "nrt", "u"))
    new = cat(spark, ("a", 0, "nrt", "u"), ("b", 0, None, "u"), ("c", 0, None, None), (None, 0, None, "u"))
    get = lambda **k: {r["seq"]: r["status"] for r in catalogue.statuses(new, old, **k).collect()}
    assert get() == {0: "skipped", 1: "added", 2: "failed", 3: "failed"}
    assert get(update=True) == {0: "updated", 1: "failed", 2: "failed", 3: "failed"}
    assert get(update_if_exists=True) == {0: "updated", 1: "added", 2: "failed", 3: "failed"}


def test_maturity(spark):
    old = cat(spark, ("n", 100, "nrt", "u"), ("f", 900, "final", "u"))
    new = cat(spark, ("x", 100, "final", "u"), ("y", 900, "nrt", "u"), ("z", 900, None, "u"))
    judged = catalogue.statuses(new, old, archive_less_mature=500)
    assert {r["id"]: r["status"] for r in judged.collect()} == {"x": "added", "y": "skipped", "z": "added"}
    after = {r["id"]: r["archived_time"] for r in catalogue.apply(judged, old, F.current_timestamp(), 500).collect()}
    assert set(after) == {"n", "f", "x", "z"} and after["n"] is not None and after["f"] is None
    sent = [(r["id"], r["action"]) for r in catalogue.events(judged, old, 500).orderBy("cause", "n").collect()]
    assert sent == [("n", "ARCHIVED"), ("x", "ADDED"), ("z", "ADDED")]


def test_archive_and_search(spark):
    c = cat(spark, ("a", 5, None, "u"), ("b", 3, None, None))
    gone = catalogue.archive(c, spark.createDataFrame([("a",)], "id string"), F.current_timestamp())
    assert [r["id"] for r in catalogue.search(gone).collect()] == ["b"]
    assert [r["id"] for r in catalogue.search(c, "p", limit=1).collect()] == ["b"]
    with pytest.raises(ValueError):
        catalogue.search(c, limit=0)


def test_lineage_and_products(spark):
    e = spark.createDataFrame([("a", "l", "p1"), ("a", "l", "p2")], "child string, label string, parent string")
    assert [r["parent"] for r in catalogue.missing_parents(e, spark.createDataFrame([("p1",)], "id string")).collect()] == ["p2"]
    docs_ = lambda x: spark.createDataFrame(x, "id string, doc string")
    assert [r[0] for r in catalogue.differing_parents(docs_([("a", '{"x": 1,"y":2}'), ("b", '{"x":1}')]), docs_([("a", '{"y":2,"x":1}'), ("b", '{"x":2}')])).collect()] == ["b"]


def test_listing(spark, rows, tmp_path):
    o = spark.createDataFrame([(u, 1, None, "e") for u in ("s3://b/a/x.yaml", "s3://b/a/c/y.yaml", "s3://b/z.yaml", "s3://c/q")], "url string, size long, last_modified timestamp, etag string")
    assert rows(listing.one_level(o, "s3://b")) == [("s3://b/a/", True), ("s3://b/z.yaml", False)]
    assert rows(listing.find(o, "s3://b/*/")) == [("s3://b/a/",)]
    assert [r["url"] for r in listing.find(o, "s3://b/**/*.yaml").orderBy("url").collect()] == ["s3://b/a/c/y.yaml", "s3://b/a/x.yaml", "s3://b/z.yaml"]
    assert rows(listing.keys(o, "s3://b/a/")) == [("c/y.yaml",), ("x.yaml",)]
    assert listing.dirs_at_depth(o, "s3://b", 0).first()[0] == "s3://b/"
    with pytest.raises(Exception, match="bad guide"):
        listing.walk(o, "s3://b/", F.lit("nonsense")).collect()
    (tmp_path / "f").write_bytes(b"0123456789")
    got = listing.fetch(spark.createDataFrame([("s3://m/f", 2, 5), ("s3://m/none", None, None), ("s3://m/f", 5, 2)], "url string, start long, stop long"), {"s3://m/": str(tmp_path)})
    out = {(r["url"], r["start"]): (r["data"] and bytes(r["data"]), r["error"]) for r in got.collect()}
    assert out == {("s3://m/f", 2): (b"234", None), ("s3://m/none", None): (None, "not found"), ("s3://m/f", 5): (None, "bad range")}
    many = spark.range(300).select(F.concat(F.lit("s3://m/f#"), "id").alias("url"), F.lit(0).alias("start"), F.lit(4).alias("stop"))
    many = many.withColumn("url", F.lit("s3://m/f")).union(spark.createDataFrame([(None, None, None)], "url string, start long, stop long"))
    got = listing.fetch(many, {"s3://m/": str(tmp_path)}, connections=3).groupBy("data", "error").count().collect()
    assert {(r["data"] and bytes(r["data"]), r["error"] is None): r["count"] for r in got} == {(b"0123", True): 300, (None, False): 1}
    with pytest.raises(ValueError):
        listing.inventory(spark, {"fileFormat": "CSV"}, str)


def test_documents(spark, rows, tmp_path):
    raw = spark.createDataFrame([("a.json", '{"x":1}'), ("b.json", "{"), ("c.yaml", "x: 1\n---\ny: 2"), ("d.yaml", "x: [")], "uri string, content string")
    assert rows(docs.parsed(raw).select("uri", "doc")) == [("a.json", '{"x":1}'), ("b.json", None), ("c.yaml", '{"x": 1}'), ("c.yaml", '{"y": 2}'), ("d.yaml", None)]
    f = spark.createDataFrame([("n1", b"one"), ("n2", None), ("d/n3", b"")], "name string, content binary")
    assert docs.write_tars(f, str(tmp_path / "t")).agg(F.sum("n")).first()[0] == 2
    assert sorted((r["name"], bytes(r["content"])) for r in docs.tar_members(spark, str(tmp_path / "t/*.tar.gz")).collect()) == [("d/n3", b""), ("n1", b"one")]
    assert [r["name"] for r in docs.tar_members(spark, str(tmp_path / "t/*.tar.gz"), lambda m: m.size > 0).collect()] == ["n1"]
    assert docs.tar_mode(True, True) == ":gz" and docs.tar_mode(pipe=True) == "|"


def test_queue(spark):
    m = spark.createDataFrame([(n,) for n in range(35)], "n long")
    assert sorted(r["count"] for r in queue.batches(m, "n").groupBy("batch").count().collect()) == [5, 10, 10, 10]
    moved, dead, live = queue.redrive(m, m.limit(0), "n", limit=12)
    assert (moved, dead.count(), live.count()) == (12, 23, 12)
    assert queue.redrive(m, m.limit(0), "n", dry_run=True)[0] == 35
    with pytest.raises(ValueError):
        queue.limited(m, 0, "n")
    body = json.dumps({"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": k}}} for k in ("x", "y")]})
    n = spark.createDataFrame([(body,), ("{}",)], "body string")
    assert [r["url"] for r in queue.notified_objects(n).collect()] == ["s3://b/x", "s3://b/y"]
    assert [r["url"] for r in queue.notified_objects(n, last_only=True).collect()] == ["s3://b/y"]


def test_listing_source(spark, rows, tmp_path):
    from gridsmith.sources import datasource

    for name in ("a/x/1.json", "a/2.json", "b/3.json", "top.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("12345")
    datasource.register(spark)
    df = spark.read.format("object_listing").option("path", str(tmp_path)).load()
    assert sorted(r["url"] for r in df.collect()) == sorted(f"{tmp_path}/{n}" for n in ("a/x/1.json", "a/2.json", "b/3.json", "top.json"))
    only = df.filter(F.col("url").startswith(f"{tmp_path}/a/"))
    assert sorted(r["size"] for r in only.collect()) == [5, 5]
    reader = datasource.ListingReader(str(tmp_path))
    list(reader.pushFilters([datasource.StringStartsWith(("url",), f"{tmp_path}/a/x")]))
    assert sorted(f for p in reader.partitions() for f, _ in p.folders) == [str(tmp_path), f"{tmp_path}/a", f"{tmp_path}/a/x"]


def test_view(spark):
    assert catalogue.view(spark.range(5), 5) == (5, None) and catalogue.view(spark.range(4), 5)[0] == 4
