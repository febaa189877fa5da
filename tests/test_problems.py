import json
import os
import random

import pytest
from pyspark.sql import functions as F

from gridsmith.operators import changefeed, dedup, drift, nested
from gridsmith.plans import problems, reference
from gridsmith.sources import archive

CHANGES = "key string, instant long, tie long, live boolean"


def brute_live(changes, base=()):
    state = {k: (None, t) for k, t in base}
    for k, i, t, live in sorted((c for c in set(changes) if None not in c[:3]), key=lambda c: c[1:3]):
        if live:
            state[k] = (i, t)
        else:
            state.pop(k, None)
    return sorted((k, t) for k, (_, t) in state.items())


def test_changefeed_against_brute_force(spark, rows):
    rnd = random.Random(1)
    changes = [(rnd.choice("aaaaabcdef") if rnd.random() > 0.02 else None, rnd.randrange(40), n, rnd.random() < 0.6) for n in range(900)]
    changes += changes[::7]
    base = [("a", -5), ("z", -6)]
    df = spark.createDataFrame(changes, CHANGES)
    assert rows(changefeed.live_rows(df)) == brute_live(changes)
    assert rows(changefeed.live_rows(df, spark.createDataFrame(base, "key string, tie long"), salts=3)) == brute_live(changes, base)


def test_changefeed_empty_and_base(spark, rows):
    empty = spark.createDataFrame([], CHANGES)
    assert rows(changefeed.live_rows(empty)) == []
    assert rows(changefeed.live_rows(empty, spark.createDataFrame([("a", 1)], "key string, tie long"))) == [("a", 1)]


def test_actions(spark):
    df = spark.createDataFrame([("ADDED",), (" updated ",), ("Archived",), (None,), ("",), ("MOVED",)], "a string")
    assert [r[0] for r in df.select(changefeed.is_live(F.col("a"))).collect()] == [True, True, False, True, True, None]


def test_deletion_vectors(spark, tmp_path):
    rnd = random.Random(2)
    data = [(n, rnd.choice(["ID-1", "{id-1}", " id1", "urn:uuid:x2", "X2", None, f"u{n}"]), rnd.choice([None, 5, 6, 7]), "payload" * 3, "clash", "clash") for n in range(3000)]
    path = str(tmp_path / "t")
    spark.createDataFrame(data, "n long, id string, at long, body string, k string, file string").repartition(3).write.parquet(path)
    src = spark.read.parquet(path)
    bits = dedup.winner_bitmaps(dedup.with_positions(src), dedup.message_key(F.col("id")), [F.col("at"), F.col("n")])
    groups = {}
    for n, i, at, *_ in data:
        key = None if i is None else i.lower().removeprefix("urn:uuid:").strip(" {}").replace("-", "")
        groups.setdefault(key if key is not None else ("null", n), []).append((at is None, at or 0, n))
    want = sorted(min(g)[2] for g in groups.values())
    kept = dedup.apply_vectors(src, bits, ["n", "body", "k"])
    assert sorted(r["n"] for r in kept.collect()) == want
    gone = dedup.apply_vectors(src, bits, ["n"], keep=False)
    assert sorted(r["n"] for r in gone.collect()) == sorted(set(range(3000)) - set(want))


def test_deletion_vectors_by_row_group(spark, rows, tmp_path):
    """One file of many row groups, larger and smaller than a block of bits, and one without any row that remains."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 100_000
    one = pa.table({"n": range(n), "id": [f"m{k % 60_000}" for k in range(n)], "body": ["x" * (k % 7) for k in range(n)]})
    (tmp_path / "t").mkdir()
    pq.write_table(one.slice(0, 90_000), tmp_path / "t" / "a b.parquet", row_group_size=40_000)
    pq.write_table(one.slice(90_000), tmp_path / "t" / "c.parquet", row_group_size=777)
    src = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r["n"] for r in dedup.row_groups(src).collect())[-3:] == [10_000, 40_000, 40_000]
    bits = dedup.winner_bitmaps(dedup.with_positions(src), dedup.message_key(F.col("id")), [F.col("n")])
    kept = dedup.apply_vectors(src, bits, ["body", "n"], partitions=5)
    assert rows(kept) == rows(src.filter("n < 60000").select("body", "n"))
    assert [r["n"] for r in dedup.apply_vectors(src, bits, ["n"], keep=False).orderBy("n").collect()] == list(range(60_000, n))


def test_deletion_vectors_empty_table(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.createDataFrame([], "n long, id string").write.parquet(path)
    src = spark.read.parquet(path)
    bits = dedup.winner_bitmaps(dedup.with_positions(src), dedup.message_key(F.col("id")), [F.col("n")])
    assert dedup.apply_vectors(src, bits, ["n"], keep=False).count() == 0


DOC = {
    "id": "d1", "label": None, "product": {"name": "p"}, "crs": "epsg:1",
    "grids": {"default": {"shape": ["10", "20"], "transform": [[1, 0, "5.0"], [0, -1, 7], [0, 0, 1]]}, "g2": {"shape": [1, 2], "transform": [1, 0, 3, 0, 1, 4]}},
    "measurements": [{"name": "a", "path": "./a.tif"}, {"name": "b", "path": "../s/b.tif", "grid": "g2", "band": 2}, {"name": "c", "path": None}, {"name": "x", "path": "x.tif", "grid": "none"}],
    "accessories": {"t": {"path": "https://h/../t.jpg"}}, "lineage": {"l": ["p1", "p2"]},
}


def test_nested_tables(spark, rows):
    second = {"id": "d2", "measurements": {"a": {"path": "/top.tif", "grid": None}}, "grids": {"default": {"shape": [3], "transform": None}}}
    texts = ["﻿" + json.dumps([DOC, second]), json.dumps({"datasets": [DOC]}), None, "", "null", "{", '{"id":1', json.dumps(DOC)[:-40], "[]", "[null, 3]", "x" * 100000]
    df = spark.createDataFrame([(i, "s3://b/k/doc.json", t, "clash") for i, t in enumerate(texts)], "doc_no long, href string, doc string, kind string")
    got = rows(nested.measurement_grids(df))
    a, b = ("d1", "a", "default", 10, 20, 5, 7, "s3://b/k/a.tif"), ("d1", "b", "g2", 1, 2, 3, 4, "s3://b/s/b.tif")
    assert got == sorted([(0, *a), (0, *b), (1, *a), (1, *b), (0, "d2", "a", "default", 3, None, None, None, "s3://b/top.tif")], key=repr)
    tables = nested.flatten(df)
    assert {k: t.count() for k, t in tables.items()} == {"dataset": 3, "grid": 5, "measurement": 9, "accessory": 2, "lineage": 4, "property": 0, "geometry": 0, "other": 0}
    assert {r["dataset_id"] for r in tables["lineage"].collect()} == {"d1"}
    sets = {(r["doc_no"], r["dataset_pre"]): r["post"] for r in tables["dataset"].collect()}
    for t in ("grid", "measurement", "accessory", "lineage", "other"):
        assert all(r["dataset_pre"] < r["pre"] < r["post"] < sets[r["doc_no"], r["dataset_pre"]] for r in tables[t].collect())


def test_count_by_product_reads_every_form(spark, tmp_path):
    one = lambda n, product: {"id": f"d{n}", "product": product}
    texts = [json.dumps(x) for x in (one(1, {"name": "a"}), [one(2, {"name": "a"}), one(3, {"name": "b"})], {"datasets": [one(4, "a"), one(5, {"name": "b"})]}, {"product": "a"}, one(6, None))]
    df = spark.createDataFrame([(i, "s3://b/doc.json", t) for i, t in enumerate(["\ufeff" + texts[0], *texts[1:], "{", None])], "doc_no long, href string, doc string")
    df.write.parquet(f"{tmp_path}/odc_document.parquet")
    assert {r["product"]: r["n"] for r in reference.count_by_product(spark, str(tmp_path)).collect()} == {"a": 3, "b": 2, None: 1}


def leaves(x, path=""):
    inner = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()
    got = [y for k, v in inner for y in leaves(v, f"{path}[{k}]" if isinstance(x, list) else f"{path}.{k}" if path else k)]
    return got or [(path, x)]


def test_nested_tables_lose_nothing():
    tree = {
        "$schema": "s", "id": "d", "product": {"name": "p", "href": "h"}, "properties": {"a": 1, "b": {"c": [2, None]}, "e": {}}, "geometry": {"type": "Point", "coordinates": [1.5, 2]},
        "grids": {"default": {"shape": [1, 2], "transform": [1, 0, 3, 0, 1, 4], "crs": "epsg:1", "extra": 5}}, "measurements": {"m": {"path": "x", "layer": "l", "band": 2}, "odd": 7}, "accessories": None, "lineage": {"l": ["p1", 3]}, "unknown": [{"q": "w"}],
    }
    nodes = nested.walk(json.dumps(tree), "s3://b/d.json")
    at = lambda kind: {n["name"]: n for n in nodes if n["kind"] == kind}
    assert {k: json.loads(n["value"]) for k, n in at("property").items()} == dict(leaves(tree["properties"]))
    assert {k: json.loads(n["value"]) for k, n in at("other").items()} == {"$schema": "s", "product.name": "p", "product.href": "h", "measurements.odd": 7, "accessories": None, "lineage.l": 3, "unknown[0].q": "w"}
    assert json.loads(at("grid")["default"]["value"]) == {k: v for k, v in tree["grids"]["default"].items() if k != "crs"} and json.loads(at("measurement")["m"]["value"]) == {"layer": "l"}
    assert json.loads(at("geometry")["Point"]["value"]) == tree["geometry"] and [n["id"] for n in nodes if n["kind"] == "lineage"] == ["p1"]
    labels = sorted(x for n in nodes for x in (n["pre"], n["post"]))
    assert len(set(labels)) == len(labels)
    spans = sorted((n["pre"], n["post"]) for n in nodes)
    assert all(b[0] > a[1] or b[1] < a[1] for i, a in enumerate(spans) for b in spans[i + 1 :])
    assert [n["pre"] for n in nested.walk(json.dumps(tree), None, ("grid",), rest=False)] == [at("grid")["default"]["pre"]]


def test_tables_share_one_parse(spark):
    df = spark.createDataFrame([(1, "s3://b/doc.json", json.dumps(DOC))], "doc_no long, href string, doc string")
    plan = nested.flatten(df)["other"]._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "PartitionFilters: [isnotnull(kind" in plan


def test_nested_empty(spark):
    df = spark.createDataFrame([], "doc_no long, href string, doc string")
    assert nested.measurement_grids(df).count() == 0


def test_long_object_keys(spark, tmp_path):
    key = "tn-lists/ls_s2/day=2017/" + "k" * 1500 + ".json"
    df = spark.createDataFrame([(1, f"s3://{key}", "{}")], "file_no long, href string, body string").withColumn("n_bytes", F.lit(2)).withColumn("written_at", F.lit(None).cast("timestamp"))
    df.write.parquet(f"{tmp_path}/tiny_file.parquet")
    assert [tuple(r) for r in reference.inventory_filter(spark, str(tmp_path)).collect()] == [(1, key)]
    assert [r["name"] for r in reference.tar_round_trip(spark, str(tmp_path)).collect()] == [f"s3://{key}"]


def test_resolve():
    assert nested.resolve("s3://b/a/doc.json", "x/./y/../z.tif") == "s3://b/a/x/z.tif"
    assert nested.resolve("s3://b/doc.json", "../../z.tif") == "s3://b/z.tif"
    assert nested.resolve(None, "z.tif") is None
    assert nested.resolve(None, "https://h/a/../z.tif") == "https://h/z.tif"


LINES = "stream_no long, file_no long, line_no int, written_at timestamp, payload string"


def lines(spark, data):
    return spark.createDataFrame([(s, f, n, t, p) for s, f, n, t, p in data], "stream_no long, file_no long, line_no int, t long, payload string").withColumn("written_at", F.timestamp_seconds("t")).drop("t")


def test_drift_changes(spark, rows):
    data = [
        (1, 10, 0, 100, '{"id":"a","gsd":10,"eo:platform":"x","u":null}'), (1, 10, 1, 100, '{"id":"b","sparse":1.5}'), (1, 10, 1, 100, '{"id":"b","sparse":1.5}'),
        (1, 9, 0, 200, '{"id":"a","eo_gsd":10.0,"eo:platform":["x"],"u":1,"f":true}'), (1, 9, 1, 200, "broken"), (1, 9, 2, 200, None),
        (1, 11, 0, 300, ""), (2, 12, 0, 50, '{"id":1}'),
    ]
    got = rows(drift.changes(lines(spark, data)))
    want = [
        (9, "renamed", "gsd", "eo_gsd"), (9, "retyped", "gsd", "eo_gsd"), (9, "retyped", "eo:platform", "eo:platform"), (9, "removed", "sparse", ""), (9, "added", "", "f"),
        *[(11, "removed", f, "") for f in ("id", "eo_gsd", "eo:platform", "u", "f")],
    ]
    assert got == sorted(want, key=repr)


def test_renames_by_values(spark, rows):
    """No word list knows these names: kind and values tell; values that say nothing don't."""
    old = [json.dumps({"sat": f"ls{k % 2}", "elev": 10.5 + k, "flag": 1, "gone": "x", "on": True}) for k in range(6)]
    new = [json.dumps({"spacecraft": f"ls{k % 2}", "altitude": 10.5 + k, "count": 1, "fresh": "y", "off": True}) for k in range(6)]
    data = [(1, f, n, f, p) for f, ps in ((1, old), (2, new)) for n, p in enumerate(ps)]
    want = [(2, "renamed", "sat", "spacecraft"), (2, "renamed", "elev", "altitude"), *[(2, "removed", f, "") for f in ("flag", "gone", "on")], *[(2, "added", "", f) for f in ("count", "fresh", "off")]]
    assert rows(drift.changes(lines(spark, data))) == sorted(want, key=repr)


def test_nested_changes(spark, rows):
    data = [(1, 1, 0, 1, '{"a":{"b":1,"d":{"e":"x"}},"l":[{"q":1}]}'), (1, 2, 0, 2, '{"a":{"c":"x","d":{"e":2}},"l":[{"q":1}]}')]
    df = lines(spark, data)
    assert rows(drift.changes(df)) == []
    assert rows(drift.changes(df, depth=3)) == [(2, "added", "", "a.c"), (2, "removed", "a.b", ""), (2, "retyped", "a.d.e", "a.d.e")]
    got = rows(drift.statistics(df, ["file_no"], depth=4).filter("file_no = 1").drop("file_no"))
    assert got == [("a", "object", 1), ("a.b", "whole", 1), ("a.d", "object", 1), ("a.d.e", "text", 1), ("l", "list", 1)]


def test_drift_project(spark):
    df = lines(spark, [(1, 1, 0, 1, '{"eo:gsd":"30.0","platform":["p"],"cloud_cover":{"v":5}}'), (1, 1, 1, 1, '{"gsd_m":"x"}'), (1, 1, 2, 1, None)])
    got = [tuple(r) for r in drift.project(df, {"gsd": "double", "platform": "string", "cloudcover": "double"}, ["line_no"]).orderBy("line_no").collect()]
    assert got == [(0, 30.0, "p", 5.0, []), (1, None, None, None, ["gsd_m"]), (2, None, None, None, [])]


def test_drift_keeps_every_value(spark):
    data = [
        (1, 1, 0, 1, '{"gsd":"10","n:count":3,"platform":{"name":"p","serial":7},"proj:shape":[4,5],"ok":true,"void":null}'),
        (1, 2, 0, 2, '{"gsd":"x","eo:gsd":20.5,"count":"007","shape":[6],"ok":false,"late":{"a":[1]}}'), (1, 2, 1, 2, '{"gsd":12.5,"count":9}'),
    ]
    df = lines(spark, data)
    target = drift.columns(df, ["file_no", "line_no", "rest"], known={"gsd": "double", "platform": "string"})
    assert target == {"gsd": "double", "platform": "string", "count": "bigint", "ok": "boolean", "shape": "json", "late": "json"}
    got = {(r["file_no"], r["line_no"]): r.asDict() for r in drift.project(df, target, ["file_no", "line_no"], rest="rest").collect()}
    first, second, third = got[1, 0], got[2, 0], got[2, 1]
    assert (first["gsd"], first["count"], first["platform"], first["shape"], first["ok"], first["failed_casts"]) == (10.0, 3, "p", "[4,5]", True, [])
    assert {k: json.loads(v) for k, v in first["rest"].items()} == {"platform": {"name": "p", "serial": 7}}
    assert (second["gsd"] is None, second["count"], second["late"], second["failed_casts"]) == (True, 7, '{"a":[1]}', ["gsd"])
    assert {k: json.loads(v) for k, v in second["rest"].items()} == {"gsd": "x", "eo:gsd": 20.5, "count": "007"}
    assert (third["gsd"], third["count"], third["rest"]) == (12.5, 9, {})


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_whole_line_table(spark):
    """Every non-null value of every line is in its column or in the rest map, and the columns of the SQL have the SQL's rows."""
    import duckdb

    d = "/root/testdata/sf0.001"
    t = problems.p4_table(spark, d)
    rows = t.collect()
    cores = set(t.columns) - {"line_key", "file_no", "failed_casts", "rest"}
    payload = {r["line_key"]: json.loads(r["payload"]) for r in spark.read.parquet(f"{d}/metadata_line.parquet").collect()}
    names = sorted({f for p in payload.values() for f in p})
    core = dict(zip(names, spark.createDataFrame([(f,) for f in names], "f string").select(drift.core_name(F.col("f"))).toPandas().iloc[:, 0]))
    assert cores == {core[f] for p in payload.values() for f, v in p.items() if v is not None} and len(cores) > 15
    for r in rows:
        rest = dict(x.split("=", 1) for x in r["rest"].split("\n") if x)
        for field, v in payload[r["line_key"]].items():
            if v is None:
                continue
            if field in rest:
                assert json.loads(rest[field]) == v
            else:
                got = r[core[field]]
                assert json.loads(got) == v if isinstance(v, (list, dict)) else str(got) == str(v) or float(got) == float(v)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW metadata_line AS SELECT * FROM read_parquet('{d}/metadata_line.parquet')")
    want = db.sql(problems.ORACLES["p4_table"])
    assert sorted((tuple(r[c] for c in want.columns) for r in rows), key=repr) == sorted(want.fetchall(), key=repr)


def test_drift_empty(spark):
    assert drift.changes(lines(spark, [])).count() == 0


def test_archive_round_trip(spark, tmp_path):
    rnd = random.Random(3)
    files = [(n, f"p{n % 90}", rnd.choice([None, "", "x" * rnd.randrange(3000), "é\n" * 5])) for n in range(400)]
    df = spark.createDataFrame(files, "file_no long, href string, body string")
    at = f"file://{tmp_path}/a b"
    packed = archive.pack(df, at, block_bytes=20_000)
    assert packed.count() == 400 and 5 < packed.select("container").distinct().count() < 100
    back = [(r["file_no"], r["path"], None if r["body"] is None else r["body"].decode()) for r in archive.unpack(packed).collect()]
    assert sorted(back, key=repr) == sorted(files, key=repr)
    for asked in (["p3", "p5"], spark.createDataFrame([("p3",), ("p5",), ("p5",), ("none",)], "p string")):
        assert sorted(r["file_no"] for r in archive.lookup(packed, asked).collect()) == sorted(n for n, p, _ in files if p in ("p3", "p5"))
    assert "PushedFilters: [In(path, [p3,p5])]" in archive.lookup(packed, ["p3", "p5"])._jdf.queryExecution().executedPlan().toString()
    # What a lost attempt leaves is no file of the archive.
    (tmp_path / "a b" / "containers" / "000000-000000-999.pack").write_bytes(b"left over")
    assert archive.sweep(spark, at) == 1 and archive.unpack(archive.index(spark, at)).count() == 400
    one = next((tmp_path / "a b" / "containers").glob("*.pack"))
    one.write_bytes(b"?" + one.read_bytes()[1:])
    with pytest.raises(Exception, match="checksum"):
        archive.unpack(packed).collect()
    assert archive.unpack(archive.pack(df.limit(0), f"{at}0")).count() == 0


def test_complete_records():
    rec = {"href": "h", "etag": '"e"', "size": 1}
    j = json.dumps(rec)
    assert list(archive.complete_records(j + "\r\n" + j)) == [rec, rec]
    assert list(archive.complete_records("[" + j + "," + j[:-5])) == [rec]
    assert list(archive.complete_records(j[9:] + j)) == [rec]
    assert rec in list(archive.complete_records(json.dumps({"records": [rec]})))
    assert list(archive.complete_records("")) == []


def test_records(spark, rows, tmp_path):
    bodies = ['{"href":"a","etag":"\\"1\\""}', '{"href":"a","etag":"1","size":7}\n{"href":"b","etag":null}', '{"href":"c","etag":"2"', None, ""]
    df = spark.createDataFrame([(i, "p", b) for i, b in enumerate(bodies)], "file_no long, href string, body string")
    assert rows(archive.records(archive.pack(df, str(tmp_path / "r"))).select("href", "etag").distinct()) == [("a", "1")]
