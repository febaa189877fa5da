import json

import pytest

from gridsmith.cli import run
from gridsmith.operators.store import Store


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)


def doc(i, maturity="nrt"):
    return json.dumps({"id": i, "product": {"name": "p"}, "properties": {"odc:region_code": "r", "datetime": "2020-01-01T00:00:00Z", "dea:dataset_maturity": maturity}})


def test_index_skip_archive_and_summary(spark, tmp_path, capsys):
    folder, cat = tmp_path / "docs", f"file://{tmp_path}/cat"
    write(folder, a__json=doc("a"), b__yaml="id: b\nproduct: {name: q}\n")
    out = lambda *argv: (run(spark, list(argv)), capsys.readouterr().out.strip())
    assert out("index", str(folder), cat) == (0, '{"added": 2}')
    assert out("index", str(folder), cat) == (0, '{"skipped": 2}')
    write(folder, a__json=doc("c", "final"), x__json="{")
    (folder / "b.yaml").unlink()
    code, text = out("index", str(folder), cat, "--archive-less-mature", "500")
    assert code == 1 and json.loads(text) == {"added": 1, "failed": 1}
    rows = {r["id"]: r["archived_time"] is not None for r in Store(spark, cat).read().collect()}
    assert rows == {"a": True, "b": False, "c": False}
    assert [(r["id"], r["action"]) for r in Store(spark, cat).outbox().filter("cause = 'c'").orderBy("n").collect()] == [("a", "ARCHIVED"), ("c", "ADDED")]
    (tmp_path / "ids").write_text("b\n\n")
    assert out("archive", str(tmp_path / "ids"), cat)[0] == 0
    assert {r["id"] for r in Store(spark, cat).read().filter("archived_time IS NULL").collect()} == {"c"}
    assert len(out("summary", cat)[1].splitlines()) == 2
    assert out("export", cat, str(tmp_path / "exp"))[0] == 0


def test_tars_tiles_find_and_products(spark, tmp_path, capsys):
    folder = tmp_path / "d"
    write(folder, a__json=doc("a"), p__yaml="name: p\n---\nname: q\n")
    out = lambda *argv: (run(spark, list(argv)), capsys.readouterr().out.strip())
    assert out("to-tar", str(folder), str(tmp_path / "t"), "--pattern", "*.json") == (0, "1")
    assert out("index-tar", f"{tmp_path}/t/*.tar.gz", f"file://{tmp_path}/c2") == (0, '{"added": 1}')
    assert out("tiles", "--box", "5,5,7,7")[1].split() == ["E005_N05", "E005_N06", "E006_N05", "E006_N06"]
    assert out("find", str(folder), f"file:{folder}/*.json")[1].endswith("a.json")
    (tmp_path / "l.csv").write_text("product,definition\np;q,x/p.yaml\nz,x/none.yaml\n")
    (folder / "a.json").unlink()
    code, text = out("sync-products", str(tmp_path / "l.csv"), str(folder), f"file://{tmp_path}/c2")
    assert code == 1 and sorted(text.splitlines()) == ["p\tunchanged", "q\tadded", "z\tfailed"]


def items_in(folder, n=3):
    folder.mkdir(exist_ok=True)
    for k in range(n):
        item = {"id": f"i{k}", "collection": "c", "properties": {"datetime": f"202{k}-01-01T00:00:00Z", "proj:epsg": 4326, "odc:region_code": f"r{k}"}, "links": [{"rel": "self", "href": f"s3://b/{k}.json"}], "assets": {"m": {"href": f"s3://b/{k}.tif", "type": "image/tiff; geotiff", "proj:shape": [2, 3], "proj:transform": [1, 0, 0, 0, -1, 0]}}}
        (folder / f"{k}.json").write_text(json.dumps(item))
    return [json.loads(p.read_text()) for p in sorted(folder.iterdir())]


def test_queue_until_empty_and_again(spark, tmp_path, capsys):
    """Two runs over one queue, the second with new messages; nothing is done twice."""
    cat, q = f"file://{tmp_path}/cat", tmp_path / "q"
    body = lambda m, action=None: json.dumps({"Message": json.dumps(m), "MessageAttributes": {"action": {"Type": "String", "Value": action}} if action else {}})
    made = items_in(tmp_path / "items")
    one = [(k, body(m)) for k, m in enumerate(made)] + [(7, "broken"), (8, body({}))]
    put = lambda rows: spark.createDataFrame(rows, "seq long, body string").coalesce(1).write.mode("append").parquet(str(q))
    out = lambda *argv: (run(spark, list(argv)), capsys.readouterr().out.strip())
    put(one)
    (tmp_path / "regions").write_text("r0,r1\nr9\n")
    args = ("index-queue", str(q), cat, str(tmp_path / "cp"), "--stac", "--regions", str(tmp_path / "regions"))
    assert out(*args) == (0, "2")
    store = Store(spark, cat)
    ids = {r["uri"]: r["id"] for r in store.read().collect()}
    assert set(ids) == {"s3://b/0.json", "s3://b/1.json"}
    assert sorted(r["reason"] for r in spark.read.parquet(f"{cat}/quarantine").collect()) == ["unreadable message"] * 2
    put([(9, body({"id": ids["s3://b/0.json"]}, "ARCHIVED")), (10, body(made[1]))])
    assert out(*args) == (0, "1") and out(*args) == (0, "1")
    assert [(r["id"], r["action"]) for r in store.outbox().filter("action = 'ARCHIVED'").collect()] == [(ids["s3://b/0.json"], "ARCHIVED")]


def test_api_blobs_crawl_tiles_export_and_bootstrap(spark, tmp_path, capsys):
    out = lambda *argv: (run(spark, list(argv)), capsys.readouterr().out.strip())
    made, cat = items_in(tmp_path / "items"), f"file://{tmp_path}/cat"
    api = tmp_path / "api" / "c"
    api.mkdir(parents=True)
    page = lambda xs, nxt: json.dumps({"features": xs, "links": [{"rel": "next", "href": nxt}] if nxt else []})
    (api / "0.json").write_text(page(made[:2], f"{api}/1.json"))
    (api / "1.json").write_text(page(made[2:], f"{api}/0.json"))
    assert out("index-api", str(tmp_path / "api"), cat, "--options", "collections=c#datetime=2021/", "--rename-product", "new") == (0, '{"added": 2}')
    assert out("index-api", str(tmp_path / "api"), cat, "--collections", "c,none", "--limit", "1")[1] == '{"added": 1}'
    assert {r["product"] for r in Store(spark, cat).read().collect()} == {"new", "c"}
    assert out("index-blobs", str(tmp_path / "items"), f"file://{tmp_path}/c2", "--suffix", "1.json", "--stac") == (0, '{"added": 1}')
    assert out("index-crawl", str(tmp_path / "items"), f"file://{tmp_path}/c3", "--select", "items/", "--skip", "0.json$", "--stac") == (0, '{"added": 2}')
    assert out("index-tiles", f"file://{tmp_path}/c4", "--box", "5,5,8,7", "--limit", "5", "--url", "s3://dem/{ns}_{ew}.tif") == (0, '{"added": 5}')
    assert out("tiles", "--box", "5,5,6,6", "--url", "u/{tile}")[1] == "E005_N05\tu/E005_N05"
    assert out("export", cat, str(tmp_path / "exp"), "--product", "new") == (0, "2")
    assert len(list((tmp_path / "exp").glob("*-metadata.yaml"))) == 2 and "EPSG:4326" in next((tmp_path / "exp").glob("*.yaml")).read_text()
    write(tmp_path / "defs", p__yaml="name: p\n---\nname: q\n")
    assert out("bootstrap", f"file://{tmp_path}/c5", str(tmp_path / "defs")) == (0, '{"registered": 2}') and out("bootstrap", f"file://{tmp_path}/c5", str(tmp_path / "defs")) == (0, '{"known": 2}')
    assert Store(spark, f"file://{tmp_path}/c5").head()[0] == 1
    (tmp_path / "urls").write_text(f"{tmp_path}/items/0.json\n{tmp_path}/items/none.json\n")
    assert out("urls-to-tar", str(tmp_path / "urls"), str(tmp_path / "t")) == (1, "1")
    assert out("crawl-to-tar", str(tmp_path / "items"), str(tmp_path / "t2"), "--skip", "2.json") == (0, "2")
    assert out("blobs-to-tar", str(tmp_path / "items"), str(tmp_path / "t3"), "--suffix", "0.json") == (0, "1")


def test_redrive_deletes_what_it_sends(spark, tmp_path, capsys):
    dead, live = str(tmp_path / "dead"), str(tmp_path / "live")
    spark.range(5).withColumnRenamed("id", "n").write.parquet(dead)
    out = lambda *argv: (run(spark, list(argv)), capsys.readouterr().out.strip())
    assert out("redrive", dead, live, "n", "--dry-run") == (0, "5") and spark.read.parquet(dead).count() == 5
    assert out("redrive", dead, live, "n", "--limit", "2") == (0, "2") and out("redrive", dead, live, "n") == (0, "3") and out("redrive", dead, live, "n") == (0, "0")
    assert spark.read.parquet(dead).count() == 0 and sorted(r["n"] for r in spark.read.parquet(live).collect()) == [0, 1, 2, 3, 4]


def test_store_conflicts_and_replays(spark, tmp_path):
    from pyspark.sql import functions as F

    from gridsmith.operators.store import Conflict

    store = Store(spark, f"file://{tmp_path}/s")
    rows = lambda *ids: spark.createDataFrame([(i, f"u/{i}", n) for n, i in enumerate(ids)], "id string, uri string, seq long").select("id", F.lit("p").alias("product"), F.lit(None).cast("string").alias("region_code"), F.lit(None).cast("timestamp").alias("center_time"), F.lit(None).cast("string").alias("maturity"), "uri", F.lit(None).cast("timestamp").alias("archived_time"), F.lit("{}").alias("doc"), "seq")
    assert store.index(rows("a", "b"), ("q", 0)) == {"added": 2}
    assert store.index(rows("c"), ("q", 0)) == {} and store.index(rows("a"), ("q", 1)) == {"skipped": 1} and store.index(rows("d"), ("q", 1)) == {}
    number, manifest = store.head()
    assert store.index(rows("e")) == {"added": 1}
    with pytest.raises(Conflict):
        store.commit(number, manifest, rows("x").drop("seq"), {0})
    untouched = store.head()[1]["buckets"]
    assert store.index(rows("f")) == {"added": 1}
    assert sum(v != untouched.get(b) for b, v in store.head()[1]["buckets"].items()) == 1
    assert sorted(r["id"] for r in store.read().collect()) == ["a", "b", "e", "f"] and sorted(r["id"] for r in store.outbox().collect()) == ["a", "b", "e", "f"]
    assert store.archive(spark.createDataFrame([("a",), ("zz",)], "id string")) == 1 and store.archive(spark.createDataFrame([("a",)], "id string")) == 0


def test_bad_command(spark):
    with pytest.raises(SystemExit):
        run(spark, ["nothing"])
