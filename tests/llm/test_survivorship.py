import glob
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from gridsmith.llm import queries, survivorship

DATA = "/root/testdata/sf0.001"


def test_survivors(spark):
    data = [
        (3, "g", "final", 10, "x"), (2, "g", "final", 10, "y"), (1, "g", "nrt", 99, "z"), (4, "g", " FINAL ", None, "w"),
        (5, "h", None, None, "-"), (6, "h", "nrt", 1, " unknown "), (7, "i", "final", 1, "alone"), (2, "g", "final", 10, "y"),
    ]
    df = spark.createDataFrame(data, "record long, g string, maturity string, at long, v string").withColumn("first", F.lit(1))
    got = survivorship.survivors(df, ["g"], {"v": survivorship.text_present(F.col("v"))}, survivorship.maturity_rank(F.col("maturity")), F.col("at"), "record")
    out = {r["g"]: (r["first_record"], r["last_record"], r["v"] and tuple(r["v"])) for r in got.collect()}
    assert out == {"g": (1, 4, (2, "y")), "h": (5, 6, None), "i": (7, 7, (7, "alone"))}


def test_region_key(spark):
    same = ["01JGK", "MGRS-01JGK", "T01JGK", "01J GK", "01-J-GK", "t01jgk ", "1JGK"]
    paths = ["002199", " 002199", "002_199", "P002_R199", "p002r199", "2/199", "002-199"]
    df = spark.createDataFrame([(x,) for x in [*same, *paths, "", "??", None]], "r string")
    got = [r[0] for r in df.select(survivorship.region_key(F.col("r"))).collect()]
    assert got == ["01JGK"] * len(same) + ["002199"] * len(paths) + [None] * 3


def test_number_present(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (-1.0,)], "v double")
    assert [r[0] for r in df.select(survivorship.number_present(F.col("v"), F.col("v") > 0)).collect()] == [True, False, False, False]


def test_hot_group(spark):
    """A group with a third of all rows."""
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), ((F.col("id") * 7919) % 30011).alias("instant"), F.col("id").alias("tie"), F.lit("x").alias("v"))
    best = survivorship.survivors(df, ["key"], {"v": F.lit(True)}, F.lit(0), F.col("instant"), "tie")
    last = df.filter("key = 'hot'").orderBy(F.col("instant").desc(), F.col("tie")).first()["tie"]
    assert best.filter("key = 'hot'").first()["v"]["record"] == last and best.count() == 20001


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    df, want = queries.QUERIES[name](spark, DATA), db.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert Counter(tuple(plain(r[c]) for c in cols) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
