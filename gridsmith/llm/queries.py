"""Queries of the problems of training data (P2, P8-P10), each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.functions.timestamps import with_instant
from gridsmith.llm import leakage, reading, survivorship, tokenize
from gridsmith.plans.oracles import instants
from gridsmith.plans.problems import clocks
from gridsmith.session import load, materialise


def _scenes(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    df = load(spark, d, "dataset_record").select("record_no", "product", "region_code", "datetime_text", "processing_datetime_text", "maturity", *columns)
    df = df.join(clocks(spark, d), "product", "left")
    df = with_instant(df, "datetime_text", "taken", "zone", "date_order")
    df = with_instant(df, "processing_datetime_text", "processed", "zone", "date_order")
    df = df.withColumn("region", survivorship.region_key(F.col("region_code"))).withColumn("second", F.expr("CAST(floor(taken / 1000000) AS bigint)"))
    return df.filter("product IS NOT NULL AND region IS NOT NULL AND second IS NOT NULL")


SCENE_FIELDS = ["platform", "gsd", "cloud_cover", "crs", "href"]


def _present() -> dict:
    tests = {c: survivorship.text_present(F.col(c)) for c in ("platform", "crs", "href")}
    tests["gsd"] = survivorship.number_present(F.col("gsd"), F.col("gsd") > 0)
    tests["cloud_cover"] = survivorship.number_present(F.col("cloud_cover"), F.col("cloud_cover").between(0, 100))
    return {c: tests[c] for c in SCENE_FIELDS}


def scene_survivors(spark: SparkSession, d: str) -> DataFrame:
    df = _scenes(spark, d, *SCENE_FIELDS)
    best = survivorship.survivors(df, ["product", "region", "second"], _present(), survivorship.maturity_rank(F.col("maturity")), F.col("processed"), "record_no")
    return best.filter("first_record < last_record")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Of each group of records of one scene and each field, the record whose value survives."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}.record").alias("record_no")) for c in SCENE_FIELDS])).alias("e")
    return scene_survivors(spark, d).select(F.col("first_record").alias("group_no"), each).select("group_no", "e.*").filter("record_no IS NOT NULL")


def p2_golden(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record built field by field."""
    return scene_survivors(spark, d).select(F.col("first_record").alias("group_no"), "product", "region", *[F.col(f"{c}.value").alias(c) for c in SCENE_FIELDS])


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.encode(load(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the bytes that the token ids of each document stand for."""
    return tokenize.decode(tokenize.encode(load(spark, d, "documents"))).select("doc_id", F.md5("data").alias("digest"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold passages of test items."""
    return leakage.leaked(load(spark, d, "documents"), load(spark, d, "eval_item"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """Documents left after the leaking ones are removed."""
    return leakage.clean(load(spark, d, "documents").select("doc_id", "text"), load(spark, d, "eval_item")).select("doc_id")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document after the leaking passages are cut out: how many were, and what still leaks then (nothing may)."""
    docs, items = load(spark, d, "documents").select("doc_id", "text"), load(spark, d, "eval_item")
    made = materialise(leakage.redacted(docs, items), "redacted")
    still = leakage.leaked(made, items).select("doc_id").distinct().withColumn("leaks", F.lit(True))
    return made.join(still, "doc_id", "left").groupBy(F.coalesce("leaks", F.lit(False)).alias("leaks"), (F.col("n_cut") > 0).alias("was_cut")).agg(F.count("*").alias("n_docs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Reading level of every document with enough prose."""
    docs = load(spark, d, "documents")
    return reading.grade(docs, reading.fit(docs, load(spark, d, "reading_label")))


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """The corpus by language and reading level."""
    docs = load(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    return docs.join(p10_found(spark, d), "doc_id").groupBy("lang", "reading_level").agg(F.count("*").alias("n_docs"))


_MISSING = ", ".join(f"'{w}'" for w in survivorship.MISSING_WORDS)
_RANK = "CASE lower(trim(maturity)) WHEN 'final' THEN 0 WHEN 'interim' THEN 1 WHEN 'nrt' THEN 2 ELSE 3 END"
_SCENES = f"""WITH {instants('''SELECT record_no AS row_key, 'taken' AS field, datetime_text AS text, product FROM dataset_record
        UNION ALL SELECT record_no, 'processed', processing_datetime_text, product FROM dataset_record''')},
taken AS (SELECT row_key AS record_no, utc FROM read WHERE field = 'taken'),
processed AS (SELECT row_key AS record_no, utc FROM read WHERE field = 'processed'),
regions AS (
    SELECT *, regexp_extract(upper(trim(region_code)), '^P?(\\d{{1,3}})[^0-9A-Z]*R?(\\d{{1,3}})$', ['p', 'r']) AS pr,
        regexp_replace(regexp_replace(upper(trim(region_code)), '[^0-9A-Z]', '', 'g'), '^(MGRS)?T?(\\d)', '\\2') AS sq
    FROM dataset_record
),
scenes AS (
    SELECT r.*, p.utc AS processed, CASE WHEN pr.p <> '' THEN lpad(pr.p, 3, '0') || lpad(pr.r, 3, '0') WHEN regexp_full_match(sq, '\\d{{1,2}}[A-Z]{{3}}') THEN lpad(sq, 5, '0') END AS region,
        CAST(floor(t.utc / 1000000) AS bigint) AS second
    FROM regions r JOIN taken t USING (record_no) JOIN processed p USING (record_no)
),
grouped AS (
    SELECT *, min(record_no) OVER g AS group_no, count(*) OVER g AS n FROM scenes
    WHERE region IS NOT NULL AND second IS NOT NULL AND product IS NOT NULL WINDOW g AS (PARTITION BY product, region, second)
),
entries AS (
    SELECT group_no, 'platform' AS field, record_no, maturity, processed, platform AS v FROM grouped WHERE n > 1 AND lower(trim(platform)) NOT IN ({_MISSING})
    UNION ALL SELECT group_no, 'crs', record_no, maturity, processed, crs FROM grouped WHERE n > 1 AND lower(trim(crs)) NOT IN ({_MISSING})
    UNION ALL SELECT group_no, 'href', record_no, maturity, processed, href FROM grouped WHERE n > 1 AND lower(trim(href)) NOT IN ({_MISSING})
    UNION ALL SELECT group_no, 'gsd', record_no, maturity, processed, CAST(gsd AS varchar) FROM grouped WHERE n > 1 AND gsd > 0 AND NOT isnan(gsd)
    UNION ALL SELECT group_no, 'cloud_cover', record_no, maturity, processed, CAST(cloud_cover AS varchar) FROM grouped WHERE n > 1 AND cloud_cover BETWEEN 0 AND 100 AND NOT isnan(cloud_cover)
),
best AS (SELECT *, row_number() OVER (PARTITION BY group_no, field ORDER BY {_RANK}, processed DESC NULLS LAST, record_no) AS place FROM entries)"""

ORACLES = {
    "p2_found": f"{_SCENES} SELECT group_no, field, record_no FROM best WHERE place = 1",
    "p2_golden": f"""{_SCENES}
        SELECT g.group_no, g.product, g.region, max(v) FILTER (b.field = 'platform') AS platform, CAST(max(v) FILTER (b.field = 'gsd') AS double) AS gsd,
            CAST(max(v) FILTER (b.field = 'cloud_cover') AS double) AS cloud_cover, max(v) FILTER (b.field = 'crs') AS crs, max(v) FILTER (b.field = 'href') AS href
        FROM (SELECT DISTINCT group_no, product, region FROM grouped WHERE n > 1) g LEFT JOIN best b ON b.group_no = g.group_no AND b.place = 1 GROUP BY ALL""",
    "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
}

QUERIES = {f.__name__: f for f in (p2_found, p2_golden, p8_ids, p8_decoded, p9_found, p9_clean, p9_redacted, p10_found, p10_profile)}
