"""From change messages to the catalogue: what each message asks for, and doing it, batch by batch.

Defined results: a message fails (and stays in its queue) if body or document cannot be read, a document is empty, an archiving message
has no id, a notification names no bucket or key, a link is not there or what it names cannot be fetched. It is skipped (and leaves its
queue) if its key matches no record path, its region is not allowed, or it has no address. Everything else is archived or
indexed. Of a notification's records all are checked and the last one counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.functions import globs, identifiers, items
from gridsmith.operators.store import Store, dataset_rows
from gridsmith.session import materialise
from gridsmith.sources import docs, listing, queue


def _say(verdict: str, reason: str = "") -> Column:
    return F.lit(f"{verdict}:{reason}")


def dataset_text() -> Column:
    """JSON text of the columns of ``items.to_datasets``; null without a product."""
    doc = F.to_json(F.struct("id", F.struct(F.col("product").alias("name")).alias("product"), "label", "crs", "grids", "measurements", "accessories", "lineage", "properties"))
    return F.when(F.col("product").isNotNull(), doc)


def _fetched(rows: DataFrame, roots: dict[str, str] | None) -> DataFrame:
    """Rows (seq, uri) with the document behind ``uri``: each address is read once, all copies of it by a join."""
    got = docs.parsed(listing.documents(rows.filter("uri IS NOT NULL").select(F.col("uri").alias("url")).distinct(), roots)).groupBy("uri").agg(F.first("doc").alias("doc"))
    return rows.join(got, "uri", "left")


def decide(messages: DataFrame, archive: bool = False, record_path: Sequence[str] | None = None, metadata_link: str | None = None, stac: bool = False,
           regions: DataFrame | None = None, roots: dict[str, str] | None = None, seq: str = "seq", body: str = "body") -> DataFrame:
    """(seq, verdict, reason, id, uri, doc) of every message: archive, index, skip or fail.

    ``record_path``: the messages are bucket notifications of which keys must match. ``metadata_link``: where an item names its
    dataset document. ``stac``: documents are items, to be made datasets. ``regions``: the allowed ones (region_code).
    """
    df = queue.decoded(messages.select(F.col(seq).alias("seq"), F.col(body).alias("body")))
    archiving = F.coalesce(F.col("action") == "ARCHIVED", F.lit(False)) | F.lit(archive)
    got = F.when(F.col("error").isNotNull() | F.col("document").rlike(r"^\s*\{\s*\}\s*$"), _say("fail", "unreadable message"))
    got = got.when(archiving & identifiers.canonical_uuid(F.get_json_object("document", "$.id")).isNull(), _say("fail", "no id to archive")).when(archiving, _say("archive"))
    df = df.select("seq", "document", got.alias("said"), identifiers.canonical_uuid(F.get_json_object("document", "$.id")).alias("id"))
    if record_path is not None:
        r = F.from_json(F.get_json_object("document", "$.Records"), queue.NOTIFICATION)
        whole = F.forall(r, lambda x: F.coalesce(F.length(x["s3"]["bucket"]["name"]) > 0, F.lit(False)) & F.coalesce(F.length(x["s3"]["object"]["key"]) > 0, F.lit(False)))
        match = F.forall(r, lambda x: F.coalesce(x["s3"]["object"]["key"].rlike("|".join(f"(?:{globs.path_regex(p)})" for p in record_path) or r"\z\A."), F.lit(False)))
        last = F.try_element_at(r, F.lit(-1))
        uri = F.concat(F.lit("s3://"), last["s3"]["bucket"]["name"], F.lit("/"), last["s3"]["object"]["key"])
        said = F.coalesce("said", F.when(F.coalesce(F.size(r), F.lit(0)) < 1, _say("fail", "no records")).when(~whole, _say("fail", "no bucket or key")).when(~match, _say("skip", "no such record path")))
        df = _fetched(df.withColumn("said", said).withColumn("uri", F.when(said.isNull(), uri)), roots)
        df = df.withColumn("said", F.coalesce("said", F.when(F.col("doc").isNull(), _say("fail", "object not readable"))))
    elif metadata_link is not None:
        uri = items.metadata_link(F.col("document"), metadata_link)
        said = F.coalesce("said", F.when(uri.isNull(), _say("fail", "link not found")))
        df = _fetched(df.withColumn("said", said).withColumn("uri", F.when(said.isNull(), uri)), roots)
        df = df.withColumn("said", F.coalesce("said", F.when(F.col("doc").isNull(), _say("fail", "link not readable"))))
    else:
        links = F.from_json(F.get_json_object("document", "$.links"), "array<struct<rel:string,href:string>>")
        df = df.withColumn("uri", items.link(links, "self")).withColumn("doc", F.col("document"))
        if stac:
            made = items.to_datasets(df.filter("said IS NULL"), "seq", "doc").select("seq", dataset_text().alias("doc"))
            df = df.drop("doc").join(made, "seq", "left")
    if regions is not None:
        code = F.get_json_object("doc", "$.properties['odc:region_code']")
        allowed = regions.select(F.col("region_code").alias("__region")).filter("__region IS NOT NULL").distinct().withColumn("__ok", F.lit(True))
        df = df.withColumn("__region", code).join(allowed, "__region", "left").withColumn("said", F.coalesce("said", F.when(F.col("__ok").isNull(), _say("skip", "region not allowed"))))
    said = F.coalesce("said", F.when(F.col("doc").isNull() | F.col("uri").isNull(), _say("skip", "no address")), _say("index"))
    kept = F.split_part(said, F.lit(":"), F.lit(1))
    return df.select(
        "seq", kept.alias("verdict"), F.nullif(F.split_part(said, F.lit(":"), F.lit(2)), F.lit("")).alias("reason"),
        F.when(kept.isin("archive", "index"), F.coalesce(F.when(kept == "index", F.get_json_object("doc", "$.id")), "id")).alias("id"),
        F.when(kept == "index", F.col("uri")).alias("uri"), F.when(kept == "index", F.col("doc")).alias("doc"),
    )


def run(decided: DataFrame, store: Store, batch: tuple[str, int] | None = None, **options: object) -> dict[str, int]:
    """Carry out decided messages; counts of success, failed and skipped.

    The outcome is that of the messages one after another (by ``seq``): what is archived was in the catalogue before the batch, or
    an earlier message of the batch put it there. A dataset that is in, archived or not, is not added again.
    """
    part = lambda name: (f"{batch[0]}/{name}", batch[1]) if batch else None
    decided = materialise(decided, "decided")
    verdicts = {r[0]: r[1] for r in decided.groupBy("verdict").count().collect()}
    gone = decided.filter("verdict = 'archive'").groupBy("id").agg(F.max("seq").alias("__last"))
    come = decided.filter("verdict = 'index'").groupBy("id").agg(F.min("seq").alias("__first"))
    there = store.read().select("id").distinct().withColumn("__there", F.lit(True))
    gone = gone.join(come, "id", "left").join(there, "id", "left").filter("__first IS NULL OR __last > __first OR __there").select("id")
    gone = materialise(gone, "archiving")
    counts = store.index(dataset_rows(decided.filter("verdict = 'index'").select("uri", "doc", "seq")), part("index"), **options)
    store.archive(gone, part("archive"))
    return {
        "success": verdicts.get("archive", 0) + counts.get("added", 0) + counts.get("updated", 0),
        "failed": verdicts.get("fail", 0) + counts.get("failed", 0), "skipped": verdicts.get("skip", 0) + counts.get("skipped", 0),
    }
