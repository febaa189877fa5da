"""Schemas that drift between files: path-value maps, per-file statistics, change list and one typed table.

Rows are loaded as maps from path to raw (variant) value, so that nothing is lost to a guessed schema; objects are opened
as deep as asked (``a.b.c``). Statistics by file and path (values of each kind and a sketch of the values: least hashes in
``BINS`` bins) come from one aggregation with partial sums on the map side; all later steps work on these statistics, whose
size is files x paths, not rows. Files are compared with their predecessor by a window per stream over the statistics.

A removed and an added field are one renamed property if their names have one core (what is left without namespace, case,
separators and affixes), or if their statistics say so: same kind, at least half of the sketch in common, each the other's best
match, and values that tell something (a text, or three different numbers). Names are matched first.

Defined results: unreadable and null payloads count no fields; a field is present if any line has it, even as null; nulls
have no kind, and a field without a kind is never retyped; a file with several kinds of a field has the most frequent one
(ties: the alphabetically first); exact repeats of a line count once in the typed table; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Affixes of names that carry no meaning of their own (namespaces written with an underscore, units, fillers).
AFFIXES = ["eo", "odc", "dea", "m", "name", "value"]
KINDS = ["boolean", "list", "object", "point", "text", "whole"]
BINS = 4


def path_values(payload: Column) -> Column:
    """The payload as a map from field to raw value; null if it is no JSON object."""
    return F.from_json(payload, "map<string,variant>")


def paths(payload: Column, depth: int = 1) -> Column:
    """The payload as an array of (path, raw): its fields and, down to ``depth`` levels, what their objects hold."""

    def opened(e: Column, left: int) -> Column:
        if left < 2:
            return F.array(e)
        inner = F.map_entries(e["raw"].try_cast("map<string,variant>"))
        below = F.transform(inner, lambda x: F.struct(F.concat(e["path"], F.lit("."), x["key"]).alias("path"), x["value"].alias("raw")))
        return F.concat(F.array(e), F.coalesce(F.flatten(F.transform(below, lambda x: opened(x, left - 1))), F.filter(F.array(e), lambda _: F.lit(False))))

    top = F.transform(F.map_entries(path_values(payload)), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("raw")))
    return top if depth < 2 else F.flatten(F.transform(top, lambda e: opened(e, depth)))


def kind_of(raw: str) -> Column:
    """Kind of a variant column: text, whole, point, boolean, list, object; null for JSON null."""
    t = F.expr(f"schema_of_variant({raw})")
    return (
        F.when(t == "STRING", "text").when(t == "BIGINT", "whole").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "point")
        .when(t == "BOOLEAN", "boolean").when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "object")
    )


def core_name(name: Column) -> Column:
    """What is left of a field's name without namespace, case, separators and affixes; the same for all its spellings."""
    bare = F.regexp_replace(name, r"^.*:", "")
    words = F.split(F.lower(F.regexp_replace(bare, r"(?<=[a-z0-9])(?=[A-Z])", "_")), r"[^\p{L}\p{N}]+")
    kept = F.filter(words, lambda w: ~w.isin([*AFFIXES, ""]))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), "")


def statistics(lines: DataFrame, keys: list[str], payload: str = "payload", depth: int = 1) -> DataFrame:
    """(keys, field, kind, n): how often each path of each file has a value of each kind (null kind: JSON nulls)."""
    raw = lines.select(*keys, F.explode(paths(F.col(payload), depth)).alias("e")).select(*keys, F.col("e.path").alias("field"), F.col("e.raw").alias("raw"))
    return raw.select(*keys, "field", kind_of("raw").alias("kind")).groupBy(*keys, "field", "kind").agg(F.count("*").alias("n"))


def file_schemas(lines: DataFrame, stream: str = "stream_no", file: str = "file_no", at: str = "written_at", payload: str = "payload", depth: int = 1) -> DataFrame:
    """(stream, file, at, schema, before): each file's paths with prevailing kind and sketch, beside those of the file before.

    One scan; files whose lines hold no field still are a step of their stream.
    """
    raw = lines.select(stream, file, at, F.explode_outer(paths(F.col(payload), depth)).alias("e")).select(stream, file, at, F.col("e.path").alias("field"), F.col("e.raw").alias("raw"))
    raw = raw.select(stream, file, at, "field", kind_of("raw").alias("kind"), F.hash(F.lower(F.col("raw").cast("string"))).alias("h"))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    bins = [F.min(F.when(F.col("kind").isNotNull() & (F.pmod("h", F.lit(BINS)) == b), F.col("h"))).alias(f"b_{b}") for b in range(BINS)]
    per_field = raw.groupBy(stream, file, at, "field").agg(*counts, *bins)
    # The most frequent kind; of equal ones the alphabetically first.
    best = F.array_max(F.array(*[F.when(F.col(f"n_{k}") > 0, F.struct(F.col(f"n_{k}").alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("kind"))) for i, k in enumerate(KINDS)]))["kind"]
    entry = F.when(F.col("field").isNotNull(), F.struct("field", F.struct(best.alias("kind"), F.array(*[f"b_{b}" for b in range(BINS)]).alias("sketch")).alias("s")))
    files = per_field.groupBy(stream, file, at).agg(F.map_from_entries(F.collect_list(entry)).alias("schema"))
    order = Window.partitionBy(stream).orderBy(at, file)
    return files.withColumn("before", F.lag("schema").over(order))


def _alike(a: Column, b: Column) -> Column:
    """Share of the sketch that two fields of one kind have in common, 0 if their values tell nothing."""
    known = lambda x: F.size(F.filter(x["s"]["sketch"], lambda v: v.isNotNull()))
    both = F.size(F.filter(F.zip_with(a["s"]["sketch"], b["s"]["sketch"], lambda x, y: x == y), lambda same: F.coalesce(same, F.lit(False))))
    tells = (a["s"]["kind"] == "text") | ((known(a) > 2) & a["s"]["kind"].isin("whole", "point"))
    return F.when(tells & (a["s"]["kind"] == b["s"]["kind"]), both / F.greatest(known(a), known(b), F.lit(1))).otherwise(F.lit(0.0))


def _partner(x: Column, others: Column, place: str) -> Column:
    """The field of ``others`` that has the same core name and the same place among its like, else null."""
    return F.get(F.filter(others, lambda o: (o["core"] == x["core"]) & (o[place] == x[place])), F.lit(0))["field"]


def _best(x: Column, others: Column) -> Column:
    """The field of ``others`` whose values are most like those of ``x``, if at least half are."""
    scored = F.transform(others, lambda o: F.struct(_alike(x, o).alias("alike"), o["field"].alias("field")))
    return F.array_max(F.filter(scored, lambda o: o["alike"] >= 0.5))["field"]


def changes(lines: DataFrame, stream: str = "stream_no", file: str = "file_no", at: str = "written_at", payload: str = "payload", depth: int = 1) -> DataFrame:
    """(file, change_kind, old_field, new_field): added, removed, renamed and retyped paths against the file before.

    The n-th removed spelling of a core name is paired with the n-th added one (mostly there is one of each), what is left by
    values. All of it happens within a file's row of statistics, between the few fields that came or went: no further shuffle.
    """
    steps = file_schemas(lines, stream, file, at, payload, depth).filter("before IS NOT NULL")

    def listed(keys: Column, schema: str) -> Column:
        named = F.transform(F.array_sort(keys), lambda f: F.struct(f.alias("field"), core_name(f).alias("core"), F.col(schema)[f].alias("s")))
        return F.transform(named, lambda x: F.struct(x["field"].alias("field"), x["core"].alias("core"), x["s"].alias("s"), F.size(F.filter(named, lambda o: (o["core"] == x["core"]) & (o["field"] < x["field"]))).alias("nth")))

    now, old = F.map_keys("schema"), F.map_keys("before")
    steps = steps.select(file, "schema", "before", listed(F.array_except(old, now), "before").alias("gone"), listed(F.array_except(now, old), "schema").alias("new"), F.array_intersect(now, old).alias("both"))
    steps = steps.withColumn("named", F.filter(F.transform("gone", lambda g: F.struct(g["field"].alias("f0"), _partner(g, F.col("new"), "nth").alias("f1"))), lambda p: p["f1"].isNotNull()))
    left = lambda side, end: F.filter(side, lambda x: ~F.exists("named", lambda p: p[end] == x["field"]))
    steps = steps.withColumn("gone", left("gone", "f0")).withColumn("new", left("new", "f1"))
    valued = F.transform("gone", lambda g: F.struct(g["field"].alias("f0"), _best(g, F.col("new")).alias("f1")))
    mutual = F.filter(valued, lambda p: F.exists("new", lambda n: (n["field"] == p["f1"]) & (_best(n, F.col("gone")) == p["f0"])))
    steps = steps.withColumn("renamed", F.concat("named", mutual))
    taken = lambda side, end: F.filter(F.transform(side, lambda x: x["field"]), lambda f: ~F.exists("renamed", lambda p: p[end] == f))
    change = lambda kind, f0, f1: F.struct(F.lit(kind).alias("change_kind"), f0.alias("old_field"), f1.alias("new_field"))
    retyped = lambda f0, f1: F.coalesce(F.col("before")[f0]["kind"] != F.col("schema")[f1]["kind"], F.lit(False))
    none = F.lit("")
    each = F.concat(
        F.transform(taken("gone", "f0"), lambda f: change("removed", f, none)), F.transform(taken("new", "f1"), lambda f: change("added", none, f)),
        F.transform("renamed", lambda p: change("renamed", p["f0"], p["f1"])), F.transform(F.filter("renamed", lambda p: retyped(p["f0"], p["f1"])), lambda p: change("retyped", p["f0"], p["f1"])),
        F.transform(F.filter("both", lambda f: retyped(f, f)), lambda f: change("retyped", f, f)),
    )
    return steps.select(file, F.explode(each).alias("c")).select(file, "c.*")


def _has_core(core: str):
    return lambda e: e["core"] == core


#: Beyond so many properties (most frequent first) values stay in the rest map; none is lost.
MOST_COLUMNS = 500


def columns(lines: DataFrame, reserved: list[str], payload: str = "payload", known: Mapping[str, str] | None = None) -> dict[str, str]:
    """A typed column for every core name of all files, from the counts of its kinds (fields x kinds rows); ``known`` ones are given.

    The prevailing kind decides (ties: the alphabetically first): text string, numbers bigint or, if any has a point, double, boolean,
    lists and objects ``json`` (their whole text). Names in ``reserved`` and fields that are only null get no column.
    """
    out = dict(known or {})
    per_core = statistics(lines, [], payload).filter("kind IS NOT NULL").groupBy(core_name(F.col("field")).alias("core"))
    counts = per_core.agg(F.sum("n").alias("all"), *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in KINDS])
    for r in counts.filter(~F.col("core").isin(["", *out, *reserved])).orderBy(F.desc("all"), "core").limit(MOST_COLUMNS).collect():
        numbers = "double" if r["point"] else "bigint"
        types = [(r["boolean"], "boolean"), (r["list"] + r["object"], "json"), (r["point"] + r["whole"], numbers), (r["text"], "string")]
        out[r["core"]] = max(types, key=lambda t: t[0])[1]
    return out


def _same(value: Column, text: Column) -> Column:
    """Whether a typed value still says all of the raw scalar ``text`` (numbers by value, unless leading zeros would go)."""
    number = lambda c: c.try_cast("decimal(38,18)")
    return F.coalesce((value.cast("string") == text) | ((number(value.cast("string")) == number(text)) & ~text.rlike(r"^\s*[+-]?0\d")), F.lit(False))


def project(lines: DataFrame, target: Mapping[str, str], keys: list[str], payload: str = "payload", rest: str | None = None) -> DataFrame:
    """One consistent table: a typed column per core name of ``target`` and ``failed_casts``, the fields whose value had another form.

    Lists give their first element, objects their member ``name`` or their only member; a value that still doesn't cast is null and reported.
    ``rest`` names a map from field to JSON text of all values that no typed column holds in full: fields without a column, failed
    casts, lists and objects of which a part was taken, and a second spelling in one line. Nulls are no values.
    """
    raw = lines.select(*keys, path_values(F.col(payload)).alias("raw"))
    entries = F.transform(F.map_entries("raw"), lambda e: F.struct(core_name(e["key"]).alias("core"), e["key"].alias("key"), e["value"].alias("value")))
    raw = raw.withColumn("entries", F.filter(entries, lambda e: ~F.is_variant_null(e["value"])))
    raw = raw.select(*keys, "entries", *[F.get(F.filter("entries", _has_core(core)), F.lit(0)).alias(f"hit_{i}") for i, core in enumerate(target)])
    out, failed, held = [], [], []
    for i, (core, dtype) in enumerate(target.items()):
        hit = F.col(f"hit_{i}")
        text = hit["value"].cast("string")
        if dtype == "json":
            value = F.to_json(hit["value"])
            held.append(F.when(value.isNotNull(), hit["key"]))
        else:
            member = F.regexp_replace(text, r'^\{\s*"[^"]*"\s*:\s*"?([^",}]*)"?\s*\}$', "$1")
            inner = F.coalesce(F.try_variant_get(hit["value"], "$.name", "string"), F.try_variant_get(hit["value"], "$[0]", "string"), member)
            value = inner.try_cast(dtype)
            held.append(F.when(_same(value, text), hit["key"]))
        out.append(value.alias(core))
        failed.append(F.when(text.isNotNull() & value.isNull(), hit["key"]))
    failed_casts = F.filter(F.array(*failed), lambda x: x.isNotNull()).alias("failed_casts")
    if rest is None:
        return raw.select(*keys, *out, failed_casts)
    typed = raw.select(*keys, *out, failed_casts, "entries", F.array_compact(F.array(*held)).alias("held"))
    left = F.filter("entries", lambda e: ~F.array_contains("held", e["key"]))
    return typed.withColumn(rest, F.map_from_entries(F.transform(left, lambda e: F.struct(e["key"], F.to_json(e["value"]))))).drop("entries", "held")
