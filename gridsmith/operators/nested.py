"""Deeply nested documents to flat tables by interval labels.

A depth-first walk numbers every node of a document - objects, lists and scalars - on entry (pre) and on exit (post); a node lies
below another exactly if its interval lies inside the other's. Node tables by type (datasets, grids, measurements,
accessories, lineage, properties, geometries, other) carry those labels and nothing else of their parents; ``link`` finds
each node's dataset by interval containment with a running maximum over the nodes of a document in pre-order, so that no
pairs within a document are formed. All node kinds share one parse and one exchange on the document's row.

Nothing is lost: what the typed columns of a node don't hold is the JSON text in ``value`` (a scalar, or an object of the
remaining members), and every scalar outside the known branches is a row of ``other`` under its path.

Defined results: unreadable, blank and null documents give no node; absent parts give no rows; numbers may be texts;
unreadable numbers are null; a document row that occurs twice gives its rows twice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.session import materialise

TABLES = ("dataset", "grid", "measurement", "accessory", "lineage", "property", "geometry", "other")
NODE_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in [
        ("row_id", T.LongType()), ("doc_no", T.LongType()), ("kind", T.StringType()), ("pre", T.IntegerType()), ("post", T.IntegerType()),
        ("name", T.StringType()), ("id", T.StringType()), ("product", T.StringType()), ("crs", T.StringType()), ("label", T.StringType()),
        ("path", T.StringType()), ("grid", T.StringType()), ("band_no", T.LongType()),
        ("n_rows", T.LongType()), ("n_cols", T.LongType()), ("x0", T.LongType()), ("y0", T.LongType()), ("value", T.StringType()),
    ]]
)


def resolve(base: str | None, path: str) -> str | None:
    """``path`` against the document at ``base``, without dot segments."""
    m = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)(.*)$", path, re.S)
    if m:
        root, rest = m.groups()
    else:
        b = re.match(r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)?(.*)$", base, re.S) if base is not None else None
        if b is None:
            return None
        root = b.group(1) or ""
        rest = path if path.startswith("/") else b.group(2).rpartition("/")[0] + "/" + path
    if not rest:
        return root
    out: list[str] = []
    parts = rest.split("/")
    for i, p in enumerate(parts):
        if p == "." or p == "..":
            if p == ".." and len(out) > 1:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(p)
    return root + "/".join(out)


def _integer(x: object) -> int | None:
    if isinstance(x, bool) or x is None:
        return None
    try:
        v = float(x) if not isinstance(x, int) else x
        v = int(v)
        return v if -(2**63) <= v < 2**63 else None
    except (TypeError, ValueError, OverflowError):
        return None


def _text(x: object) -> str | None:
    return x if isinstance(x, str) else None if x is None or isinstance(x, (dict, list)) else json.dumps(x)


def _items(part: object) -> Iterator[tuple[str | None, object]]:
    """Named parts, given as an object or as a list of objects with ``name``."""
    if isinstance(part, dict):
        yield from part.items()
    elif isinstance(part, list):
        for x in part:
            if isinstance(x, dict):
                yield _text(x.get("name")), x


def parse_document(doc: str | None) -> list[dict]:
    """The datasets of a document text: one object, a list of them, or an object with ``datasets``."""
    if not doc:
        return []
    try:
        tree = json.loads(doc.lstrip("﻿ \t\r\n"))
    except (ValueError, RecursionError):
        return []
    if isinstance(tree, dict) and isinstance(tree.get("datasets"), list):
        tree = tree["datasets"]
    return [x for x in (tree if isinstance(tree, list) else [tree]) if isinstance(x, dict) and x]


class _Walk:
    """The labelled nodes of one document; ``kinds`` names those that are kept (all nodes are numbered)."""

    def __init__(self, href: str | None, kinds: Sequence[str], rest: bool):
        self.href, self.kinds, self.rest, self.clock, self.nodes = href, frozenset(kinds), rest, 0, []

    def tick(self) -> int:
        self.clock += 1
        return self.clock

    def number(self, value: object) -> None:
        """Number a subtree whose nodes get no rows of their own."""
        self.clock += 1
        for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            if isinstance(x, (dict, list)):
                self.number(x)
            else:
                self.clock += 2
        self.clock += 1

    def keep(self, kind: str, pre: int, node: dict, value: object = None) -> None:
        post = self.tick()
        if kind in self.kinds:
            text = json.dumps(value, ensure_ascii=False) if self.rest and value not in (None, {}) else None
            self.nodes.append(node | {"kind": kind, "pre": pre, "post": post, "value": text})

    def leaves(self, kind: str, name: str, value: object) -> None:
        """A row for each scalar (and each empty list or object) of a subtree, named by its path."""
        pre = self.tick()
        inner = list(value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ())
        for k, x in inner:
            self.leaves(kind, f"{name}[{k}]" if isinstance(value, list) else f"{name}.{k}" if name else k, x)
        if inner:
            self.clock += 1
        elif kind in self.kinds:
            self.nodes.append({"kind": kind, "pre": pre, "post": self.tick(), "name": name, "value": json.dumps(value, ensure_ascii=False) if self.rest else None})
        else:
            self.clock += 1

    def part(self, key: str, part: object, typed: Callable[[str | None, object, int], bool]) -> None:
        """The elements of a part, named by an object's keys or by ``name`` in a list; anything else goes to ``other``."""
        self.tick()
        for name, x in _items(part):
            pre = self.tick()
            if isinstance(x, (dict, list)):
                for v in x.values() if isinstance(x, dict) else x:
                    self.number(v)
            if not typed(name, x, pre):
                self.clock += 1
                self.leaves("other", f"{key}.{name}", x)
        if isinstance(part, list):
            for i, x in enumerate(part):
                if not isinstance(x, dict):
                    self.leaves("other", f"{key}[{i}]", x)
        elif not isinstance(part, dict):
            self.leaves("other", key, part)
        self.clock += 1

    def grid(self, name: str | None, grid: object, pre: int) -> bool:
        if not isinstance(grid, dict):
            return False
        shape = grid.get("shape") if isinstance(grid.get("shape"), list) else []
        rows = grid.get("transform") if isinstance(grid.get("transform"), list) else []
        flat = [y for x in rows for y in (x if isinstance(x, list) else [x])]
        node = {"name": name, "crs": _text(grid.get("crs"))}
        node |= {k: _integer(s[i]) if len(s) > i else None for k, s, i in (("n_rows", shape, 0), ("n_cols", shape, 1), ("x0", flat, 2), ("y0", flat, 5))}
        self.keep("grid", pre, node, {k: v for k, v in grid.items() if k not in ("crs", "name")} if self.rest else None)
        return True

    def asset(self, kind: str) -> Callable[[str | None, object, int], bool]:
        def typed(name: str | None, x: object, pre: int) -> bool:
            x = {"path": x} if isinstance(x, str) else x
            if not isinstance(x, dict):
                return False
            path = _text(x.get("path"))
            node = {"name": name, "path": resolve(self.href, path) if path else None, "grid": _text(x.get("grid")), "band_no": _integer(x.get("band")), "label": path or None}
            self.keep(kind, pre, node, {k: v for k, v in x.items() if k not in ("path", "grid", "band", "name")} if self.rest else None)
            return True

        return typed

    def parents(self, name: str | None, parents: object, pre: int) -> bool:
        for parent in parents if isinstance(parents, list) else [parents]:
            at = self.tick()
            if isinstance(parent, str):
                self.keep("lineage", at, {"name": name, "id": parent})
            else:
                self.clock += 1
                self.leaves("other", f"lineage.{name}", parent)
        self.clock += 1
        return True

    def dataset(self, tree: dict) -> None:
        pre, product = self.tick(), tree.get("product")
        parts = {"grids": self.grid, "measurements": self.asset("measurement"), "accessories": self.asset("accessory"), "lineage": self.parents}
        for key, value in tree.items():
            if key in parts and isinstance(value, (dict, list)):
                self.part(key, value, parts[key])
            elif key == "properties" and isinstance(value, dict):
                self.tick()
                for k, v in value.items():
                    self.leaves("property", k, v)
                self.clock += 1
            elif key == "geometry" and isinstance(value, dict):
                at = self.tick()
                for v in value.values():
                    self.number(v)
                self.keep("geometry", at, {"name": _text(value.get("type"))}, value)
            elif (key in ("id", "label", "crs", "product") and not isinstance(value, (dict, list))) or (key == "product" and isinstance(value, dict) and set(value) <= {"name"}):
                self.number(value)
            else:
                self.leaves("other", key, value)
        self.keep("dataset", pre, {"id": _text(tree.get("id")), "label": _text(tree.get("label")), "crs": _text(tree.get("crs")), "product": _text(product.get("name")) if isinstance(product, dict) else _text(product)})


def walk(doc: str | None, href: str | None, kinds: Sequence[str] = TABLES, rest: bool = True) -> list[dict]:
    """The labelled nodes of one document, children before their parents' exits."""
    w = _Walk(href, kinds, rest)
    for tree in parse_document(doc):
        w.dataset(tree)
    return w.nodes


def nodes(docs: DataFrame, doc_no: str = "doc_no", href: str = "href", doc: str = "doc", kinds: Sequence[str] = TABLES, rest: bool = True) -> DataFrame:
    """The labelled nodes of a table of documents (one pass, no shuffle); ``rest`` asks for ``value``."""
    narrow = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(doc_no).alias("doc_no"), F.col(href).alias("href"), F.col(doc).alias("doc"))
    names = NODE_SCHEMA.fieldNames()
    kinds = tuple(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(NODE_SCHEMA)
        for batch in batches:
            cols: dict[str, list] = {n: [] for n in names}
            for row_id, no, at, text in zip(*(batch.column(c).to_pylist() for c in ("row_id", "doc_no", "href", "doc"))):
                for node in walk(text, at, kinds, rest):
                    node["row_id"], node["doc_no"] = row_id, no
                    for n in names:
                        cols[n].append(node.get(n))
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)

    return narrow.mapInArrow(run, NODE_SCHEMA)


def link(labelled: DataFrame) -> DataFrame:
    """Add ``dataset`` (pre, id, product) of the dataset whose interval contains each node; null for datasets themselves."""
    before = Window.partitionBy("row_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = F.last(F.when(F.col("kind") == "dataset", F.struct("pre", "post", "id", "product")), ignorenulls=True).over(before)
    inside = (F.col("open.pre") < F.col("pre")) & (F.col("post") < F.col("open.post"))
    return labelled.withColumn("open", open_).withColumn("dataset", F.when(inside, F.col("open"))).drop("open")


def flatten(docs: DataFrame, kinds: Sequence[str] = TABLES, **columns: str) -> dict[str, DataFrame]:
    """The related flat tables; every child table has the document's number and its dataset's pre label and id.

    The documents are parsed once: the linked nodes are written to the shared folder, a partition a kind, and each table
    reads its own. A single kind is not written but read as it comes.
    """
    wanted = ["dataset", *[k for k in kinds if k != "dataset"]]
    linked = link(nodes(docs, kinds=wanted, **columns))
    if len(kinds) > 1:
        linked = materialise(linked, "nodes", ("kind",))
    key = ["doc_no", F.col("dataset.pre").alias("dataset_pre"), F.col("dataset.id").alias("dataset_id")]
    own = ["doc_no", F.col("pre").alias("dataset_pre"), F.col("id").alias("dataset_id")]
    shapes = {
        "dataset": [*own, "post", "product", "label", "crs"],
        "grid": [*key, "pre", "post", F.col("name").alias("grid_name"), "n_rows", "n_cols", "x0", "y0", "crs", "value"],
        "measurement": [*key, "pre", "post", F.col("name").alias("band"), F.coalesce(F.nullif("grid", F.lit("")), F.lit("default")).alias("grid_name"), "band_no", F.col("path").alias("asset_href"), F.col("label").alias("path"), "value"],
        "accessory": [*key, "pre", "post", "name", F.col("path").alias("asset_href"), F.col("label").alias("path"), "value"],
        "lineage": [*key, "pre", "post", F.col("name").alias("label"), F.col("id").alias("parent_id")],
        "property": [*key, "pre", "post", "name", "value"],
        "geometry": [*key, "pre", "post", F.col("name").alias("type"), "value"],
        "other": [*key, "pre", "post", F.col("name").alias("path"), "value"],
    }
    return {kind: linked.filter(F.col("kind") == kind).select(*shapes[kind]) for kind in kinds}


def measurement_grids(docs: DataFrame, **columns: str) -> DataFrame:
    """Each measurement that has a path, with the grid of its dataset that it lies on (only where that grid exists)."""
    linked = link(nodes(docs, kinds=("dataset", "grid", "measurement"), rest=False, **columns)).filter(F.col("dataset").isNotNull())
    grid_name = F.when(F.col("kind") == "grid", F.col("name")).otherwise(F.coalesce(F.nullif("grid", F.lit("")), F.lit("default")))
    on_grid = Window.partitionBy("row_id", F.col("dataset.pre"), "grid_name")
    grid = F.max(F.when(F.col("kind") == "grid", F.struct("pre", "n_rows", "n_cols", "x0", "y0"))).over(on_grid)
    found = linked.withColumn("grid_name", grid_name).withColumn("g", grid)
    return found.filter((F.col("kind") == "measurement") & F.col("label").isNotNull() & F.col("g").isNotNull()).select(
        "doc_no", F.col("dataset.id").alias("dataset_id"), F.col("name").alias("band"), "grid_name", "g.n_rows", "g.n_cols", "g.x0", "g.y0", F.col("path").alias("asset_href")
    )
