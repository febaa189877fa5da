"""Boxes, tiles, periods, footprints and projections."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def period_step(text: Column, n: int = 1) -> Column:
    """A calendar period (``2019``, ``2019-04``, ``2019-04-24``) moved by ``n`` of its own unit."""
    year = F.lpad((F.substring(text, 1, 4).cast("int") + n).cast("string"), 4, "0")
    month = F.date_format(F.add_months(F.concat(F.substring(text, 1, 7), F.lit("-01")).cast("date"), n), "yyyy-MM")
    day = F.date_format(F.date_add(F.substring(text, 1, 10).cast("date"), n), "yyyy-MM-dd")
    return F.when(F.length(text) == 4, year).when(F.length(text) == 7, month).when(F.length(text) == 10, day)


def zoom_level(width: Column, height: Column) -> Column:
    """Map zoom that shows a box of the given size in degrees; null for an empty box."""
    ok = (width > 0) & (height > 0)
    return F.when(ok, F.floor(F.log2(F.greatest(F.lit(360.0) / width, F.lit(180.0) / height))).cast("int"))


def boxes_overlap(a: dict[str, Column], left: float, bottom: float, right: float, top: float) -> Column:
    """Whether boxes touch the view; a view with ``left > right`` wraps around the antimeridian."""
    x = (a["left"] <= right) & (a["right"] >= left) if left <= right else (a["left"] <= right) | (a["right"] >= left)
    return x & (a["bottom"] <= top) & (a["top"] >= bottom)


def box_polygon(left: float, bottom: float, right: float, top: float) -> dict:
    """The box of a query as a GeoJSON polygon."""
    return {"type": "Polygon", "coordinates": [[[left, bottom], [left, top], [right, top], [right, bottom], [left, bottom]]]}


def box_within(a: dict[str, Column], polygon: dict) -> Column:
    """Whether a box lies inside the polygon of a query box."""
    xs, ys = zip(*polygon["coordinates"][0])
    return (a["left"] >= min(xs)) & (a["right"] <= max(xs)) & (a["bottom"] >= min(ys)) & (a["top"] <= max(ys))


def _label(x: str, y: str) -> str:
    return f"concat(IF({x} < 0, 'W', 'E'), lpad(abs({x}), 3, '0'), '_', IF({y} < 0, 'S', 'N'), lpad(abs({y}), 2, '0'))"


def tiles(spark: SparkSession, box: tuple[float, float, float, float] | None, step: int = 1, limit: int | None = None) -> DataFrame:
    """(x, y, tile): lower left corners of the ``step``-degree tiles that cover a box, x-major; the whole world for no box."""
    left, bottom, right, top = (-180, -90, 180, 90) if box is None else box
    if left > right or bottom > top:
        raise ValueError("bad bounding box")
    lo = lambda v: math.floor(v / step) * step
    hi = lambda v: math.ceil(v / step) * step
    x = spark.range(lo(left), max(hi(right), lo(left)), step).withColumnRenamed("id", "x")
    ys = F.array(*[F.lit(v).cast("long") for v in range(lo(bottom), max(hi(top), lo(bottom)), step)])
    out = x.select("x", F.explode(ys).alias("y")).select("x", "y", F.expr(_label("x", "y")).alias("tile"))
    return out if limit is None else out.orderBy("x", "y").limit(limit)


def box_of_transform(transform: Column, shape: Column) -> Column:
    """Box of a grid from its affine numbers and shape (width by the first number of the shape, as in the item rules)."""
    at = lambda c, i: F.get(c, F.lit(i))
    x0, y0 = at(transform, 2), at(transform, 5)
    x1, y1 = x0 + at(transform, 0) * at(shape, 0), y0 + at(transform, 4) * at(shape, 1)
    return F.struct(F.least(x0, x1).alias("left"), F.least(y0, y1).alias("bottom"), F.greatest(x0, x1).alias("right"), F.greatest(y0, y1).alias("top"))


def binned(df: DataFrame, x: Column, y: Column, size: float, member: str) -> DataFrame:
    """(tx, ty, n, members): rows by square tiles of ``size``, with the sorted members of each.

    Members are gathered: the size must be such that a tile's fit a task; ``n`` alone has no such bound.
    """
    tile = df.select(F.floor(x / size).alias("tx"), F.floor(y / size).alias("ty"), member)
    return tile.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(member)).alias("members"))


def solar_day(ts: Column, longitude: Column) -> Column:
    """Calendar day of the local solar time."""
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + (longitude * 240_000_000).cast("long")).cast("date")


def hull(points: list) -> list:
    """Convex hull, counter-clockwise, closed. Points on a side (but for rounding) are no corners."""
    pts = sorted({(float(x), float(y)) for x, y in points})
    if len(pts) < 3:
        return [list(p) for p in pts]

    def half(seq: list) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1:
                (ax, ay), (bx, by) = (out[-1][0] - out[-2][0], out[-1][1] - out[-2][1]), (p[0] - out[-1][0], p[1] - out[-1][1])
                if ax * by - ay * bx > 1e-12 * math.hypot(ax, ay) * math.hypot(bx, by):
                    break
                out.pop()
            out.append(p)
        return out

    ring = half(pts)[:-1] + half(pts[::-1])[:-1]
    return [list(p) for p in [*ring, ring[0]]]


def simplify(points: list, tolerance: float) -> list:
    """Line simplification: keeps points farther than ``tolerance`` from the chord (iterative, no recursion)."""
    if len(points) < 3:
        return list(points)
    keep = [False] * len(points)
    keep[0] = keep[-1] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        (x1, y1), (x2, y2) = points[a], points[b]
        dx, dy = x2 - x1, y2 - y1
        n = math.hypot(dx, dy)
        far, at = -1.0, -1
        for i in range(a + 1, b):
            x, y = points[i]
            d = math.hypot(x - x1, y - y1) if n == 0 else abs(dy * (x - x1) - dx * (y - y1)) / n
            if d > far:
                far, at = d, i
        if far > tolerance:
            keep[at] = True
            stack += [(a, at), (at, b)]
    return [p for p, k in zip(points, keep) if k]


def transverse_mercator(lon: float, lat: float, zone: int, south: bool) -> tuple[float, float]:
    """Easting and northing of WGS84 degrees in a UTM zone (series of sixth order)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    al = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    phi, lam = math.radians(lat), math.radians(lon - (6 * zone - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
    east = eta + sum(c * math.cos(2 * (j + 1) * xi) * math.sinh(2 * (j + 1) * eta) for j, c in enumerate(al))
    north = xi + sum(c * math.sin(2 * (j + 1) * xi) * math.cosh(2 * (j + 1) * eta) for j, c in enumerate(al))
    return 500000 + k0 * big * east, (10_000_000 if south else 0) + k0 * big * north


# Equal-area conic systems (latitude and longitude of origin, standard parallels, false easting and northing), on GRS80.
CONIC = {3577: (0, 132, -18, -36, 0, 0), 5070: (23, -96, 29.5, 45.5, 0, 0), 3310: (0, -120, 34, 40.5, 0, -4_000_000), 102022: (0, 25, 20, -23, 0, 0)}


def equal_area_conic(lon: float, lat: float, epsg: int) -> tuple[float, float]:
    """Easting and northing of degrees in an equal-area conic system with two standard parallels (ellipsoid)."""
    lat0, lon0, sp1, sp2, fe, fn = CONIC[epsg]
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def q(phi: float) -> float:
        s = e * math.sin(phi)
        return (1 - e2) * (math.sin(phi) / (1 - s * s) + math.atanh(s) / e)

    def m2(phi: float) -> float:
        return math.cos(phi) ** 2 / (1 - e2 * math.sin(phi) ** 2)

    p0, p1, p2 = (math.radians(v) for v in (lat0, sp1, sp2))
    n = (m2(p1) - m2(p2)) / (q(p2) - q(p1))
    c = m2(p1) + n * q(p1)
    r, r0 = (a * math.sqrt(c - n * q(v)) / n for v in (math.radians(lat), p0))
    theta = n * math.radians(lon - lon0)
    return fe + r * math.sin(theta), fn + r0 - r * math.cos(theta)


def web_mercator(lon: float, lat: float) -> tuple[float, float]:
    return 6378137.0 * math.radians(lon), 6378137.0 * math.atanh(math.sin(math.radians(lat)))


def projection(epsg: int):  # noqa: ANN201
    """(lon, lat) → (x, y) of a reference system: geographic, UTM, equal-area conic, web mercator; null for any other."""
    if epsg == 4326:
        return lambda lon, lat: (float(lon), float(lat))
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return lambda lon, lat: transverse_mercator(lon, lat, epsg % 100, epsg > 32700)
    if epsg in CONIC:
        return lambda lon, lat: equal_area_conic(lon, lat, epsg)
    return web_mercator if epsg == 3857 else None


def project_geometry(geometry: dict, epsg: int, digits: int = 0) -> dict | None:
    """A WGS84 GeoJSON geometry in another reference system (``projection``), rounded unless geographic; null for unknown systems.

    A MultiPolygon becomes its convex hull.
    """
    to = projection(epsg)
    if to is None:
        return None

    def move(p: list) -> list:
        out = to(p[0], p[1])
        return list(out) if epsg == 4326 else [round(v, digits) for v in out]

    def walk(c: list) -> list:
        return move(c) if c and not isinstance(c[0], list) else [walk(x) for x in c]

    out = walk(geometry["coordinates"])
    if geometry["type"] == "MultiPolygon":
        return {"type": "Polygon", "coordinates": [hull([p for poly in out for ring in poly for p in ring])]}
    return {"type": geometry["type"], "coordinates": out}


@F.pandas_udf(T.StringType())
def projected(geometry, epsg):  # noqa: ANN001, ANN201
    """Arrow-batched ``project_geometry`` on GeoJSON texts."""
    import pandas as pd

    def one(g: str | None, e: int | None) -> str | None:
        try:
            out = project_geometry(json.loads(g), int(e)) if g and e is not None else None
        except (ValueError, KeyError, TypeError, IndexError):
            return None
        return json.dumps(out) if out else None

    return pd.Series([one(g, None if e is None or e != e else e) for g, e in zip(geometry, epsg)])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def convex_hull(points):  # noqa: ANN001, ANN201
    """Arrow-batched ``hull`` of arrays of points."""
    return points.map(lambda ps: None if ps is None else hull([list(p) for p in ps]))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def simplified(ring, tolerance):  # noqa: ANN001, ANN201
    """Arrow-batched ``simplify`` of rings: the end points and whatever is farther than the tolerance from the line of its neighbours."""
    import pandas as pd

    return pd.Series([None if r is None else simplify([list(p) for p in r], t) for r, t in zip(ring, tolerance)])


def footprints(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Convex hull of each group's points.

    Every task first reduces each batch of points to its hulls; hulls of salted parts follow, then those of whole groups, so
    that no step gathers a group's points.
    """
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(group).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict = {}
            for g, px, py in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sets.setdefault(g, set()).add((px, py))
            out = [(g, *p) for g, ps in sets.items() for p in hull(list(ps))]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.schema.field(0).type), *[pa.array([o[i] for o in out], pa.float64()) for i in (1, 2)]], names=["g", "x", "y"])

    part = points.mapInArrow(reduce, points.schema).select("g", F.array("x", "y").alias("p")).withColumn("salt", F.pmod(F.xxhash64("p"), F.lit(256)))
    part = part.groupBy("g", "salt").agg(convex_hull(F.collect_set("p")).alias("h"))
    rings = part.select("g", F.explode("h").alias("p")).groupBy("g").agg(F.collect_set("p").alias("ps"))
    return rings.select(F.col("g").alias(group), convex_hull("ps").alias("ring"))


def feature_collection(df: DataFrame, x: str = "x", y: str = "y", step: int = 1) -> DataFrame:
    """One row with the GeoJSON of a tile grid, titles like ``+5,-3``. For grids of bounded size (at most 360 x 180 tiles).

    A coordinate of zero has a plus sign.
    """
    ring = F.expr(f"array(array({x}, {y}), array({x} + {step}, {y}), array({x} + {step}, {y} + {step}), array({x}, {y} + {step}), array({x}, {y}))")
    title = F.concat(F.when(F.col(x) < 0, "").otherwise("+"), F.col(x).cast("string"), F.lit(","), F.when(F.col(y) < 0, "").otherwise("+"), F.col(y).cast("string"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(title.alias("title")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    return df.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.sort_array(F.collect_list(feature)).alias("features"))).alias("geojson"))
