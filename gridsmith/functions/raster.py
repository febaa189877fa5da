"""Raster cells in long form: scaling, masks, bounds, colours, image bytes, geometric median."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_byte(value: Column, clamp: Column) -> Column:
    """0 stays 0, ``clamp`` becomes 255; null (no data) stays null."""
    return F.least(F.greatest(F.floor(value * 255.0 / clamp), F.lit(0)), F.lit(255)).cast("int")


def rgba(r: Column, g: Column, b: Column, clamp: Column, nodata: Column) -> Column:
    """struct(r, g, b, a): scaled bands, transparent where the red band has no data."""
    empty = r.isNull() | (r == nodata)
    band = lambda c: F.when(empty, 0).otherwise(F.coalesce(to_byte(c, clamp), F.lit(0)))
    return F.struct(band(r).alias("r"), band(g).alias("g"), band(b).alias("b"), F.when(empty, 0).otherwise(255).alias("a"))


def opaque(pixel: Column, colour: tuple[int, int, int] = (255, 0, 255)) -> Column:
    """struct(r, g, b): transparent pixels take ``colour``."""
    return F.struct(*[F.when(pixel["a"] == 0, c).otherwise(pixel[n]).alias(n) for n, c in zip("rgb", colour)])


def coloured(value: Column, colours: dict[int, tuple[int, int, int, int]]) -> Column:
    """struct(r, g, b, a) of a class; null for a class without a colour. The table is part of the expression: no join."""
    pixel = lambda c: F.struct(*[F.lit(v).alias(n) for n, v in zip("rgba", c)])
    return F.try_element_at(F.create_map(*[x for k, c in colours.items() for x in (F.lit(k), pixel(c))]), value.cast("int"))


def scaled(value: Column, good: Column, nodata: Column, scale: float = 1.0, offset: float = 0.0) -> Column:
    """Valid cells as numbers, others null."""
    return F.when(good & value.isNotNull() & (value != nodata), value * scale + offset)


def unscaled(value: Column, nodata: int, scale: float = 1.0, offset: float = 0.0) -> Column:
    return F.coalesce(F.when(~F.isnan(value), F.round((value - offset) / scale)), F.lit(float(nodata))).cast("int")


def mask_changes(a: Column, b: Column) -> tuple[Column, Column]:
    """(added, removed) cells of mask ``b`` against ``a``."""
    return ~a & b, a & ~b


def pixel_bounds(cells: DataFrame, group: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Shape, aspect and pixel-edge bounds per group; half of the first step is added at each end."""
    axis = lambda c: F.array_sort(F.collect_set(c))
    g = cells.groupBy(*group).agg(axis(x).alias("xs"), axis(y).alias("ys"))
    half = lambda c: F.coalesce((F.get(c, F.lit(1)) - F.get(c, F.lit(0))) / 2, F.lit(0.5))
    xs, ys = F.col("xs"), F.col("ys")
    return g.select(
        *group, F.size(ys).alias("height"), F.size(xs).alias("width"), (F.size(xs) / F.size(ys)).alias("aspect"),
        (F.array_min(xs) - half(xs)).alias("left"), (F.array_min(ys) - half(ys)).alias("bottom"),
        (F.array_max(xs) + half(xs)).alias("right"), (F.array_max(ys) + half(ys)).alias("top"),
    )


def data_uri(data: Column, mime: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(data), "[\r\n]", ""))


def png(image: np.ndarray, level: int = 6) -> bytes:
    """PNG bytes of a uint8 image of one, three or four bands."""
    image = image[:, :, None] if image.ndim == 2 else image
    h, w, n = image.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * n)], axis=1).tobytes()
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def png_pixels(data: bytes) -> np.ndarray:
    """The pixels of a PNG of 8 bits a band without interlacing."""
    at, body, head = 8, b"", None
    while at < len(data):
        size, tag = struct.unpack(">I4s", data[at : at + 8])
        if tag == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + size])
        elif tag == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    w, h, depth, kind, _, _, interlaced = head
    if depth != 8 or interlaced or kind not in (0, 2, 6):
        raise ValueError("only plain images of 8 bits a band")
    n = {0: 1, 2: 3, 6: 4}[kind]
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, (w + 1) * n), np.int32)
    for y in range(h):
        row, up, way = lines[y, 1:], out[y], lines[y, 0]
        if way in (0, 2):
            out[y + 1, n:] = row + (up[n:] if way == 2 else 0) & 255
            continue
        for i, v in enumerate(row):
            a, b, c = out[y + 1, i], up[i + n], up[i]
            guess = a if way == 1 else (a + b) // 2 if way == 3 else min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out[y + 1, i + n] = (v + guess) & 255
    return out[1:, n:].reshape(h, w, n).astype(np.uint8)


# The standard's example tables of quantisation (in rows) and of code lengths with their symbols.
_LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
_CHROMA = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32
_DC_LENGTHS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _codes(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol → (code, bits) of a table given by the number of codes of each length."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, bits)
            code += 1
        at, code = at + n, code << 1
    return out


#: Run and size in one byte: a flat table of eight and nine bits, valid for any image.
_AC_SYMBOLS = [0x00, 0xF0, *[r << 4 | s for s in range(1, 11) for r in range(16)]]
_AC_LENGTHS = [0] * 7 + [len(_AC_SYMBOLS)] + [0] * 8


def jpeg(image: np.ndarray, quality: int = 95, transparent: tuple[int, int, int] | None = None) -> bytes:
    """Baseline JPEG bytes of a uint8 image of one, three or four bands (no subsampling).

    With four bands, pixels of no opacity take the colour ``transparent`` (magenta unless told otherwise).
    """
    if image.ndim == 3 and image.shape[2] == 4:
        image = np.where(image[:, :, 3:] == 0, np.array(transparent or (255, 0, 255), np.uint8), image[:, :, :3])
    image = image[:, :, None] if image.ndim == 2 else image
    h, w, n = image.shape
    if n == 3:
        r, g, b = (image[:, :, k].astype(float) for k in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, 128 + (b - y) / 1.772, 128 + (r - y) / 1.402]
    else:
        planes = [image[:, :, 0].astype(float)]
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    tables = [np.clip((np.array(t) * scale + 50) // 100, 1, 255).astype(int) for t in (_LUMA, _CHROMA)][: 2 if n == 3 else 1]
    k = np.arange(8)
    dct = np.sqrt(np.where(k[:, None] == 0, 1, 2) / 8) * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    blocks = []
    for i, p in enumerate(planes):
        p = np.pad(p - 128, ((0, -h % 8), (0, -w % 8)), mode="edge")
        b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        q = np.rint((dct @ b @ dct.T).reshape(-1, 64) / tables[min(i, 1)]).astype(int)
        blocks.append(q[:, _ZIGZAG])
    dc, ac = _codes(_DC_LENGTHS, list(range(12))), _codes(_AC_LENGTHS, _AC_SYMBOLS)
    bits: list[str] = []

    def put(code: tuple[int, int]) -> None:
        bits.append(format(code[0], f"0{code[1]}b"))

    def number(v: int, size: int) -> None:
        if size:
            bits.append(format(v if v > 0 else v + (1 << size) - 1, f"0{size}b"))

    before = [0] * len(planes)
    for m in range(len(blocks[0])):
        for i, plane in enumerate(blocks):
            block = plane[m]
            diff, before[i] = int(block[0]) - before[i], int(block[0])
            size = abs(diff).bit_length()
            put(dc[size])
            number(diff, size)
            run = 0
            last = int(np.flatnonzero(block[1:])[-1]) + 1 if block[1:].any() else 0
            for v in block[1 : last + 1].tolist():
                if v == 0:
                    run += 1
                    continue
                while run > 15:
                    put(ac[0xF0])
                    run -= 16
                size = abs(v).bit_length()
                put(ac[run << 4 | size])
                number(v, size)
                run = 0
            if last < 63:
                put(ac[0x00])
    stream = "".join(bits)
    stream += "1" * (-len(stream) % 8)
    body = int(stream, 2).to_bytes(len(stream) // 8, "big").replace(b"\xff", b"\xff\x00") if stream else b""
    part = lambda tag, data: bytes([0xFF, tag]) + struct.pack(">H", len(data) + 2) + data
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    out += b"".join(part(0xDB, bytes([i]) + bytes(t[_ZIGZAG].tolist())) for i, t in enumerate(tables))
    out += part(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(len(planes))))
    out += part(0xC4, b"\x00" + bytes(_DC_LENGTHS) + bytes(range(12))) + part(0xC4, b"\x10" + bytes(_AC_LENGTHS) + bytes(_AC_SYMBOLS))
    out += part(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + b"\0\x3f\0")
    return out + body + b"\xff\xd9"


def geometric_median(vectors: np.ndarray, eps: float = 1e-4, most: int = 200) -> np.ndarray:
    """Vector of least summed distance, starting at the mean (Weiszfeld steps)."""
    m = vectors.mean(axis=0)
    for _ in range(most):
        d = np.linalg.norm(vectors - m, axis=1)
        w = 1 / np.maximum(d, 1e-12)
        step = (vectors * w[:, None]).sum(axis=0) / w.sum()
        if np.linalg.norm(step - m) < eps:
            return step
        m = step
    return m


#: So many numbers of centres (groups times length of a vector) are sent to the tasks at most; beyond that centres are joined.
MOST_CENTRES = 4_000_000


def _joined_step(rows: DataFrame, centre: DataFrame, group: str) -> DataFrame:
    """One pass for any number of groups: vectors taken apart and joined with their group's centre."""
    parts = rows.select(group, "row", F.posexplode("v").alias("i", "x"))
    near = parts.join(centre, [group, "i"])
    weight = near.groupBy(group, "row").agg((1 / F.greatest(F.sqrt(F.sum((F.col("x") - F.col("m")) ** 2)), F.lit(1e-12))).alias("w"))
    return parts.join(weight, [group, "row"]).groupBy(group, "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m"))


def _broadcast_step(rows: DataFrame, centre: DataFrame, group: str) -> DataFrame:
    """One pass with the centres in every task: a batch of vectors gives a weighted sum per group, and only those are shuffled."""
    centres: dict = {}
    for g, i, m in centre.select(group, "i", "m").toLocalIterator():
        centres.setdefault(g, {})[i] = m
    shared = rows.sparkSession.sparkContext.broadcast({g: np.array([x[i] for i in range(len(x))]) for g, x in centres.items()})
    schema = T.StructType([rows.schema[group], T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("w", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            lists = batch.column(1)
            vectors = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
            codes = keys.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            out: tuple[list, list, list] = ([], [], [])
            for code in np.unique(codes):
                key, v = None if code < 0 else keys.dictionary[int(code)].as_py(), vectors[codes == code]
                w = 1 / np.maximum(np.linalg.norm(v - shared.value[key], axis=1), 1e-12)
                for c, x in zip(out, (key, (v * w[:, None]).sum(axis=0).tolist(), float(w.sum()))):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.list_(pa.float64())), pa.array(out[2], pa.float64())], names=[group, "s", "w"])

    sums = rows.select(group, "v").mapInArrow(run, schema).select(group, "w", F.posexplode("s").alias("i", "x"))
    return sums.groupBy(group, "i").agg((F.sum("x") / F.sum("w")).alias("m"))


def geomedian_over(df: DataFrame, group: str, vector: str, steps: int = 200, eps: float = 1e-4) -> DataFrame:
    """Geometric median per group of any size: each Weiszfeld step is one aggregation of weighted sums.

    All vectors have one length. Passes end once every group has moved by less than ``eps`` (groups with NaN don't count); a
    group that still moves after ``steps`` passes is an error.
    """
    from gridsmith.session import materialise

    # The row's number is given before its elements are taken apart, so that they share one weight.
    rows = df.filter(F.col(vector).isNotNull()).select(group, F.monotonically_increasing_id().alias("row"), F.col(vector).cast("array<double>").alias("v"))
    rows = materialise(rows, "geomedian-rows")
    centre = materialise(rows.select(group, F.posexplode("v").alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("m")), "geomedian")
    step = _broadcast_step if centre.count() <= MOST_CENTRES else _joined_step
    shift = F.nanvl(F.sqrt(F.sum((F.col("m") - F.col("before")) ** 2)), F.lit(0.0)).alias("shift")
    for _ in range(steps):
        before = centre.select(group, "i", F.col("m").alias("before"))
        centre = materialise(step(rows, centre, group), "geomedian")
        moved = centre.join(before, [group, "i"]).groupBy(group).agg(shift).agg(F.max("shift")).first()[0]
        if moved is None or moved < eps:
            break
    else:
        raise RuntimeError(f"geometric median: a group still moves after {steps} steps")
    return centre.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("median"))


def geomedian_pixels(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """Geometric median of each pixel's time series; a series is as long as the stack of scenes, so one task can hold it."""
    schema = T.StructType([*[df.schema[g] for g in group], T.StructField("median", T.ArrayType(T.DoubleType()))])

    def run(table: pa.Table) -> pa.Table:
        v = np.array(table.column(vector).to_pylist(), dtype=float)
        out = {g: table.column(g).slice(0, 1) for g in group} | {"median": pa.array([geometric_median(v).tolist()])}
        return pa.table(out)

    return df.filter(F.col(vector).isNotNull()).select(*group, vector).groupBy(*group).applyInArrow(run, schema)


def image_bytes(cells: DataFrame, group: list[str], level: int = 6, quality: int | None = None) -> DataFrame:
    """PNG (or, with ``quality``, JPEG) per group of pixels (x, y, r, g, b); an image must fit a task, as any encoder needs it whole.

    The columns are ``group`` and ``png`` or ``jpeg``; pixels that aren't there are black.
    """
    name = "png" if quality is None else "jpeg"
    schema = T.StructType([*[cells.schema[g] for g in group], T.StructField(name, T.BinaryType())])

    def run(table: pa.Table) -> pa.Table:
        x, y = (np.unique(table.column(c).to_numpy(), return_inverse=True)[1] for c in "xy")
        im = np.zeros((y.max() + 1, x.max() + 1, 3), np.uint8)
        for k, c in enumerate("rgb"):
            im[y, x, k] = table.column(c).to_numpy()
        return pa.table({g: table.column(g).slice(0, 1) for g in group} | {name: pa.array([png(im, level) if quality is None else jpeg(im, quality)], pa.binary())})

    return cells.groupBy(*group).applyInArrow(run, schema)


def pixels_of(images: DataFrame, group: list[str], column: str, x0: Column, y0: Column) -> DataFrame:
    """The pixels (x, y, r, g, b) of PNG images that aren't black; x and y start at ``x0`` and ``y0``."""
    pixel = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in ("x", "y", "r", "g", "b")]))

    @F.pandas_udf(pixel)
    def taken(data):  # noqa: ANN001, ANN202
        def one(raw: bytes) -> list[dict]:
            im = png_pixels(bytes(raw))
            ys, xs = np.nonzero(im.any(axis=2))
            return [dict(zip("xyrgb", (int(x), int(y), *map(int, im[y, x])))) for y, x in zip(ys, xs)]

        return data.map(one, na_action="ignore")

    out = images.select(*group, F.explode(taken(F.col(column))).alias("p"))
    return out.select(*group, (F.col("p.x") + x0).alias("x"), (F.col("p.y") + y0).alias("y"), "p.r", "p.g", "p.b")
