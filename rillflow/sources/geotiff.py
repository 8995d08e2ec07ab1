"""GeoTIFF rasters as pixel tables, and back: one band, strips or tiles, uncompressed or
deflated, integer or floating samples.

Files are read by Spark's binary reader, one to a row; a file is one task's work, so a large
raster should be cut into tiles, as rasters in a store usually are.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}  # of sample format
#: Numbers of the tags that are read or written.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, FORMAT, SCALE, TIEPOINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
SCHEMA = "path string, i int, j int, lat double, lon double, value double"


def parse(data: bytes) -> tuple[np.ndarray, dict]:
    """Values (rows from the north, nodata as NaN) and minx, maxy, resx, resy, nodata."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n, _ = struct.unpack_from(order + "HHII", data, at + 2 + 12 * k)
        size = SIZES.get(kind, 1) * n
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        raw = data[where : where + size]
        tags[tag] = struct.unpack(f"{order}{n}{CODES[kind]}", raw) if kind in CODES else raw
    if tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError("one band only")
    w, h, packed = tags[WIDTH][0], tags[HEIGHT][0], tags.get(COMPRESSION, (1,))[0]
    if packed not in (1, 8, 32946):
        raise ValueError(f"compression {packed} isn't supported")
    kind = np.dtype(f"{order}{KINDS[tags.get(FORMAT, (1,))[0]]}{tags[BITS][0] // 8}")
    tiled = TILE_OFFSETS in tags
    bw, bh = (tags[TILE_W][0], tags[TILE_H][0]) if tiled else (w, tags.get(ROWS, (h,))[0])
    out = np.zeros((-(-h // bh) * bh, -(-w // bw) * bw), kind)
    across = out.shape[1] // bw
    for n, (o, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS], strict=True)):
        raw = data[o : o + size] if packed == 1 else zlib.decompress(data[o : o + size])
        block = np.frombuffer(raw, kind)
        rows = block.reshape(-1, bw)
        if tags.get(PREDICTOR, (1,))[0] == 2:
            rows = np.cumsum(rows, 1, dtype=kind)
        y, x = n // across * bh, n % across * bw
        out[y : y + len(rows), x : x + bw] = rows
    out = out[:h, :w].astype(float)
    none = tags.get(NODATA)
    none = float(none.split(b"\0")[0]) if none else None
    if none is not None:
        out[out == none] = np.nan
    (sx, sy), tie = tags.get(SCALE, (1.0, 1.0, 0.0))[:2], tags.get(TIEPOINT, (0.0,) * 6)
    return out, {"minx": tie[3] - tie[0] * sx, "maxy": tie[4] + tie[1] * sy, "resx": sx, "resy": sy, "nodata": none}


def build(values: np.ndarray, minx: float, maxy: float, res: float, nodata: float = -9999.0) -> bytes:
    """A deflated single-precision GeoTIFF; NaN becomes nodata."""
    h, w = values.shape
    body = zlib.compress(np.where(np.isnan(values), nodata, values).astype("<f4").tobytes())
    none = f"{nodata:g}".encode() + b"\0"
    entries = [
        (WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (32,)), (COMPRESSION, 3, (8,)), (262, 3, (1,)), (OFFSETS, 4, (8,)), (SAMPLES, 3, (1,)),
        (ROWS, 4, (h,)), (COUNTS, 4, (len(body),)), (FORMAT, 3, (3,)), (SCALE, 12, (res, res, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, minx, maxy, 0.0)), (NODATA, 2, none),
    ]
    at = 8 + len(body) + len(body) % 2
    head, extra = struct.pack("<H", len(entries)), b""
    free = at + 2 + 12 * len(entries) + 4
    for tag, kind, v in entries:
        raw = v if isinstance(v, bytes) else struct.pack(f"<{len(v)}{CODES[kind]}", *v)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", free + len(extra))
        extra += raw + b"\0" * (len(raw) % 2) if len(raw) > 4 else b""
        head += struct.pack("<HHI", tag, kind, len(v)) + place
    return b"II*\0" + struct.pack("<I", at) + body + b"\0" * (len(body) % 2) + head + struct.pack("<I", 0) + extra


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """Pixels with a value: (path, i, j, lat, lon, value), at cell centres."""

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf.path, pdf.content, strict=True):
                v, m = parse(bytes(content))
                i, j = np.nonzero(~np.isnan(v))
                for a in range(0, len(i), 100_000):
                    y, x = i[a : a + 100_000], j[a : a + 100_000]
                    yield pd.DataFrame({"path": p, "i": y.astype("int32"), "j": x.astype("int32"), "lat": m["maxy"] - (y + 0.5) * m["resy"], "lon": m["minx"] + (x + 0.5) * m["resx"], "value": v[y, x]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def raster_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: minx, maxx, miny, maxy, nx, ny, resx, resy, nodata."""

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf.path, pdf.content, strict=True):
                v, m = parse(bytes(content))
                h, w = v.shape
                yield pd.DataFrame({"path": [p], "minx": m["minx"], "maxx": m["minx"] + w * m["resx"], "miny": m["maxy"] - h * m["resy"], "maxy": m["maxy"], "nx": w, "ny": h, "resx": m["resx"], "resy": m["resy"], "nodata": m["nodata"]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, minx double, maxx double, miny double, maxy double, nx int, ny int, resx double, resy double, nodata double")


def to_geotiff(pixels: DataFrame, keys: list[str], value: str, res: float) -> DataFrame:
    """(keys, content): a GeoTIFF of each group of pixels (lat, lon at centres), missing
    pixels as nodata.  Groups are tiles: each is one worker's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y1 = pdf.lon.min() - res / 2, pdf.lat.max() + res / 2
        j, i = np.rint((pdf.lon - x0) / res - 0.5).astype(int), np.rint((y1 - pdf.lat) / res - 0.5).astype(int)
        v = np.full((i.max() + 1, j.max() + 1), np.nan)
        v[i, j] = pdf[value].astype(float)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "content": [build(v, x0, y1, res)]})

    from pyspark.sql import types as T

    rows = pixels.select(*keys, F.col("lat").cast("double"), F.col("lon").cast("double"), value)
    return rows.groupBy(*keys).applyInPandas(run, T.StructType([*[pixels.schema[k] for k in keys], T.StructField("content", T.BinaryType())]))
