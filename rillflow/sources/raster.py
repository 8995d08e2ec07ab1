"""GeoTIFF rasters as a data source of Spark's: ``spark.read.format("geotiff")``.

A raster's blocks (strips or tiles) are dealt out over tasks; conditions on i, j, lat, lon and path
choose files and blocks before anything is read, and a task reads the bytes of its blocks alone.
``option("metadata", "true")`` gives a row a file from its header.  ``df.write.format("geotiff")``
writes a file for each map and tile: tasks write attempts, and the job's commit moves one attempt of
each into place, so that a task that failed or ran twice leaves no file.

Paths are what ``pyarrow.fs`` reads: local paths or URIs of a store; a folder, a file or a pattern.
"""

from __future__ import annotations

import dataclasses
import fnmatch
import math
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import geotiff as g

PIXELS = "path string, i int, j int, lat double, lon double, value double"
METADATA = "path string, minx double, maxx double, miny double, maxy double, nx int, ny int, resx double, resy double, nodata double, blocks int"
#: Bytes of a header that are read at once; most headers fit.
HEAD = 4096
#: Blocks' bytes for one task, and files from which on tasks read headers themselves.
TASK_BYTES, MANY_FILES = 8 << 20, 1000


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and turns on what hands conditions to such sources
    (``spark.sql.python.filterPushdown.enabled``), which the format needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiff)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """Files of a folder (all below it), of a pattern in the last part, or the file, in order."""
    store, at = opened(path)
    base, last = posixpath.split(at.rstrip("/"))
    if any(c in last for c in "*?["):
        found = [x.path for x in store.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(x.path), last)]
    elif (info := store.get_file_info(at)).type == fs.FileType.Directory:
        found = [x.path for x in store.get_file_info(fs.FileSelector(at, recursive=True)) if x.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in x.path[len(at) :].split("/"))]
    elif info.type == fs.FileType.File:
        found = [at]
    else:
        raise FileNotFoundError(path)
    return sorted(x for x in found if x.lower().endswith((".tif", ".tiff")))


def fetch(store: fs.FileSystem, path: str, offset: int, size: int) -> bytes:
    """Bytes of a file: the one place at which files are read."""
    with store.open_input_file(path) as f:
        f.seek(offset)
        return f.read(size)


@dataclasses.dataclass(frozen=True)
class Header:
    """What a raster's tags say."""

    order: str
    tags: dict

    @property
    def size(self) -> tuple[int, int]:
        return self.tags[g.HEIGHT][0], self.tags[g.WIDTH][0]

    @property
    def block(self) -> tuple[int, int]:
        h, w = self.size
        return (self.tags[g.TILE_H][0], self.tags[g.TILE_W][0]) if g.TILE_OFFSETS in self.tags else (min(h, self.tags.get(g.ROWS, (h,))[0]), w)

    @property
    def across(self) -> int:
        return -(-self.size[1] // self.block[1])

    @property
    def places(self) -> list[tuple[int, int]]:
        """(offset, bytes) of each block."""
        tiled = g.TILE_OFFSETS in self.tags
        return list(zip(self.tags[g.TILE_OFFSETS if tiled else g.OFFSETS], self.tags[g.TILE_COUNTS if tiled else g.COUNTS], strict=True))

    @property
    def nodata(self) -> float | None:
        raw = self.tags.get(g.NODATA)
        return float(raw.split(b"\0")[0]) if raw else None

    @property
    def georeference(self) -> tuple[float, float, float, float]:
        """minx, maxy, resx, resy."""
        (sx, sy), tie = self.tags.get(g.SCALE, (1.0, 1.0, 0.0))[:2], self.tags.get(g.TIEPOINT, (0.0,) * 6)
        return tie[3] - tie[0] * sx, tie[4] + tie[1] * sy, sx, sy


def header(store: fs.FileSystem, path: str) -> Header:
    """Reads the tags, wherever in the file they are, and nothing else."""
    head = fetch(store, path, 0, HEAD)
    read = lambda at, n: head[at : at + n] if at + n <= len(head) else fetch(store, path, at, n)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack_from(order + "H", head, 2)[0] != 42:
        raise ValueError(f"{path} isn't a TIFF")
    at = struct.unpack_from(order + "I", head, 4)[0]
    n = struct.unpack(order + "H", read(at, 2))[0]
    table, tags = read(at + 2, 12 * n), {}
    for k in range(n):
        tag, kind, count, value = struct.unpack_from(order + "HHII", table, 12 * k)
        size = g.SIZES.get(kind, 1) * count
        raw = table[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else read(value, size)
        tags[tag] = struct.unpack(f"{order}{count}{g.CODES[kind]}", raw) if kind in g.CODES else raw
    if tags.get(g.SAMPLES, (1,))[0] != 1:
        raise ValueError(f"{path}: one band only")
    if tags.get(g.COMPRESSION, (1,))[0] not in (1, 8, 32946):
        raise ValueError(f"{path}: compression {tags[g.COMPRESSION][0]} isn't supported")
    return Header(order, tags)


def decoded(h: Header, raw: bytes) -> np.ndarray:
    """A block's samples, rows of the block's width."""
    kind = np.dtype(f"{h.order}{g.KINDS[h.tags.get(g.FORMAT, (1,))[0]]}{h.tags[g.BITS][0] // 8}")
    rows = np.frombuffer(raw if h.tags.get(g.COMPRESSION, (1,))[0] == 1 else zlib.decompress(raw), kind).reshape(-1, h.block[1])
    return np.cumsum(rows, 1, dtype=kind) if h.tags.get(g.PREDICTOR, (1,))[0] == 2 else rows


@dataclasses.dataclass
class Bounds:
    """Closed ranges of i, j, lat and lon, and the paths asked for."""

    low: dict = dataclasses.field(default_factory=dict)
    high: dict = dataclasses.field(default_factory=dict)
    paths: set | None = None

    def add(self, name: str, low: float, high: float) -> None:
        self.low[name] = max(self.low.get(name, low), low)
        self.high[name] = min(self.high.get(name, high), high)

    def rows_and_columns(self, h: Header) -> tuple[int, int, int, int]:
        """First and last row and column that can hold an answer.  Bounds of lat and lon are widened
        by a cell: conditions on them are judged again on each row."""
        minx, maxy, sx, sy = h.georeference
        inf = float("inf")
        low, high = (lambda n: self.low.get(n, -inf)), (lambda n: self.high.get(n, inf))
        i0, i1 = max(low("i"), (maxy - high("lat")) / sy - 1.5, 0), min(high("i"), (maxy - low("lat")) / sy + 0.5, h.size[0] - 1)
        j0, j1 = max(low("j"), (low("lon") - minx) / sx - 1.5, 0), min(high("j"), (high("lon") - minx) / sx + 0.5, h.size[1] - 1)
        return (1, 0, 1, 0) if i0 > i1 or j0 > j1 else (math.ceil(i0), math.floor(i1), math.ceil(j0), math.floor(j1))


@dataclasses.dataclass
class Blocks(InputPartition):
    """Blocks of one file with its header, or whole files whose headers are still to be read."""

    files: list
    head: Header | None = None
    blocks: list | None = None


class Reader(DataSourceReader):
    def __init__(self, path: str, metadata: bool, task_bytes: int, many_files: int):
        self.path, self.metadata, self.task_bytes, self.many_files, self.bounds = path, metadata, task_bytes, many_files, Bounds()

    def pushFilters(self, filters):
        """Ranges of i and j and sets of paths are taken over; those of lat and lon narrow what is read
        and are left to Spark as well, as all other conditions are."""
        inf = float("inf")
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            left, v = True, getattr(f, "value", None)
            if name in ("i", "j", "lat", "lon") and isinstance(v, (int, float)) and not self.metadata:
                strict = name in ("i", "j") and isinstance(v, int)
                step = 1 if strict else 0
                bounds = {EqualTo: (v, v), GreaterThan: (v + step, inf), GreaterThanOrEqual: (v, inf), LessThan: (-inf, v - step), LessThanOrEqual: (-inf, v)}.get(type(f))
                if bounds:
                    self.bounds.add(name, *bounds)
                    left = not strict
            elif name == "path" and isinstance(f, (EqualTo, In)):
                paths = {v} if isinstance(f, EqualTo) else set(v)
                self.bounds.paths, left = paths if self.bounds.paths is None else self.bounds.paths & paths, False
            if left:
                yield f

    def partitions(self):
        store, _ = opened(self.path)
        files = [p for p in listed(self.path) if self.bounds.paths is None or p in self.bounds.paths]
        if self.metadata or len(files) > self.many_files:
            n = max(1, len(files) // max(8, len(files) // 64))
            return [Blocks(files[k : k + n]) for k in range(0, len(files), n)]
        out = []
        for p in files:
            h = header(store, p)
            part, size = [], 0
            for b in self.wanted(h):
                part, size = [*part, b], size + h.places[b][1]
                if size >= self.task_bytes:
                    out.append(Blocks([p], h, part))
                    part, size = [], 0
            if part:
                out.append(Blocks([p], h, part))
        return out

    def wanted(self, h: Header) -> Iterator[int]:
        """The blocks that hold a row and a column within the bounds."""
        i0, i1, j0, j1 = self.bounds.rows_and_columns(h)
        bh, bw = h.block
        if i0 <= i1:
            for y in range(i0 // bh, i1 // bh + 1):
                yield from range(y * h.across + j0 // bw, y * h.across + j1 // bw + 1)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Blocks):
            return
        store, _ = opened(self.path)
        for p in partition.files:
            h = partition.head or header(store, p)
            if self.metadata:
                (ny, nx), (minx, maxy, sx, sy) = h.size, h.georeference
                yield pa.RecordBatch.from_pylist([{"path": p, "minx": minx, "maxx": minx + nx * sx, "miny": maxy - ny * sy, "maxy": maxy, "nx": nx, "ny": ny, "resx": sx, "resy": sy, "nodata": h.nodata, "blocks": len(h.places)}], pa.schema([("path", pa.string()), *[(c, pa.float64()) for c in ("minx", "maxx", "miny", "maxy")], ("nx", pa.int32()), ("ny", pa.int32()), *[(c, pa.float64()) for c in ("resx", "resy", "nodata")], ("blocks", pa.int32())]))
            else:
                for b in partition.blocks if partition.blocks is not None else self.wanted(h):
                    yield from self.pixels(store, p, h, b)

    def pixels(self, store, path: str, h: Header, b: int, rows: int = 65_536) -> Iterator[pa.RecordBatch]:
        i0, i1, j0, j1 = self.bounds.rows_and_columns(h)
        bh, bw = h.block
        y, x = b // h.across * bh, b % h.across * bw
        v = decoded(h, fetch(store, path, *h.places[b])).astype(float)
        if h.nodata is not None:
            v[v == h.nodata] = np.nan
        i, j = np.nonzero(~np.isnan(v[max(0, i0 - y) : i1 + 1 - y, max(0, j0 - x) : j1 + 1 - x]))
        i, j = i + max(0, i0 - y), j + max(0, j0 - x)
        minx, maxy, sx, sy = h.georeference
        for a in range(0, len(i), rows):
            r, c = i[a : a + rows], j[a : a + rows]
            names = ["path", "i", "j", "lat", "lon", "value"]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(r), pa.string()), pa.array(r + y, pa.int32()), pa.array(c + x, pa.int32()), pa.array(maxy - (r + y + 0.5) * sy), pa.array(minx + (c + x + 0.5) * sx), pa.array(v[r, c])], names)


@dataclasses.dataclass
class Written(WriterCommitMessage):
    """Where an attempt's files are and where they belong."""

    moves: list


class Writer(DataSourceWriter):
    """Rows (name, content): a file ``name.tif`` each.  An attempt writes below ``_attempts``; commit moves
    one attempt of each task and removes the rest.  A name that is there already is replaced, so that
    writing a segment again changes nothing but its own files."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def at(self, *parts: str) -> str:
        return posixpath.join(opened(self.path)[1], *parts)

    def write(self, iterator) -> Written:
        store, moves, attempt = opened(self.path)[0], [], uuid.uuid4().hex
        for row in iterator:
            final = self.at(f"{row.name}.tif")
            where = self.at("_attempts", self.job, attempt, f"{len(moves)}.tif")
            store.create_dir(posixpath.dirname(where), recursive=True)
            with store.open_output_stream(where) as f:
                f.write(bytes(row.content))
            moves.append((where, final))
        return Written(moves)

    def commit(self, messages) -> None:
        store = opened(self.path)[0]
        if self.overwrite:
            old = fs.FileSelector(self.at(), recursive=True, allow_not_found=True)
            for x in store.get_file_info(old):
                if x.type == fs.FileType.File and "/_attempts/" not in x.path:
                    store.delete_file(x.path)
        for where, final in sorted(move for m in messages if m for move in m.moves):
            store.create_dir(posixpath.dirname(final), recursive=True)
            store.move(where, final)
        self.drop()

    def abort(self, messages) -> None:
        self.drop()

    def drop(self) -> None:
        store = opened(self.path)[0]
        for at in (self.at("_attempts", self.job), self.at("_attempts")):
            if store.get_file_info(at).type == fs.FileType.Directory and (at.endswith(self.job) or not store.get_file_info(fs.FileSelector(at))):
                store.delete_dir(at)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return METADATA if self.metadata else PIXELS

    @property
    def metadata(self) -> bool:
        return self.options.get("metadata", "false").lower() == "true"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.metadata, int(self.options.get("taskBytes", TASK_BYTES)), int(self.options.get("manyFiles", MANY_FILES)))

    def writer(self, schema, overwrite: bool) -> Writer:
        if schema.names != ["name", "content"]:
            raise ValueError(f"a GeoTIFF sink takes (name, content), not {schema.names}: see maps()")
        return Writer(self.options["path"], overwrite)


def maps(pixels: DataFrame, values: dict[str, Column], keys: list[str], res: float, tile: int = 512, i: str = "i", j: str = "j", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(name, content): each value's map of each key as tiles of so many rows and columns, named
    ``value/key/row_column``; null, NaN and infinite values are nodata.  A tile is one worker's
    work, bounded by its size; all maps are made in one shuffle of the pixels."""
    c = F.col
    named = F.array(*[F.struct(F.lit(n).alias("map"), v.cast("double").alias("v")) for n, v in values.items()])
    rows = pixels.select(*keys, c(i).cast("int").alias("i"), c(j).cast("int").alias("j"), c(lat).cast("double").alias("lat"), c(lon).cast("double").alias("lon"), F.explode(named).alias("x"))
    rows = rows.select(F.concat_ws("/", c("x.map"), *[c(k).cast("string") for k in keys], F.concat_ws("_", F.floor(c("i") / tile), F.floor(c("j") / tile))).alias("name"), (c("i") % tile).alias("i"), (c("j") % tile).alias("j"), "lat", "lon", c("x.v").alias("v"))

    def build(t: pa.Table) -> pa.Table:
        y, x, v = (t.column(n).to_numpy() for n in ("i", "j", "v"))
        v = np.where(np.isfinite(v), v, np.nan)
        out = np.full((y.max() - y.min() + 1, x.max() - x.min() + 1), np.nan)
        out[y - y.min(), x - x.min()] = v
        west, north = t.column("lon").to_numpy().min() - res / 2, t.column("lat").to_numpy().max() + res / 2
        return pa.table({"name": [t.column("name")[0].as_py()], "content": pa.array([g.build(out, west, north, res)], pa.binary())})

    return rows.groupBy("name").applyInArrow(build, "name string, content binary")
