"""The raster data source: what is read, what is written, and what a failed task leaves."""

import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual, StringContains

from rillflow.sources import geotiff, raster


def tiff(v, rows=4, tile=None, kind="<f4", packed=True, nodata=-9999.0, at=(10.0, 50.0, 0.5), predictor=False, head_last=True):
    """A raster of many strips or tiles, the directory at the end or before the samples."""
    kind = np.dtype(kind)
    order, (h, w) = ">" if kind.byteorder == ">" else "<", v.shape
    v = np.where(np.isnan(v), nodata, v).astype(kind)
    bh, bw = tile or (rows, w)
    blocks = []
    for y in range(0, h, bh):
        for x in range(0, w, bw):
            b = v[y : y + bh, x : x + bw]
            if tile:
                b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1])))
            if predictor:
                b = np.diff(b, axis=1, prepend=b.dtype.type(0)).astype(kind)
            blocks.append(zlib.compress(b.tobytes()) if packed else b.tobytes())
    fmt = {"u": 1, "i": 2, "f": 3}[kind.kind]
    none = f"{nodata:g}".encode() + b"\0"
    n = 14 + bool(tile)
    extra_at = 8 + 2 + 12 * n + 4 if not head_last else None
    body_at = 8 if head_last else extra_at + 8 * len(blocks) + 24 + 48 + len(none) + 16
    places = [body_at + sum(map(len, blocks[:k])) for k in range(len(blocks))]
    ifd_at = body_at + sum(map(len, blocks)) if head_last else 8
    free = ifd_at + 2 + 12 * n + 4
    table, extra = b"", b""
    entries = [(256, "H", (w,)), (257, "H", (h,)), (258, "H", (kind.itemsize * 8,)), (259, "H", (8 if packed else 1,)), (262, "H", (1,)), (277, "H", (1,)), (317, "H", (2 if predictor else 1,)), (339, "H", (fmt,)), (33550, "d", (at[2], at[2], 0.0)), (33922, "d", (0.0, 0.0, 0.0, at[0], at[1], 0.0))]
    entries += [(322, "H", (bw,)), (323, "H", (bh,)), (324, "I", places), (325, "I", [len(b) for b in blocks])] if tile else [(273, "I", places), (279, "I", [len(b) for b in blocks])]
    entries += [] if tile else [(278, "H", (bh,))]
    for tag, code, values in entries:
        raw = struct.pack(f"{order}{len(values)}{code}", *values)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", free + len(extra))
        extra += raw if len(raw) > 4 else b""
        table += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "d": 12}[code], len(values)) + place
    table += struct.pack(order + "HHII", 42113, 2, len(none), free + len(extra))
    extra += none
    k = len(entries) + 1
    ifd = struct.pack(order + "H", k) + table + bytes(4) + bytes(12 * (n - k)) + extra
    start = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", ifd_at)
    data = start + (b"".join(blocks) + ifd if head_last else ifd.ljust(body_at - 8, b"\0") + b"".join(blocks))
    return data


def sample(h=37, w=23, seed=0):
    v = np.random.default_rng(seed).integers(-50, 50, (h, w)).astype(float)
    v[3, :5] = np.nan
    return v


@pytest.fixture
def source(spark):
    raster.register(spark)
    return lambda path, **o: spark.read.format("geotiff").options(**o).load(str(path))


LAYOUTS = {
    "strips": {}, "tiles": {"tile": (16, 16)}, "raw": {"packed": False}, "big-endian": {"kind": ">i2", "rows": 5}, "predictor": {"kind": "<i4", "predictor": True},
    "header first": {"head_last": False}, "one strip": {"rows": 100}, "doubles": {"kind": "<f8", "tile": (16, 32)},
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_reads_every_layout(source, tmp_path, name):
    v = sample()
    (tmp_path / "a.tif").write_bytes(tiff(v, **LAYOUTS[name]))
    assert np.array_equal(geotiff.parse((tmp_path / "a.tif").read_bytes())[0], v, equal_nan=True)
    got = source(tmp_path).collect()
    assert {(r.i, r.j): r.value for r in got} == {(i, j): v[i, j] for i in range(37) for j in range(23) if not np.isnan(v[i, j])}
    assert all(r.lat == 50 - (r.i + 0.5) * 0.5 and r.lon == 10 + (r.j + 0.5) * 0.5 for r in got)


def read_of(reader, filters, monkeypatch):
    """(rows, filters left to Spark, bytes ranges that were read) of a scan, all in this process."""
    seen, fetch = [], raster.fetch
    monkeypatch.setattr(raster, "fetch", lambda store, path, at, n: seen.append((os.path.basename(path), at, n)) or fetch(store, path, at, n))
    left = list(reader.pushFilters(filters))
    parts = reader.partitions()
    heads = len(seen)
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    monkeypatch.setattr(raster, "fetch", fetch)
    return rows, left, seen[heads:], parts


def test_a_window_reads_its_strips_alone(tmp_path, monkeypatch):
    v = sample(400, 50, 1)
    data = tiff(v, rows=10)
    (tmp_path / "a.tif").write_bytes(data)
    h = raster.header(raster.fs.LocalFileSystem(), str(tmp_path / "a.tif"))
    reader = lambda: raster.Reader(str(tmp_path), False, 1 << 20, 1000)
    rows, left, reads, _ = read_of(reader(), [GreaterThanOrEqual(("i",), 100), LessThan(("i",), 120), EqualTo(("j",), 7)], monkeypatch)
    assert not left and [at for _, at, _ in reads] == [h.places[10][0], h.places[11][0]]
    assert {(r["i"], r["j"]) for r in rows} == {(i, 7) for i in range(100, 120)}
    # latitudes choose strips too, and are judged again by Spark
    f = [GreaterThan(("lat",), 50 - 0.5 * 30), StringContains(("path",), "a")]
    rows, left, reads, _ = read_of(reader(), f, monkeypatch)
    assert left == f and len(reads) == 4 and {r["i"] for r in rows} >= set(range(30))
    for nothing in ([GreaterThan(("i",), 399)], [EqualTo(("j",), -1)], [LessThanOrEqual(("i",), 3), GreaterThan(("i",), 5)], [LessThan(("lon",), 0.0)], [In(("path",), ("elsewhere",))]):
        rows, _, reads, parts = read_of(reader(), nothing, monkeypatch)
        assert rows == reads == parts == []


def test_tiles_and_tasks(tmp_path, monkeypatch):
    (tmp_path / "a.tif").write_bytes(tiff(sample(128, 128, 2), tile=(16, 16)))
    _, _, reads, parts = read_of(raster.Reader(str(tmp_path), False, 1, 1000), [GreaterThanOrEqual(("i",), 40), LessThanOrEqual(("i",), 60), GreaterThanOrEqual(("j",), 16), LessThan(("j",), 32)], monkeypatch)
    assert len(reads) == 2 and len(parts) == 2
    assert len(raster.Reader(str(tmp_path), False, 1, 1000).partitions()) == 64
    # of many files, tasks read headers themselves, and the same rows come
    for k in range(20):
        (tmp_path / f"b{k}.tif").write_bytes(tiff(sample(8, 8, k)))
    many = read_of(raster.Reader(str(tmp_path), False, 1 << 20, 5), [LessThan(("i",), 3)], monkeypatch)[0]
    assert many == read_of(raster.Reader(str(tmp_path), False, 1 << 20, 1000), [LessThan(("i",), 3)], monkeypatch)[0]


def test_conditions_reach_the_scan(source, tmp_path):
    v = sample(100, 20, 3)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.tif").write_bytes(tiff(v))
    (tmp_path / "sub" / "b.tif").write_bytes(tiff(v + 1))
    df = source(tmp_path, taskBytes="1").where("i BETWEEN 20 AND 27 AND j > 4 AND value > 0")
    assert df.rdd.getNumPartitions() == 2 * 2
    want = {(k, i, j) for k in (0, 1) for i in range(20, 28) for j in range(5, 20) if v[i, j] + k > 0}
    assert {(int(r.path.endswith("b.tif")), r.i, r.j) for r in df.collect()} == want
    near = source(tmp_path / "*.tif").where(F.col("lat").between(44.9, 47.2) & (F.col("lon") < 12.1))
    assert near.count() == sum(44.9 <= 50 - (i + 0.5) * 0.5 <= 47.2 for i in range(100)) * 4
    md = {os.path.basename(r.path): r for r in source(tmp_path, metadata="true").collect()}
    assert (md["b.tif"].nx, md["b.tif"].ny, md["b.tif"].blocks, md["b.tif"].minx, md["b.tif"].miny, md["b.tif"].nodata) == (20, 100, 25, 10.0, 0.0, -9999.0)


def pixels(spark, n=40):
    return spark.range(n * n).selectExpr("id % 2 + 1 AS cid", f"cast(id div {n} AS int) AS i", f"cast(id % {n} AS int) AS j", f"50 - (id div {n} + 0.5) * 0.5 AS lat", f"10 + (id % {n} + 0.5) * 0.5 AS lon", "id AS a", "CASE WHEN id % 5 > 0 THEN cast(id AS double) / 4 ELSE double('NaN') END AS b")


def test_maps_round_trip(spark, source, tmp_path):
    """All maps in one call; writing them again leaves the same files."""
    px = pixels(spark)
    out = raster.maps(px, {"hru": F.col("a"), "hand": F.col("b")}, ["cid"], 0.5, tile=16)
    for _ in range(2):
        out.write.format("geotiff").mode("append").save(str(tmp_path / "out"))
        files = sorted(os.path.relpath(os.path.join(d, f), tmp_path / "out") for d, _, fs in os.walk(tmp_path / "out") for f in fs)
        assert len(files) == 2 * 2 * 9 and "hand/1/2_0.tif" in files and not os.path.exists(tmp_path / "out" / "_attempts")
    for name, want in (("hru", "a"), ("hand", "b")):
        got = {(r.lat, r.lon): r.value for r in source(tmp_path / "out" / name).collect()}
        assert got == {(r.lat, r.lon): float(r[want]) for r in px.where(f"NOT isnan({want})").collect()}
    px.where("cid = 1").transform(lambda d: raster.maps(d, {"hru": F.col("a")}, ["cid"], 0.5, tile=16)).write.format("geotiff").mode("overwrite").save(str(tmp_path / "out"))
    assert source(tmp_path / "out").count() == 800


def test_a_failed_task_leaves_nothing(spark, source, tmp_path):
    out = raster.maps(pixels(spark), {"hru": F.col("a")}, ["cid"], 0.5, tile=16)
    out.where("name LIKE 'hru/1/%'").write.format("geotiff").mode("append").save(str(tmp_path / "out"))
    before = source(tmp_path / "out").count()
    bad = out.withColumn("content", F.when(F.col("name") == "hru/2/1_1", F.raise_error("lost").cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("geotiff").mode("append").save(str(tmp_path / "out"))
    assert source(tmp_path / "out").count() == before and not os.path.exists(tmp_path / "out" / "_attempts")
    with pytest.raises(Exception, match="name, content"):
        spark.range(1).write.format("geotiff").mode("append").save(str(tmp_path / "out"))


def test_a_second_attempt_leaves_no_second_copy(spark, source, tmp_path):
    """A task that ran twice: only the attempt whose message is committed counts."""
    rows = raster.maps(pixels(spark), {"hru": F.col("a")}, ["cid"], 0.5, tile=16).collect()
    w = raster.Writer(str(tmp_path / "out"), False)
    w.write(iter(rows[:5]))  # lost after it wrote
    w.commit([w.write(iter(rows[:9])), w.write(iter(rows[9:])), None])
    assert source(tmp_path / "out").count() == 1600 and not os.path.exists(tmp_path / "out" / "_attempts")
