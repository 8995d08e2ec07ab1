import json

import numpy as np
from pyspark.sql import functions as F

from rillflow.sources import tables
from rillflow.streaming import runner


def test_config_and_parameter_tables(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"dx": 90, "soil": {"dz": [0.1, 0.2]}}, indent=1))
    assert tables.read_config(spark, str(tmp_path / "c.json"))["soil"]["dz"] == [0.1, 0.2]
    (tmp_path / "s.tbl").write_text("Soil Parameters\nSTAS\n2,1   'BB  SATPSI'\n1, 2.79, 0.069, 'SAND'\n2, 4.26, 0.036, 'LOAMY SAND'\n\nOTHER\n1,1 'X'\n1, 9.0, 'ONE'\n")
    got = tables.read_class_table(spark, str(tmp_path / "s.tbl"), "STAS").collect()
    assert [tuple(r) for r in got] == [(1, 2.79, 0.069, "SAND"), (2, 4.26, 0.036, "LOAMY SAND")]
    (tmp_path / "n.tbl").write_text("&veg ! classes\n ISURBAN = 13\n CH2OP = 0.1, 0.2\n/\n")
    assert {tuple(map(str, r)) for r in tables.read_namelist(spark, str(tmp_path / "n.tbl")).collect()} == {("veg", "ISURBAN", "['13']"), ("veg", "CH2OP", "['0.1', '0.2']")}


def test_grids(spark, tmp_path):
    (tmp_path / "sand_latlon_2.5cm.asc").write_text("ncols 3\nnrows 2\nxllcorner 10.0\nyllcorner 50.0\ncellsize 0.5\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    px = tables.with_depths(tables.read_ascii_grid(spark, str(tmp_path)))
    rows = {(r.i, r.j): r for r in px.collect()}
    assert rows[0, 0].lat == 50.75 and rows[1, 2].lon == 11.25 and rows[1, 1].value is None and rows[0, 2].value == 3.0 and rows[0, 0].depth_cm == 2.5
    md = tables.grid_metadata(px).first()
    assert (md.nx, md.ny, md.resx, md.resy) == (3, 2, 0.5, 0.5)
    assert tables.in_box(px, (50.5, 51), (10, 11)).count() == 2


def test_geotiff_round_trip(spark, tmp_path):
    import struct

    from rillflow.sources import geotiff

    v = np.arange(12, dtype=float).reshape(3, 4)
    v[1, 2] = np.nan
    (tmp_path / "a_latlon_5cm.tif").write_bytes(geotiff.build(v, 10.0, 50.0, 0.5))
    px = geotiff.read_geotiff(spark, str(tmp_path / "*.tif"))
    rows = {(r.i, r.j): r for r in px.collect()}
    assert len(rows) == 11 and rows[2, 3].value == 11.0 and rows[0, 0].lat == 49.75 and rows[0, 3].lon == 11.75
    m = geotiff.raster_metadata(spark, str(tmp_path)).first()
    assert (m.minx, m.maxx, m.miny, m.maxy, m.nx, m.ny, m.nodata) == (10.0, 12.0, 48.5, 50.0, 4, 3, -9999.0)
    back, meta = geotiff.parse(bytes(geotiff.to_geotiff(px, ["path"], "value", 0.5).first().content))
    assert np.array_equal(back, v, equal_nan=True) and meta["maxy"] == 50.0
    # a big-endian file of uncompressed 16-bit strips of two rows
    body = np.arange(12, dtype=">i2").tobytes()
    tags = [(256, 3, 1, 4 << 16), (257, 3, 1, 3 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (273, 4, 2, 200), (278, 3, 1, 2 << 16), (279, 4, 2, 208), (339, 3, 1, 2 << 16)]
    ifd = struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + bytes(4)
    data = (b"MM\0*" + struct.pack(">I", 8) + ifd).ljust(200, b"\0") + struct.pack(">IIII", 216, 232, 16, 8) + body
    assert np.array_equal(geotiff.parse(data)[0], np.arange(12.0).reshape(3, 4))


def test_segments_and_model_inputs_are_replaced_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, "2018", 1.5), (2, "2018", 2.5), (1, "2019", 3.5)], "cid long, segment string, q double")
    at = str(tmp_path / "o")
    tables.write_outputs(df, at, ["segment"], ["q"], replace=True)
    for _ in range(2):
        tables.write_outputs(df.where("segment = '2019'").withColumn("q", F.col("q") + 1), at, ["segment"], ["q"], replace=True)
    assert sorted((r.cid, r.q) for r in tables.read_outputs(spark, at, ["q"]).collect()) == [(1, 1.5), (1, 4.5), (2, 2.5)]
    tables.write_tables({"units": df, "edges": df.select("cid", "q")}, str(tmp_path / "in"))
    tables.write_tables({"units": df.where("cid = 2").limit(0).unionByName(df.where("cid = 2").withColumn("q", F.lit(9.0)))}, str(tmp_path / "in"))
    got = tables.read_tables(spark, str(tmp_path / "in"), ["units", "edges"])
    assert sorted((r.cid, r.q) for r in got["units"].collect()) == [(1, 1.5), (1, 3.5), (2, 9.0)] and got["edges"].count() == 3
    one = tables.read_tables(spark, str(tmp_path / "in"), ["units"], [2])["units"]
    assert one.count() == 1 and "PartitionFilters: [isnotnull(cid" in one._jdf.queryExecution().executedPlan().toString()


def test_outputs_and_restart(spark, tmp_path):
    df = spark.createDataFrame([(1, "2018-01-01", 1.23456), (1, "2018-01-02", None)], "cid long, date string, q double")
    tables.write_outputs(df, str(tmp_path / "o"), ["date"], ["q"], {"q": 2})
    assert {r.q for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {np.float32(1.23).item(), -9999.0}
    assert tables.read_outputs(spark, str(tmp_path / "o"), ["q"]).where("q IS NULL").count() == 1
    cold = spark.createDataFrame([(1, 0.3)], "hru long, smc double")
    at = str(tmp_path / "state")
    assert tables.read_state(spark, at, "2018", cold).first().smc == 0.3
    tables.write_state(cold.withColumn("smc", F.lit(0.4)), at, "2018")
    assert tables.read_state(spark, at, "2018", cold).first().smc == 0.4


def test_times_and_mosaic(spark):
    df = spark.sql("SELECT timestamp_ntz'1900-01-02 03:00:00' AS ts")
    r = df.select(tables.hours_since(F.col("ts")).alias("h"), tables.from_hours(F.lit(27.0), "1900-01-01").alias("back"), "ts").first()
    assert r.h == 27.0 and r.back == r.ts
    a, b = (spark.createDataFrame([(1, 1.0), (2, 2.0)], f"mask long, {c} double") for c in "ab")
    assert {tuple(x) for x in tables.mosaic([a, b], "mask", [1, 2]).collect()} == {(1, 1.0, None), (2, None, 2.0)}
    assert [x.cid for x in tables.catchments(spark, 3).collect()] == [1, 2, 3]


def test_streamed_queue_is_the_batch_convolution(spark, tmp_path):
    from rillflow.operators import sequence

    kernel = [0.5, 0.3, 0.2]
    rows = [(k, t, float(10 * k + t)) for k in (1, 2) for t in (0, 1, 2, 5, 6)]
    for i, part in enumerate((rows[:2] + rows[5:7], rows[2:5] + rows[7:])):
        spark.createDataFrame(part, "band long, step long, v double").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("band long, step long, v double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = runner.route_queue(stream, "band", "step", "v", kernel).writeStream.format("memory").queryName("routed").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.band, r.step): round(r.routed, 9) for r in spark.table("routed").collect()}
    k = spark.createDataFrame(list(enumerate(kernel)), "lag long, w double")
    want = {(r.band, r.step): round(r.routed, 9) for b in (1, 2) for r in sequence.convolve(spark.createDataFrame(rows, "band long, step long, v double").where(f"band = {b}"), k, [], "step", "v", "lag", "w").withColumn("band", F.lit(b)).collect()}
    assert got == {x: want.get(x, 0.0) for x in got} and {x for x in want if x[1] <= 6} <= got.keys()


def test_streamed_days(spark, tmp_path):
    spark.sql("SELECT 1 AS cid, timestamp'2018-01-01 05:00:00' AS ts, 2.0D AS p UNION ALL SELECT 1, timestamp'2018-01-01 06:00:00', 3.0D UNION ALL SELECT 1, timestamp'2018-01-03 06:00:00', 1.0D").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cid int, ts timestamp, p double").parquet(str(tmp_path / "in"))
    q = runner.daily_balance(stream, "cid", "ts", ["p"]).writeStream.format("memory").queryName("days").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.cid, r.p) for r in spark.table("days").collect()] == [(1, 5.0)]
