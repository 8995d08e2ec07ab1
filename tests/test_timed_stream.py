import random

import pytest
from pyspark.sql import functions as F

from rillflow.operators import sequence
from rillflow.streaming import runner

KERNEL = [0.5, 0.3, 0.2]
SCHEMA = "band long, ts timestamp, v double"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(PROVIDER, before)


def put(spark, at, batch, rows):
    """A file of (band, seconds since 1970, v)."""
    df = spark.createDataFrame(rows, "band long, s double, v double")
    df.select("band", F.timestamp_seconds("s").alias("ts"), "v").coalesce(1).write.parquet(f"{at}/{batch:03d}")


def started(spark, at, checkpoint, name, **more):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(at)
    routed = runner.route_timed(stream, "band", "ts", "v", KERNEL, late="2 hours", **more)
    return routed.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").start()


def convolved(spark, rows):
    steps = spark.createDataFrame([(b, int(s // 3600), v or 0.0) for b, s, v in rows], "band long, step long, v double").groupBy("band", "step").agg(F.sum("v").alias("v"))
    k = spark.createDataFrame([(b, lag, w) for b in sorted({r[0] for r in rows}) for lag, w in enumerate(KERNEL)], "band long, lag long, w double")
    return {(r.band, r.step): round(r.routed, 9) for r in sequence.convolve(steps, k, ["band"], "step", "v", "lag", "w").collect()}


def test_rows_in_any_order_are_the_batch_convolution(rocks, tmp_path):
    rng, at = random.Random(3), str(tmp_path / "in")
    rows = [(b, 3600.0 * t + rng.randrange(3600), rng.random()) for b in (1, 2, 3) for t in (0, 0, 1, 2, 5, 6, 11, 30) if (b, t) != (3, 30)]
    rows.append((2, 3600.0 * 7, None))
    rows.sort(key=lambda r: r[1])
    # each file's rows are shuffled, and files overlap by less than the watermark's delay
    for i in range(0, len(rows), 6):
        part = rows[i : i + 6]
        rng.shuffle(part)
        put(rocks, at, i // 6, part)
    put(rocks, at, 90, [(None, 3600.0 * 60, 1.0)])
    put(rocks, at, 91, [(1, 3600.0 * 3, 99.0), (1, 3600.0 * 61, 0.0), (4, None, 5.0)])
    q = started(rocks, at, str(tmp_path / "ck"), "timed")
    q.processAllAvailable()
    q.stop()
    found = rocks.table("timed").collect()
    out = [r for r in found if not r.late]
    assert len(out) == len({(r.band, r.step) for r in out})
    assert {(r.band, r.step): round(r.routed, 9) for r in out} == convolved(rocks, rows)
    assert sorted(((r.band, r.step, r.v, r.routed) for r in found if r.late), key=str) == [(1, 3, 99.0, None), (4, None, 5.0, None)]
    # only what isn't closed is left
    left = {(r.band, r.step): r.amount for r in runner.open_steps(rocks, str(tmp_path / "ck"), "band").collect()}
    assert left == {(None, 60): 0.5, (None, 61): 0.3, (None, 62): 0.2, (1, 61): 0.0, (1, 62): 0.0, (1, 63): 0.0}


def test_state_moves_through_a_table(rocks, tmp_path):
    rows = [(b, 3600.0 * t, float(10 * b + t)) for t in range(12) for b in (1, 2)]
    whole, one, two = (str(tmp_path / n) for n in ("whole", "one", "two"))
    end = [(9, 3600.0 * 40, 0.0)]
    for i in range(4):
        part = rows[6 * i : 6 * i + 6]
        put(rocks, whole, i, part)
        put(rocks, one if i < 2 else two, i, part)
    put(rocks, whole, 8, end)
    put(rocks, two, 8, [*end, (1, 3600.0, 7.0)])
    q = started(rocks, whole, str(tmp_path / "ck0"), "whole_run")
    q.processAllAvailable()
    q.stop()
    q = started(rocks, one, str(tmp_path / "ck1"), "first_half")
    q.processAllAvailable()
    q.stop()
    runner.open_steps(rocks, str(tmp_path / "ck1"), "band").write.parquet(str(tmp_path / "state"))
    sent = {(r.band, r.step): r.routed for r in rocks.table("first_half").collect()}
    first = max(t for _, t in sent) + 1
    q = started(rocks, two, str(tmp_path / "ck2"), "second_half", begin=rocks.read.parquet(str(tmp_path / "state")), first=first)
    q.processAllAvailable()
    q.stop()
    rest = rocks.table("second_half").collect()
    assert [(r.band, r.step, r.v) for r in rest if r.late] == [(1, 1, 7.0)]
    more = {(r.band, r.step): r.routed for r in rest if not r.late}
    assert sent and more and not sent.keys() & more.keys()
    want = {(r.band, r.step): round(r.routed, 9) for r in rocks.table("whole_run").collect()}
    assert {k: round(v, 9) for k, v in (sent | more).items()} == want == convolved(rocks, rows)


def test_empty_stream_and_kernel(rocks, tmp_path):
    put(rocks, str(tmp_path / "in"), 0, [])
    q = started(rocks, str(tmp_path / "in"), str(tmp_path / "ck"), "nothing")
    q.processAllAvailable()
    q.stop()
    assert rocks.table("nothing").count() == 0
    with pytest.raises(ValueError, match="kernel"):
        runner.route_timed(rocks.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), "band", "ts", "v", [])
