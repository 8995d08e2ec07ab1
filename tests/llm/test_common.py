import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rillflow.llm import common
from tests.conftest import SF


def test_byte_planes():
    rng = np.random.default_rng(0)
    for v in ([], [0], [255, 256], rng.integers(0, 1 << 62, 99).tolist(), [2**64 - 1]):
        assert common.unplanes(common.planes(np.array(v, np.uint64))).tolist() == v


def test_ragged_and_binaries():
    assert common.ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert common.ragged(np.array([], int), np.array([], int)).tolist() == []
    b = common.binaries(np.frombuffer(b"abcd", np.uint8), np.array([1, 1, 4]))
    assert b.to_pylist() == [b"a", b"", b"bcd"]


def test_slices_are_bounded_and_whole():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 50)], ["t"])
    parts = list(common.slices([b, b.slice(0, 0)], rows=20, size=5000))
    assert sum(p.num_rows for p in parts) == 50 and max(p.num_rows for p in parts) <= 5


def test_tables_and_plans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert common.stable(docs) is docs
    shuffled = docs.repartition(3)
    assert common.stable(shuffled) is not shuffled and common.stable(shuffled).count() == docs.count()
    assert common.spread(shuffled) is shuffled
    wide = common.spread(docs)
    assert wide.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and wide.count() == docs.count()
    assert common.spread(spark.range(100).repartition(64).select(F.col("id"))).count() == 100


def test_partitions_follow_the_size_of_files(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    few, many = common.partitions_for(docs), common.partitions_for(docs, 1 << 12)
    assert few == common.shuffle_partitions(spark) < many < 1000
    assert common.partitions_for(spark.createDataFrame([(1,)], "x long").rdd.toDF()) == few


def test_largest_and_sampled(spark):
    rows = [(f"w{i:04}", 1 + (i * 7919) % 97) for i in range(3000)] + [("a", 10**12), ("b", 2)]
    df = spark.createDataFrame(rows, "word string, n long").repartition(5)
    for limit in (1, 50, 2999, 5000):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:limit]
        assert sorted(map(tuple, common.largest(df, "n", "word", limit).collect())) == sorted(want)
    picked = [sorted(r.word for r in common.sampled(x, F.col("word"), 100).collect()) for x in (df, df.repartition(2))]
    assert picked[0] == picked[1] and len(picked[0]) == 100
    assert common.sampled(df, F.col("word"), 9999).count() == len(rows) and common.sampled(df.limit(0), F.col("word"), 9).count() == 0
    assert common.largest(df.limit(0), "n", "word", 5).count() == 0
