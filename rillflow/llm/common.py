"""What several operators of this subpackage share.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir``; only where that is unset (tests) is a folder of the driver's
machine set.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as ``bytes.split()`` has it: the complement of ``[^\x20\x09-\x0D]``.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="rillflow-")
        sc.setCheckpointDir(found)
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: computed once, and
    what follows doesn't depend on the executors that made it."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stable(df: DataFrame) -> DataFrame:
    """df, whose tasks give the same rows in the same order whenever they run: df itself
    if its plan only reads, projects and filters, else df written and read again."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return written(df, "input") if "Exchange" in plan or "RDD" in plan else df


#: Bytes of an Arrow batch between executor and Python worker.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession):
    """Sets the session's bound of Arrow batches in bytes, if it is higher or off: by rows alone
    a batch grows with the length of texts, and so does what executor and worker hold of it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """df for work that takes much time a row: a table with fewer row groups than there are
    cores is dealt out over them first."""
    bound_batches(df.sparkSession)
    plan = df._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if plan.execute().getNumPartitions() >= cores else df.repartition(2 * cores)


def largest(df: DataFrame, size: str, tie: str, limit: int) -> DataFrame:
    """The rows with the largest sizes (1 or more), at most limit, of equal sizes those with the
    least tie.  A histogram of sizes tells first from where on rows can be among them, so that
    neither the tasks' own best rows nor all rows are gathered."""
    df = written(df.withColumn("__rf_bin", F.floor(F.log2(F.col(size)) * 16).cast("int")), "largest")
    cut, held = 0, 0
    for r in sorted(df.groupBy("__rf_bin").count().collect(), key=lambda r: -r["__rf_bin"]):
        cut, held = r["__rf_bin"], held + r["count"]
        if held >= limit:
            break
    return df.where(F.col("__rf_bin") >= cut).drop("__rf_bin").repartition(8).orderBy(F.desc(size), tie).limit(limit)


def sampled(df: DataFrame, key: Column, limit: int) -> DataFrame:
    """At most limit rows, those with the least hash of the key (a string, distinct).  Hashes
    that are surely too large are dropped first, so that tasks send few rows in vain."""
    n, place = df.count(), F.pmod(F.xxhash64(key), F.lit(1 << 40))
    share = min(1.0, limit * 1.1 / max(1, n) + 1000.0 / max(1, n))
    near = df.withColumn("__rf_place", place).where(F.col("__rf_place") <= int(share * (1 << 40)))
    few = near.orderBy("__rf_place", key).limit(limit)
    return (few if share == 1 or few.count() >= min(limit, n) else df.withColumn("__rf_place", place).orderBy("__rf_place", key).limit(limit)).drop("__rf_place")


def one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """Of rows of one key the one whose columns, as strings, have the least SHA-256: the same row in
    every run, however the rows are dealt out.  Copies are dropped in each task before they are shuffled."""
    names = [c for c in rows.columns if c != key]
    told = F.sha2(F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), rows[c].cast("string")), F.lit("")) for c in names]), 256)
    best = rows.select(key, F.struct(*[rows[c] for c in names]).alias("__rf_row"), told.alias("__rf_told")).groupBy(key).agg(F.min_by("__rf_row", "__rf_told").alias("__rf_row"))
    return best.select(key, "__rf_row.*")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, each: int = 32 << 20) -> int:
    """Shuffle partitions for work on all of df: the session's number, and no fewer than one for
    so many bytes of its files, by the planner's size of its columns."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # tables without files have a default far above
    return max(shuffle_partitions(df.sparkSession), size // each + 1 if known else 0)


def text_of(docs: DataFrame, text_col: str) -> Column:
    """The text as a string, null as the empty string."""
    bound_batches(docs.sparkSession)
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 512, size: int = 4 << 20):
    """Each record batch in pieces of at most so many rows and about so many bytes: a
    Python worker's memory then doesn't depend on how long the texts are."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        step = max(1, min(rows, int(n * size / max(1, b.nbytes))))
        for i in range(0, n, step):
            yield b.slice(i, step)


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array from its bytes and the end of each value."""
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... (lengths[i] of them), one run after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)


def planes(values: np.ndarray) -> bytes:
    """uint64 values as byte planes, the low bytes first: high planes are mostly zero
    and compress to little."""
    v = np.ascontiguousarray(values, dtype="<u8")
    top = int(v.max()) if len(v) else 0
    n = max(1, (top.bit_length() + 7) // 8)
    return bytes([n]) + np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def unplanes(data: bytes) -> np.ndarray:
    n = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(n, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :n] = raw.T
    return out.view("<u8").ravel()


def field(df: DataFrame, name: str, as_name: str | None = None) -> T.StructField:
    return T.StructField(as_name or name, df.schema[name].dataType, True)
