"""Sources and sinks: configuration, parameter tables, grids, partitioned tables, restarts.

Paths may be in any store that Spark reads: all go through its readers and writers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.impute import RASTER_NODATA, null_to_sentinel, sentinel_to_null

#: Digits after the point that outputs keep, by column.
Digits = Mapping[str, int]


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON file as a dictionary."""
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def text_of(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def read_class_table(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """A table of classes: comma-separated numbers with the class first and a name in quotes
    last; the first line has the column names in quotes.  section: the line that a table
    follows in a file of several."""
    lines = [line.split("!")[0].strip() for line in text_of(spark, path).splitlines()]
    if section is not None:
        lines = lines[next(i for i, x in enumerate(lines) if x.strip("'\" ") == section) + 1 :]
    names: list[str] = []
    rows: list[tuple] = []
    for line in lines:
        quoted = re.findall(r"'([^']*)'", line)
        parts = [p.strip() for p in re.sub(r"'[^']*'", "", line).split(",") if p.strip()]
        if not names and quoted:  # the line of column names stands first
            names = quoted[0].split()
        elif re.match(r"\s*\d+\s*,", line):
            rows.append((int(parts[0]), *map(float, parts[1:]), quoted[-1].strip() if quoted else None))
        elif rows:
            break
    width = max(map(len, rows), default=2) - 2
    names = [n.lower() for n in names][:width] if len(names) >= width else [f"p{i}" for i in range(width)]
    schema = T.StructType([T.StructField("class", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("name", T.StringType())])
    return spark.createDataFrame(rows, schema)


def read_namelist(spark: SparkSession, path: str) -> DataFrame:
    """(block, name, value): a namelist file's entries, values as arrays of numbers or text."""
    block, rows = "", []
    for line in text_of(spark, path).splitlines():
        line = line.split("!")[0].strip()
        if line.startswith("&"):
            block = line[1:].strip()
        elif "=" in line:
            name, value = line.split("=", 1)
            rows.append((block, name.strip(), [v.strip().strip("'\"") for v in value.split(",") if v.strip()]))
    return spark.createDataFrame(rows, "block string, name string, value array<string>")


def read_ascii_grid(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """ESRI ASCII grids of a folder as pixels (path, i, j, lat, lon, value), cell centres,
    nodata as null; row 0 is the north."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\\n").alias("lines"))
    get = lambda name: F.regexp_extract(F.array_join(F.slice("lines", 1, 6), "\n"), rf"(?i){name}\s+(\S+)", 1).cast("double")
    head = text.withColumns({k: get(k) for k in ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value")})
    rows = head.select("path", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value", F.posexplode(F.slice("lines", F.lit(7), F.col("nrows").cast("int"))).alias("i", "row"))
    cells = rows.select("*", F.posexplode(F.split(F.trim("row"), "\\s+")).alias("j", "v"))
    v = F.col("v").cast("double")
    return cells.select("path", "i", "j", (F.col("yllcorner") + (F.col("nrows") - F.col("i") - 0.5) * F.col("cellsize")).alias("lat"), (F.col("xllcorner") + (F.col("j") + 0.5) * F.col("cellsize")).alias("lon"), F.when(v != F.col("nodata_value"), v).alias(value))


def grid_metadata(pixels: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Bounds and size of grids."""
    res = lambda hi, lo, n: (F.max(hi) - F.min(lo)) / F.nullif(F.max(n) - F.min(n), F.lit(0))
    return pixels.groupBy(*keys).agg(F.min("lon").alias("minx"), F.max("lon").alias("maxx"), F.min("lat").alias("miny"), F.max("lat").alias("maxy"), F.countDistinct("j").alias("nx"), F.countDistinct("i").alias("ny"), res("lon", "lon", "j").alias("resx"), res("lat", "lat", "i").alias("resy"))


def in_box(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float], lat_col: str = "lat", lon_col: str = "lon") -> DataFrame:
    """A window of a grid; on a Parquet table these bounds reach the scan."""
    return df.where(F.col(lat_col).between(*lat) & F.col(lon_col).between(*lon))


def depth_of(path: Column) -> Column:
    """Depth in cm from a file's name."""
    return F.regexp_extract(path, r"latlon_([0-9.]+)cm", 1).cast("double")


def with_depths(pixels: DataFrame, path_col: str = "path") -> DataFrame:
    return pixels.withColumn("depth_cm", depth_of(F.col(path_col)))


def catchments(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", "cid")


def read_forcing(spark: SparkSession, path: str, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Steps of [start, end); a partitioned table reads these alone."""
    return spark.read.parquet(path).where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))


def hours_since(ts: Column, origin: str = "1900-01-01") -> Column:
    return F.timestamp_diff("HOUR", F.lit(origin).cast("timestamp_ntz"), ts).cast("double")


def from_hours(hours: Column, origin: str) -> Column:
    return F.timestamp_add("SECOND", (hours * 3600).cast("int"), F.lit(origin).cast("timestamp_ntz"))


def write_outputs(df: DataFrame, path: str, by: Sequence[str], values: Sequence[str], digits: Digits | None = None, sentinel: float = RASTER_NODATA, replace: bool = False) -> None:
    """A partitioned table of outputs in single precision, rounded, nulls as the sentinel.  With
    ``replace``, partitions (segments) that df has are replaced whole and others stay, so that a segment
    written again, or by a job that was restarted, is there once."""
    for c in values:
        v = F.bround(F.col(c), digits[c]) if digits and c in digits else F.col(c)
        df = df.withColumn(c, v.cast("float"))
    _partitioned(null_to_sentinel(df, list(values), sentinel), path, by, replace)


def _partitioned(df: DataFrame, path: str, by: Sequence[str], replace: bool) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") if replace else df.write.mode("append")
    writer.partitionBy(*by).parquet(path)


def write_tables(tables: Mapping[str, DataFrame], path: str, by: str = "cid") -> None:
    """A model's input: each table below its name, a folder for each catchment.  Catchments that a
    table has are replaced whole, others stay."""
    for name, df in tables.items():
        _partitioned(df, f"{path}/{name}", [by], replace=True)


def read_tables(spark: SparkSession, path: str, names: Sequence[str], cids: Sequence[int] | None = None, by: str = "cid") -> dict[str, DataFrame]:
    """The tables again; of some catchments only their folders are read."""
    out = {}
    for name in names:
        df = spark.read.parquet(f"{path}/{name}")
        df = df.withColumn(by, F.col(by).cast("long"))
        out[name] = df if cids is None else df.where(F.col(by).isin(*cids))
    return out


def read_outputs(spark: SparkSession, path: str, values: Sequence[str], sentinel: float = RASTER_NODATA) -> DataFrame:
    return sentinel_to_null(spark.read.parquet(path), list(values), sentinel)


def write_state(state: DataFrame, path: str, segment: str) -> None:
    """A restart snapshot of a segment; written again it is replaced whole."""
    state.write.mode("overwrite").parquet(f"{path}/segment={segment}")


def read_state(spark: SparkSession, path: str, segment: str | None, cold: DataFrame) -> DataFrame:
    """The snapshot of a segment, or a cold start where there is none."""
    if segment is None:
        return cold
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/segment={segment}")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return cold
    return spark.read.schema(cold.schema).parquet(f"{path}/segment={segment}")


def mosaic(parts: Sequence[DataFrame], mask: str, cid: Sequence[int]) -> DataFrame:
    """Catchments' pixels as one table, each with its own mask only."""
    own = [p.where(F.col(mask) == c) for p, c in zip(parts, cid, strict=True)]
    out = own[0]
    for p in own[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
