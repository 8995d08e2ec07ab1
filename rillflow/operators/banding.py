"""Height bands and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .impute import _back


def bin_of(c: Column, low: Column, high: Column, n: int | Column) -> Column:
    """Number of the equal bin of [low, high], 0 to n - 1; the last is closed, and a range
    of width 0 is one bin.  Outside: null."""
    n = F.lit(n) if isinstance(n, int) else n
    at = F.floor((c - low) / F.when(high > low, (high - low) / n))
    return F.when((c >= low) & (c <= high), F.coalesce(F.least(at, n - 1), F.lit(0))).cast("int")


def height_bands(df: DataFrame, keys: Sequence[str], height: str, band_height: float, most: int = 100, name: str = "band") -> DataFrame:
    """Bands of equal height in each zone: as many as the zone's range asks for, at most
    ``most``."""
    ends = df.groupBy(*keys).agg(F.min(height).alias("__lo"), F.max(height).alias("__hi"))
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil((F.col("__hi") - F.col("__lo")) / band_height))).cast("int")
    return _back(df.withColumn(name, F.lit(None).cast("int")), ends, keys, {name: bin_of(F.col(height), F.col("__lo"), F.col("__hi"), n)})


def hist_density(df: DataFrame, keys: Sequence[str], col: str, low: float, high: float, n: int = 100) -> DataFrame:
    """(keys, bin, density) of bins with rows; densities integrate to 1 over [low, high]."""
    binned = df.select(*keys, bin_of(F.col(col), F.lit(low), F.lit(high), n).alias("bin")).where("bin IS NOT NULL")
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("__t"))
    width = (high - low) / n
    out = counts.withColumn("density", F.lit(None).cast("double"))
    if not keys:
        return out.crossJoin(F.broadcast(total)).withColumn("density", F.col("n") / (F.col("__t") * width)).select("bin", "density")
    return _back(out, total, keys, {"density": F.col("n") / (F.col("__t") * width)}).select(*keys, "bin", "density")
