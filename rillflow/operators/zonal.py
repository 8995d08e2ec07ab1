"""Zonal statistics: one grouped aggregation for a whole parameter table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .impute import _back

#: Conductivity where a zone's harmonic mean has no value, m/s.
DEFAULT_KSAT = 1.41e-4
MM_H = 3.6e6


def strict_mean(c: Column) -> Column:
    """A mean that any null (once a NaN) makes null."""
    return F.when(F.count(F.when(c.isNull(), 1)) == 0, F.avg(c))


def skip_mean(c: Column) -> Column:
    """A mean of what is there; NaN counts as missing."""
    return F.avg(F.when(~F.isnan(c), c))


def harmonic_mean(c: Column, scale: float = 1.0, default: float | None = None) -> Column:
    """count / sum of reciprocals / scale; the default where a value isn't positive or none
    is there."""
    ok = F.min(c) > 0
    mean = F.count(c) / F.sum(F.when(c > 0, F.lit(1.0) / c)) / scale
    return F.when(ok, mean).otherwise(F.lit(default))


def smallest_mode(c: Column, least: float | None = None, default: float | None = None) -> Column:
    """The most frequent value, the smallest of several; of values from ``least`` on only."""
    m = F.mode(c if least is None else F.when(c >= least, c), True)
    return m if default is None else F.coalesce(m, F.lit(default))


def weighted_mean(c: Column, w: Column) -> Column:
    """Of rows that have both; null where weights add up to 0."""
    both = c.isNotNull() & w.isNotNull()
    total = F.sum(F.when(both, w))
    return F.sum(F.when(both, c * w)) / F.when(total != 0, total)


def zonal(df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column]) -> DataFrame:
    """One row for each zone; stats by name, as the functions above make them."""
    return df.groupBy(*keys).agg(*[c.alias(name) for name, c in stats.items()])


def zonal_by_layer(df: DataFrame, keys: Sequence[str], layer: str, stats: Mapping[str, Column]) -> DataFrame:
    """Zonal statistics of each layer, as arrays in the order of layers."""
    long = zonal(df, [*keys, layer], stats)
    packed = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(layer, *stats))).alias("__l"))
    return packed.select(*keys, F.col(f"__l.{layer}").alias("layers"), *[F.col(f"__l.{n}").alias(n) for n in stats])


def share(df: DataFrame, keys: Sequence[str], col: str, name: str = "share", percent: float = 100.0) -> DataFrame:
    """Each row's percentage of its zone's total."""
    total = df.groupBy(*keys).agg(F.sum(col).alias("__t"))
    value = percent * F.col(col) / F.when(F.col("__t") != 0, F.col("__t"))
    out = df.withColumn(name, F.lit(None).cast("double"))
    return _back(out, total, keys, {name: value})


def soil_points(df: DataFrame, b: str = "BB", maxsmc: str = "MAXSMC", satpsi: str = "SATPSI", wilting: float = 200.0, reference: float = 3.4) -> DataFrame:
    """Wilting and reference point of aggregated soils, by the power law of retention."""
    at = lambda psi: F.col(maxsmc) * F.pow(F.lit(psi) / F.col(satpsi), -1.0 / F.col(b))
    return df.withColumns({"WLTSMC": at(wilting), "REFSMC": at(reference)})


def nested_area(df: DataFrame, outer: str, inner: str, area: str, tag: str, order: Column) -> DataFrame:
    """Area and last tag (by an explicit order) of each (outer, inner)."""
    return df.groupBy(outer, inner).agg(F.sum(area).alias(area), F.max_by(tag, order).alias(tag))


def member_mean(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Each member takes the mean of its cluster."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    return _back(df, means, keys, {c: F.col(f"__m_{c}") for c in cols})


def adjusted_area(pixels: DataFrame, bands: DataFrame, keys: Sequence[str], area: str, name: str = "pixel_area") -> DataFrame:
    """Each pixel's part of its band's area."""
    n = pixels.groupBy(*keys).agg(F.count("*").alias("__n")).join(bands.select(*keys, F.col(area).alias("__a")), list(keys))
    return _back(pixels.withColumn(name, F.lit(None).cast("double")), n, keys, {name: F.col("__a") / F.col("__n")})


def fractions(df: DataFrame, zone: Sequence[str], part: Sequence[str], name: str = "fraction") -> DataFrame:
    """Shares of a zone's rows that its parts have; they add up to 1."""
    counts = df.groupBy(*zone, *part).agg(F.count("*").alias("n"))
    total = counts.groupBy(*zone).agg(F.sum("n").alias("__t"))
    return _back(counts.withColumn(name, F.lit(None).cast("double")), total, zone, {name: F.col("n") / F.col("__t")})


def conditional_totals(df: DataFrame, keys: Sequence[str], value: str, sectors: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(when, F.col(value))), F.lit(0.0)).alias(name) for name, when in sectors.items()])


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w))
