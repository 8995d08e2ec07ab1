"""Cleaning columns: sentinels, imputation, masks, recoding, bounds.

All operators are projections, with a window or a small aggregate by ``keys`` where a
statistic of a zone is needed; columns and keys are arguments.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What marks a missing value in the model's rasters, states and integers.
RASTER_NODATA, STATE_FILL, INT_FILL = -9999.0, 9999999999.0, -2147483647


def finite(c: Column) -> Column:
    """NaN, infinities and the raster sentinel become null."""
    bad = F.isnan(c) | (F.abs(c) == float("inf")) | (c == RASTER_NODATA)
    return F.when(~bad, c)


def sentinel_to_null(df: DataFrame, cols: Sequence[str], sentinel: float = RASTER_NODATA) -> DataFrame:
    return df.withColumns({c: F.when((F.col(c) != sentinel) & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")), F.col(c)) for c in cols})


def null_to_sentinel(df: DataFrame, cols: Sequence[str], sentinel: float = RASTER_NODATA) -> DataFrame:
    """What a raster or restart sink stores."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(sentinel).cast(df.schema[c].dataType)) for c in cols})


def missing_ratio(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Share of nulls of each column in each zone."""
    return df.groupBy(*keys).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_missing") for c in cols])


def require_present(df: DataFrame, keys: Sequence[str], cols: Sequence[str], fatal: Sequence[str], most: float = 0.99) -> DataFrame:
    """missing_ratio with a column ``poor`` of the columns above the limit; one of
    ``fatal`` raises when the rows are computed."""
    r = missing_ratio(df, keys, cols)
    poor = F.array_compact(F.array(*[F.when(F.col(f"{c}_missing") > most, F.lit(c)) for c in cols]))
    r = r.withColumn("poor", poor)
    if not fatal:
        return r
    hit = F.array_intersect("poor", F.array(*map(F.lit, fatal)))
    return r.where(F.when(F.size(hit) > 0, F.raise_error(F.concat(F.lit("columns without data: "), F.array_join(hit, ", "))).cast("boolean")).otherwise(True))


def mean_impute(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Nulls take the zone's mean.  Means are aggregated first and joined back, so that a
    large zone isn't sorted by a window."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"__m_{c}") for c in cols])
    return _back(df, means, keys, {c: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in cols})


def mode_impute(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Nulls take the zone's most frequent value, the smallest of several."""
    out = df
    for c in cols:
        counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("__n"))
        top = counts.groupBy(*keys).agg(F.min_by(c, F.struct(-F.col("__n"), F.col(c))).alias(f"__m_{c}"))
        out = _back(out, top, keys, {c: F.coalesce(F.col(c), F.col(f"__m_{c}"))})
    return out


def _back(df: DataFrame, stats: DataFrame, keys: Sequence[str], new: Mapping[str, Column]) -> DataFrame:
    """Joins statistics of zones to rows; null keys are a zone too."""
    other = stats.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in stats.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(other, on, "left").withColumns(dict(new)).select(*df.columns)


def mask_outside(df: DataFrame, inside: Column, cols: Sequence[str], exempt: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({c: F.when(inside, F.col(c)) for c in cols if c not in exempt})


def derive_terrain(df: DataFrame, aspect: str, area: str) -> DataFrame:
    """Components of the aspect and the logarithm of the area, as clustering takes them."""
    return df.withColumns({"x_aspect": F.sin(aspect), "y_aspect": F.cos(aspect), "carea_log10": F.log10(area)})


def recode(c: Column, rules: Sequence[tuple[Column, float]], default: float | None = None) -> Column:
    """Ordered rules of which a later one wins over those before."""
    out = F.lit(default)
    for when, value in rules:
        out = F.when(when, F.lit(value)).otherwise(out)
    return out


def graded_mask(land_cover: Column, full: Sequence[int], most: Sequence[int] = (), some: Sequence[int] = (), least: Sequence[int] = ()) -> Column:
    """Weights 1, 0.66, 0.33 and 0.01 for groups of classes; other classes: null."""
    groups = [(least, 0.01), (some, 0.33), (most, 0.66), (full, 1.0)]
    return recode(land_cover, [(land_cover.isin(*g), w) for g, w in groups if g])


def one_hot(df: DataFrame, col: str, classes: Sequence[int], prefix: str = "lc_") -> DataFrame:
    return df.withColumns({f"{prefix}{k}": (F.col(col) == k).cast("double") for k in classes})


def initiate(area: Column, threshold: float) -> Column:
    """Pixels whose upstream area makes a channel."""
    return F.coalesce(area > threshold, F.lit(False))


def fill_inside(value: Column, inside: Column, fill: float = 0.0) -> Column:
    return F.when(value.isNull() & inside.isNotNull(), F.lit(fill)).otherwise(value)


def both_present(a: Column, b: Column) -> tuple[Column, Column]:
    """Two maps, each null where the other is."""
    ok = a.isNotNull() & b.isNotNull()
    return F.when(ok, a), F.when(ok, b)


def rebase(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Ids from 0 on: less the smallest of the zone."""
    if not keys:
        return df.withColumn(col, F.col(col) - df.agg(F.min(col)).scalar())
    low = df.groupBy(*keys).agg(F.min(col).alias("__m_low"))
    return _back(df, low, keys, {col: F.col(col) - F.col("__m_low")})


def clamp(c: Column, low: float | None = None, high: float | None = None) -> Column:
    c = c if low is None else F.greatest(c, F.lit(low))
    return c if high is None else F.least(c, F.lit(high))


def rough_floodplain(floodplain: Column, channel: Column) -> Column:
    """A floodplain is no smoother than its channel."""
    return F.greatest(floodplain, channel)


def depth_to_rate(depth_m: Column, dt_seconds: float) -> Column:
    """Metres in a step to mm/s."""
    return depth_m * 1000.0 / dt_seconds


def rate_to_depth(rate_mm_s: Column, dt_seconds: float) -> Column:
    """mm/s to metres in a step."""
    return rate_mm_s * dt_seconds / 1000.0


def backfill(df: DataFrame, constants: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in constants.items()})
