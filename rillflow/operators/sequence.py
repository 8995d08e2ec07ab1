"""Operators over an order: time, layers, stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def lead_min(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, name: str | None = None) -> DataFrame:
    """min(x[i], x[i + 1]) with values as they were; the last keeps its own."""
    return df.withColumn(name or col, F.least(F.col(col), F.lead(col).over(_by(keys, order))))


def difference(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: str, name: str) -> DataFrame:
    return df.withColumn(name, F.col(col) - F.lag(col).over(_by(keys, order)))


def normalise(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """A unit hydrograph's ordinates, to a sum of 1."""
    total = F.sum(col).over(Window.partitionBy(*keys))
    return df.withColumn(col, F.col(col) / F.when(total != 0, total))


def convolve(runoff: DataFrame, kernel: DataFrame, keys: Sequence[str], step: str, value: str, lag: str, weight: str, name: str = "routed", legacy_queue: bool = False) -> DataFrame:
    """Sum over k of value[t - k] * weight[k], for every t that anything arrives at.

    ``step`` is an integer number of steps; ``keys`` are in both tables (none: one kernel for
    all, of a bounded number of lags).  Each value meets its lags and is summed again at its
    arrival: no state is carried, and steps of one key needn't be in one task.

    legacy_queue: the reference's aliasing, by which lag 1 is lost and later lags arrive a
    step early."""
    k = kernel
    if legacy_queue:
        k = k.where(F.col(lag) != 1).withColumn(lag, F.when(F.col(lag) > 1, F.col(lag) - 1).otherwise(F.col(lag)))
    if keys:
        met = runoff.join(k.select(*keys, lag, weight), list(keys))
    else:
        met = runoff.crossJoin(F.broadcast(k.select(lag, weight)))
    arrive = met.select(*keys, (F.col(step) + F.col(lag)).alias(step), (F.col(value) * F.col(weight)).alias("__v"))
    return arrive.groupBy(*keys, step).agg(F.sum("__v").alias(name))


def vertical_integral(value: Column, dz: Column) -> Column:
    """Sum over layers of value * thickness; arrays of equal length."""
    return F.aggregate(F.zip_with(value, dz, lambda v, d: v * d), F.lit(0.0), lambda s, x: s + x)


def root_zone_mean(value: Column, dz: Column, depth: float) -> Column:
    """Mean of the layers down to a depth, the last in part."""
    tops = F.transform(dz, lambda d, i: F.aggregate(F.slice(dz, F.lit(1), i), F.lit(0.0), lambda s, x: s + x))
    part = F.zip_with(tops, dz, lambda t, d: F.greatest(F.lit(0.0), F.least(d, F.lit(depth) - t)))
    return vertical_integral(value, part) / F.aggregate(part, F.lit(0.0), lambda s, x: s + x)


def cumulative(values: Column) -> Column:
    """Running sums of an array, in one pass."""
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(values, start, lambda a, x: F.struct((a["s"] + x).alias("s"), F.array_append(a["out"], a["s"] + x).alias("out")))["out"]


def step_hold(steps: DataFrame, forcing: DataFrame, keys: Sequence[str], step: str, every: int, index: str) -> DataFrame:
    """Forcing of index floor(step / every): held, not interpolated."""
    return steps.withColumn(index, F.floor(F.col(step) / every).cast("long")).join(forcing, [*keys, index], "left")


def interpolate(x: Column, knots: Column, left: float | None = 0.0) -> Column:
    """Linear interpolation at x in knots, an array of (x, y) ascending by x: ``left`` before
    the first (null: that knot's y), the last y after the last."""
    n = F.size(knots)
    below = F.filter(knots, lambda k: k["x"] <= x)
    i = F.size(below)
    a, b = F.get(knots, i - 1), F.get(knots, i)
    first = F.get(knots, F.lit(0))["y"] if left is None else F.lit(left)
    span = b["x"] - a["x"]
    return F.when(n == 0, F.lit(None)).when(i == 0, first).when(i == n, a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / F.when(span != 0, span))


def knots_of(df: DataFrame, keys: Sequence[str], x: str, y: str, name: str = "knots") -> DataFrame:
    """Knots of a zone (a profile's few depths), ascending."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias(name))


def block_mean(df: DataFrame, keys: Sequence[str], ts: str, width: str, cols: Sequence[str], name: str = "block") -> DataFrame:
    """Means of blocks of time (``1 day``, ``3 hours``)."""
    return df.groupBy(*keys, F.window(ts, width)["start"].alias(name)).agg(*[F.avg(c).alias(c) for c in cols])


def in_season(month: Column, start: Column | int, end: Column | int) -> Column:
    """Whether a month is in a season that may go over the year's end."""
    s, e = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.when(s <= e, (month >= s) & (month <= e)).otherwise((month >= s) | (month <= e))


def monthly(day_of_year: Column, twelve: Column, northern: Column | bool = True, days: float = 365.0) -> Column:
    """A monthly table, its values mid-month, at a day of the year; half a year off in the
    south.  days: length of the year."""
    north = F.lit(northern) if isinstance(northern, bool) else northern
    day = F.when(north, day_of_year.cast("double")).otherwise(F.pmod(day_of_year + 0.5 * days, F.lit(days)))
    t = 12.0 * day / days
    i1 = (t + 0.5).cast("int")
    w1 = i1 + 0.5 - t
    wrap = lambda i: F.when(i < 1, 12).when(i > 12, 1).otherwise(i)
    return w1 * F.element_at(twelve, wrap(i1)) + (1.0 - w1) * F.element_at(twelve, wrap(i1 + 1))


def stage_table(df: DataFrame, keys: Sequence[str], hand: str, area: str, length: str, bankfull: str, channel_width: str) -> DataFrame:
    """Cross-sections of reaches: a row for each stage, sorted by its height above the
    channel.

    Heights above the first are lowered by the first step and raised by the bankfull depth;
    widths are areas over the length, with the channel's width moved between the first two
    (at most 0.9 of the second); an interior stage's slope is its rise over half its width,
    the last copies the one before; perimeters and areas below each stage are running sums
    from 0.  Stages of one height go by area, then by the other columns, so that rows that differ
    have one order; unknown heights come last."""
    w = _by(keys, [F.asc_nulls_last(x) for x in (hand, area, length, bankfull, channel_width)])
    up = w.rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("stage", F.row_number().over(w) - 1)
    first, second = (F.max(F.when(F.col("stage") == i, F.col(hand))).over(Window.partitionBy(*keys)) for i in (0, 1))
    d = d.withColumn("__z", F.when(F.col("stage") == 0, F.col(hand)).otherwise(F.col(hand) - (second - first) + F.col(bankfull)))
    d = d.withColumn("__w", F.col(area) / F.col(length))
    w0, w1 = (F.max(F.when(F.col("stage") == i, F.col("__w"))).over(Window.partitionBy(*keys)) for i in (0, 1))
    moved = F.least(F.col(channel_width) - w0, 0.9 * w1)
    d = d.withColumn("width", F.when(F.col("stage") == 0, F.col("__w") + F.coalesce(moved, F.lit(0.0))).when(F.col("stage") == 1, F.col("__w") - moved).otherwise(F.col("__w")))
    rise = F.lead("__z").over(w) - F.col("__z")
    d = d.withColumn("__s", F.when(F.col("stage") > 0, rise / (F.col("width") / 2)))
    d = d.withColumn("slope", F.coalesce(F.col("__s"), F.when(F.col("stage") > 0, F.lag("__s").over(w))))
    d = d.withColumn("__r", rise)
    floor_ = F.when(F.col("stage") == 0, F.col("width") + 2 * F.col("__r")).otherwise(2 * F.col("__r"))
    wall = F.when(F.col("stage") > 0, F.sqrt(F.col("width") * F.col("width") / 4 + F.col("__r") * F.col("__r")) * 2).otherwise(F.lit(0.0))
    flood = F.when(F.col("stage") > 0, F.col("width") * F.col("__r") / 2).otherwise(F.lit(0.0))
    below = F.coalesce(F.sum("width").over(up), F.lit(0.0))
    full = below * F.col("__r") + F.when(F.col("stage") == 0, F.col("width") * F.col("__r")).otherwise(F.lit(0.0))
    sums = {"Pc": floor_, "Pf": wall, "Ac": full, "Af": flood}
    d = d.withColumns({f"__{k}": v for k, v in sums.items()})
    d = d.withColumns({k: F.coalesce(F.sum(f"__{k}").over(up), F.lit(0.0)) for k in sums})
    return d.select(*keys, "stage", F.col("__z").alias("hand"), "width", "slope", "Ac", "Pc", "Af", "Pf")


def year_segments(df: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each calendar year that [start, end) touches: year, segment_start, segment_end (dates);
    an empty or unknown span has none."""
    a, b = F.col(start).cast("date"), F.col(end).cast("date")
    years = F.when(a < b, F.sequence(F.year(a), F.year(F.date_sub(b, 1))))
    df = df.withColumn("year", F.explode(years))
    first = lambda y: F.make_date(y, F.lit(1), F.lit(1))
    return df.withColumns({"segment_start": F.greatest(a, first(F.col("year"))), "segment_end": F.least(b, first(F.col("year") + 1))})
