"""Points in rectangles of any sizes, by a cover of each rectangle with cells of its own level.

Cells of level l are squares of side 2 ** l (l may be negative).  A rectangle is covered at the level of
its shorter side, or of a ``aspect``-th of its longer one, by at most 2 x (aspect + 1) cells; a point
lies in one cell of each level.  Only levels that some rectangle uses are looked at.  The join is an
equi-join on cells, so that a small side goes by broadcast, and the partitions of a hot cell are
split by adaptive execution; the rectangle's own bounds are judged last.

Cases: rectangles are half-open (x0 <= x < x1, y0 <= y < y1); one with a null, NaN, infinite or empty
side holds nothing, and a point with a null, NaN or infinite coordinate lies in none; repeated points
and rectangles count each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def cover(rects: DataFrame, box: Sequence[str], aspect: int = 16) -> DataFrame:
    """rects with the (level, ci, cj) of their cells, a row each."""
    x0, x1, y0, y1 = (F.col(b).cast("double") for b in box)
    w, h = x1 - x0, y1 - y0
    # beyond 2 ** 50 cells from the origin, numbers can't tell cells apart
    far = F.greatest(F.abs(x0), F.abs(x1), F.abs(y0), F.abs(y1)) * 2.0**-50
    side = F.greatest(F.least(w, h), F.greatest(w, h) / aspect, far)
    whole = finite(x0) & finite(x1) & finite(y0) & finite(y1) & (w > 0) & (h > 0)
    cells = lambda lo, hi: F.sequence(F.floor(lo / F.col("__side")), F.ceil(hi / F.col("__side")) - 1)
    df = rects.where(whole).withColumn("level", F.ceil(F.log2(side)).cast("int")).withColumn("__side", F.pow(F.lit(2.0), F.col("level")))
    return df.withColumn("ci", F.explode(cells(x0, x1))).withColumn("cj", F.explode(cells(y0, y1))).drop("__side")


def rect_join(points: DataFrame, rects: DataFrame, x: str, y: str, box: Sequence[str] = ("x0", "x1", "y0", "y1"), aspect: int = 16) -> DataFrame:
    """All columns of the points and of the rectangles that hold them, a row for each pair."""
    cells = cover(rects, box, aspect)
    # a double has 2,098 exponents: there are no more levels
    levels = sorted(r.level for r in cells.select("level").distinct().collect())
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    place = F.array(*[F.struct(F.lit(v).cast("int").alias("level"), F.floor(px / 2.0**v).alias("ci"), F.floor(py / 2.0**v).alias("cj")) for v in levels]) if levels else F.array().cast("array<struct<level:int,ci:bigint,cj:bigint>>")
    placed = points.where(finite(px) & finite(py)).withColumn("__c", F.explode(place)).select(*points.columns, "__c.level", "__c.ci", "__c.cj")
    x0, x1, y0, y1 = (F.col(b).cast("double") for b in box)
    met = placed.join(cells, ["level", "ci", "cj"]).where((px >= x0) & (px < x1) & (py >= y0) & (py < y1))
    return met.drop("level", "ci", "cj")
