"""Totals of the points in intervals and in rectangles, whose pairs are never made.

Coordinates become ranks among the points' distinct values, so that repeated values are one.  A node
(level, node) has the ranks [node * 4 ** level, (node + 1) * 4 ** level); a point is in one node of each level,
and an interval is whole nodes of the least number, some six a level.  Rows grow with points and intervals,
times the logarithm of the number of values, however many pairs they make.

Cases: intervals are half-open (low <= x < high), by Spark's order, in which NaN is above all; one
with a null or without a point has no row; a point with a null coordinate lies in none; repeated points
and intervals count each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import settled

#: Two bits of a rank a level; bits of the ranks that are one group of a running sum.
BITS, CHUNK_BITS = 2, 12


def ranked(values: DataFrame, asked: DataFrame) -> tuple[DataFrame, int]:
    """(v, rank) of both tables' only columns, rank being the number of distinct values below v, and how many
    there are.  Values are sorted in ranges that are written; only the ranges' counts are added up."""
    every = values.toDF("v").withColumn("has", F.lit(1)).unionByName(asked.toDF("v").withColumn("has", F.lit(0)))
    every = every.where("v IS NOT NULL").groupBy("v").agg(F.max("has").alias("has"))
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = settled(every.repartitionByRange(n, "v").withColumn("p", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range
    ranges = every.groupBy("p").agg(F.sum("has").alias("c")).withColumn("base", F.coalesce(F.sum("c").over(before(Window.partitionBy(F.lit(0)).orderBy("p"))), F.lit(0)))
    own = F.coalesce(F.sum("has").over(before(Window.partitionBy("p").orderBy("v"))), F.lit(0))
    out = every.withColumn("own", own).join(F.broadcast(ranges.select("p", "base")), "p").select("v", (F.col("own") + F.col("base")).alias("rank"))
    return out, every.agg(F.sum("has")).first()[0] or 0


def with_rank(df: DataFrame, col: str, ranks: DataFrame, name: str) -> DataFrame:
    return df.join(ranks.select(F.col("v").alias(col), F.col("rank").alias(name)), col)


def levels(n: int) -> Column:
    """The levels of n ranks, an array."""
    top = 0
    while 1 << BITS * (top + 1) <= n:
        top += 1
    return F.sequence(F.lit(0), F.lit(top))


def in_nodes(points: DataFrame, rank: str, n: int) -> DataFrame:
    """points with their (level, node), a row for each level."""
    return points.withColumn("level", F.explode(levels(n))).withColumn("node", F.expr(f"shiftright({rank}, {BITS} * level)"))


def covered(spans: DataFrame, low: str, high: str, n: int) -> DataFrame:
    """spans with the (level, node) that make up the ranks [low, high), a row each."""
    lo = lambda by: F.expr(f"shiftright({low} + shiftleft(1L, {BITS} * (level + {by})) - 1, {BITS} * (level + {by}))")
    hi = lambda by: F.expr(f"shiftright({high}, {BITS} * (level + {by}))")
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    a, b, up = F.col("__lo"), F.col("__hi"), 1 << BITS
    top = F.element_at(levels(n), -1)
    # what the next level's nodes don't cover
    above = (F.col("level") < top) & (F.col("__up_lo") < F.col("__up_hi"))
    nodes = F.when(above, F.concat(run(a, F.col("__up_lo") * up), run(F.col("__up_hi") * up, b))).otherwise(run(a, b))
    df = spans.where(F.col(low) < F.col(high)).withColumn("level", F.explode(levels(n)))
    df = df.withColumns({"__lo": lo(0), "__hi": hi(0), "__up_lo": lo(1), "__up_hi": hi(1)}).where("__lo < __hi")
    return df.withColumn("node", F.explode(nodes)).drop("__lo", "__hi", "__up_lo", "__up_hi")


def in_intervals(points: DataFrame, intervals: DataFrame, x: str, low: str, high: str, keys: Sequence[str], sums: Mapping[str, Column] = {}, least: Mapping[str, Column] = {}, most: Mapping[str, Column] = {}) -> DataFrame:
    """(keys, n, sums, least, most) of the points in the intervals of the same keys."""
    first = {**{k: F.sum(v) for k, v in sums.items()}, **{k: F.min(v) for k, v in least.items()}, **{k: F.max(v) for k, v in most.items()}}
    again = lambda: [F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in sums], *[F.min(k).alias(k) for k in least], *[F.max(k).alias(k) for k in most]]
    at = points.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("__x")).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in first.items()])
    own = intervals.select(*keys, F.col(low).cast("double").alias("__a"), F.col(high).cast("double").alias("__b"))
    ranks, n = ranked(at.select("__x"), own.select("__a").union(own.select("__b")))
    nodes = in_nodes(with_rank(at, "__x", ranks, "__r"), "__r", n).groupBy("level", "node").agg(*again())
    spans = with_rank(with_rank(own, "__a", ranks, "__ra"), "__b", ranks, "__rb").select(*keys, "__ra", "__rb")
    return covered(spans, "__ra", "__rb", n).join(nodes, ["level", "node"]).groupBy(*keys).agg(*again())


def in_rects(points: DataFrame, rects: DataFrame, x: str, y: str, keys: Sequence[str], value: str, box: Sequence[str] = ("x0", "x1", "y0", "y1")) -> DataFrame:
    """(keys, n, total, latest) of the points in the rectangles of the same keys: how many there are, the
    sum of ``value`` (a decimal or whole number, so that differences are exact), and their greatest y.

    A rectangle's x are nodes; in each the points before y1, less those before y0, are running sums by y.
    The last point before y1 is the latest, if it isn't before y0.  Running sums are made in
    chunks of ranks of y, and chunks' totals carried on."""
    c = F.col
    at = points.where(c(x).isNotNull() & c(y).isNotNull()).groupBy(c(x).cast("double").alias("__x"), c(y).cast("double").alias("__y")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    kind = at.schema["total"].dataType
    own = rects.select(*keys, *[c(b).cast("double").alias(f"__{i}") for i, b in enumerate(box)]).where(" AND ".join(f"__{i} IS NOT NULL" for i in range(4)))
    xs, nx = ranked(at.select("__x"), own.select("__0").union(own.select("__1")))
    ys, ny = ranked(at.select("__y"), own.select("__2").union(own.select("__3")))
    chunk = F.expr(f"shiftright(r, {CHUNK_BITS})").alias("chunk")
    dots = in_nodes(with_rank(with_rank(at, "__x", xs, "__rx"), "__y", ys, "r"), "__rx", nx).groupBy("level", "node", "r").agg(F.sum("n").alias("n"), F.sum("total").cast(kind).alias("total"), F.max("__y").alias("latest"))
    dots = dots.select("level", "node", chunk, "r", "n", "total", "latest")
    spans = own
    for i, ranks in enumerate((xs, xs, ys, ys)):
        spans = with_rank(spans, f"__{i}", ranks, f"__r{i}")
    spans = covered(spans.where("__r2 < __r3"), "__r0", "__r1", nx)
    ends = F.explode(F.array(F.struct(c("__r2").alias("r"), F.lit(-1).alias("sign")), F.struct(c("__r3").alias("r"), F.lit(1).alias("sign"))))
    asked = spans.select(*keys, c("__2").alias("y0"), "level", "node", ends.alias("e")).select(*keys, "y0", "level", "node", c("e.r").alias("r"), c("e.sign").alias("sign")).select(*keys, "y0", "level", "node", chunk, "r", "sign")
    both = dots.unionByName(asked, allowMissingColumns=True)
    # an end comes before the points of its own rank
    w = Window.partitionBy("level", "node", "chunk").orderBy("r", F.col("sign").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.select(*keys, "y0", "level", "node", "chunk", "sign", F.sum("n").over(w).alias("n"), F.sum("total").over(w).alias("total"), F.max("latest").over(w).alias("latest")).where("sign IS NOT NULL")
    if ny >> CHUNK_BITS:
        totals = dots.groupBy("level", "node", "chunk").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("latest").alias("latest"))
        totals = totals.unionByName(asked.select("level", "node", "chunk").distinct(), allowMissingColumns=True).groupBy("level", "node", "chunk").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("latest").alias("latest"))
        up = Window.partitionBy("level", "node").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select("level", "node", "chunk", F.sum("n").over(up).alias("__n"), F.sum("total").over(up).alias("__t"), F.max("latest").over(up).alias("__l"))
        zero = lambda v: F.coalesce(v, F.lit(0))
        found = found.join(carried, ["level", "node", "chunk"]).withColumns({"n": zero("n") + zero("__n"), "total": F.when(c("total").isNull() & c("__t").isNull(), None).otherwise(zero("total") + zero("__t")), "latest": F.greatest("latest", "__l")})
    late = F.when((c("sign") > 0) & (c("latest") >= c("y0")), c("latest"))
    return found.groupBy(*keys).agg(F.sum(c("sign") * c("n")).alias("n"), F.sum(c("sign") * c("total")).alias("total"), F.max(late).alias("latest")).where("n > 0")
