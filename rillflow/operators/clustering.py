"""Clustering of units on scaled covariates, and of pixels within bands."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import stored


def min_max(df: DataFrame, cols: Sequence[str], bounds: Mapping[str, tuple[float, float]] | None = None, prefix: str = "scaled_") -> DataFrame:
    """Columns scaled to [0, 1] by given bounds or by the table's own; a constant column
    becomes 0."""
    if bounds is None:
        r = df.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]).first()
        bounds = {c: (float(r[f"lo_{c}"] or 0.0), float(r[f"hi_{c}"] or 0.0)) for c in cols}
    scaled = lambda c, lo, hi: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - lo) / (hi - lo))) if hi > lo else F.when(F.col(c).isNotNull(), 0.0)
    return df.withColumns({f"{prefix}{c}": scaled(c, *bounds[c]) for c in cols})


def kmeans(df: DataFrame, cols: Sequence[str], k: int, name: str = "cluster", seed: int = 1, rounds: int = 20) -> DataFrame:
    """Clusters of all rows at once by Spark ML; labels are renumbered by centre, so that
    they don't depend on how the centres began.  A row with a null has no cluster (null)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=list(cols), outputCol="__v", handleInvalid="skip").transform(df)
    model = KMeans(k=k, featuresCol="__v", predictionCol="__c", seed=seed, maxIter=rounds).fit(v)
    centres = [tuple(round(float(x), 9) for x in c) for c in model.clusterCenters()]
    rank = {i: n for n, i in enumerate(sorted(range(len(centres)), key=lambda i: centres[i]))}
    number = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    found = model.transform(v).withColumn(name, number[F.col("__c")]).drop("__v", "__c")
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return found.unionByName(df.where(~whole).withColumn(name, F.lit(None).cast(found.schema[name].dataType)))


def grouped_kmeans(df: DataFrame, keys: Sequence[str], cols: Sequence[str], k: int, name: str = "cluster", rounds: int = 50) -> DataFrame:
    """Lloyd's iteration in each group (a band of a basin cluster), from quantiles of the
    first principal axis; a group of fewer distinct rows than k has fewer clusters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[list(cols)].to_numpy(float)
        span = np.ptp(x, 0)
        x = (x - x.min(0)) / np.where(span > 0, span, 1.0)
        u = np.unique(x, axis=0)
        n = min(k, len(u))
        axis = np.linalg.svd(u - u.mean(0), full_matrices=False)[2][0] if len(u) > 1 else np.ones(x.shape[1])
        axis = axis * (np.sign(axis[np.argmax(np.abs(axis))]) or 1.0)
        order = u[np.argsort(u @ axis, kind="stable")]
        c = order[((np.arange(n) + 0.5) * len(order) / n).astype(int)]
        for _ in range(rounds):
            at = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            new = np.array([x[at == i].mean(0) if (at == i).any() else c[i] for i in range(n)])
            if np.allclose(new, c):
                break
            c = new
        return pdf.assign(**{name: at.astype("int32")})

    return df.groupBy(*keys).applyInPandas(run, T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())]))


#: Steps of a column's range in a group, and groups up to which centres go to the rows by broadcast.
STEPS, FEW_GROUPS = 1 << 20, 10_000


def lloyd(df: DataFrame, keys: Sequence[str], cols: Sequence[str], k: int, name: str = "cluster", rounds: int = 50) -> DataFrame:
    """df with the cluster of each row within its group (a band of a basin cluster), all groups at once.

    Columns are scaled to whole steps of their range in the group, so that sums and distances are
    exact and results don't depend on partitioning.  Centres begin with the group's least row and go on
    with the row farthest from those before (the greatest of several).  A round is a join of the
    rows with their group's centres and sums by cluster, made in parts: no group is ever one task's.
    Rounds end when no centre moves.  Clusters are numbered by their centres.  A group of fewer
    distinct rows than k has fewer clusters; a row with a null or NaN has none (null)."""
    keys, c = list(keys), F.col
    every = functools.reduce(operator.and_, [c(x).isNotNull() & ~F.isnan(c(x).cast("double")) for x in cols])
    whole = df.where(every)
    ends = whole.groupBy(*keys).agg(*[f(c(x).cast("double")).alias(f"__{n}_{x}") for x in cols for n, f in (("lo", F.min), ("hi", F.max))])
    few = ends.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS

    def joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
        """rows with what their group has; keys may be null."""
        groups = groups.select(*[c(x).alias(f"__k_{x}") for x in keys], *[x for x in groups.columns if x not in keys])
        on = functools.reduce(operator.and_, [c(x).eqNullSafe(c(f"__k_{x}")) for x in keys])
        return rows.join(F.broadcast(groups) if few else groups, on).drop(*[f"__k_{x}" for x in keys])

    def steps(x: str) -> Column:
        lo, hi = c(f"__lo_{x}"), c(f"__hi_{x}")
        return F.when(hi > lo, F.floor((c(x).cast("double") - lo) / (hi - lo) * STEPS)).otherwise(F.lit(0).cast("long"))

    rows = stored(joined(whole, ends).withColumn("__x", F.array(*[steps(x) for x in cols])).select(*df.columns, "__x"))

    def apart(a: Column, b: Column) -> Column:
        return functools.reduce(operator.add, [(a[i] - b[i]) * (a[i] - b[i]) for i in range(len(cols))])

    def nearest(centres: Column) -> Column:
        return F.array_min(F.transform(centres, lambda m, i: F.struct(apart(c("__x"), m).alias("d"), i.alias("i"))))

    centres = stored(rows.groupBy(*keys).agg(F.array(F.min("__x")).alias("__m")))
    for _ in range(k - 1):
        far = joined(rows, centres).groupBy(*keys).agg(F.max(F.struct(nearest(c("__m"))["d"].alias("d"), c("__x"))).alias("__far"))
        centres = stored(joined(centres, far).select(*keys, F.when(c("__far.d") > 0, F.concat("__m", F.array("__far.__x"))).otherwise(c("__m")).alias("__m")))
    for _ in range(rounds):
        near = joined(rows, centres).withColumn("__i", nearest(c("__m"))["i"])
        sums = near.groupBy(*keys, "__i").agg(F.count("*").alias("__n"), *[F.sum(c("__x")[i]).alias(f"__s{i}") for i in range(len(cols))])
        # of a group's sums, as many as it has centres
        mean = F.array(*[F.expr(f"__s{i} div __n") for i in range(len(cols))])
        new = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__i", mean))).alias("__new"))
        moved = joined(centres, new).select(*keys, c("__m").alias("__was"), F.transform("__m", lambda m, i: F.coalesce(c("__new")[i], m)).alias("__m"))
        moved = stored(moved)
        centres = moved.drop("__was")
        if moved.where("__m != __was").isEmpty():
            break
    order = F.array_sort(F.transform("__m", lambda m, i: F.struct(m.alias("m"), i.alias("i"))))
    number = F.array_position(F.transform(order, lambda s: s["i"]), c("__at")) - 1
    out = joined(rows, centres).withColumn("__at", nearest(c("__m"))["i"]).withColumn(name, number.cast("int")).select(*df.columns, name)
    return out.unionByName(df.where(~every | every.isNull()).withColumn(name, F.lit(None).cast("int")))
