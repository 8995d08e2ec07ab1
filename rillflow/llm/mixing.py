"""Mixing sources to target weights by pivotal dependent rounding.

Sources have target sizes (their share by weight of all sizes, at most ``most`` times their
own size, the excess reshared until none is above).  Each document of a source is to be
taken target / size times; the whole part is certain, the rest is a fractional copy.

Pivotal rounding, within a source: of two fractional probabilities one takes from the other
until one of them is 0 or 1, at random and without bias; the sum stays as it is.  Documents
of a source are dealt by a hash into leaves of about ``leaf`` rows, however large the
source; a leaf goes through its documents by size, which pairs similar sizes, and leaves at
most one fractional document.  These residuals meet in a tree, ``fan`` leaves at a time,
until each source has one, which is drawn.  A level is a shuffle of what the level before
has left, a ``leaf``-th and a ``fan``-th of it.

A row's leaf and its place there depend on its id, source, text and, of equal rows, its
number among them (they are counted, with partial sums, and numbered from the count); all
draws are hashes of the seed and of the place in the tree.  Reruns thus agree, whatever the
files, their order and the number of partitions.

Cases: a null text has size 0; a null source is a source of its own, after the others; a
document of size 0 is never taken; if all sizes are 0 nothing is; repeated rows and null
ids are kept, one result for each input row, and equal rows may be taken a different number
of times; other columns are ignored, whatever their names; an empty table gives an empty
table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
#: A probability this near to 0 or 1 is taken as it.
TINY = 1e-9


def n_words(text):
    """Number of words of a text column, without a list of them: positions where a word
    begins."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.when(F.length(F.trim(spaced)) > 0, F.size(F.split(F.trim(F.regexp_replace(spaced, " {2,}", " ")), " ", -1))).otherwise(0).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """(source, size) -> (source, n, source_size, target), one row for each source.

    The fixed point of stopping and resharing is target = min(most * size, level * weight)
    with the level at which targets add up to all sizes: sources stop in the order of
    size / weight, so that a running sum finds the level."""
    totals = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(most)
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = totals.withColumn("w", weight).withColumn("cap", cap)
    found = found.withColumn("all", F.sum("source_size").over(every).cast("double")).withColumn("level", (F.col("all") - before) / rest)
    # the level of the first source that isn't stopped by it holds for all from there on
    free = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    found = found.withColumn("at", F.first(free, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap"), F.coalesce(F.col("at") * F.col("w"), F.col("cap")))
    return found.select("source", "n", "source_size", target.alias("target"))


def draws(seed: int, *parts: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) from integers."""
    with np.errstate(over="ignore"):
        x = np.full(len(parts[0]), seed, np.uint64)
        for p in parts:
            x = (x ^ p.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pivot(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Probabilities, in order, after pivotal rounding: all 0 or 1 but at most one."""
    out = p.copy()
    held, a = -1, 0.0
    for i, b in enumerate(p.tolist()):
        if b <= TINY or b >= 1 - TINY:
            out[i] = round(b)
            continue
        if held < 0:
            held, a = i, b
            continue
        total, r = a + b, u[i]
        if total < 1:  # one gives all it has
            if r * total < a:
                out[i], a = 0.0, total
            else:
                out[held], held, a = 0.0, i, total
        else:  # one is filled up
            if r * (2 - total) < 1 - b:
                out[held], held, a = 1.0, i, total - 1
            else:
                out[i], a = 1.0, total - 1
        if a <= TINY or a >= 1 - TINY:
            out[held], held = round(a), -1
    if held >= 0:
        out[held] = a
    return out


def _level(t: pa.Table, level: int, seed: int, last: bool) -> pa.Table:
    """One node of the tree: rows from the largest down, so that what is left is small; of
    one size by what else tells them apart."""
    t = t.sort_by([("size", "descending"), ("own", "ascending"), ("rid", "ascending")])
    n = t.num_rows
    key = [np.full(n, t.column(c)[0].as_py(), np.int64) for c in ("place", "node")]
    u = draws(seed, *key, np.full(n, level), np.arange(n))
    p = pivot(t.column("p").to_numpy(), u)
    if last:  # what is left at the root is drawn
        at = (p > TINY) & (p < 1 - TINY)
        p[at] = draws(seed, *key, np.full(n, level + 1), np.arange(n))[at] < p[at]
    return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p))


def _node(level: int, seed: int, last: bool):
    return lambda t: _level(t, level, seed, last)


def _numbered(rows: DataFrame, step: int = 1024) -> DataFrame:
    """(id, source, size, tie) -> the same rows and own: a hash that tells also equal rows apart.

    Equal rows are counted and made anew from the count, in two steps so that arrays stay
    short: a group is never gathered in a task."""
    same = rows.groupBy("id", "source", "size", "tie").agg(F.count("*").alias("m"))
    first = same.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / step))))
    last = F.least(F.col("m") - 1, (F.col("block") + 1) * step - 1)
    each = first.withColumn("k", F.explode(F.sequence(F.col("block") * step, last)))
    return each.select("id", "source", "size", "tie", F.xxhash64("id", F.isnull("source"), "source", "tie", "k").alias("own"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 20240229, leaf: int = 4096, fan: int = 64) -> DataFrame:
    """(id, source, size, source_size, target, copies, tie) of each row; tie: a hash of the text."""
    slim = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), n_words(common.text_of(docs, text_col)).alias("size"), F.xxhash64(common.text_of(docs, text_col)).alias("tie"))
    slim = common.written(_numbered(slim).withColumn("rid", F.monotonically_increasing_id()), "mix")
    targets = common.checkpointed(source_targets(slim.select("source", "size"), weights, most))
    largest = targets.agg(F.max("n")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = slim.withColumnRenamed("source", "from").join(targets, F.col("from").eqNullSafe(F.col("source")), "left").drop("from")
    whole = F.when(F.col("size") > 0, F.floor(F.col("ratio") + TINY)).otherwise(0)
    part = F.when(F.col("size") > 0, F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0))).otherwise(0.0)
    rows = rows.withColumn("ratio", ratio).withColumn("whole", whole.cast("long")).withColumn("p", part)
    # a source's place in the tree, and the document's leaf: as many as the source needs
    rows = rows.withColumn("place", F.xxhash64(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))).withColumn("node", F.pmod("own", F.ceil(F.col("n") / leaf)).cast("long"))
    levels, width = 1, (largest + leaf - 1) // leaf
    while width > 1:
        levels, width = levels + 1, (width + fan - 1) // fan
    slim_tree = rows.where(F.col("p") > TINY).select("rid", "place", "node", "size", "own", "p")
    settled, schema = None, slim_tree.schema
    for level in range(levels):
        done = common.checkpointed(slim_tree.groupBy("place", "node").applyInArrow(_node(level, seed, level == levels - 1), schema))
        open_ = (F.col("p") > TINY) & (F.col("p") < 1 - TINY)
        one = done.where(F.col("p") >= 1 - TINY).select("rid")
        settled = one if settled is None else settled.unionByName(one)
        slim_tree = done.where(open_).withColumn("node", F.floor(F.col("node") / fan))
    copies = F.col("whole") + F.when(F.col("up").isNotNull(), 1).otherwise(0)
    out = rows.join(settled.select(F.col("rid"), F.lit(True).alias("up")), "rid", "left").withColumn("copies", copies)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", "tie")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """All columns, each row as often as the mix takes it.  Rows that are equal in id, source
    and text are taken together, as the one that ``common.one_of_each`` defines."""
    tell = lambda *cs: F.sha2(F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in cs]), 256)
    mixed = mix(docs, id_col, text_col, source_col, **how).where("copies > 0")
    copies = mixed.groupBy(tell(F.col(id_col), F.col("source"), F.col("tie")).alias("__rf_key")).agg(F.sum("copies").cast("int").alias("__rf_n"))
    rows = docs.withColumn("__rf_key", tell(F.col(id_col), F.col(source_col), F.xxhash64(common.text_of(docs, text_col))))
    rows = common.one_of_each(rows, "__rf_key").join(copies, "__rf_key")
    return rows.withColumn("__rf_n", F.explode(F.array_repeat(F.lit(0), F.col("__rf_n")))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by their sources."""
    mixed = mix(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def queries() -> dict:
    return {"op10_mixing": op10_mixing}
