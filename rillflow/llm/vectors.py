"""Compression of vectors to short codes: product quantisation in integers, the nearest
entry found by vector-approximation filtering.

A component x becomes the integer floor(4096 x); a vector is cut into ``PARTS`` equal parts,
and each part is coded by its nearest of ``ENTRIES`` codebook entries.  To find it, the
entries' coordinates are quantised to ``BITS`` bits, each to a cell of its axis.  A part to be
coded makes a table for each axis: the least and the greatest squared distance to each cell.
Their sums bound its distance to every entry from below and above; only entries whose lower
bound doesn't exceed the least upper bound are compared by their exact integer distance.

Codebooks start as the parts of the vectors with the smallest ids and are refined in rounds.
A round is one scan: each task adds up the parts of each entry, and sends one row for each
component of the codebooks, however many vectors it has read; the driver gets as many rows as
the codebooks have components.

Cases: a vector that is null, or has a null or non-finite component, is dropped; repeated rows
are kept, one result each; null ids are kept and come last among those that start codebooks, and
equal ids go by their vectors; fewer vectors than entries give codebooks of fewer entries;
vectors of different lengths count as continued with zeros up to the longest, and a length that
the parts don't divide up to the next that they do; components of any size are computed without
overflow, and an error beyond a long is given as the largest long; null labels are one label;
other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SCALE, PARTS, ENTRIES, ROUNDS, BITS = 4096, 8, 16, 6, 4
LIMB = 62
MOST = (1 << 63) - 1

SUMS = "part int, entry int, pos int, limb int, total long"


@dataclasses.dataclass(frozen=True)
class Codebooks:
    """entries[part][entry]: integer components."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]
    width: int

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()


def whole(df: DataFrame, vector_col: str) -> DataFrame:
    """The rows with a vector of finite components, as ``__rf_v``, an array of doubles."""
    v = F.col("__rf_v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.withColumn("__rf_v", df[vector_col].cast("array<double>")).where(v.isNotNull() & ~bad)


def integer(x: float, scale: int = SCALE) -> int:
    """floor(scale * x), exactly: a double from 2 ** 52 on is an integer itself."""
    return int(x) * scale if abs(x) >= 1 << 52 else math.floor(x * scale)


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """A matrix of integer components, int64 or, where values are too large, Python's."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    full = np.zeros((len(vectors), width))
    if len(flat):
        full.ravel()[common.ragged(np.arange(len(vectors)) * width, lengths)] = flat
    if np.abs(full).max(initial=0) < 1 << 18:
        return np.floor(full * SCALE).astype(np.int64)
    return np.array([[integer(x) for x in row] for row in full.tolist()], object).reshape(full.shape)


def narrow(x: np.ndarray, most: int) -> np.ndarray:
    """x as int64 if squares of differences of such values, over all axes, fit."""
    return x.astype(np.int64) if 4 * most * most * max(1, x.shape[-1]) < 1 << 62 else x.astype(object)


class Filter:
    """The entries of one part, quantised."""

    def __init__(self, entries, bits: int = BITS):
        self.entries = np.array(entries, object).reshape(len(entries), -1)
        self.cells, self.axes = 1 << bits, []
        for values in self.entries.T:
            low, n = min(values), max(values) - min(values) + 1
            edges = [low - (-c * n // self.cells) for c in range(self.cells + 1)]
            self.axes.append((np.array([(v - low) * self.cells // n for v in values], np.int64), np.array(edges[:-1], object), np.array(edges[1:], object) - 1))
        self.most = max((abs(x) for e in entries for x in e), default=0)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance of each row of x to each entry's cells."""
        lower = np.zeros((len(x), len(self.entries)), x.dtype)
        upper = lower.copy()
        for axis, (cell, low, high) in enumerate(self.axes):
            v, low, high = x[:, axis, None], low.astype(x.dtype), high.astype(x.dtype)
            below, above = low - v, v - high
            near, far = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
            lower += (near * near)[:, cell]
            upper += (far * far)[:, cell]
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of each row's nearest entry, the lower index of equally
        near ones, and how many distances were computed."""
        x = narrow(x, max(self.most, int(np.abs(x).max(initial=0))))
        entries = self.entries.astype(x.dtype)
        lower, upper = self.bounds(x)
        row, entry = np.nonzero((lower <= upper.min(axis=1)[:, None]).astype(bool))
        d = x[row] - entries[entry]
        d = (d * d).sum(axis=1) if x.shape[1] else np.zeros(len(row), x.dtype)
        far = np.full(lower.shape, (int(d.max()) if len(d) else 0) + 1, x.dtype)
        far[row, entry] = d
        best = far.argmin(axis=1)
        return best, far[np.arange(len(x)), best], len(row)


def _filters(books: Codebooks) -> list[Filter]:
    return [Filter(part) for part in books.entries]


def _parts(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, PARTS, axis=1)


def _sums(batches, books: Codebooks):
    """A task's sums: for each entry in use its count (pos -1) and its components' totals, in
    limbs of LIMB bits with the total's sign."""
    filters = _filters(books)
    d, k = books.width // PARTS, len(books.entries[0])
    total, count = np.zeros((PARTS, k, d), object), np.zeros((PARTS, k), np.int64)
    for b in common.slices(batches):
        for p, x in enumerate(_parts(integers(b.column("__rf_v"), books.width))):
            best, *_ = filters[p].nearest(x)
            count[p] += np.bincount(best, minlength=k)
            order = np.argsort(best, kind="stable")
            starts = np.flatnonzero(np.diff(best[order], prepend=-1))
            total[p, best[order][starts]] += np.add.reduceat(x[order], starts, axis=0)
    rows = []
    for p, e in zip(*np.nonzero(count), strict=True):
        rows.append((p, e, -1, 0, count[p, e]))
        for pos, t in enumerate(total[p, e].tolist()):
            sign, t, limb = (-1 if t < 0 else 1), abs(t), 0
            while t:
                rows.append((p, e, pos, limb, sign * (t & ((1 << LIMB) - 1))))
                t, limb = t >> LIMB, limb + 1
    if rows:
        kinds = [pa.int32()] * 4 + [pa.int64()]
        names = ["part", "entry", "pos", "limb", "total"]
        yield pa.RecordBatch.from_arrays([pa.array([int(v) for v in c], kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after so many rounds over all vectors."""
    common.bound_batches(vectors.sparkSession)
    rows = whole(vectors, vector_col)
    longest = rows.agg(F.max(F.size("__rf_v"))).first()[0]
    if longest is None:
        return Codebooks(((),) * PARTS, 0)
    width = -(-longest // PARTS) * PARTS
    first = rows.select(rows[id_col].alias("id"), "__rf_v").orderBy(F.col("id").asc_nulls_last(), "__rf_v").limit(ENTRIES).collect()
    parts = _parts(integers(pa.array([r["__rf_v"] for r in first], pa.list_(pa.float64())), width))
    books = Codebooks(tuple(tuple(map(tuple, p.tolist())) for p in parts), width)
    rows = rows.select("__rf_v")
    for _ in range(rounds):
        sums = rows.mapInArrow(lambda it, books=books: _sums(it, books), SUMS)
        sums = sums.groupBy("part", "entry", "pos", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        totals, counts = {}, {}
        for r in sums:
            if r.pos < 0:
                counts[r.part, r.entry] = int(r.total)
            else:
                at = r.part, r.entry, r.pos
                totals[at] = totals.get(at, 0) + (int(r.total) << LIMB * r.limb)
        new = lambda p, e, old: tuple(totals.get((p, e, i), 0) // counts[p, e] for i in range(len(old))) if (p, e) in counts else old
        books = Codebooks(tuple(tuple(new(p, e, old) for e, old in enumerate(part)) for p, part in enumerate(books.entries)), width)
    return books


def _codes(batches, books: Codebooks):
    filters = _filters(books)
    for b in common.slices(batches):
        found = [f.nearest(x)[:2] for f, x in zip(filters, _parts(integers(b.column("__rf_v"), books.width)), strict=True)]
        codes = np.stack([best for best, _ in found], axis=1).astype(np.uint8)
        errors = [min(MOST, sum(e)) for e in zip(*(d.tolist() for _, d in found), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), common.binaries(codes.ravel(), np.arange(1, len(codes) + 1) * PARTS), pa.array(errors, pa.int64())], ["id", "label", "code", "error"])


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error) of each whole vector; code: one byte a part."""
    common.bound_batches(vectors.sparkSession)
    rows = whole(vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].alias("__rf_x")), "__rf_x").select("id", "label", "__rf_v")
    out = T.StructType([common.field(rows, "id"), common.field(rows, "label"), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    coded = rows.mapInArrow(lambda it: _codes(it, books), out)
    return coded.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error")


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """coded with ``decoded``, the vector that its code stands for: an array of doubles."""
    table = F.lit([x / SCALE for part in books.entries for e in part for x in e]) if books.width else F.array().cast("array<double>")
    d, k = books.width // PARTS, len(books.entries[0])
    at = lambda i: F.conv(F.hex(F.substring("code", i + 1, 1)), 16, 10).cast("int")
    parts = [F.slice(table, at(i) * d + (i * k * d + 1), d) for i in range(PARTS)]
    return coded.withColumn("decoded", F.concat(*parts))


def with_label_error(coded: DataFrame, label_col: str = "label", hot: int = 1_000, hot_rows: int = 100) -> DataFrame:
    """coded (a written table) with ``label_error``: the sum of errors of its label.  Labels of more
    than ``hot_rows`` rows, and more than a ``hot``-th of all, are fewer than ``hot``: their sums go
    to the rows by broadcast, and the rows of others are shuffled."""
    least = max(hot_rows, coded.count() // hot)
    sums = coded.groupBy(F.col(label_col).alias("__rf_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("__rf_sum"), F.count("*").alias("__rf_n"))
    same = F.col(label_col).eqNullSafe(F.col("__rf_label"))
    often = sums.where(F.col("__rf_n") > least)
    alone = coded.join(F.broadcast(often.select("__rf_label")), same, "left_anti")
    both = coded.join(F.broadcast(often), same).unionByName(alone.join(sums.where(F.col("__rf_n") <= least), same))
    return both.withColumn("label_error", F.least("__rf_sum", F.lit(MOST)).cast("long")).drop("__rf_label", "__rf_sum", "__rf_n")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every whole vector of embeddings by codebooks of all of them."""
    vectors = common.table(spark, sf_dir, "embeddings")
    books = fit(vectors)
    coded = common.written(encode(vectors, books), "vector-codes")
    return with_label_error(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def queries() -> dict:
    return {"op12_vector_codes": op12_vector_codes}


def oracle_sql() -> dict:
    """The same by nested queries: every distance, each round a table."""
    assign = """
a{n} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, d * 16 + entry) AS entry, min(d) AS d FROM
  (SELECT v.vec_id, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x))::BIGINT AS d FROM v JOIN b{n} b USING (part, pos) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
    update = """
m{n} AS (SELECT a.part, a.entry, v.pos, sum(v.x)::BIGINT AS s, count(*) AS c FROM v JOIN a{n} a USING (vec_id, part) GROUP BY 1, 2, 3),
b{m} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(((s - ((s % c) + c) % c) // c)::BIGINT, b.x) AS x FROM b{n} b LEFT JOIN m{n} m USING (part, entry, pos))"""
    steps = [assign.format(n=n) + "," + update.format(n=n, m=n + 1) for n in range(ROUNDS)] + [assign.format(n=ROUNDS)]
    sql = f"""
WITH r AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT vec_id, unnest(embedding) AS f, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {PARTS} AS d FROM r),
v AS MATERIALIZED (SELECT vec_id, i // d AS part, i % d AS pos, floor({SCALE} * f::DOUBLE)::BIGINT AS x FROM w),
b0 AS MATERIALIZED (SELECT v.part, s.entry, v.pos, v.x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM r ORDER BY vec_id LIMIT {ENTRIES}) s USING (vec_id)),
{",".join(steps)},
e AS (SELECT a.vec_id, lower(string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part)) AS code, sum(d)::BIGINT AS error, any_value(label) AS label FROM a{ROUNDS} a JOIN r USING (vec_id) GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{ROUNDS}) AS codebooks_sha256 FROM e"""
    return {"op12_vector_codes": sql}
