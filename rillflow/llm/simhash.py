"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at a small
Hamming distance, by bit-sliced comparison.

1. A fingerprint for each document; exact copies and texts with equal fingerprints are
   one node from there on.
2. Candidates by pigeonhole: the 64 bits are cut into six blocks; fingerprints within
   three bits agree on at least three whole blocks, so that they meet under one of the 20
   keys of three blocks (31 to 33 bits each).  Groups of one are dropped.  A group above
   ``tile`` members gets four keys more, of 8 bits of the rest each (again by pigeonhole),
   and what is still too large is cut into tiles, each pair of tiles a task of its own:
   no task holds more than two tiles, whatever the group's size.
3. In a task the candidates' bits are stored vertically, a plane for each bit and 64
   fingerprints in a word.  The distances of a fingerprint to 64 others are two bit planes
   of a carry-save counter and an overflow plane; a word in which all lanes have overflown
   is abandoned.  What leaves the task are the edges of a spanning forest of its links,
   never all pairs.
4. Connected components over these edges (``components``).

Cases: a null text counts as empty; a text without words has fingerprint zero, which links
like any other; one with fewer words than a shingle has its whole sequence as its only
shingle; repeated rows and null ids are kept, one result for each input row; the component
is named by its smallest id that isn't null (null if there is none); other columns are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

#: Bits of the six blocks, and of the four parts of what a key leaves.
WIDTHS, PARTS = (11, 11, 11, 11, 10, 10), 4
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint, unsigned."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[i : i + (1 << 15)], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long."""
    slim = docs.select(docs[id_col].alias("id"), common.text_of(docs, text_col).cast("binary").alias("text"))

    def run(batches):
        for b in common.slices(batches):
            fps = np.array([fingerprint(x, shingle, seed) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return common.spread(slim).mapInArrow(run, T.StructType([common.field(docs, id_col, "id"), T.StructField("fp", T.LongType())]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks() -> list[tuple[int, list[int]]]:
    """For each key its bits, and the four parts of the rest, all as signed masks."""
    blocks, at = [], 0
    for w in WIDTHS:
        blocks.append(range(at, at + w))
        at += w
    out = []
    for held in itertools.combinations(range(len(blocks)), 3):
        bits = [b for i in held for b in blocks[i]]
        rest = [b for i in range(len(blocks)) if i not in held for b in blocks[i]]
        to = lambda bs: _signed(sum(1 << b for b in bs))
        out.append((to(bits), [to(rest[i::PARTS]) for i in range(PARTS)]))
    return out


def within(fps: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int = 3, lanes_at_once: int = 1 << 14):
    """Bit-sliced comparison of fps (uint64): of each fps[i] with fps[64*first[i] : 64*last[i]],
    in whole words of 64.  Yields arrays (i, j), i < j, of pairs within the radius (3 at most)."""
    if not 0 <= radius <= 3:
        raise ValueError("the counter has two planes: the radius is 3 at most")
    n = len(fps)
    words = (n + 63) // 64
    padded = np.zeros(words * 64, np.uint64)
    padded[:n] = fps
    planes = np.empty((64, words), np.uint64)
    for b in range(64):
        planes[b] = np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")
    valid = np.packbits(np.arange(words * 64) < n, bitorder="little").view("<u8")
    spans = last - first
    for lo, hi in _runs(spans, lanes_at_once):
        q = np.repeat(np.arange(lo, hi), spans[lo:hi])
        w = common.ragged(first[lo:hi], spans[lo:hi])
        c0, c1 = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64)
        over = ~valid[w]
        for b in range(64):
            differs = planes[b][w] ^ (np.uint64(0) - ((fps[q] >> np.uint64(b)) & np.uint64(1)))
            carry = c0 & differs
            c0 ^= differs
            over |= c1 & carry
            c1 ^= carry
            if b % 4 == 3:
                live = over != FULL
                if not live.all():
                    q, w, c0, c1, over = q[live], w[live], c0[live], c1[live], over[live]
                    if not len(q):
                        break
        if not len(q):
            continue
        near = ~over
        if radius < 3:
            near &= ~(c1 & c0) if radius == 2 else ~c1 if radius == 1 else ~(c1 | c0)
        at, lane = np.nonzero(np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = q[at], w[at] * 64 + lane
        keep = i < j
        if keep.any():
            yield i[keep], j[keep]


def _runs(spans: np.ndarray, most: int):
    """Consecutive ranges whose spans add up to about most."""
    if not len(spans):
        return
    group = (np.cumsum(spans) - spans) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    yield from zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(spans)]]), strict=True)


def forest(fps: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links within each group (equal, adjacent numbers)."""
    n = len(fps)
    ends = np.append(np.flatnonzero(np.diff(groups)) + 1, n)
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    root = np.arange(n)
    for i, j in within(fps, np.arange(n) // 64, (end + 63) // 64, radius):
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(root, up := root[root]):
                root = up
    at = np.flatnonzero(root != np.arange(n))
    return fps[at], fps[root[at]]


def _link(batches, radius: int):
    """Step 3 on one task: rows (t, fp) sorted by the task number t; whole tasks at a time."""
    held: list[pa.RecordBatch] = []

    def run(t: np.ndarray, fps: np.ndarray):
        if len(fps) < 2:
            return
        u, v = forest(fps.view(np.uint64), t, radius)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def arrays(bs):
        return (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in bs]) for k in (0, 1))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t, fps = arrays(held)
        cut = int(np.searchsorted(t, t[-1])) if t[0] != t[-1] else 0
        if cut:
            yield from run(t[:cut], fps[:cut])
            held = [pa.RecordBatch.from_arrays([pa.array(t[cut:]), pa.array(fps[cut:])], ["t", "fp"])]
    if held:
        yield from run(*arrays(held))


def _tiled(members: DataFrame, tile: int) -> DataFrame:
    """Rows (key, fp, n) of groups of n -> (t, fp): t a task of two tiles at most."""
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    every = members.select("key", "fp", tiles.alias("k"), own.alias("own")).select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    return every.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("t"), "fp")


def _groups(keyed: DataFrame) -> DataFrame:
    """(key, fp) -> (key, fp, n), where a key has two members or more."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return keyed.join(sizes, "key")


def links(fps: DataFrame, radius: int = 3, tile: int = 4096) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) with the components of the graph of all
    pairs within the radius."""
    fp, masks = F.col("fp"), _masks()
    key = lambda kind, mask: F.xxhash64(F.lit(kind), fp.bitwiseAND(F.lit(mask)))
    keyed = fps.select("fp", F.explode(F.array(*[key(i, m) for i, (m, _) in enumerate(masks)])).alias("key"))
    groups = common.written(_groups(keyed), "simhash-groups")
    small = groups.where(F.col("n") <= tile)
    large = groups.where(F.col("n") > tile).select("fp").distinct()
    parts = [key(1000 + PARTS * i + k, m | p) for i, (m, ps) in enumerate(masks) for k, p in enumerate(ps)]
    finer = _groups(large.select("fp", F.explode(F.array(*parts)).alias("key")))
    tasks = _tiled(small, tile).unionByName(_tiled(finer, tile))
    n = common.shuffle_partitions(fps.sparkSession)
    return tasks.repartition(n, "t").sortWithinPartitions("t").mapInArrow(lambda it: _link(it, radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 3, tile: int = 4096) -> DataFrame:
    """(id, fp, component_id) of each row."""
    fps = common.written(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("id").alias("low"))
    roots = components(links(nodes.select("fp"), radius, tile))
    named = nodes.join(roots, nodes["fp"] == roots["u"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = named.join(lows, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """All columns of one row of each component: one with the smallest id that isn't null,
    of several such rows one with the smallest fingerprint (signed), of these the one that
    ``common.one_of_each`` defines."""
    found = near_duplicates(docs, id_col, text_col, **how).withColumnRenamed(id_col, "id")
    named = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("fp").alias("fp"))
    lows = found.where(F.col("component_id").isNotNull()).groupBy("component_id").agg(F.min(named).alias("low")).select("low.id", "low.fp")
    rest = found.where(F.col("component_id").isNull())
    if not rest.isEmpty():
        nodes = rest.select("fp").distinct()
        roots = components(links(nodes, how.get("radius", 3), how.get("tile", 4096)))
        low = nodes.join(roots, nodes["fp"] == roots["u"], "left").groupBy(F.coalesce("root", "fp")).agg(F.min("fp").alias("fp"))
        lows = lows.unionByName(low.select(F.lit(None).cast(docs.schema[id_col].dataType).alias("id"), "fp"))
    key = lambda i, f: F.concat_ws(":", f.cast("string"), F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("")))
    lows = lows.select(key(F.col("id"), F.col("fp")).alias("__rf_key"))
    schema = T.StructType([*docs.schema.fields, T.StructField("__rf_fp", T.LongType())])
    shingle, seed = how.get("shingle", 3), how.get("seed", 42)

    def run(batches):
        for b in common.slices(batches):
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            fps = np.array([fingerprint((t or "").encode(), shingle, seed) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], [*b.schema.names, "__rf_fp"])

    rows = docs.mapInArrow(run, schema).withColumn("__rf_key", key(F.col(id_col), F.col("__rf_fp")))
    return common.one_of_each(rows.join(lows, "__rf_key", "left_semi"), "__rf_key").select(*docs.columns)


def hex64(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text of documents."""
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def queries() -> dict:
    return {"op2_simhash": op2_simhash}
