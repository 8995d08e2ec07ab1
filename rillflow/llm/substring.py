"""Exact substring dedup on words, by fixed-block anchors.

A window is ``window`` consecutive words of one document; a word goes if a window over it
starts anywhere else too.  With blocks of ``(window + 1) // 2`` words at multiples of that
length, every window holds a whole block of its document, so two equal windows always have
an anchor: a block of the one equal to a rolling block-length window of the other.

1. Documents are packed into chunks (compressed texts), shuffled by chunk once; all later
   steps read that one shuffle.
2. Each chunk sends the hashes of all its rolling windows of block length, distinct and
   sorted, to the shards of the hash, with a mark at those that are one of its
   non-overlapping reference blocks and at those that it has twice.  A shard answers with
   the hashes that are a reference block and occur more than once.  However frequent a
   passage is, a chunk sends it once.
3. Around each hit a chunk extends: it sends the hashes of the full windows that hold a hit
   (80 bits), and the shards answer with those that occur twice.  Windows that are repeated
   and overlap or touch make up the maximal exact repeats.
4. Covered words are left out.

Hashes of step 2 only choose what step 3 looks at, so that they may be short.

Cases: a null text counts as empty; a text with fewer words than a window keeps all its
words; a text that repeats itself loses all copies, the first included; repeated rows
are copies of each other; null ids are kept, one result for each input row; other columns
are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SPACES = b" \t\n\x0b\x0c\r"
PIECE = 4 << 20


def words_of(text: bytes):
    """The words of a text, a list for each piece of a few MB."""
    while len(text) > PIECE:
        cut = max(text.rfind(bytes([c]), 1, PIECE) for c in SPACES)
        if cut < 0:
            cut = min((i for c in SPACES if (i := text.find(bytes([c]), PIECE)) >= 0), default=len(text))
        yield text[:cut].split()
        text = text[cut:]
    yield text.split()


def hashes_of(text: bytes) -> np.ndarray:
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.concatenate([np.fromiter(map(h, ws), np.uint64, len(ws)) for ws in words_of(text)])


def rolling(h: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of all windows of so many words, by doubling."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    done, out, power = 0, None, None
    part, width, p = h, 1, base  # part[i] covers width words, p = base ** width
    with np.errstate(over="ignore"):
        while True:
            if length >> (width.bit_length() - 1) & 1:
                if out is None:
                    out, done, power = part, width, p
                else:
                    n = len(h) - done - width + 1
                    out, done, power = out[:n] * p + part[done : done + n], done + width, power * p
            if 2 * width > length:
                break
            n = len(h) - 2 * width + 1
            part, p, width = part[:n] * p + part[width : width + n], p * p, 2 * width
    x = out
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _pack(batches, chunk_bytes: int):
    """Step 1 on one task."""
    pid, seq = TaskContext.get().partitionId(), itertools.count()
    pack = zstandard.ZstdCompressor(level=3)
    ids, texts, size, kind = [], [], 0, pa.int64()

    def emit():
        lens = np.fromiter(map(len, texts), np.uint64, len(texts))
        return pa.RecordBatch.from_arrays(
            [pa.array([(pid << 28) + next(seq)], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([pack.compress(b"".join(texts))], pa.binary()), pa.array([pack.compress(common.planes(lens))], pa.binary())],
            ["chunk", "ids", "texts", "lens"],
        )

    for b in common.slices(batches):
        kind = b.schema.field(0).type
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = text.as_py()
            ids.append(key)
            texts.append(text)
            size += len(text) + 64
            if size >= chunk_bytes:
                yield emit()
                ids, texts, size = [], [], 0
    if ids:
        yield emit()


class Chunk:
    """The documents of a chunk, their word hashes one after another."""

    def __init__(self, ids, texts: bytes, lens: bytes):
        unpack = zstandard.ZstdDecompressor()
        texts, ends = unpack.decompress(texts), np.cumsum(common.unplanes(unpack.decompress(lens))).tolist()
        self.ids, self.texts = ids, [texts[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        parts = [hashes_of(t) for t in self.texts]
        self.counts = np.fromiter(map(len, parts), np.int64, len(parts))
        self.hashes = np.concatenate(parts)
        self.ends = np.cumsum(self.counts)

    def starts(self, length: int) -> np.ndarray:
        """Whether a window of so many words of one document starts at each word."""
        n = len(self.hashes)
        return np.arange(n) + length <= np.repeat(self.ends, self.counts)

    def window(self, length: int, base: np.uint64 = ODD[0]) -> np.ndarray:
        out = np.zeros(len(self.hashes), np.uint64)
        r = rolling(self.hashes, length, base)
        out[: len(r)] = r
        return out


def _send(chunk: int, shards: int, shard: np.ndarray, key: np.ndarray, extra: np.ndarray, flags: np.ndarray) -> pa.RecordBatch | None:
    """Rows for the shards: distinct keys, sorted; flags of equal keys are or-ed, and 2 says
    that there are several."""
    if not len(key):
        return None
    order = np.lexsort((extra, key, shard))
    shard, key, extra, flags = shard[order], key[order], extra[order], flags[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (extra[1:] != extra[:-1]) | (shard[1:] != shard[:-1])
    at = np.flatnonzero(new)
    flags = np.bitwise_or.reduceat(flags, at) | np.where(np.diff(np.append(at, len(key))) > 1, 2, 0).astype(np.uint8)
    shard, key, extra = shard[at], key[at], extra[at]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
    pack = zstandard.ZstdCompressor(level=1)
    rows = []
    for a, b in itertools.pairwise(cuts):
        if a < b:
            rows.append((chunk, int(shard[a]), pack.compress(common.planes(np.diff(key[a:b], prepend=np.uint64(0)))), pack.compress(common.planes(extra[a:b])), pack.compress(flags[a:b].tobytes())))
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])], ["chunk", "shard", "keys", "extra", "flags"])


SENT = "chunk long, shard int, keys binary, extra binary, flags binary"
ANSWER = "chunk long, keys binary, extra binary"


def _keys(data: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(common.unplanes(zstandard.ZstdDecompressor().decompress(data)), dtype=np.uint64)


def _probe(batches, shards: int, block: int):
    """Step 2, from a chunk: all rolling windows, and which are reference blocks."""
    for b in batches:
        for row in b.to_pylist():
            c = Chunk(row["ids"], row["texts"], row["lens"])
            ok = c.starts(block)
            h = c.window(block)[ok]
            place = (np.arange(len(c.hashes)) - np.repeat(c.ends - c.counts, c.counts))[ok]
            flags = (place % block == 0).astype(np.uint8)
            shard = (h % np.uint64(shards)).astype(np.int32)
            sent = _send(row["chunk"], shards, shard, h >> np.uint64(16), np.zeros(len(h), np.uint8), flags)
            if sent:
                yield sent


def _answer(t: pa.Table, anchored: bool) -> pa.Table:
    """A shard's answer: for each chunk its keys that occur twice anywhere (anchored: and
    are a reference block somewhere)."""
    unpack = zstandard.ZstdDecompressor()
    keys = [_keys(x.as_py()) for x in t.column("keys")]
    lens = np.fromiter(map(len, keys), np.int64, len(keys))
    key = np.concatenate(keys)
    extra = np.concatenate([common.unplanes(unpack.decompress(x.as_py())) for x in t.column("extra")]).astype(np.uint16)
    flags = np.concatenate([np.frombuffer(unpack.decompress(x.as_py()), np.uint8) for x in t.column("flags")])
    order = np.lexsort((extra, key))
    k, e = key[order], extra[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (e[1:] != e[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(k)))
    either = np.bitwise_or.reduceat(flags[order], at)
    good = (size > 1) | (either & 2 > 0)
    if anchored:
        good &= either & 1 > 0
    hit = np.empty(len(k), bool)
    hit[order] = np.repeat(good, size)
    pack = zstandard.ZstdCompressor(level=1)
    rows, start = [], 0
    for chunk, n in zip(t.column("chunk").to_pylist(), lens.tolist(), strict=True):
        own = hit[start : start + n]
        if own.any():
            found = key[start : start + n][own]
            rows.append((chunk, pack.compress(common.planes(np.diff(found, prepend=np.uint64(0)))), pack.compress(common.planes(extra[start : start + n][own]))))
        start += n
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["chunk", "keys", "extra"])


def _found(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All answers to a chunk, sorted."""
    unpack = zstandard.ZstdDecompressor()
    if not right.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    key = np.concatenate([_keys(x.as_py()) for x in right.column("keys")])
    extra = np.concatenate([common.unplanes(unpack.decompress(x.as_py())) for x in right.column("extra")])
    order = np.argsort(key, kind="stable")
    return key[order], extra[order]


def _member(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in of (sorted), and where."""
    if not len(of):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(of, keys), len(of) - 1)
    return of[at] == keys, at


def _full_hashes(c: Chunk, window: int) -> tuple[np.ndarray, np.ndarray]:
    return c.window(window), c.window(window, ODD[1]) >> np.uint64(48)


def _one(left: pa.Table) -> dict:
    if left.num_rows != 1:
        raise ValueError(f"a chunk has {left.num_rows} rows of texts")
    return left.to_pylist()[0]


def _extend(left: pa.Table, right: pa.Table, shards: int, block: int, window: int) -> pa.Table:
    """Step 3, from a chunk: the full windows that hold a hit."""
    empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), *[pa.array([], pa.binary())] * 3], ["chunk", "shard", "keys", "extra", "flags"])
    if not right.num_rows:
        return empty
    row = _one(left)
    c = Chunk(row["ids"], row["texts"], row["lens"])
    hits, _ = _found(right)
    hit = _member(c.window(block) >> np.uint64(16), hits)[0] & c.starts(block)
    seen = np.concatenate([[0], np.cumsum(hit)])
    n, full = len(hit), c.starts(window)
    at = np.flatnonzero(full)
    at = at[seen[np.minimum(at + window - block + 1, n)] > seen[at]]
    h, extra = _full_hashes(c, window)
    h, extra = h[at], extra[at]
    shard = (h % np.uint64(shards)).astype(np.int32)
    sent = _send(row["chunk"], shards, shard, h, extra, np.zeros(len(h), np.uint8))
    return pa.Table.from_batches([sent]) if sent else empty


def _cut(left: pa.Table, right: pa.Table, window: int, id_name: str) -> pa.Table:
    """Step 4 on one chunk."""
    row = _one(left)
    c = Chunk(row["ids"], row["texts"], row["lens"])
    keys, extras = _found(right)
    n = len(c.hashes)
    gone = np.zeros(n, bool)
    if len(keys):
        h, extra = _full_hashes(c, window)
        hit, at = _member(h, keys)
        hit &= (extras[at] == extra) & c.starts(window)
        edge = np.zeros(n + 1, np.int64)
        s = np.flatnonzero(hit)
        edge[s] += 1
        np.subtract.at(edge, s + window, 1)
        gone = np.cumsum(edge[:-1]) > 0
    kept, spans, removed, start = [], [], [], 0
    for text, end in zip(c.texts, c.ends.tolist(), strict=True):
        own = gone[start:end]
        removed.append(int(own.sum()))
        keep = iter((~own).tolist()) if removed[-1] else itertools.repeat(True)
        kept.append(b" ".join(w for ws in words_of(text) for w in itertools.compress(ws, itertools.islice(keep, len(ws)))))
        e = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
        spans.append(e.tolist())
        start = end
    ids = left.column("ids").combine_chunks().flatten()
    return pa.table([ids, pa.array(c.counts), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], [id_name, "n_words", "n_removed", "repeats", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, chunk_bytes: int = 4 << 20) -> DataFrame:
    """(id, n_words, n_removed, repeats, kept) of each row.  repeats: start and end, by
    turns, of the maximal repeated stretches, in words; kept: the other words, joined by one
    space, as UTF-8."""
    if window < 2:
        raise ValueError("a window has two words at least")
    block = (window + 1) // 2
    kind = docs.schema[id_col].dataType
    slim = docs.select(docs[id_col].alias("id"), common.text_of(docs, text_col).cast("binary").alias("text"))
    packed = T.StructType().add("chunk", "long").add("ids", T.ArrayType(kind)).add("texts", "binary").add("lens", "binary")
    slim = common.stable(slim)
    n = common.partitions_for(slim)
    chunks = slim.mapInArrow(lambda it: _pack(it, chunk_bytes), packed).repartition(n, "chunk")
    by_shard = lambda sent, anchored: sent.groupBy("shard").applyInArrow(lambda t: _answer(t, anchored), ANSWER)
    hits = by_shard(chunks.mapInArrow(lambda it: _probe(it, 2 * n, block), SENT), True)
    full = chunks.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(lambda a, b: _extend(a, b, 2 * n, block, window), SENT)
    repeated = by_shard(full, False)
    out = T.StructType([T.StructField(id_col, kind)]).add("n_words", "long").add("n_removed", "long").add("repeats", T.ArrayType(T.LongType())).add("kept", "binary")
    return chunks.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(lambda a, b: _cut(a, b, window, id_col), out)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of 35 words, over every whole text of documents."""
    return substring_dedup(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict:
    return {"op9_substring_dedup": op9_substring_dedup}
