"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Encoding, in three steps:

1. Documents are packed into chunks of a few MB.  In each chunk the texts are split
   into pre-tokens; what is kept are the chunk's distinct pre-tokens and, for every
   position of every document, the number of its pre-token.  These rows are shuffled by
   chunk once, and both following steps read that one shuffle.
2. The distinct pre-tokens of all chunks are shuffled by their hash.  A word stands there
   at most once for each chunk, however frequent it is, and is encoded once.
3. The ids come back to the chunk, and each document is put together by position.

Decoding, by a worker of its own or by that of step 3, joins each id with the token-byte table, which has a row for each rank of the
vocabulary (its size is that of the vocabulary, not of the data) and is thus held by every
worker.

Cases: a null text counts as empty; an empty text has no ids and decodes to no bytes;
repeated rows and null ids are kept, one result for each input row; other columns of the
input are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words whose ids a task keeps at hand.
KNOWN = 1_000_000
#: Characters beyond which the matches of one text aren't held as a list of strings.
LONG_TEXT = 1 << 21
#: Pre-tokens or ids that are put in place at a time.
PIECE = 1 << 16


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: start and length of each id, and the bytes."""
    ranks = load_ranks(path)
    n = max(ranks.values(), default=-1) + 1
    lengths = np.zeros(n, np.int64)
    by_id = [b""] * n
    for k, v in ranks.items():
        by_id[v], lengths[v] = k, len(k)
    return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(by_id), np.uint8)


def _chunks(batches, pattern: str, shards: int, chunk_bytes: int):
    """Step 1 on one task."""
    import regex
    import xxhash

    split = regex.compile(pattern)
    pid = TaskContext.get().partitionId()
    seq = itertools.count()
    pack = zstandard.ZstdCompressor(level=3)

    def emit(ids: list, counts: list, parts: list, words: dict):
        chunk = (pid << 28) + next(seq)
        pos = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        keys = [w.encode() for w in words]
        order = np.argsort(-np.bincount(pos, minlength=len(keys)), kind="stable")
        rank = np.empty(len(keys), np.uint32)
        rank[order] = np.arange(len(keys), dtype=np.uint32)
        keys = [keys[i] for i in order]
        of = np.fromiter((xxhash.xxh64_intdigest(k) % shards for k in keys), np.int64, len(keys))
        rows = [(chunk, -1, ids, pack.compress(common.planes(rank[pos])), pack.compress(common.planes(of)), pack.compress(common.planes(np.array(counts))))]
        by = np.argsort(of, kind="stable")
        cuts = np.flatnonzero(np.diff(of[by])) + 1
        for part in np.split(by, cuts) if len(by) else ():
            own = [keys[i] for i in part]
            rows.append((chunk, int(of[part[0]]), None, pack.compress(b"".join(own)), pack.compress(common.planes(np.fromiter(map(len, own), np.uint64, len(own)))), None))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(id_type)), *(pa.array(c, pa.binary()) for c in cols[3:])],
            ["chunk", "shard", "ids", "a", "b", "c"],
        )

    words: dict = defaultdict(itertools.count().__next__)
    ids, counts, parts, size = [], [], [], 0
    id_type = pa.int64()
    for batch in common.slices(batches):
        id_type = batch.schema.field(0).type
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            if len(text) <= LONG_TEXT:
                found = split.findall(text)
                at = np.fromiter(map(words.__getitem__, found), np.uint32, len(found))
            else:
                at = np.fromiter((words[m.group()] for m in split.finditer(text)), np.uint32)
            ids.append(key)
            counts.append(len(at))
            parts.append(at)
            size += len(text) + 64
            if size >= chunk_bytes:
                yield emit(ids, counts, parts, words)
                words = defaultdict(itertools.count().__next__)
                ids, counts, parts, size = [], [], [], 0
    if ids:
        yield emit(ids, counts, parts, words)


def _words(batches):
    """The rows of words.  Not a where(): that would be pushed below the shuffle, which
    then couldn't be shared."""
    for b in batches:
        yield b.filter(pc.greater_equal(b.column("shard"), 0)).select(["chunk", "shard", "a", "b"])


def _encode_words(batches, path: str, pattern: str):
    """Step 2 on one task: every distinct word of its shards is encoded once (again if the task
    has met KNOWN others since, so that its memory has a bound)."""
    one = _encoder(path, pattern)._core_bpe.encode_single_piece
    known: dict[bytes, list[int]] = {}
    pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for data, lens in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            data, ends = unpack.decompress(data), np.cumsum(common.unplanes(unpack.decompress(lens))).tolist()
            found, start = [], 0
            for end in ends:
                word = data[start:end]
                start = end
                ids = known.get(word)
                if ids is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    ids = known[word] = one(word)
                found.append(ids)
            n = np.fromiter(map(len, found), np.uint64, len(found))
            flat = np.fromiter(itertools.chain.from_iterable(found), np.uint64)
            out.append((pack.compress(common.planes(n)), pack.compress(common.planes(flat))))
        if out:
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("shard"), *(pa.array(c, pa.binary()) for c in zip(*out, strict=True))], ["chunk", "shard", "n", "flat"])


def _spelled(items: np.ndarray, ends: np.ndarray, starts: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs data[starts[i] : starts[i] + lengths[i]] of all items i, one after another, and where the runs
    of the first ends[j] items end.  PIECE items at a time: indices take many times what they point to."""
    parts, out, done = [data[:0]], np.zeros(len(ends), np.int64), 0
    for i in range(0, len(items), PIECE):
        at = items[i : i + PIECE]
        n = lengths[at]
        here = np.concatenate([[0], np.cumsum(n)])
        low, high = np.searchsorted(ends, [i, i + len(at)], "right")
        out[low:high] = done + here[ends[low:high] - i]
        parts.append(data[common.ragged(starts[at], n)])
        done += int(here[-1])
    return np.concatenate(parts), out


def _reassemble(left: pa.Table, right: pa.Table, id_name: str, path: str = "", decoded: str = "") -> pa.Table:
    """Step 3 on one chunk; with a name for them, the decoded bytes too."""
    unpack = zstandard.ZstdDecompressor()
    get = lambda x: common.unplanes(unpack.decompress(x.as_py()))
    left = left.filter(pc.less(left.column("shard"), 0))
    if left.num_rows != 1:
        raise ValueError(f"a chunk has {left.num_rows} position rows")
    ids = left.column("ids").combine_chunks().flatten()
    pos, of, counts = get(left.column("a")[0]), get(left.column("b")[0]), get(left.column("c")[0]).astype(np.int64)
    start, length = np.zeros(len(of), np.int64), np.full(len(of), -1, np.int64)
    # the words of each shard, in order: one sort, not a pass for each shard
    order = np.argsort(of, kind="stable")
    sizes = right.column("shard").to_numpy().astype(of.dtype)
    lows, highs = np.searchsorted(of, sizes, "left", order), np.searchsorted(of, sizes, "right", order)
    flats, base = [], 0
    for low, high, n, flat in zip(lows.tolist(), highs.tolist(), right.column("n"), right.column("flat"), strict=True):
        n, flat = get(n).astype(np.int64), get(flat).astype("<u4")
        at = order[low:high]
        length[at] = n
        start[at] = base + np.cumsum(n) - n
        flats.append(flat)
        base += len(flat)
    if (length < 0).any():
        raise ValueError("a word of the chunk has no ids")
    flat = np.concatenate(flats) if flats else np.zeros(0, "<u4")
    tokens, ends = _spelled(pos, np.cumsum(counts), start, length, flat)
    cols = {id_name: ids, "ids": common.binaries(tokens.view(np.uint8), ends * 4)}
    if decoded:
        cols[decoded] = common.binaries(*_spelled(tokens, ends, *token_bytes(path)))
    return pa.table(cols)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4 << 20, decoded: str = "") -> DataFrame:
    """Id and ids of each document; ids as little-endian unsigned 32-bit integers.  With a name for
    them, the bytes that bpe_decode gives too, made by the same worker: a second one beside it takes
    an executor's memory."""
    if decoded in (id_col, "ids"):
        raise ValueError("the decoded bytes need a name of their own")
    kind = docs.schema[id_col].dataType
    schema = T.StructType().add("chunk", "long").add("shard", "integer").add("ids", T.ArrayType(kind)).add("a", "binary").add("b", "binary").add("c", "binary")
    slim = docs.select(docs[id_col].alias("id"), common.text_of(docs, text_col).alias("text"))
    slim = common.stable(slim)
    shards = common.partitions_for(slim)
    packed = slim.mapInArrow(lambda it: _chunks(it, pattern, shards, chunk_bytes), schema).repartition(shards, "chunk")
    words = packed.mapInArrow(_words, "chunk long, shard int, a binary, b binary")
    coded = words.repartition(shards, "shard").mapInArrow(lambda it: _encode_words(it, ranks_path, pattern), "chunk long, shard int, n binary, flat binary")
    out = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.BinaryType()) for c in ("ids", decoded) if c)])
    return packed.groupBy("chunk").cogroup(coded.groupBy("chunk")).applyInArrow(lambda a, b: _reassemble(a, b, id_col, ranks_path, decoded), out)


def bpe_decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns, and the decoded bytes (in place of a column of that name).  An id outside the
    vocabulary raises."""
    if ids_col == out_col:
        raise ValueError("the decoded bytes need a name of their own")
    encoded = encoded.drop(out_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.BinaryType())])

    def decode(batches):
        starts, lengths, data = token_bytes(ranks_path)
        for b in common.slices(batches):
            col = b.column(b.schema.get_field_index(ids_col)).fill_null(b"")
            offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
            raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            found = common.binaries(*_spelled(raw.view("<u4"), (offsets[1:] - offsets[0]) // 4, starts, lengths, data))
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, out_col])

    return encoded.mapInArrow(decode, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded again."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe_encode(common.table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict:
    return {"op8_byte_bpe": op8_byte_bpe}
