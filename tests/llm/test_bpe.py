import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

from rillflow.llm import bpe
from tests.conftest import SF
from tests.llm.samples import SCHEMA, clashing, frame, hard_rows

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_as_library_and_round_trip(spark):
    enc = library()
    df = bpe.bpe_decode(bpe.bpe_encode(clashing(frame(spark)), RANKS, P.PATTERN, chunk_bytes=2000), RANKS)
    got = sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in df.collect())
    want = sorted((str(r[0]), np.array(enc.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in hard_rows())
    assert got == want


def test_query(spark):
    enc = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe.op8_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.bpe_encode(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).count() == 0


def test_words_of_many_shards_come_back_in_place():
    import pyarrow as pa
    import zstandard

    from rillflow.llm import common

    rng, pack = np.random.default_rng(5), lambda v: zstandard.ZstdCompressor().compress(common.planes(np.asarray(v)))
    shards, words = 20_000, 60_000
    of, ids = rng.integers(0, shards, words), [list(rng.integers(0, 50_000, rng.integers(1, 4))) for _ in range(words)]
    pos, counts = rng.integers(0, words, 200_000), [120_000, 0, 80_000]
    left = pa.table({"chunk": [0], "shard": [-1], "ids": [[7, None, 9]], "a": [pack(pos)], "b": [pack(of)], "c": [pack(counts)]})
    held = {}
    for w, shard in enumerate(of.tolist()):
        held.setdefault(shard, []).append(ids[w])
    mixed = list(held)
    rng.shuffle(mixed)
    right = pa.table(
        {
            "chunk": [0] * len(mixed),
            "shard": pa.array(mixed, pa.int32()),
            "n": [pack([len(x) for x in held[s]]) for s in mixed],
            "flat": [pack([t for x in held[s] for t in x]) for s in mixed],
        }
    )
    got = bpe._reassemble(left, right, "doc_id")
    assert got.column("doc_id").to_pylist() == [7, None, 9]
    want = [np.array([t for p in part for t in ids[p]], "<u4").tobytes() for part in (pos[:120_000], pos[:0], pos[120_000:])]
    assert got.column("ids").to_pylist() == want


def test_one_worker_encodes_and_decodes(spark, monkeypatch):
    for df in (bpe.bpe_encode(clashing(frame(spark)), RANKS, P.PATTERN, chunk_bytes=2000, decoded="decoded"), bpe.op8_byte_bpe(spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan[: plan.index("FlatMapCoGroupsInArrow")]
    monkeypatch.setattr(bpe, "PIECE", 7)
    df = bpe.bpe_encode(clashing(frame(spark)), RANKS, P.PATTERN, chunk_bytes=2000, decoded="decoded")
    enc = library()
    got = sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in df.collect())
    assert got == sorted((str(r[0]), np.array(enc.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in hard_rows())


def test_runs_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    data, starts, lengths = np.arange(100, dtype="<u4"), rng.integers(0, 90, 30), rng.integers(0, 5, 30)
    for n in (0, 1, 6, 7, 8, 40):
        items, ends = rng.integers(0, 30, n), np.sort(np.r_[0, 0, rng.integers(0, n + 1, 5), n, n])
        want = [list(data[starts[i] : starts[i] + lengths[i]]) for i in items]
        for piece in (1, 7, 1000):
            monkeypatch.setattr(bpe, "PIECE", piece)
            got, out = bpe._spelled(items, ends, starts, lengths, data)
            assert got.tolist() == sum(want, []) and out.tolist() == [sum(map(len, want[:e])) for e in ends]
