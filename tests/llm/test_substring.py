import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rillflow.llm import substring
from tests.conftest import SF
from tests.llm.samples import SCHEMA, clashing, frame, hard_rows


def brute(texts, window):
    import re

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window", [2, 7, 35])
def test_hard_cases(spark, window):
    rng = random.Random(window)
    rows = hard_rows()
    passage = " ".join(f"p{i}" for i in range(90))
    for k in range(30):
        own = [f"w{rng.randrange(12 if window < 9 else 10**6)}" for _ in range(rng.randrange(0, 120))]
        at, a = rng.randrange(len(own) + 1), rng.randrange(0, 60)
        rows.append((1000 + k, " ".join([*own[:at], *passage.split()[a : a + rng.randrange(30, 60)], *own[at:]]), None, None, None))
    rows.append((2000, " ".join(f"s{i % 40}" for i in range(200)), None, None, None))
    got = substring.substring_dedup(clashing(frame(spark, rows)), window=window, chunk_bytes=1500).collect()
    want = brute([r[1] for r in rows], window)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, bytes(r.kept).decode()) for r in got) == sorted((str(r[0]), *w) for r, w in zip(rows, want, strict=True))
    for r in got:
        assert sum(b - a for a, b in zip(r.repeats[::2], r.repeats[1::2])) == r.n_removed


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {d.doc_id: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in zip(docs, brute([d.text for d in docs], 35), strict=True)}
    got = substring.op9_substring_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want and len(got) == len(docs)
    assert any(r.n_removed for r in got)


def test_rolling_windows():
    h = np.random.default_rng(0).integers(0, 1 << 62, 100).astype(np.uint64)
    for length in (1, 2, 3, 18, 35, 64, 100, 101):
        r = substring.rolling(h, length, substring.ODD[0])
        assert len(r) == max(0, 101 - length) == len(set(r.tolist()))
        twice = substring.rolling(np.concatenate([h, h]), length, substring.ODD[0])
        assert np.array_equal(twice[: len(r)], twice[100 : 100 + len(r)])


def test_long_texts_are_cut_at_spaces(monkeypatch):
    monkeypatch.setattr(substring, "PIECE", 10)
    for t in (b"", b"a" * 50, b"ab cd" * 9, b" " * 30 + b"x", b"a" * 30 + b" b " + b"c" * 30):
        assert [w for ws in substring.words_of(t) for w in ws] == t.split()


def test_empty_table(spark):
    assert substring.substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
