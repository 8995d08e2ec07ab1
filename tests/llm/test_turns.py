import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rillflow.llm import turns
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain(rows):
    """Every audit of a layer as a string, the best for each string of role initials kept."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
    seen, blank, duplicate, truncated, kinds = set(), 0, 0, 0, []
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        blank, duplicate, truncated = blank + (fault == "b"), duplicate + (fault == "d"), truncated + (fault == "t")
        kinds.append(fault)
    initials = [r[2][:1] or " " for r in rows]
    # a prefix's initials count only by what may follow: none, s, ...u, ...a
    state = lambda s: s if s in ("", "s") else s[-1]
    fits = lambda s: re.fullmatch(r"(s?(ua)*u?)?", s)
    best = {"": (0, "", "", [])}  # state -> cost, audit, initials, lines

    def inserted(b):
        found = {}
        for k in range(4):
            for new in itertools.product("ua", repeat=k):
                s = b[2] + "".join(new)
                if all(fits(s[: len(b[2]) + i]) for i in range(1, k + 1)):
                    found[k, s] = (b[0] + 2 * k, b[1] + "I" * k, s, b[3] + [("user:" if c == "u" else "assistant:") for c in new])
        return found.values()

    for (_, _, role, text), fault, c in zip(rows, kinds, initials, strict=True):
        layer = {}
        for b in best.values():
            for cost, audit, s, lines in inserted(b):
                options = [(cost + 3, audit + "D", s, lines)]
                if fault not in ("b", "d"):
                    more = fault == "t"
                    options += [(cost + more, audit + "K", s + c, [*lines, f"{role}:{text}"])] if fits(s + c) else []
                    options += [(cost + 2 + more, audit + "R", s + x, [*lines, f"{name}:{text}"]) for x, name in (("u", "user"), ("a", "assistant")) if fits(s + x)]
                for o in options:
                    layer[state(o[2])] = min(layer.get(state(o[2]), o), o)
        best = layer
    cost, audit, s, lines = min(x for b in best.values() for x in inserted(b) if GOOD.fullmatch(x[2]))
    have = sorted({r[1] for r in rows if r[1] is not None})
    gaps = min(2**63 - 1, have[-1] - have[0] + 1 - len(have)) if have else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(rows, all_ids):
    groups = {i: [] for i in all_ids}
    for r in rows:
        groups[r[0]].append(r)
    return {i: plain(g) for i, g in groups.items()}


def results(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", *turns.RESULT).collect()}


def conversations(seed, n=60, most=9):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice(["Hi.", "Hi", "", " \n", "Why? ", "No!", "und so", None, f"{rng.random()}."])))
    return rows


HARD = [
    (None, 1, "user", "Null id."), (None, None, None, None), (1, None, "user", "a."), (1, None, "assistant", "b."), (2, 5, "", "x."), (3, 2**62, "user", "far."), (3, -(2**62) - 5, "assistant", "far."),
    (4, 1, "user", "same."), (4, 1, "user", "same."), (4, 1, "user", "other."), (5, 1, "system", "alone."), (6, 1, "Ünï", "é."), (7, 1, "assistant", "z" * 100_000),
]


@pytest.mark.parametrize(("rows", "most"), [(conversations(1), 4096), (conversations(2, 40), 2), (HARD, 4096), (HARD, 0), ([], 4096), (conversations(3, 3, 90), 0)], ids=["many", "many by blocks", "hard", "hard by blocks", "empty", "long by blocks"])
def test_is_the_plain_version(spark, rows, most, monkeypatch):
    """most: how long a conversation may be before it goes by blocks; both ways agree."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("id", "name", "pos", "key", "blank", "audit", "gone", "digest"):
        df = df.withColumn(c, F.lit("clash"))
    monkeypatch.setattr(turns, "LEVELS", (2, 33, 34, 63))
    got = results(turns.repair(turns.damage(df), gone=F.col("gone"), most=most))
    assert got == expected(damaged(rows), {r[0] for r in rows})


def test_undamaged_and_renamed(spark):
    rows = conversations(5)
    df = spark.createDataFrame([(str(a), b, c, d) for a, b, c, d in rows], "who string, n long, speaker string, said string")
    got = turns.repair(df, "who", "n", "speaker", "said")
    word = lambda x: " " if x is None else x
    assert {r.who: tuple(r[c] for c in turns.RESULT) for r in got.collect()} == {str(k): v for k, v in expected([(a, b, word(c), word(d)) for a, b, c, d in rows], {r[0] for r in rows}).items()}


def test_one_conversation_of_most_rows(spark):
    """It goes by many blocks over all ranges, none of which holds it."""
    rng = random.Random(3)
    rows = [(0, i, rng.choice(["user", "assistant"]), f"{rng.choice('abcdefg')}{i % 700}.") for i in range(2000)] + conversations(6, 40)[:100]
    rows = [(c + 1 if c is not None and i >= 2000 else c, *r) for i, (c, *r) in enumerate(rows)]
    got = results(turns.repair(spark.createDataFrame(rows, SCHEMA).repartition(7)))
    word = lambda x: " " if x is None else x
    assert got == expected([(a, b, word(c), word(d)) for a, b, c, d in rows], {r[0] for r in rows})


def test_macros_are_prefix_free():
    every = {m for i in "sua " for must in (False, True) for cut in (False, True) for found in turns.macros(i, must, cut).values() for *_, m in found}
    assert not any(a != b and b.startswith(a) for a in every for b in every)


def test_query_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = turns.op13_turns(spark, SF)
    found = con.sql(turns.oracle_sql()["op13_turns"])
    assert sorted(map(tuple, df.select(*found.columns).collect())) == sorted(found.fetchall())
    rows = con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert results(df) == expected(damaged(rows), {r[0] for r in rows})
