"""Conversation structure repair: the cheapest edits that give role initials ``(s?(ua)+)?``.

An edit of a turn, with the run of inserted turns before it, is one macro (``K``, ``IID``).
Macros are prefix-free codes in ASCII order: two audits over the same turns differ first inside
a macro, neither is a prefix of the other, and so they compare macro by macro.  The dynamic
program over turns needs no audit strings therefore: a layer keeps, for each state of the
role automaton, the least cost and the rank of its best audit among the layer's, and a pointer to
the state and macro that it comes from.  The audit is put together from the pointers afterwards.

Rows are dealt out by ranges of (conversation, turn): a conversation is mostly whole within a
range and is solved there while rows stream by.  One that crosses a range's ends, or is longer
than ``most`` rows or ``size`` characters, goes by blocks: a block's transfer (cost and rank from
each state to each) is made alone, transfers compose (``compose``) up a tree of fixed height,
states come down the tree, and blocks follow their pointers.  No task gathers a conversation.
Only the digest and the audit, one value each, are made by passing its rows in order.

Cases: null roles and texts are one space; an empty role's initial counts as a space; null turns
come first, and rows of equal turns go by role, then by the SHA-256 of role and text; null
ids are one conversation; a conversation of which no row is left gives zeros, an empty audit and
the digest of nothing; repeated rows are duplicates; numbers beyond a long are given as the largest
long; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
#: The automaton of ``(s?(ua)+)?``: from a state by an initial to a state, and inserted turns that
#: lead from a state to an accepting one.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEFT = {0: 0, 1: 2, 2: 1, 3: 0}
STATES = range(4)
RUN = 3
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
MOST = (1 << 63) - 1
#: Bits of a row's place by which blocks, ranges and groups of ranges are told apart.
LEVELS = (10, 33, 45, 63)

COUNTS = ("blank", "duplicate", "truncated", "illegal")


@functools.cache
def macros(initial: str, must_go: bool, cut_off: bool) -> dict[int, list[tuple[int, int, str]]]:
    """state -> (to, cost, macro) of a turn with this initial, the best macro for each pair of states."""
    out = {}
    for q in STATES:
        found, at = {}, q
        for run in range(RUN + 1):
            options = [(at, DELETE, "D")]
            if not must_go:
                options += [(NEXT[at, initial], cut_off * TRUNCATED, "K")] if (at, initial) in NEXT else []
                options += [(NEXT[at, c], REROLE + cut_off * TRUNCATED, "R") for c in ROLES if (at, c) in NEXT]
            for to, cost, edit in options:
                new = (cost + run * INSERT, "I" * run + edit)
                found[to] = min(found.get(to, new), new)
            at = next(NEXT[at, c] for c in ROLES if (at, c) in NEXT)
        out[q] = sorted(((to, cost, macro) for to, (cost, macro) in found.items()), key=lambda x: x[2])
    return out


@functools.lru_cache(maxsize=1 << 16)
def _layer(at: tuple, turn: tuple) -> tuple:
    """(new layer, cost taken off, pointers); a layer: (state, cost above the least, rank) each."""
    best: dict = {}
    for q, cost, rank in at:
        for place, (to, more, macro) in enumerate(macros(*turn)[q]):
            if to not in best or (cost + more, rank) < best[to][:2]:
                best[to] = (cost + more, rank, place, q, macro)
    order = sorted(best, key=lambda k: best[k][1:3])
    least = min(b[0] for b in best.values())
    return tuple((k, best[k][0] - least, i) for i, k in enumerate(order)), least, {k: best[k][3:] for k in best}


def forward(turns: list[tuple], start: int) -> tuple[dict, list]:
    """({state: (cost, rank)} after all turns, pointers of each layer)."""
    at, taken, back = ((start, 0, 0),), 0, []
    for turn in turns:
        at, least, pointers = _layer(at, turn)
        taken += least
        back.append(pointers)
    return {q: (cost + taken, rank) for q, cost, rank in at}, back


def audit_of(back: list, end: int) -> list[str]:
    """The macros that lead to the state, from the pointers."""
    out = []
    for pointers in reversed(back):
        end, macro = pointers[end]
        out.append(macro)
    return out[::-1]


def ending(found: dict) -> tuple[int, int]:
    """(cost with the inserts at the end, state before them)."""
    cost, _, q = min((cost + LEFT[q] * INSERT, rank, q) for q, (cost, rank) in found.items())
    return cost, q


def compose(first: dict, then: dict) -> dict:
    """Transfers {state: {state: (cost, rank)}} one after the other."""
    out = {}
    for q, mids in first.items():
        best = {}
        for mid, (cost, rank) in mids.items():
            for to, (more, place) in then[mid].items():
                if to not in best or (cost + more, rank) < best[to][:2]:
                    best[to] = (cost + more, rank, place)
        order = sorted(best, key=lambda k: best[k][1:])
        out[q] = {k: (best[k][0], i) for i, k in enumerate(order)}
    return out


class Writer:
    """The repaired conversation's digest, turn by turn."""

    def __init__(self):
        self.hash, self.state, self.any = hashlib.sha256(), 0, False

    def line(self, role: str, text: str):
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def insert(self):
        c = next(c for c in ROLES if (self.state, c) in NEXT)
        self.state = NEXT[self.state, c]
        self.line(ROLES[c], "")

    def turn(self, macro: str, role: str, text: str):
        for _ in macro[:-1]:
            self.insert()
        if macro[-1] == "R":
            c = next(c for c in ROLES if (self.state, c) in NEXT)
            self.state = NEXT[self.state, c]
            self.line(ROLES[c], text)
        elif macro[-1] == "K":
            self.state = NEXT[self.state, role[0]]
            self.line(role, text)


# Turns as columns


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turn, role, text, gone): one row in twenty each gone, emptied, without its ends of
    sentences, repeated, of the role user; chosen by the CRC-32 of ``id:turn``."""
    word = lambda name: F.coalesce(rows[name].cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(word(id_col), F.lit(":"), word(turn_col)), "UTF-8")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    df = rows.select(rows[id_col].alias("id"), rows[turn_col].alias("turn"), word(role_col).alias("role"), word(text_col).alias("text"), fault.alias("fault"))
    df = df.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    df = df.select("id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"))
    return df.select(F.col("id").alias(id_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col), "gone")


def _last(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1)


def ordered(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, gone: Column) -> DataFrame:
    """Rows in ranges, each in order, with their place: (id, turn, role, text, gone, empty, cut_off, digest, pos)."""
    common.bound_batches(rows.sparkSession)
    word = lambda name: F.coalesce(rows[name].cast("string"), F.lit(" "))
    df = common.stable(rows.select(rows[id_col].alias("id"), rows[turn_col].cast("long").alias("turn"), word(role_col).alias("role"), word(text_col).alias("text"), gone.alias("gone")))
    last = _last(F.col("text"))
    df = df.withColumns({"empty": last == "", "cut_off": ~last.isin(".", "!", "?"), "digest": F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)), "__rf_in": F.monotonically_increasing_id()})
    keys = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "__rf_in"]
    return df.repartitionByRange(common.partitions_for(df), *keys).sortWithinPartitions(*keys).drop("__rf_in").withColumn("pos", F.monotonically_increasing_id())


ROW = ("turn", "role", "text", "gone", "empty", "cut_off", "digest", "pos")
RESULT = ("gaps", *COUNTS, "cost", "audit", "repaired_sha256")
DONE = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in RESULT)


def kind_of(initial: str, must_go: bool, cut_off: bool) -> tuple:
    return initial if initial in "sua" else " ", must_go, cut_off and not must_go


def _tally(rows, seen: set | None = None) -> tuple[list[tuple], dict]:
    """(turns for the dynamic program, what is counted) of rows that are left, in order.  seen:
    digests of earlier rows; without it rows tell by themselves whether they are repeated."""
    turns, initials = [], []
    n = dict.fromkeys(COUNTS, 0) | {"first": None, "last": None, "low": None, "high": None, "turns": 0}
    for r in rows:
        repeated = r["repeated"] if seen is None else r["digest"] in seen
        if seen is not None:
            seen.add(r["digest"])
        turn = kind_of(r["role"][:1] or " ", r["empty"] or repeated, r["cut_off"])
        turns.append(turn)
        initials.append(r["role"][:1] or " ")
        if fault := "blank" if r["empty"] else "duplicate" if repeated else "truncated" if r["cut_off"] else None:
            n[fault] += 1
        if r["turn"] is not None:
            n["turns"] += r["turn"] != n["high"]
            n["low"] = r["turn"] if n["low"] is None else n["low"]
            n["high"] = r["turn"]
    if initials:
        n["illegal"] = sum(a + b not in LEGAL for a, b in itertools.pairwise(initials))
        n["first"], n["last"] = initials[0], initials[-1]
    return turns, n


def _together(parts: list[dict]) -> dict:
    """Counts of neighbouring stretches of a conversation, as one."""
    out = dict(parts[0])
    for n in parts[1:]:
        if n["first"] is not None:
            out["illegal"] += n["illegal"] + (out["last"] is not None and out["last"] + n["first"] not in LEGAL)
            out["first"] = n["first"] if out["first"] is None else out["first"]
            out["last"] = n["last"]
        for c in ("blank", "duplicate", "truncated"):
            out[c] += n[c]
        if n["low"] is not None:
            out["turns"] += n["turns"] - (out["high"] == n["low"])
            out["low"] = n["low"] if out["low"] is None else out["low"]
            out["high"] = n["high"]
    return out


def gaps(n: dict) -> int:
    return 0 if n["low"] is None else min(MOST, n["high"] - n["low"] + 1 - n["turns"])


def solve(rows: list[dict]) -> dict:
    """The result of a whole conversation, by its rows in order."""
    rows = [r for r in rows if not r["gone"]]
    turns, n = _tally(rows, set())
    found, back = forward(turns, 0)
    cost, q = ending(found)
    audit, w = audit_of(back, q), Writer()
    for macro, r in zip(audit, rows, strict=True):
        w.turn(macro, r["role"], r["text"])
    for _ in range(LEFT[q]):
        w.insert()
    return {c: n[c] for c in COUNTS} | {"gaps": gaps(n), "cost": cost, "audit": "".join(audit) + "I" * LEFT[q], "repaired_sha256": w.hash.hexdigest()}


def _stream(batches, schema: pa.Schema, most: int, size: int):
    """Results of the conversations that are surely whole in this range, rows of the others."""
    unknown = object()
    out, held, mine, chars, through = [], [], unknown, 0, False
    for b in common.slices(batches):
        for r in b.to_pylist():
            if mine is unknown or r["id"] != mine:
                if held:
                    out.append({"id": mine} | solve(held))
                # the range's first conversation may have begun in the one before
                held, chars, through, mine = [], 0, mine is unknown, r["id"]
            held.append(r)
            chars += len(r["text"]) + len(r["role"])
            if through or len(held) > most or chars > size:
                out, held, through = out + held, [], True
        yield pa.RecordBatch.from_pylist(out, schema)
        out = []
    if held:  # the range's last may go on in the next
        yield pa.RecordBatch.from_pylist(held, schema)


# Conversations by blocks

WAY = "name string, key long, start int, end int"
ROOT = WAY + ", tail int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
NODE = "name string, key long, transfer array<array<long>>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"


def _node(name: str, key: int, transfer: dict, n: dict) -> dict:
    flat = [[q, to, cost, rank] for q, tos in transfer.items() for to, (cost, rank) in tos.items()]
    return {"name": name, "key": key, "transfer": flat} | {c: n[c] for c in (*COUNTS, "first", "last", "low", "high", "turns")}


def _transfer(flat: list) -> dict:
    out: dict = {q: {} for q in STATES}
    for q, to, cost, rank in flat:
        out[q][to] = (cost, rank)
    return out


ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<array<long>>": pa.list_(pa.list_(pa.int64()))}


def _table(rows: list[dict], columns: str) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([(name, ARROW[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))]))


def _block(t: pa.Table) -> pa.Table:
    rows = sorted(t.to_pylist(), key=lambda r: r["pos"])
    turns, n = _tally([r for r in rows if not r["gone"]])
    return _table([_node(rows[0]["name"], rows[0]["key"], {q: forward(turns, q)[0] for q in STATES}, n)], NODE)


def _combine(t: pa.Table) -> pa.Table:
    rows = sorted(t.to_pylist(), key=lambda r: r["key"])
    return _table([_node(rows[0]["name"], rows[0]["parent"], functools.reduce(compose, [_transfer(r["transfer"]) for r in rows]), _together(rows))], NODE)


def _way(t: pa.Table) -> pa.Table:
    """The states between which each child goes, by those of their parent."""
    rows = sorted(t.to_pylist(), key=lambda r: r["key"])
    layers = [{rows[0]["start"]: (0, 0, None)}]
    for r in rows:
        best, then = {}, _transfer(r["transfer"])
        for mid, (cost, rank, _) in layers[-1].items():
            for to, (more, place) in then[mid].items():
                if to not in best or (cost + more, rank) < best[to][:2]:
                    best[to] = (cost + more, rank, place, mid)
        order = sorted(best, key=lambda k, best=best: best[k][1:3])
        layers.append({k: (best[k][0], i, best[k][3]) for i, k in enumerate(order)})
    end, out = rows[0]["end"], []
    for r, layer in zip(reversed(rows), reversed(layers[1:]), strict=True):
        start = layer[end][2]
        out.append({"name": r["name"], "key": r["key"], "start": start, "end": end})
        end = start
    return _table(out, WAY)


def _edits(t: pa.Table) -> pa.Table:
    rows = sorted((r for r in t.to_pylist() if not r["gone"]), key=lambda r: r["pos"])
    if not rows:
        return _table([], "pos long, macro string")
    _, back = forward(_tally(rows)[0], rows[0]["start"])
    return _table([{"pos": r["pos"], "macro": m} for r, m in zip(rows, audit_of(back, rows[0]["end"]), strict=True)], "pos long, macro string")


def _digests(batches, schema: pa.Schema):
    """(name, audit, repaired_sha256) while the rows of a conversation pass in order."""
    name, w, audit = None, None, []
    done = lambda: pa.RecordBatch.from_pylist([{"name": name, "audit": "".join(audit), "repaired_sha256": w.hash.hexdigest()}], schema)
    for b in common.slices(batches):
        for r in b.to_pylist():
            if r["name"] != name:
                if w:
                    yield done()
                name, w, audit = r["name"], Writer(), []
            if r["macro"] is None:
                continue
            audit.append(r["macro"])
            if r["role"] is None:  # inserts at the end
                for _ in r["macro"]:
                    w.insert()
            else:
                w.turn(r["macro"], r["role"], r["text"])
    if w:
        yield done()


def by_blocks(rows: DataFrame) -> DataFrame:
    """Results of conversations whose rows (id, ``ROW``) are spread over ranges; rows: a written table."""
    name = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("null"))
    rows = rows.withColumn("name", name)
    lean = rows.select("name", "pos", "turn", "role", "gone", "empty", "cut_off")
    # a digest's first place, with partial minima; its other places are duplicates
    first = rows.where("NOT gone AND NOT empty").groupBy("name", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(False).alias("repeated"))
    lean = lean.join(first, "pos", "left").withColumns({"repeated": F.coalesce("repeated", ~F.col("empty")), "key": F.shiftright("pos", LEVELS[0])})
    lean = common.written(lean, "turns-lean")
    levels = [common.written(lean.groupBy("name", "key").applyInArrow(_block, NODE), "turns-blocks")]
    for below, shift in itertools.pairwise(LEVELS):
        up = levels[-1].withColumn("parent", F.shiftright("key", shift - below))
        levels.append(common.written(up.groupBy("name", "parent").applyInArrow(_combine, NODE), "turns-nodes"))
    roots = levels.pop()
    out = roots.mapInArrow(_root, ROOT)
    out = common.written(out, "turns-roots")
    way = out.select("name", "key", "start", "end")
    for children, (below, shift) in zip(reversed(levels), reversed(list(itertools.pairwise(LEVELS))), strict=True):
        met = children.withColumn("parent", F.shiftright("key", shift - below)).join(way.withColumnRenamed("key", "parent"), ["name", "parent"])
        way = met.groupBy("name", "parent").applyInArrow(_way, WAY)
    edits = lean.join(way, ["name", "key"]).groupBy("name", "key").applyInArrow(_edits, "pos long, macro string")
    told = rows.where("NOT gone").select("name", "pos", "role", "text").join(edits, "pos", "left").select("name", "pos", "role", "text", "macro")
    none = F.lit(None).cast("string")
    tails = out.select("name", F.lit(MOST).alias("pos"), none.alias("role"), none.alias("text"), F.repeat(F.lit("I"), F.col("tail")).alias("macro"))
    told = told.unionByName(tails).repartition("name").sortWithinPartitions("name", "pos")
    digests = "name string, audit string, repaired_sha256 string"
    schema = _table([], digests).schema
    told = told.mapInArrow(lambda it: _digests(it, schema), digests)
    ids = rows.groupBy("name").agg(F.first("id").alias("id"))
    return ids.join(out, "name").join(told, "name").select("id", *RESULT)


def _root(batches):
    for b in batches:
        out = []
        for r in b.to_pylist():
            cost, q = ending(_transfer(r["transfer"])[0])
            out.append({"name": r["name"], "key": r["key"], "start": 0, "end": q, "tail": LEFT[q], "gaps": gaps(r), "cost": cost} | {c: r[c] for c in COUNTS})
        yield from _table(out, ROOT).to_batches()


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None, most: int = 4096, size: int = 4 << 20) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each
    conversation.  gone: rows that aren't there, but whose conversation is."""
    df = ordered(rows, id_col, turn_col, role_col, text_col, F.lit(False) if gone is None else gone)
    schema = T.StructType([common.field(df, "id"), *[common.field(df, c) for c in ROW], *T.StructType.fromDDL(DONE).fields])
    arrow = to_arrow_schema(schema)
    passed = common.written(df.mapInArrow(lambda it: _stream(it, arrow, most, size), schema), "turns")
    done = passed.where("audit IS NOT NULL").select("id", *RESULT)
    return done.unionByName(by_blocks(passed.where("audit IS NULL").select("id", *ROW))).withColumnRenamed("id", id_col)


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    rows = damage(common.table(spark, sf_dir, "conversations"))
    return repair(rows, gone=F.col("gone"))


def queries() -> dict:
    return {"op13_turns": op13_turns}


def oracle_sql() -> dict:
    """Audits as strings in a recursion over turns: prefix-free macros make the least prefix right."""
    edges = ", ".join(f"({q}, '{c}', {to})" for (q, c), to in NEXT.items())
    codes = "list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step}), 4294967295)"
    sql = f"""
WITH RECURSIVE f AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS fault FROM conversations),
d AS MATERIALIZED (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy FROM f WHERE fault <> 0)),
o AS (SELECT *, row_number() OVER w AS i, coalesce(nullif(role[1], ''), ' ') AS c,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role)::VARCHAR || ':' || role || text))),
r AS MATERIALIZED (SELECT conv_id, i, turn, role, text, c, body = '' AS blank, body <> '' AND seen > 1 AS duplicate, body <> '' AND seen = 1 AND body[-1] NOT IN ('.', '!', '?') AS truncated, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM o)),
edge(q, c, to_q) AS (VALUES {edges}),
one AS (SELECT q, to_q, CASE c WHEN 'u' THEN 'user:' ELSE 'assistant:' END AS role FROM edge WHERE c IN ('u', 'a')),
run AS (SELECT q, q AS to_q, 0 AS k, []::VARCHAR[] AS lines FROM range(4) s(q) UNION ALL SELECT q, to_q, 1, [role] FROM one UNION ALL SELECT a.q, b.to_q, 2, [a.role, b.role] FROM one a JOIN one b ON b.q = a.to_q),
act AS (SELECT 'D' AS letter, q, NULL::VARCHAR AS c, q AS to_q, NULL::VARCHAR AS role, 3 AS cost FROM range(4) s(q) UNION ALL SELECT 'K', q, c, to_q, NULL::VARCHAR, 0 FROM edge UNION ALL SELECT 'R', q, NULL::VARCHAR, to_q, role, 2 FROM one),
macro AS MATERIALIZED (SELECT run.q, act.to_q, k, repeat('I', k) || letter AS edits, lines, letter, c, role, 2 * k + cost AS cost FROM run JOIN act ON act.q = run.to_q),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL SELECT conv_id, i, q, (best).cost, (best).audit, (best).lines FROM (
    SELECT dp.conv_id, r.i, m.to_q::BIGINT AS q, arg_min({{'cost': (dp.cost + m.cost + CASE WHEN truncated AND letter <> 'D' THEN 1 ELSE 0 END)::BIGINT, 'audit': dp.audit || edits,
        'lines': dp.lines || m.lines || CASE letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [m.role || r.text] END}},
      lpad((dp.cost + m.cost + CASE WHEN truncated AND letter <> 'D' THEN 1 ELSE 0 END)::VARCHAR, 12, '0') || dp.audit || edits) AS best
    FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1 JOIN macro m ON m.q = dp.q AND (letter = 'D' OR NOT (blank OR duplicate) AND (letter = 'R' OR m.c = r.c)) GROUP BY 1, 2, 3)),
n AS (SELECT conv_id, max(i) AS i, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1),
z AS (SELECT dp.conv_id, arg_min({{'cost': dp.cost + 2 * k, 'audit': dp.audit || repeat('I', k), 'lines': dp.lines || run.lines}}, lpad((dp.cost + 2 * k)::VARCHAR, 12, '0') || dp.audit || repeat('I', k)) AS best
  FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.i = dp.i JOIN run ON run.q = dp.q AND run.to_q IN (0, 3) GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce((best).cost, 0)::BIGINT AS cost, coalesce((best).audit, '') AS audit, sha256(coalesce(array_to_string((best).lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""
    return {"op13_turns": sql}
