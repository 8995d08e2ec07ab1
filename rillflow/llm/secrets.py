"""Secret scans: patterns, and values in a credential's context by their guess cost.

Base kinds are ``assign``, ``access`` and ``hex`` (patterns below, leftmost and
non-overlapping for each kind).  ``guess`` spans are added: values that stand where a
credential would, whose cheapest explanation takes many guesses.  A value stands there after a
credential's name and a sign (``:``, ``=``, ``=>``), past a scheme word if there is one; before
the host of an address; and, if it isn't of letters alone, after a name and ``is`` or after
``bearer``.  The cost is a minimum-cost segmentation of the value, by dynamic programming over
its characters, into

* words of a ranked list, with capitals and digit-for-letter spellings,
* dates, * repeats of a unit of one to four characters, * keyboard or alphabet walks,
* brute-force characters for the rest.

Costs are log10 of guesses and add up; each segment also pays for the choice of its kind.  All
stretches of a repeat or walk are tried, not only whole runs; they pay for their length by
its doublings, so that each doubling is one sliding minimum over the places where the stretch
may begin: the minimum is exact and the time n log n in the length of the value.

The list of words is the common words of passwords (``COMMON``), then the words that many
documents have, most documents first (``corpus_words``): a word that the corpus often has is no
secret.  No word is learnt where a value stands, so that a secret can't be its own word, however
often its document is copied; and a word needs ``least_docs`` documents and a share of all.

A value may be the name of the next credential, or hold it: the search goes on after each
name.  What lies in a value that is found isn't listed again.

Cases: a null text counts as empty and has no spans; whole texts and whole values are
looked at, however long; repeated rows and null ids are kept, one result for each input
row; other columns are ignored by ``find_secrets`` and kept by ``redact_secrets``, whatever
their names; an empty table gives an empty table.  Positions are code points, ends
exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: For these two a run that is too short holds no run that is long enough.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Where the value of a credential stands: after its name and a sign, or before the host of an
#: address.  A match ends with the name, so that names inside or instead of a value are looked
#: at too.
CONTEXT = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth)[_-]?key|bearer|authorization)"""
    r"""(?=(?:["']?\x20*(?::|=>?)\x20*["']?(?ai:(?:bearer|basic|token|digest|negotiate)\x20+(?![:=]))?"""
    r"""|(?:\x20+(?ai:is)|(?<=[Rr]))\x20+["']?(?=[^\s"'<>,;]*[^\sA-Za-z"'<>,;.:!?)]))(?P<value>[^\s"'<>,;]{6,}))"""
    r"""|://(?=[^\s:/@]+:(?P<login>[^\s/@]{6,})@)"""
)

#: The most common words of passwords, most common first.
COMMON = tuple(
    "password love admin welcome monkey dragon master login princess qwerty sunshine football baseball shadow michael superman iloveyou letmein "
    "hello freedom whatever trustno secret summer winter spring autumn computer internet server access test guest root user default system manager "
    "oracle public private change pass word key token api apple orange banana flower cookie ginger pepper cheese chocolate coffee tigger soccer hockey "
    "killer hunter ranger batman charlie jordan thomas robert daniel george andrew jessica ashley nicole michelle jennifer amanda hannah maria alex "
    "london paris berlin madrid boston dallas austin texas america germany france mexico january february march april may june july august september "
    "october november december monday tuesday wednesday thursday friday saturday sunday black white green yellow purple silver golden happy lucky magic "
    "angel heaven star moon sun fire water earth wind storm thunder light dark knight king queen prince blood death life music guitar piano dance "
    "correct horse battery staple the and for you with this that from have example sample changeme".split()
)
LEET = str.maketrans("4@3160!$57+9", "aaeliolsstg" + "g")
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba")
KIND, TWO, WALK, TURN = math.log10(5), math.log10(2), math.log10(94), 0.15
DAY, MONTH, YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d"
#: At a place at most one date of each of these begins.
DATES = tuple(
    re.compile(x)
    for x in (rf"{YEAR}(?:{MONTH}{DAY}|([-/._])(?:0?[1-9]|1[0-2])\1{DAY})", rf"{DAY}([-/._]?){MONTH}\1{YEAR}", rf"{MONTH}([-/._]?){DAY}\1{YEAR}", r"(?:19\d\d|20[0-4]\d)")
)

def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for row in ROWS:
        for a, b in zip(row, row[1:], strict=False):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for up, down in zip(ROWS[:3], ROWS[1:4], strict=True):
        for i, a in enumerate(up):
            for b in down[max(0, i - 1) : i + 1]:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
    return near


NEAR = _neighbours()
RANK = {w: i + 1 for i, w in reversed(list(enumerate(COMMON)))}


def alphabet(value: str) -> float:
    """Guesses for a character of a value, by the kinds of characters that it has."""
    n = 10 * any(c.isdigit() for c in value) + 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value)
    return float(max(10, n + 32 * any(not c.isalnum() for c in value)))


def lowered(value: str) -> str:
    """In lower case, of the same length (a few letters have a longer lower case)."""
    low = value.lower()
    return low if len(low) == len(value) else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)


def words_and_dates(value: str, words: dict[str, int], longest: int):
    """(start, end, kind, cost) of all words and dates in a value."""
    low, n = lowered(value), len(value)
    plain = low.translate(LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            for spelt, extra in ((low, 0.0), (plain, 1.0)):
                if (rank := words.get(spelt[i:j])) and not (extra and plain[i:j] == low[i:j]):
                    capitals = sum(c.isupper() for c in value[i:j])
                    caps = 0.0 if not capitals else TWO if capitals == j - i or value[i].isupper() and capitals == 1 else min(capitals, j - i - capitals) * math.log10(j - i + 1)
                    yield i, j, "word", math.log10(rank + 1) + extra + caps
        if value[i].isdigit():
            for k, date in enumerate(DATES):
                if m := date.match(value, i):
                    yield i, m.end(), "date", math.log10(150 * (1 if k == 3 else 365 * 4))


class Least:
    """The smallest of the values at lo..hi of a growing list, for lo and hi that only grow."""

    def __init__(self):
        self.held, self.upto = deque(), -1

    def at(self, values: list[float], lo: int, hi: int) -> int:
        held = self.held
        for i in range(max(self.upto + 1, lo), hi + 1):
            while held and values[held[-1]] >= values[i]:
                held.pop()
            held.append(i)
        self.upto = max(self.upto, hi)
        while held[0] < lo:
            held.popleft()
        return held[0]


def guess_cost(value: str, words: dict[str, int] | None = None, longest: int | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses of the cheapest segmentation, and that segmentation."""
    words = RANK if words is None else words
    longest = max(map(len, words), default=0) if longest is None else longest
    n, one, low = len(value), math.log10(alphabet(value)), lowered(value)
    ending: list[list] = [[] for _ in range(n + 1)]
    for i, j, kind, cost in words_and_dates(value, words, longest):
        ending[j].append((i, kind, cost))
    # best[j]: value[:j] at least cost; brute[j]: of those that end in brute force
    best, brute, back = [0.0], [math.inf], [(0, "")]
    begun = [0]  # where the brute force that ends at j begins
    turned = [0.0]  # turned[k]: cost of the turns before k; a walk turns at k if k + 2 isn't again as k
    for k in range(n):
        turned.append(turned[k] + (TURN if k + 2 < n and low[k] != low[k + 2] else 0.0))
    spaced, walk = [0.0], 0  # best[j] - turned[j]: for walks that begin at j; length of the walk ending at j
    runs, least = [0] * 5, {}
    for j in range(1, n + 1):
        going, fresh = brute[j - 1] + one, best[j - 1] + KIND + one
        brute.append(min(going, fresh))
        begun.append(begun[j - 1] if going <= fresh else j - 1)
        found, how = brute[j], (begun[j], "brute")
        for i, kind, cost in ending[j]:
            if (c := best[i] + cost + KIND) < found:
                found, how = c, (i, kind)
        for unit in (1, 2, 3, 4):  # value[j - runs[unit] : j] repeats itself after unit
            runs[unit] = runs[unit] + 1 if j > unit and value[j - 1] == value[j - 1 - unit] else 0
            size, shortest = runs[unit] + unit, max(2 * unit, 3)
            if size >= shortest and runs[unit]:
                double = 1
                while True:
                    lo = max(j - size, j - (unit << double))
                    if lo <= j - shortest:
                        i = least.setdefault((unit, double), Least()).at(best, lo, j - shortest)
                        if (c := best[i] + unit * one + double * TWO + KIND) < found:
                            found, how = c, (i, "repeat")
                    if unit << double >= size:
                        break
                    double += 1
        walk = walk + 1 if j > 1 and low[j - 1] in NEAR.get(low[j - 2], ()) else 1
        if walk >= 3:
            double = 2
            while True:
                lo = max(j - walk, j - (1 << double))
                i = least.setdefault((0, double), Least()).at(spaced, lo, j - 3)
                if (c := spaced[i] + turned[j - 2] + WALK + double * TWO + KIND) < found:
                    found, how = c, (i, "walk")
                if 1 << double >= walk:
                    break
                double += 1
        best.append(found)
        spaced.append(found - turned[j])
        back.append(how)
    parts, j = [], n
    while j:
        i, kind = back[j]
        parts.append((i, j, kind))
        j = i
    return best[n], parts[::-1]


def spans_of(text: str, least: float = 12.0, words: dict[str, int] | None = None, longest: int | None = None) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, log10 of guesses) of all spans, by start, then kind as listed."""
    found = [("assign", m.start(), m.end(), None) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    covered, login, cheap, repeats = 0, -1, -1, []
    for m in CONTEXT.finditer(text):
        name = "value" if m.group("value") is not None else "login"
        start = m.start(name)
        end = start + len(m.group(name).rstrip(".:!?)]}"))
        # found already: what a found value holds, or two names lead to; a user's name before a login is no context
        if end - start < 6 or end <= covered or start == login:
            continue
        # the rest of a cheap value that begins in one of its repeats is no dearer
        if end == cheap and any(a <= start <= b - 8 for a, b in repeats):
            continue
        cost, parts = guess_cost(text[start:end], words, longest)
        if cost >= least:
            found.append(("guess", start, end, cost))
            covered = end
        else:
            cheap, repeats = end, [(start + i, start + j) for i, j, kind in parts if kind == "repeat"]
        login = start if name == "login" else login
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redacted(text: str, spans: list) -> str:
    """The text with each stretch that spans cover replaced by the first one's kind."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def ranked(words: list[str]) -> dict[str, int]:
    """COMMON and then other words, by rank."""
    return {w: i + 1 for i, w in enumerate(dict.fromkeys((*COMMON, *words)))}


#: After these, as after a sign, a value may stand.
SCHEMES = ("bearer", "basic", "token", "digest", "negotiate")


def learnt(tokens: pa.Array, first: np.ndarray, longest: int) -> tuple[pa.Array, np.ndarray]:
    """Words of letters, and which of the tokens (lower case, in order) they are.  What follows a
    sign or a scheme word, or begins with a sign, may be a value and isn't learnt; first: where a
    document's first token is."""
    words = pc.utf8_trim(tokens, characters=".,;:!?\"'()")
    size = pc.utf8_length(words)
    held = pc.and_(pc.utf8_is_alpha(words), pc.and_(pc.greater_equal(size, 4), pc.less_equal(size, longest))).to_numpy(zero_copy_only=False)
    leads = pc.or_(pc.match_substring_regex(tokens, "[:=>][\"']?$"), pc.is_in(words, pa.array(SCHEMES))).to_numpy(zero_copy_only=False)
    after = np.concatenate([[False], leads[:-1]]) & ~first if len(leads) else first
    own = pc.match_substring_regex(tokens, "^[\"']?[:=]").to_numpy(zero_copy_only=False)
    at = np.flatnonzero(held & ~after & ~own)
    return words.take(pa.array(at)), at


def _word_rows(batches, longest: int):
    """(word, n): how many texts of this task have a word of letters, in part sums; the word '' is
    in each text."""
    found: Counter = Counter()

    def sent():
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    for b in common.slices(batches):
        found[""] += b.num_rows
        lists = pc.utf8_split_whitespace(pc.utf8_lower(b.column(0)))
        of = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        first = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
        words, at = learnt(lists.flatten(), first, longest)
        coded = words.dictionary_encode()
        kinds = max(1, len(coded.dictionary))
        once = np.unique(of[at] * kinds + coded.indices.to_numpy())
        for w, n in zip(coded.dictionary.to_pylist(), np.bincount(once % kinds, minlength=kinds).tolist(), strict=False):
            found[w] += n
        if len(found) > 200_000:
            yield sent()
            found.clear()
    if found:
        yield sent()


def corpus_words(docs: DataFrame, text_col: str = "text", least_docs: int = 10, share: float = 0.001, longest: int = 32) -> list[str]:
    """The words of letters (4 to ``longest`` of them) that at least so many documents and such a
    share of all documents have, those of most documents first.  They are no more than the mean
    number of different words of a document, divided by the share."""
    texts = docs.select(common.text_of(docs, text_col).alias("text"))
    counts = common.spread(texts).mapInArrow(lambda it: _word_rows(it, longest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = common.written(counts, "words")
    total = sum(r.n for r in counts.where("word = ''").collect())
    often = counts.where((F.col("word") != "") & (F.col("n") >= max(least_docs, math.ceil(share * total))))
    return [r.word for r in sorted(often.collect(), key=lambda r: (-r.n, r.word))]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 12.0, words: list[str] | None = None) -> DataFrame:
    """(id, spans) of each row.  least: log10 of the guesses from which a value in a
    credential's context is a secret; words: what comes after COMMON, most common first, if
    not corpus_words()."""
    ranks = ranked(corpus_words(docs, text_col) if words is None else words)
    longest, shared = max(map(len, ranks)), docs.sparkSession.sparkContext.broadcast(ranks)
    slim = docs.select(docs[id_col].alias("id"), common.text_of(docs, text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("guesses", pa.float64())]))

    def run(batches):
        ranks = shared.value
        for b in common.slices(batches):
            found = [[dict(zip(("kind", "start", "end", "guesses"), s, strict=True)) for s in spans_of(t.as_py(), least, ranks, longest)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], [id_col, "spans"])

    spans = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("guesses", "double"))
    return common.spread(slim).mapInArrow(run, T.StructType([common.field(docs, id_col), T.StructField("spans", spans)]))


def redact_secrets(docs: DataFrame, text_col: str = "text", least: float = 12.0, words: list[str] | None = None) -> DataFrame:
    """All columns, with secrets in the text replaced by their kind; a null text stays null.
    words: as in find_secrets()."""
    ranks = ranked(corpus_words(docs, text_col) if words is None else words)
    longest, shared = max(map(len, ranks)), docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        ranks = shared.value
        for b in common.slices(batches):
            at = b.schema.get_field_index(text_col)
            texts = [t if t is None else redacted(t, spans_of(t, least, ranks, longest)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return common.spread(docs).mapInArrow(run, docs.schema)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    found = find_secrets(common.table(spark, sf_dir, "documents"))
    n = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}")
    joined = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), n("guess"),
        F.expr(f"sha2({joined("filter(spans, s -> s.kind != 'guess')")}, 256)").alias("base_sha256"),
        F.expr(joined("spans")).alias("spans"),
    )


def queries() -> dict:
    return {"op3_secrets": op3_secrets}
