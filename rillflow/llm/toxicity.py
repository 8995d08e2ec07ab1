"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max
inverted index, distance-weighted votes, calibrated.

Fitting takes a bounded sample of labelled rows (``fit_rows``, by a hash of the id; never
the held-out fold), all of which are the examples.  The vocabulary: terms of at least
``least_rows`` examples and at most a share ``common_share`` of them (commoner ones only if
they go with a label, either one), the ``terms`` most frequent of these.  A term is
a stem (a word or a word's beginning) that a text has at least 1, 2, 3, 5 or 8 times, so that
term frequency outlives the normalising of vectors, and weighs idf * association.  Document
frequencies are counted over all documents.
The association is the absolute phi coefficient of term and label, whichever label the term
goes with, less what chance gives (chi-square of ``chance``), and ``floor`` at least: each
term counts, so that each text with a term has neighbours, clean ones too.  The index,
bounded by these parameters, is broadcast.

A search is exact: examples are laid in blocks of 64, each term keeps its largest weight
in each block, blocks are gone through in the order of the bound that these give, and the
search ends when no block left can reach the k-th best cosine.  Ties go to the example that
stands first in the index, whose order is one of content: by the most frequent term, the
number of terms, and a digest of the text.

The vote is the share of toxic neighbours weighted by squared cosine, shrunk towards the
base rate; isotonic regression on leave-one-out votes of the examples makes it a
probability.  A document that has none of the terms gets the toxic share of such examples
(the base rate if there are none), and no evidence.

Cases: a null text counts as empty and is scored as a document without terms; labels that
are null or neither 0 nor 1, or whose id is null, teach nothing; of several labels of an id
the largest holds, of several texts of an id the first in their order; copies of a text are
one example with the largest of their labels and the smallest of their ids; without examples
of both labels the score is their base rate (0 if there is no label at all); repeated rows
and null ids are kept, one result for each input row; other columns are ignored by
``score_toxicity`` and kept by ``keep_clean``, whatever their names; an empty table gives an
empty table.
"""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCK = 64
#: What doesn't belong to a word at its ends.
EDGE = string.punctuation + "«»„“”‘’‚…–—¡¿"
#: Lengths of the beginnings of words that are stems.
BEGINNINGS = (4, 5, 6)
#: A stem that a text has so many times counts as a term for each of these that it reaches.
LEVELS = (1, 2, 3, 5, 8)


#: Bytes of text that are read at a time.
SLICE = 1 << 20


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts (lower case, cut at white space, without EDGE), for
    each place of a word its number there, and its text's place."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    coded = lists.flatten().dictionary_encode()
    counts = lists.value_lengths().to_numpy(zero_copy_only=False)
    return pc.utf8_trim(coded.dictionary, characters=EDGE), coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(texts)), counts)


class Vocabulary:
    """The chosen terms, "word#n" or "beginning*#n" (n occurrences or more), by number."""

    def __init__(self, names: list[str]):
        self.names = names
        stems = list(dict.fromkeys(name.rpartition("#")[0] for name in names))
        number = {stem: i for i, stem in enumerate(stems)}
        #: of[stem, level]: the number of the term, or -1
        self.of = np.full((len(stems), len(LEVELS)), -1)
        for i, name in enumerate(names):
            stem, _, n = name.rpartition("#")
            self.of[number[stem], LEVELS.index(int(n))] = i
        self.words = self._numbered([(s, i) for s, i in number.items() if s[-1] != "*"])
        self.begun = [self._numbered([(s[:-1], i) for s, i in number.items() if s[-1] == "*" and len(s) == n + 1]) for n in BEGINNINGS]

    @staticmethod
    def _numbered(found: list[tuple[str, int]]) -> tuple[pa.Array, np.ndarray]:
        return pa.array([s for s, _ in found], pa.string()), np.array([i for _, i in found] + [-1])

    def __len__(self):
        return len(self.names)

    def __reduce__(self):
        return Vocabulary, (self.names,)

    def _stems(self, words: pa.Array) -> np.ndarray:
        """For each word the numbers of its stems: itself and its beginnings, or -1."""
        size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        out = np.empty((len(words), 1 + len(BEGINNINGS)), np.int64)
        for k, (n, (known, number)) in enumerate(zip((1, *BEGINNINGS), (self.words, *self.begun), strict=True)):
            at = pc.index_in(pc.utf8_slice_codeunits(words, 0, n) if k else words, value_set=known)
            out[:, k] = np.where(size > n, number[pc.fill_null(at, -1).to_numpy(zero_copy_only=False)], -1)
        return out

    def read(self, texts: pa.Array) -> list[np.ndarray]:
        """For each text the numbers of its terms, ascending."""
        words, at, text = words_of(texts)
        stems = self._stems(words)[at]
        known, width = stems >= 0, max(1, len(self.of))
        key, often = np.unique((text[:, None] * width + stems)[known], return_counts=True)
        terms = self.of[key % width]
        held = (terms >= 0) & (often[:, None] >= LEVELS)
        found = np.sort(np.broadcast_to((key // width)[:, None], terms.shape)[held] * max(1, len(self)) + terms[held])
        ends = np.searchsorted(found, np.arange(1, len(texts)) * max(1, len(self)))
        return np.split(found % max(1, len(self)), ends)


@dataclass
class Index:
    """Examples as sparse unit vectors, in blocks, with each term's largest weight there.

    rows, vals: the postings, by term, then example; bounds: where each term's begin."""

    terms: Vocabulary
    weight: np.ndarray
    ids: list
    labels: np.ndarray
    k: int
    shrink: float
    base: float
    none: float
    rows: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    vals: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(0), np.zeros(0)))

    def __post_init__(self):
        self.best = None

    def __getstate__(self):
        return self.__dict__ | {"best": None, "at": None}

    def vector(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weight[found]
        return found, w / max(np.sqrt((w * w).sum()), 1e-300)

    def add(self, vectors: list[tuple[np.ndarray, np.ndarray]]):
        """The examples, in order."""
        rows = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        cols = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        order = np.argsort(cols, kind="stable")
        self.rows, self.vals = rows[order], np.concatenate([np.zeros(0), *(w for _, w in vectors)])[order]
        self.bounds = np.searchsorted(cols[order], np.arange(len(self.terms) + 1))
        self.best = None

    def build(self):
        """best[t, b]: the largest weight of term t in block b; at[t, b]: where its postings
        in block b begin."""
        n, blocks = len(self.terms), (len(self.ids) + BLOCK - 1) // BLOCK
        part = np.repeat(np.arange(n), np.diff(self.bounds)) * blocks + self.rows // BLOCK
        first = np.flatnonzero(np.diff(part, prepend=-1))
        self.best = np.zeros(n * blocks, np.float32)
        if len(first):
            self.best[part[first]] = np.maximum.reduceat(self.vals, first)
        self.best = self.best.reshape(n, blocks)
        self.at = np.searchsorted(part, np.arange(n * blocks + 1)).astype(np.int32)

    def _cosines(self, t: np.ndarray, w: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines, where above 0, of the examples in some blocks (ascending)."""
        n, blocks = len(self.ids), self.best.shape[1]
        if whole := 4 * len(some) > blocks:  # then it is faster to go through all postings
            start, stop, q = self.bounds[t], self.bounds[t + 1], w
        else:
            cell = (t[:, None] * blocks + some).ravel()
            start, stop, q = self.at[cell], self.at[cell + 1], np.repeat(w, len(some))
        i = common.ragged(start, stop - start)
        cos = np.bincount(self.rows[i], self.vals[i] * np.repeat(q, stop - start), n)
        at = np.flatnonzero(cos > 0)
        if whole:
            asked = np.zeros(blocks, bool)
            asked[some] = True
            at = at[asked[at // BLOCK]]
        return at, np.round(cos[at], 12)

    def nearest(self, t: np.ndarray, w: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a cosine above 0."""
        if self.best is None:
            self.build()
        bound = w.astype(np.float32) @ self.best[t] * np.float32(1.0001)  # rounded up
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        at, cos, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        # where the bounds hardly differ none of them will end the search: one wave then
        wave = 4 if len(order) and 3 * bound[order[len(order) // 2]] < bound[order[0]] else len(order)
        while len(order):
            some, order = order[:wave], order[wave:]
            a, c = self._cosines(t, w, np.sort(some))
            at, cos = np.append(at, a[a != without]), np.append(cos, c[a != without])
            if len(at) > self.k:
                near = np.flatnonzero(cos >= np.partition(cos, -self.k)[-self.k])
                near = near[np.lexsort((at[near], -cos[near]))][: self.k]
                at, cos = at[near], cos[near]
            if len(at) == self.k:
                least = cos.min()
            order, wave = order[bound[order] >= least], len(order)
        top = np.lexsort((at, -cos))
        return at[top], np.minimum(cos[top], 1.0)

    def vote(self, at: np.ndarray, cos: np.ndarray) -> float:
        s = cos * cos
        return float(((s * self.labels[at]).sum() + self.shrink * self.base) / (s.sum() + self.shrink))

    def score(self, found: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Probability, places and cosines of the evidence."""
        if len(found) and len(self.steps[0]):
            at, cos = self.nearest(*self.vector(found))
            if len(at):
                x, y = self.steps
                return float(np.interp(self.vote(at, cos), x, y)), at, cos
        return self.none, np.zeros(0, np.int64), np.zeros(0)

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]):
        """Isotonic regression of the labels on leave-one-out votes."""
        votes, ys = [], []
        for i, (t, w) in enumerate(vectors):
            if len(t):
                at, cos = self.nearest(t, w, without=i)
                votes.append(self.vote(at, cos) if len(at) else self.base)
                ys.append(self.labels[i])
        if not votes:
            return
        order = np.argsort(votes, kind="stable")
        groups: list[list[float]] = []  # sum of labels, rows, sum of votes
        for v, y in zip(np.array(votes)[order], np.array(ys)[order], strict=True):
            groups.append([float(y), 1.0, float(v)])
            while len(groups) > 1 and groups[-2][0] / groups[-2][1] >= groups[-1][0] / groups[-1][1]:
                last = groups.pop()
                groups[-1] = [a + b for a, b in zip(groups[-1], last, strict=True)]
        self.steps = np.array([g[2] / g[1] for g in groups]), np.array([g[0] / g[1] for g in groups])


def fold(c: Column) -> Column:
    return F.crc32(c.cast("string")) % 3


def _term_rows(batches):
    """(term, toxic, rows): numbers of sample rows with the term, of this task."""
    toxic, rows = Counter(), Counter()
    for b in common.slices(batches, size=SLICE):
        words, at, text = words_of(b.column("text"))
        stems = [[w, *(w[:n] + "*" for n in BEGINNINGS if len(w) > n)] if len(w) > 1 else [] for w in words.to_pylist()]
        bounds = np.searchsorted(text, np.arange(b.num_rows + 1))
        for i, label in enumerate(b.column("label").to_pylist()):
            often = Counter(stem for w in at[bounds[i] : bounds[i + 1]].tolist() for stem in stems[w])
            found = [f"{stem}#{n}" for stem, c in often.items() for n in LEVELS if c >= n]
            rows.update(found)
            if label:
                toxic.update(found)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(rows)), pa.array([toxic[t] for t in rows], pa.int64()), pa.array(list(rows.values()), pa.int64())], ["term", "toxic", "rows"])


def _frequency_rows(batches, terms: Vocabulary):
    """(term, rows): numbers of rows with each term, of this task; term -1: all."""
    found, every = np.zeros(len(terms), np.int64), 0
    for b in common.slices(batches, size=SLICE):
        every += b.num_rows
        found += np.bincount(np.concatenate([np.zeros(0, np.int64), *terms.read(b.column("text"))]), minlength=len(terms))
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at), pa.int64()), pa.array(np.append(every, found[at]), pa.int64())], ["term", "rows"])


def _example_rows(batches, terms: Vocabulary):
    """(id, label, digest, terms) of each sample row; terms as byte planes."""
    for b in common.slices(batches, size=SLICE):
        found = [common.planes(t) for t in terms.read(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("digest"), pa.array(found, pa.binary())], ["id", "label", "digest", "terms"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 4_000, terms: int = 32_768, k: int = 15, shrink: float = 0.3, least_rows: int = 3, common_share: float = 0.07, chance: float = 16.0, floor: float = 0.02) -> Index:
    """The index of examples.  Its size, and all that comes to the driver, is bounded by
    fit_rows and terms."""
    kind = docs.schema[id_col].dataType
    ids = labels.where(labels[label_col].isin(0, 1) & labels[id_col].isNotNull() & (fold(labels[id_col]) != 1))
    ids = ids.groupBy(labels[id_col].cast(kind).alias("id")).agg(F.max(labels[label_col]).cast("long").alias("label"))
    ids = common.sampled(ids, F.col("id").cast("string"), fit_rows)
    slim = docs.select(docs[id_col].alias("id"), common.text_of(docs, text_col).alias("text"))
    sample = slim.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    # copies of a text are one example, so that a text that is often copied teaches no terms
    sample = common.written(sample.groupBy("text").agg(F.min("id").alias("id"), F.max("label").alias("label")), "toxicity")
    n, toxic = sample.agg(F.count("*"), F.sum("label")).first()
    toxic = toxic or 0
    if not n or toxic in (0, n):
        base = toxic / n if n else 0.0
        return Index(Vocabulary([]), np.zeros(0), [], np.zeros(0), k, shrink, base, base)
    seen = common.spread(sample).mapInArrow(_term_rows, "term string, toxic long, rows long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("rows").alias("rows"))
    t, every, good = F.col("toxic").cast("double"), F.col("rows").cast("double"), float(n - toxic)
    c = every - t
    chi2 = n * (t * (good - c) - c * (toxic - t)) ** 2 / F.greatest(float(toxic) * good * every * (n - every), F.lit(1e-9))
    seen = seen.withColumn("chi2", chi2).where((every >= least_rows) & ((every <= common_share * n) | (F.col("chi2") > chance)))
    seen = sorted(common.largest(seen, "rows", "term", terms).collect(), key=lambda r: r.term)
    known = Vocabulary([r.term for r in seen])
    found = common.spread(slim.select("text")).mapInArrow(lambda it: _frequency_rows(it, known), "term long, rows long")
    found = dict(map(tuple, found.groupBy("term").agg(F.sum("rows")).collect()))
    every, chi2 = (np.array([r[c] for r in seen], float) for c in ("rows", "chi2"))
    idf = np.log((1 + found.get(-1, 0)) / (1 + np.array([found.get(i, 0) for i in range(len(known))], float))) + 1
    weight = idf * np.maximum(floor, np.sqrt(np.maximum(chi2 - chance, 0) / n))
    schema = T.StructType([T.StructField("id", kind)]).add("label", "long").add("digest", "string").add("terms", "binary")
    own = []
    for r in sample.withColumn("digest", F.sha2("text", 256)).mapInArrow(lambda it: _example_rows(it, known), schema).collect():
        at = common.unplanes(bytes(r.terms)).astype(np.int64)
        leader = int(at[np.argmax(every[at])]) if len(at) else -1
        own.append(((leader, len(at), r.digest), r.id, r.label, at))
    own.sort(key=lambda x: x[0])
    without = [x[2] for x in own if not len(x[3])]
    own, base = [x for x in own if len(x[3])], toxic / n
    index = Index(known, weight, [x[1] for x in own], np.array([x[2] for x in own], float), k, shrink, base, sum(without) / len(without) if without else base)
    vectors = [index.vector(x[3]) for x in own]
    index.add(vectors)
    index.calibrate(vectors)
    return index


def score_toxicity(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, neighbours, cosines) of each row; neighbours: ids of the examples."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema[id_col].dataType
    slim = docs.select(docs[id_col].alias(id_col), common.text_of(docs, text_col).alias("__text"))
    schema = T.StructType([common.field(docs, id_col)]).add("score", "double").add("neighbours", T.ArrayType(kind)).add("cosines", T.ArrayType(T.DoubleType()))

    def run(batches):
        index = shared.value
        for b in common.slices(batches, size=SLICE):
            found = [index.score(t) for t in index.terms.read(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s for s, _, _ in found], pa.float64()), pa.array([[index.ids[i] for i in at] for _, at, _ in found], pa.list_(b.schema.field(0).type)), pa.array([c.tolist() for _, _, c in found], pa.list_(pa.float64()))],
                [id_col, "score", "neighbours", "cosines"],
            )

    return common.spread(slim).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, index: Index, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """All columns of the rows that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = shared.value
        for b in common.slices(batches, size=SLICE):
            texts = pc.fill_null(b.column(b.schema.get_field_index(text_col)).cast(pa.string()), "")
            yield b.filter(pa.array([index.score(t)[0] < threshold for t in index.terms.read(texts)], pa.bool_()))

    return common.spread(docs).mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, scored by what labels teach."""
    docs = common.table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "neighbours", "cosines")


def queries() -> dict:
    return {"op6_toxicity": op6_toxicity}
