"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.  DataFrame
functions only.

A paragraph is a line with a word in it; a line of more than ``LONG_LINE`` characters is cut at
its ends of sentences.  Equal paragraphs of a text are one key, the XXH64 of the paragraph and of
how often it stands there.  A sketch has three tables of cells; a key goes to one cell of each, and
a cell holds how many keys it has, their exclusive or, and that of their check hashes.  Sketches of
two versions are subtracted cell by cell; keys of both vanish.  Peeling takes cells of one key, whose
check hash agrees, removes these keys from their other cells, and goes on until all cells are empty:
the keys found are the digests of the paragraphs in which the versions differ.  If cells remain
none of which is of one key, both texts are sketched larger and tried again: first at a size that has
room for all their keys, then at four times that, and so on.

Cells are kept as arrays of the cells in use, in order, so that a sketch of a short text is short
at any size and a round of peeling costs what is left.

The next document is found by ids alone: ids and digests of texts are sorted by ranges, each range
has its windows, and the last of the range before is carried over.  A text meets its successor by
two equi-joins; of the successor only as many characters move as the edit takes.

Cases: a null text counts as empty: no paragraphs, an empty sketch; two texts without paragraphs
are alike (1); null ids come first; rows of equal ids go by the SHA-256 of their texts; repeated
rows are kept, one result each, each the next of the one before; a single row is its own next;
other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Characters from which on a line is cut at ends of sentences.
LONG_LINE = 160
#: Cells of each of the three tables of the first sketch; of the second for each key of both texts;
#: how often larger ones are tried, each time at GROWTH times the size.
CELLS, ROOM, TRIES, GROWTH = 16, 8, 16, 4
#: Rounds of peeling in which a sketch that can be peeled is empty, with room to spare.
ROUNDS = 48

CELL = "struct<cell:bigint,n:int,keys:bigint,checks:bigint>"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def paragraphs(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.when(F.char_length(x) > LONG_LINE, F.split(x, r"(?<=[.!?])\x20+", -1)).otherwise(F.array(x)))
    return F.filter(F.flatten(lines), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")


def digests(text: Column) -> Column:
    """The distinct keys of a text's paragraphs."""

    def runs(hashes: Column) -> Column:
        several = lambda at: F.transform(at, lambda i, j: F.xxhash64(F.get(hashes, i), F.coalesce(F.get(at, j + 1), F.size(hashes)) - i))
        return let(changes(hashes, lambda x, y: x != y), several)

    return F.array_distinct(let(F.sort_array(F.transform(paragraphs(text), lambda p: F.xxhash64(p))), runs))


def check(key: Column) -> Column:
    return F.xxhash64(F.lit("check"), key)


def cell(n: Column, at: Column, keys: Column, checks: Column) -> Column:
    return F.struct(at.cast("long").alias("cell"), n.cast("int").alias("n"), keys.alias("keys"), checks.alias("checks"))


def places(key: Column, size: Column) -> Column:
    """The cells of a key, one in each table, from three parts of one hash."""
    return let(F.xxhash64(key), lambda h: F.array(F.pmod(h, size), size + F.pmod(F.shiftrightunsigned(h, 20), size), size * 2 + F.pmod(F.shiftrightunsigned(h, 40), size)))


def xor(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(of(x)))


def changes(values: Column, by: Callable[[Column, Column], Column]) -> Column:
    """The places at which a run of equal values begins."""
    return F.filter(F.transform(values, lambda x, i: F.when((i == 0) | by(x, F.get(values, i - 1)), i)), lambda i: i.isNotNull())


def sketch(keys: Column, size: Column, first: Column | None = None) -> Column:
    """The cells in use of a sketch of three tables of so many cells, in order.  first: only so many of the
    keys are added, the others are subtracted."""
    size, low = size.cast("long"), F.lit(0xFFFFFFFF)
    one = F.lit(1) if first is None else None
    sign = lambda e: one if first is None else F.when(e < first, 1).otherwise(-1)
    at = lambda x: x.bitwiseAND(low).cast("int")

    def made(keys: Column, checks: Column, codes: Column) -> Column:
        alone = lambda x: let(at(x), lambda e: cell(sign(e), F.shiftright(x, 32), F.get(keys, e), F.get(checks, e)))
        several = lambda x, run: cell(F.size(run) if first is None else F.aggregate(run, F.lit(0), lambda s, y: s + sign(at(y))), F.shiftright(x, 32), xor(run, lambda y: F.get(keys, at(y))), xor(run, lambda y: F.get(checks, at(y))))
        run_of = lambda begins, i, j: F.coalesce(F.get(begins, j + 1), F.size(codes)) - i
        each = lambda begins: F.transform(begins, lambda i, j: let(run_of(begins, i, j), lambda n: let(F.get(codes, i), lambda x: F.when(n == 1, alone(x)).otherwise(let(F.slice(codes, i + 1, n), lambda run: several(x, run))))))
        return let(changes(codes, lambda a, b: F.shiftright(a, 32) != F.shiftright(b, 32)), each)

    coded = lambda keys: F.sort_array(F.flatten(F.transform(keys, lambda k, i: F.transform(places(k, size), lambda p: F.shiftleft(p, 32).bitwiseOR(i.cast("long"))))))
    cells = let(keys, lambda k: let(F.transform(k, check), lambda checks: let(coded(k), lambda codes: made(k, checks, codes))))
    return cells if first is None else F.filter(cells, used)


def used(x: Column) -> Column:
    return (x["n"] != 0) | (x["keys"] != 0) | (x["checks"] != 0)


def folded(cells: Column) -> Column:
    """Cells of one place added up, in order, empty ones left out."""
    none = cell(F.lit(0), F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def runs(c: Column) -> Column:
        add = lambda a, b: cell(a["n"] + b["n"], b["cell"], a["keys"].bitwiseXOR(b["keys"]), a["checks"].bitwiseXOR(b["checks"]))
        total = lambda at: F.transform(at, lambda i, j: F.aggregate(F.slice(c, i + 1, F.coalesce(F.get(at, j + 1), F.size(c)) - i), none, add))
        return F.filter(let(changes(c, lambda a, b: a["cell"] != b["cell"]), total), used)

    return let(F.sort_array(cells), runs)


def subtract(a: Column, b: Column) -> Column:
    return folded(F.concat(a, F.transform(b, lambda x: cell(-x["n"], x["cell"], x["keys"], x["checks"]))))


def peel(cells: Column, size: Column) -> Column:
    """(cells, found, stuck): what is left, and (key, n) of the keys recovered, n being 1 where the
    first version has it and -1 where the second has."""
    nothing = F.array().cast("array<struct<key:bigint,n:int>>")
    state = F.struct(cells.cast(f"array<{CELL}>").alias("cells"), nothing.alias("found"), F.lit(False).alias("stuck"))

    def all_found(cells: Column, p: Column) -> Column:
        """Whether the keys found are all that the first table holds, by number, keys and checks."""
        table = F.filter(cells, lambda x: x["cell"] < size)
        total = lambda v, f: F.aggregate(v, F.lit(0), lambda t, x: t + f(x))
        return let(table, lambda t: (total(t, lambda x: x["n"]) == total(p, lambda x: x["n"])) & (xor(t, lambda x: x["keys"]) == xor(p, lambda x: x["key"])) & (xor(t, lambda x: x["checks"]) == xor(p, lambda x: check(x["key"]))))

    def round_(s: Column, _: Column) -> Column:
        alone = F.filter(s["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["checks"] == check(x["keys"])))
        of = lambda v, n: F.transform(F.array_distinct(F.transform(F.filter(v, lambda x: x["n"] == n), lambda x: x["keys"])), lambda k: F.struct(k.alias("key"), F.lit(n).alias("n")))
        pure = let(alone, lambda v: F.concat(of(v, 1), of(v, -1)))
        taken = lambda p: F.flatten(F.transform(p, lambda x: let(check(x["key"]), lambda ch: F.transform(places(x["key"], size.cast("long")), lambda at: cell(-x["n"], at, x["key"], ch)))))
        rest = lambda p: F.when(F.size(p) == 0, s["cells"]).when(all_found(s["cells"], p), F.array().cast(f"array<{CELL}>")).otherwise(folded(F.concat(s["cells"], taken(p))))
        step = lambda p: F.struct(rest(p).alias("cells"), F.concat(s["found"], p).alias("found"), (F.size(p) == 0).alias("stuck"))
        return F.when(s["stuck"] | (F.size(s["cells"]) == 0), s).otherwise(let(pure, step))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, round_)


def difference(a: Column, b: Column, first: Column | None = None) -> Column:
    """(found, size) of two arrays of keys: the keys in which they differ, as ``peel`` has them, by
    the smallest sketches that can be peeled.  first: what subtracting the smallest has given."""
    nothing = F.array().cast("array<struct<key:bigint,n:int>>")
    state = F.struct(F.lit(CELLS).cast("long").alias("size"), nothing.alias("found"), F.lit(False).alias("done"))
    larger = lambda i, size: F.when(i == 0, F.greatest(F.lit(CELLS * GROWTH), ROOM * (F.size(a) + F.size(b))).cast("long")).otherwise(size * GROWTH)

    def attempt(s: Column, i: Column) -> Column:
        made = sketch(F.concat(a, b), s["size"], F.size(a))  # the first version's sketch less the second's
        cells = made if first is None else F.when(i == 0, first).otherwise(made)
        told = lambda p: F.struct(F.when(F.size(p["cells"]) == 0, s["size"]).otherwise(larger(i, s["size"])).alias("size"), F.when(F.size(p["cells"]) == 0, p["found"]).otherwise(nothing).alias("found"), (F.size(p["cells"]) == 0).alias("done"))
        return F.when(s["done"], s).otherwise(let(peel(cells, s["size"]), told))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), state, attempt)
    return let(out, lambda s: F.when(s["done"], s).otherwise(F.raise_error(F.lit("sketches of the greatest size can't be peeled"))))


def likeness(a: Column, b: Column, found: Column) -> Column:
    """Keys of both over keys of either, by the numbers of keys and the keys in which they differ."""
    gone = F.size(F.filter(found, lambda x: x["n"] > 0))
    both = F.size(a) - gone
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(b) + gone))


def as_text(cells: Column) -> Column:
    """A fingerprint's string: the cells in use in hexadecimal, 2 digits of place, 8 of count, 16 of
    keys and 16 of checks each."""
    hexed = lambda x, digits: F.lpad(F.lower(F.hex(x)), digits, "0")
    return F.array_join(F.transform(cells, lambda x: F.concat(hexed(x["cell"], 2), hexed(x["n"], 8), hexed(x["keys"], 16), hexed(x["checks"], 16))), "")


# The next document


def successors(rows: DataFrame) -> DataFrame:
    """Distinct rows (id, digest, n_chars, ..) with the id, digest and n_chars of the one before,
    in a circle."""
    sides = ("id", "digest", "n_chars")
    keys = [F.col("id").asc_nulls_first(), F.col("digest")]
    dealt = rows.repartitionByRange(common.partitions_for(rows), *keys).withColumn("range", F.spark_partition_id())
    dealt = common.written(dealt, "order")
    # of each range that has rows, the last row is the one before the next range's first: one row a range
    last = F.max_by(F.struct(*sides), F.struct(F.col("id").isNotNull(), "id", "digest")).alias("last")
    by_range = Window.orderBy("range")
    circle = F.last("last").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = dealt.groupBy("range").agg(last).select("range", F.coalesce(F.lag("last").over(by_range), circle).alias("before"))
    w = Window.partitionBy("range").orderBy(*keys)
    dealt = dealt.withColumn("__b", F.lag(F.struct(*sides)).over(w)).join(F.broadcast(near), "range")
    before = F.coalesce("__b", "before")
    return dealt.select(*rows.columns, before["id"].alias("prev_id"), before["digest"].alias("prev_digest"), before["n_chars"].alias("prev_chars"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digests, fingerprint) of each row."""
    rows = docs.select(docs[id_col].alias(id_col), digests(common.text_of(docs, text_col)).alias("digests"))
    return rows.withColumn("fingerprint", as_text(sketch(F.col("digests"), F.lit(CELLS))))


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text, its edited text (the second half replaced by the beginning of the next
    document) and the next document, compared by their sketches: (id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, edited_found, next_found); found: digests by which
    they differ, n 1 where the text has it and -1 where the other does."""
    rows = docs.select(docs[id_col].alias("id"), common.text_of(docs, text_col).alias("text")).withColumn("digest", F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")))  # never null: no filter computes it again
    order = successors(rows.groupBy("id", "digest").agg(F.count("*").alias("n"), F.max(F.char_length("text")).cast("long").alias("n_chars")))
    # one column that is never null tells rows apart: its joins keep the partitioning of the texts
    row = lambda i, d: F.concat(d, F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("")).cast("binary"))
    texts = rows.select(row(F.col("id"), F.col("digest")).alias("row"), "text").dropDuplicates(["row"])
    order = order.select(row(F.col("id"), F.col("digest")).alias("row"), "id", "n", "n_chars", row(F.col("prev_id"), F.col("prev_digest")).alias("prev"), "prev_chars")
    own = texts.join(order, "row")
    cut = lambda n: F.expr(f"cast({n} div 2 AS int)")
    sent = own.select(F.col("prev").alias("row"), F.substring("text", F.lit(1), cut("prev_chars")).alias("begin"), digests(F.col("text")).alias("next"))
    met = own.join(sent, "row").withColumn("mine", digests(F.col("text")))
    # a repeated row's next is its copy, but for the last copy's
    copy = F.struct(F.col("n_chars"), F.substring("text", F.lit(1), cut("n_chars")).alias("begin"), F.col("mine").alias("next"))
    other = F.struct(F.col("n_chars"), F.col("begin"), F.col("next"))
    met = met.select("id", "text", "n", "mine", F.explode(F.when(F.col("n") > 1, F.array(F.struct(copy.alias("to"), (F.col("n") - 1).alias("times")), F.struct(other.alias("to"), F.lit(1).cast("long").alias("times")))).otherwise(F.array(F.struct(other.alias("to"), F.lit(1).cast("long").alias("times"))))).alias("x"))
    met = met.select("id", "mine", "x.times", "x.to.n_chars", "x.to.next", F.concat(F.substring("text", F.lit(1), F.expr("cast(x.to.n_chars - x.to.n_chars div 2 AS int)")), F.col("x.to.begin")).alias("edited"))
    met = met.select("id", "times", "n_chars", "mine", "next", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("edited")).alias("changed"))
    size = F.lit(CELLS)
    met = met.withColumns({"a": sketch(F.col("mine"), size), "b": sketch(F.col("changed"), size), "c": sketch(F.col("next"), size)})
    met = met.withColumns({"to_edited": difference(F.col("mine"), F.col("changed"), subtract(F.col("a"), F.col("b"))), "to_next": difference(F.col("mine"), F.col("next"), subtract(F.col("a"), F.col("c")))})
    out = met.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("mine"), F.col("changed"), F.col("to_edited.found")).alias("near_edited"), likeness(F.col("mine"), F.col("next"), F.col("to_next.found")).alias("near_next"),
        F.col("to_edited.found").alias("edited_found"), F.col("to_next.found").alias("next_found"), "times",
    )
    return out.withColumn("times", F.explode(F.expr("sequence(1, times)"))).drop("times")


def op11_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of documents, and how near they come to an edit and to the next."""
    return edits(common.table(spark, sf_dir, "documents")).drop("edited_found", "next_found")


def queries() -> dict:
    return {"op11_sketches": op11_sketches}
