"""WARC archives and their fixity: Merkle trees over records and ordered offset ranges.

``archive`` lays pages out as WARC/1.0 resource records in files of fixed id ranges; within
a file records stand by section (the first two hex digits of their digest), id and digest,
so that a file of any size is laid out in sections side by side.  Equal records of an id
are stored once, with their number.

``tree`` hashes records (leaves), then the leaves of each offset range in order, then 16
ranges at a time up to the file, then 16 files at a time up to the root: every hash covers a
bounded number of hashes, and a level is a shuffle of the level below.  ``audit`` compares
two replicas from the roots down: at each level only children of nodes that differ are
looked at, and at the bottom the records that were changed, lost or added are named.

Cases: null html is an empty body, a null url an empty target, a null id goes to file -1;
repeated rows are one record with a count; an empty replica has no root, so that all
records of the other are lost or added; two empty ones agree; records of length 0 count;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PER_FILE, RANGE, FAN = 1024, 1 << 16, 4  # ids in a file, bytes in a range, log2 of the fan-out
HEAD = ("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:page:", ">\r\nWARC-Target-URI: ", "\r\nContent-Type: text/html\r\nContent-Length: ", "\r\n\r\n", "\r\n\r\n")


def record_of(page: Column, url: Column, html: Column) -> Column:
    """A WARC record as bytes."""
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [F.lit(HEAD[0]), s(page), F.lit(HEAD[1]), s(url), F.lit(HEAD[2]), F.octet_length(s(html)).cast("string"), F.lit(HEAD[3]), s(html), F.lit(HEAD[4])]
    return F.concat(*parts).cast("binary")


def parse_records(data: bytes) -> list[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, body) of each record of a WARC file."""
    out, at = [], 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:cut].decode().split("\r\n")
        if version != "WARC/1.0":
            raise ValueError(f"no WARC record at {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        end = cut + 4 + int(headers["Content-Length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} has no end")
        out.append((at, end + 4 - at, headers, data[cut + 4 : end]))
        at = end + 4
    return out


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_file: int = PER_FILE) -> DataFrame:
    """(id, file, offset, length, digest, copies, data) of each stored record; written once."""
    rows = pages.select(pages[id_col].alias("id"), record_of(pages[id_col], pages[url_col], pages[html_col]).alias("data"))
    file = F.coalesce(F.floor(F.col("id") / per_file).cast("long"), F.lit(-1))
    rows = rows.select("id", file.alias("file"), F.octet_length("data").cast("long").alias("length"), F.sha2("data", 256).alias("digest"), "data").withColumn("section", F.substring("digest", 1, 2))
    layout = rows.groupBy("file", "section", "id", "digest", "length").agg(F.count("*").alias("copies"))
    # offsets: a running sum within each section, and one of the (at most 256) sections
    within = "sum(length) OVER (PARTITION BY file, section ORDER BY id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length"
    base = layout.groupBy("file", "section").agg(F.sum("length").alias("total"))
    base = base.select("file", "section", F.expr("sum(total) OVER (PARTITION BY file ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - total AS base"))
    layout = layout.withColumn("within", F.expr(within)).join(base, ["file", "section"])
    layout = layout.select("file", "digest", (F.col("base") + F.col("within")).alias("offset"), "copies")
    # a record names its id, so that its digest does: copies go before the only shuffle of data
    once = rows.groupBy("file", "digest").agg(F.first("id").alias("id"), F.first("length").alias("length"), F.first("data").alias("data"))
    return common.written(once.join(layout, ["file", "digest"]).select("id", "file", "offset", "length", "digest", "copies", "data"), "warc")


def leaves(replica: DataFrame) -> DataFrame:
    """(file, node, hash) of each record of a replica (file, offset, data); node: the offset."""
    leaf = F.sha2(F.concat(F.lit("leaf:").cast("binary"), F.coalesce("data", F.lit("").cast("binary"))), 256)
    return common.written(replica.select(F.col("file").cast("long").alias("file"), F.col("offset").cast("long").alias("node"), leaf.alias("hash")), "merkle")


def shape(*replicas: DataFrame) -> tuple[int, int]:
    """Largest offset and file number of the leaves of replicas that are to be compared."""
    tops = reduce(DataFrame.unionByName, [r.select("file", "node") for r in replicas]).agg(F.max("node"), F.max(F.abs("file"))).first()
    return tops[0] or 0, tops[1] or 0


def tree(bottom: DataFrame, tops: tuple[int, int], range_bytes: int = RANGE) -> list[DataFrame]:
    """Levels of a tree, leaves first, root last: (file, node, hash, up_file, up_node), the
    last two naming the parent.  tops: what the offsets and files of all trees to be compared
    don't exceed, so that these are of one height."""
    ranges, files = tops[0] // range_bytes, tops[1]
    steps = [(F.col("file"), F.floor(F.col("node") / range_bytes))]
    while ranges:
        steps.append((F.col("file"), F.shiftright("node", FAN)))
        ranges >>= FAN
    while files:  # an arithmetic shift: file -1 stays beside 0, and meets it at the root
        steps.append((F.shiftright("file", FAN), F.lit(0)))
        files >>= FAN
    steps.append((F.lit(0), F.lit(0)))
    levels, at = [], bottom
    for up_file, up_node in steps:
        at = at.withColumns({"up_file": up_file.cast("long"), "up_node": up_node.cast("long")})
        levels.append(at)
        kids = F.transform(F.array_sort(F.collect_list(F.struct("file", "node", "hash"))), lambda k: F.concat_ws(":", k["file"], k["node"], k["hash"]))
        at = common.written(at.groupBy("up_file", "up_node").agg(F.sha2(F.concat_ws(",", F.lit("node"), kids), 256).alias("hash")).select(F.col("up_file").alias("file"), F.col("up_node").alias("node"), "hash"), "merkle")
    return [*levels, at]


def audit(a: DataFrame, b: DataFrame, range_bytes: int = RANGE) -> tuple[DataFrame, list[int]]:
    """(file, offset, status) of the records that replicas a and b don't share, and how many
    nodes of each level were compared, root first.  status: changed, lost (only in a) or
    added (only in b)."""
    la, lb = leaves(a), leaves(b)
    tops = shape(la, lb)
    ta, tb = tree(la, tops, range_bytes), tree(lb, tops, range_bytes)
    seen, bad = [], None
    for x, y in zip(reversed(ta), reversed(tb), strict=True):
        if bad is not None:
            x, y = (t.join(bad, (t["up_file"] == bad["f"]) & (t["up_node"] == bad["n"]), "left_semi") for t in (x, y))
        both = x.select("file", "node", F.col("hash").alias("x")).join(y.select("file", "node", F.col("hash").alias("y")), ["file", "node"], "full")
        status = F.when(F.col("y").isNull(), "lost").when(F.col("x").isNull(), "added").when(F.col("x") != F.col("y"), "changed")
        found = common.checkpointed(both.select("file", "node", status.alias("status")))
        seen.append(found.count())
        bad = found.where("status IS NOT NULL").select(F.col("file").alias("f"), F.col("node").alias("n"))
    return found.where("status IS NOT NULL").select("file", F.col("node").alias("offset"), "status"), seen


def with_faults(replica: DataFrame) -> DataFrame:
    """A replica with bytes changed and records lost at places that offsets decide: what an
    audit has to find in the query."""
    place = F.col("offset") + F.col("file")
    flipped = F.concat(F.expr("substring(data, 1, octet_length(data) - 1)"), F.lit("?").cast("binary"))
    return replica.where(place % 389 != 7).select("file", "offset", F.when(place % 97 == 13, flipped).otherwise(F.col("data")).alias("data"))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as an archive, audited against a replica with faults: each record, and what
    the audit says of it."""
    stored = archive(common.table(spark, sf_dir, "pages"))
    found, _ = audit(stored.select("file", "offset", "data"), with_faults(stored.select("file", "offset", "data")))
    out = stored.select("id", "file", "offset", "length", "digest", "copies").join(found, ["file", "offset"], "left")
    return out.select(F.col("id").alias("page_id"), "file", "offset", "length", F.col("digest").alias("record_sha256"), "copies", F.coalesce("status", F.lit("same")).alias("status"))


def queries() -> dict:
    return {"op5_warc_fixity": op5_warc_fixity}


def oracle_sql() -> dict:
    eol = "chr(13) || chr(10)"
    head = " || ".join(f"'{x}'" if x else eol for part in ["WARC/1.0", "", "WARC-Type: resource", "", "WARC-Date: 1970-01-01T00:00:00Z", "", "WARC-Record-ID: <urn:page:"] for x in [part])
    record = f"{head} || coalesce(page_id::VARCHAR, '') || '>' || {eol} || 'WARC-Target-URI: ' || coalesce(url, '') || {eol} || 'Content-Type: text/html' || {eol} || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR || {eol} || {eol} || coalesce(html, '') || {eol} || {eol}"
    return {
        "op5_warc_fixity": f"""
WITH r AS (SELECT page_id, coalesce(floor(page_id / {PER_FILE})::BIGINT, -1) AS file, {record} AS record FROM pages),
d AS (SELECT page_id, file, strlen(record)::BIGINT AS length, sha256(record) AS record_sha256, count(*)::BIGINT AS copies FROM r GROUP BY 1, 2, 3, 4),
o AS (SELECT *, (sum(length) OVER (PARTITION BY file ORDER BY substr(record_sha256, 1, 2), page_id, record_sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length)::BIGINT AS "offset" FROM d)
SELECT page_id, file, "offset", length, record_sha256, copies,
  CASE WHEN ("offset" + file) % 389 = 7 THEN 'lost' WHEN ("offset" + file) % 97 = 13 THEN 'changed' ELSE 'same' END AS status FROM o"""
    }
