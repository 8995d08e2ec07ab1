import hashlib

import duckdb
from pyspark.sql import functions as F

from rillflow.llm import warc
from tests.conftest import SF

SCHEMA = "page_id long, url string, html string"
ROWS = [(i, f"http://h/{i}", f"<p>page {i}</p>" * (i % 7)) for i in range(120)] + [(None, None, None), (5, "http://h/5", "<p>page 5</p>" * 5), (5, "http://h/5", "other"), (7, "é", "日本")]


def stored(spark, rows=ROWS, per_file=50):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("digest", F.lit("clash")).withColumn("file", F.lit("clash"))
    return warc.archive(df, per_file=per_file)


def test_files_are_warc_and_offsets_are_right(spark):
    got = stored(spark).collect()
    assert sum(r.copies for r in got) == len(ROWS) and len(got) == len(set(ROWS))
    bodies = []
    for file in {r.file for r in got}:
        own = sorted((r for r in got if r.file == file), key=lambda r: r.offset)
        records = warc.parse_records(b"".join(bytes(r.data) for r in own))
        assert [(r.offset, r.length) for r in own] == [(a, n) for a, n, _, _ in records]
        assert all(hashlib.sha256(bytes(r.data)).hexdigest() == r.digest for r in own)
        bodies += [(h["WARC-Target-URI"], b.decode()) for _, _, h, b in records]
    assert sorted(bodies) == sorted({(u or "", h or "") for _, u, h in ROWS})


def test_audit_finds_what_differs_and_no_more(spark):
    a = stored(spark).select("file", "offset", "data")
    rows = a.collect()
    changed, lost = rows[3], rows[40]
    key = lambda r: (r.file, r.offset)
    b = [(r.file, r.offset, bytes(r.data) + (b"!" if key(r) == key(changed) else b"")) for r in rows if key(r) != key(lost)] + [(0, 10**6, b"new")]
    b = spark.createDataFrame(b, "file long, offset long, data binary")
    found, seen = warc.audit(a, b, range_bytes=512)
    want = {(*key(changed), "changed"), (*key(lost), "lost"), (0, 10**6, "added")}
    assert {tuple(r) for r in found.collect()} == want
    assert seen[0] == 1 and seen[-1] < len(rows) / 2
    found, seen = warc.audit(a, a.repartition(7), range_bytes=512)
    assert found.count() == 0 and seen[0] == 1 and not any(seen[1:])


def test_empty_replicas(spark):
    none = spark.createDataFrame([], "file long, offset long, data binary")
    a = stored(spark).select("file", "offset", "data")
    assert warc.audit(none, none)[0].count() == 0
    assert {r.status for r in warc.audit(a, none)[0].collect()} == {"lost"}
    assert warc.audit(none, a)[0].where("status = 'added'").count() == a.count()
    assert stored(spark, []).count() == 0


def test_tree_is_the_plain_one(spark):
    a = warc.leaves(stored(spark).select("file", "offset", "data"))
    levels = warc.tree(a, warc.shape(a), 512)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    below = {(r.file, r.node): (r.hash, (r.up_file, r.up_node)) for r in levels[0].collect()}
    for level in levels[1:]:
        want: dict = {}
        for (f, n), (h, up) in sorted(below.items()):
            want.setdefault(up, []).append(f"{f}:{n}:{h}")
        rows = level.collect()
        assert {(r.file, r.node): r.hash for r in rows} == {k: sha(",".join(["node", *v])) for k, v in want.items()}
        below = {(r.file, r.node): (r.hash, (r.up_file, r.up_node) if "up_file" in level.columns else None) for r in rows}
    assert len(below) == 1


def test_query_agrees_with_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cols = "page_id, file, offset, length, record_sha256, copies, status"
    want = con.sql(f"SELECT {cols.replace('offset', '"offset"')} FROM ({warc.oracle_sql()['op5_warc_fixity']})").fetchall()
    got = warc.op5_warc_fixity(spark, SF).select(*cols.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
