"""Grids and river networks as edge tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Eight neighbours of a pixel as (row step, column step), by direction code of powers of two.
D8 = {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1), 64: (-1, 0), 128: (-1, 1)}
FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; only a local session without one gets a
    folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rillflow-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder.  For loops of many rounds: a checkpoint hands on sizes and
    constraints as the optimizer has inferred them, which grow with each round; a table has its own."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def neighbours(pixels: DataFrame, keys: Sequence[str], cols: Sequence[str], steps: Sequence[tuple[int, int]] = FOUR, i: str = "i", j: str = "j", legacy_edges: bool = False) -> DataFrame:
    """Ordered pairs of neighbouring pixels: columns a_* and b_*.

    legacy_edges: row 0 and column 0 are never the neighbour of row 1 and column 1."""
    every = [*keys, i, j, *cols]
    shift = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in steps]))
    a = pixels.select(*[F.col(c).alias(f"a_{c}") for c in every], shift.alias("__s"))
    a = a.withColumns({"__i": F.col(f"a_{i}") + F.col("__s.x"), "__j": F.col(f"a_{j}") + F.col("__s.y")}).drop("__s")
    b = pixels.select(*[F.col(c).alias(f"b_{c}") for c in every])
    on = (F.col("__i") == F.col(f"b_{i}")) & (F.col("__j") == F.col(f"b_{j}"))
    for k in keys:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    met = a.join(b, on).drop("__i", "__j")
    if legacy_edges:
        up, left = F.col(f"b_{i}") < F.col(f"a_{i}"), F.col(f"b_{j}") < F.col(f"a_{j}")
        met = met.where(~(up & (F.col(f"b_{i}") == 0)) & ~(left & (F.col(f"b_{j}") == 0)))
    return met


def connected(h1: Column, h2: Column, b1: Column, b2: Column, t1: Column, t2: Column, intervalley: bool = True, interridge: bool = False, intraband: bool = False) -> Column:
    """Whether two neighbouring units (unit, basin, tile position) share an edge."""
    valley = (t1 == 0) & (t2 == 0) & (b1 != b2) & F.lit(intervalley)
    ridge = (b1 != b2) & ~F.lit(interridge)
    band = (F.abs(t1 - t2) != 1) & ~F.lit(intraband)
    return h1.isNotNull() & h2.isNotNull() & ((h1 == h2) | valley | (~ridge & ~band))


def adjacency(pixels: DataFrame, keys: Sequence[str], unit: str, when: Column | None = None, cols: Sequence[str] = (), edge_length: float = 1.0, diagonal: bool = False, **how) -> DataFrame:
    """(keys, src, dst, w): how much of the border of two units is shared, in lengths of a
    pixel's edge.  ``when``: a condition on a_* and b_* columns."""
    met = neighbours(pixels.where(F.col(unit).isNotNull()), keys, [unit, *cols], **how)
    if when is not None:
        met = met.where(when)
    if not diagonal:
        met = met.where(F.col(f"a_{unit}") != F.col(f"b_{unit}"))
    return met.groupBy(*[F.col(f"a_{k}").alias(k) for k in keys], F.col(f"a_{unit}").alias("src"), F.col(f"b_{unit}").alias("dst")).agg((F.count("*") * edge_length).alias("w"))


def sum_duplicates(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A sparse matrix's entries, those of one place added up."""
    return edges.groupBy(*keys, "src", "dst").agg(F.sum("w").alias("w"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "__t"}).withColumnRenamed("dst", "src").withColumnRenamed("__t", "dst")


def receivers(pixels: DataFrame, keys: Sequence[str], fdir: str, i: str = "i", j: str = "j") -> DataFrame:
    """D8 codes to the row and column that a pixel drains to (null: none)."""
    pick = lambda k: F.coalesce(*[F.when(F.col(fdir) == code, F.lit(s[k])) for code, s in D8.items()])
    return pixels.withColumns({"to_i": F.col(i) + pick(0), "to_j": F.col(j) + pick(1)})


def slope_aspect(pixels: DataFrame, keys: Sequence[str], z: str, size: float, i: str = "i", j: str = "j") -> DataFrame:
    """Slope and aspect by the 3 x 3 stencil of third-order differences (Horn); a missing
    neighbour takes the centre's height."""
    steps = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]
    met = neighbours(pixels.where(F.col(z).isNotNull()), keys, [z], steps, i, j)
    dx, dy, w = F.col(f"b_{j}") - F.col(f"a_{j}"), F.col(f"b_{i}") - F.col(f"a_{i}"), 3 - F.abs(F.col(f"b_{j}") - F.col(f"a_{j}")) - F.abs(F.col(f"b_{i}") - F.col(f"a_{i}"))
    rise = (F.col(f"b_{z}") - F.col(f"a_{z}")) * w
    g = met.groupBy(*[F.col(f"a_{k}").alias(k) for k in keys], F.col(f"a_{i}").alias(i), F.col(f"a_{j}").alias(j)).agg((F.sum(rise * dx) / (8 * size)).alias("gx"), (F.sum(rise * dy) / (8 * size)).alias("gy"))
    return g.withColumns({"slope": F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), "aspect": F.atan2(-F.col("gy"), -F.col("gx"))}).drop("gx", "gy")


def terminals(nodes: DataFrame, node: str, down: str, length: str | None = None, rounds: int = 64) -> DataFrame:
    """(node, terminal, length): the end of each node's way down and how long it is, by
    pointer jumping: a round doubles the way looked at, so that a way of a million steps
    takes twenty joins.  A node that drains nowhere (null) is its own terminal; a node in a
    cycle raises."""
    step = F.col(length).cast("double") if length else F.lit(1.0)
    at = nodes.select(F.col(node).alias("node"), F.coalesce(F.col(down), F.col(node)).alias("to"), F.when(F.col(down).isNotNull(), step).otherwise(0.0).alias("length"), F.col(down).isNull().alias("end"))
    # there: the way ends at ``to`` (a node that isn't in the table ends it too).  Who is there stays
    # out of the joins, in which all of a basin would meet at its end
    ends = at.select(F.col("node").alias("to"), F.col("end").alias("__end"))
    at = settled(at.drop("end").join(ends, "to", "left").select("node", "to", "length", F.coalesce("__end", F.lit(True)).alias("there")))
    for _ in range(rounds):
        going = at.where(~F.col("there"))
        if going.isEmpty():
            return at.select(F.col("node").alias(node), F.col("to").alias("terminal"), "length")
        ahead = at.select(F.col("node").alias("to"), F.col("to").alias("__to"), F.col("length").alias("__l"), F.col("there").alias("__there"))
        going = going.drop("there").join(ahead, "to").select("node", F.col("__to").alias("to"), (F.col("length") + F.col("__l")).alias("length"), F.col("__there").alias("there"))
        at = settled(at.where("there").unionByName(going))
    raise ValueError(f"a way of over 2 ** {rounds} steps: the network has a cycle")


def levels(nodes: DataFrame, node: str, down: str) -> DataFrame:
    """(root, node, level): how many steps each node is from the end of its way, by pointer jumping.

    A round doubles the way looked at, in joins of the nodes still on their way, so that nothing but counts
    passes the driver, however wide a level is.  Roots drain nowhere (null).  A node whose way leaves the table or
    runs into a cycle has no row: those are still on their way after as many rounds as the table's size has bits."""
    at = settled(nodes.select(F.col(node).alias("node"), F.coalesce(F.col(down), F.col(node)).alias("to"), F.when(F.col(down).isNull(), 0).otherwise(1).cast("long").alias("level"), F.col(down).isNull().alias("there")))
    for _ in range(at.count().bit_length() + 1):
        going = at.where(~F.col("there"))
        if going.isEmpty():
            break
        ahead = at.select(F.col("node").alias("to"), F.col("to").alias("__to"), F.col("level").alias("__l"), F.col("there").alias("__there")).hint("merge")
        going = going.drop("there").join(ahead, "to").select("node", F.col("__to").alias("to"), (F.col("level") + F.col("__l")).alias("level"), F.col("__there").alias("there"))
        at = settled(at.where("there").unionByName(going))
    return at.where("there").select(F.col("to").alias("root"), "node", "level")


def height_above(nodes: DataFrame, found: DataFrame, node: str, height: str, name: str = "hand") -> DataFrame:
    """Height above the terminal (the nearest drainage on the way)."""
    base = nodes.select(F.col(node).alias("terminal"), F.col(height).alias("__base"))
    own = nodes.select(node, height)
    return found.join(own, node).join(base, "terminal").withColumn(name, F.col(height) - F.col("__base")).drop("__base", height)


def upstream(nodes: DataFrame, node: str, down: str, roots: DataFrame | None = None, levels: int = 100, order: Sequence[str] = ()) -> DataFrame:
    """(root, node, level, path): all that drains to each root, by a recursive query; path
    sorts depth-first, by the node's place among the order columns' values.  Ways of over
    ``levels`` steps raise; ``terminals`` and ``levels`` have no such limit.  The rows aren't limited,
    but Spark may send a level's rows through the driver: for shallow trees of bounded width."""
    spark = nodes.sparkSession
    rows = nodes.select(F.col(node).alias("node"), F.col(down).alias("down"), F.format_string("%020d", F.col(node)).alias("mark"))
    names = [f"__rf_{x}_{uuid.uuid4().hex}" for x in ("nodes", "roots")]
    rows.createOrReplaceTempView(names[0])
    (roots.select(F.col(node).alias("node")) if roots is not None else rows.where("down IS NULL").select("node")).createOrReplaceTempView(names[1])
    limits = {"spark.sql.cteRecursionLevelLimit": str(levels), "spark.sql.cteRecursionRowLimit": "-1"}
    was = {name: spark.conf.get(name) for name in limits}
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        out = spark.sql(
            "WITH RECURSIVE up(root, node, level, path) AS ("
            f" SELECT r.node, r.node, 0, n.mark FROM {names[1]} r JOIN {names[0]} n ON n.node = r.node"
            f" UNION ALL SELECT u.root, n.node, u.level + 1, concat(u.path, '/', n.mark) FROM up u JOIN {names[0]} n ON n.down = u.node)"
            " SELECT * FROM up"
        )
        return settled(out)
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)
        for name in names:
            spark.catalog.dropTempView(name)


def foreign_reach(found: DataFrame, time: str, most_reaches: int, most_time: float) -> DataFrame:
    """Ways upstream as far as both limits allow: a row goes on while it is below one."""
    return found.where((F.col("level") <= most_reaches) | (F.col(time) <= most_time))


def upstream_ids(reaches: DataFrame, reach: str, down: str, most: int = 3, pad: int = -9999) -> DataFrame:
    """(reach, upstream): at most so many ids, padded; more raise."""
    ups = reaches.where(F.col(down).isNotNull()).groupBy(F.col(down).alias("__r")).agg(F.array_sort(F.collect_list(reach)).alias("__u"))
    u = F.coalesce(F.col("__u"), F.array().cast("array<long>"))
    ok = F.when(F.size(u) > most, F.raise_error(F.concat(F.lit("too many reaches drain to "), F.col(reach).cast("string"))).cast("array<long>"))
    return reaches.join(ups, F.col(reach) == F.col("__r"), "left").select(reach, F.coalesce(ok, F.concat(u.cast("array<long>"), F.array_repeat(F.lit(pad).cast("long"), most - F.size(u)))).alias("upstream"))


def exchanges(links: DataFrame, from_cid: str, to_cid: str) -> DataFrame:
    """(cid, sends_to, receives_from): who exchanges with whom across catchments."""
    e = links.where(F.col(from_cid) != F.col(to_cid)).select(F.col(from_cid).alias("a"), F.col(to_cid).alias("b")).distinct()
    out = e.groupBy(F.col("a").alias("cid")).agg(F.array_sort(F.collect_list("b")).alias("sends_to"))
    into = e.groupBy(F.col("b").alias("cid")).agg(F.array_sort(F.collect_list("a")).alias("receives_from"))
    return out.join(into, "cid", "full")


def inlets_outlets(pixels: DataFrame, keys: Sequence[str], cid: str, fdir: str, i: str = "i", j: str = "j") -> DataFrame:
    """Pixels that drain into another catchment, with the pixel that takes it."""
    r = receivers(pixels, keys, fdir, i, j).select(*keys, F.col(cid).alias("from_cid"), F.col(i).alias("from_i"), F.col(j).alias("from_j"), "to_i", "to_j")
    t = pixels.select(*keys, F.col(cid).alias("to_cid"), F.col(i).alias("to_i"), F.col(j).alias("to_j"))
    return r.join(t, [*keys, "to_i", "to_j"]).where(F.col("from_cid") != F.col("to_cid"))


def channels(pixels: DataFrame, keys: Sequence[str], pid: str, down: str, area: str, threshold: float) -> DataFrame:
    """Channel pixels with the pixel they drain to and whether a reach begins there: at a
    head or a confluence."""
    c = pixels.where(F.col(area) > threshold).select(*keys, pid, down, area)
    ups = c.where(F.col(down).isNotNull()).groupBy(F.col(down).alias("__p")).agg(F.count("*").alias("__n"))
    n = F.coalesce(F.col("__n"), F.lit(0))
    return c.join(ups, F.col(pid) == F.col("__p"), "left").select(*keys, pid, down, area, (n != 1).alias("starts"))


def channel_properties(reaches: DataFrame, area: str, depth: tuple[float, float] = (0.26, 0.4), width: tuple[float, float] = (2.7, 0.52)) -> DataFrame:
    """Bankfull depth and width as powers of the drained area in km2."""
    km2 = F.col(area) / 1e6
    return reaches.withColumns({"bankfull": depth[0] * F.pow(km2, depth[1]), "channel_width": width[0] * F.pow(km2, width[1])})


def river_components(links: DataFrame, a: str, b: str, rounds: int = 64) -> DataFrame:
    """(node, component): catchments that the river joins, by the smallest id; each round
    takes the smallest label of neighbours, then jumps to that label's own label."""
    e = settled(links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    at = settled(e.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("c")))
    for _ in range(rounds):
        near = e.join(at.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        up = at.join(near, "u").select("u", "c", F.least("c", "m").alias("n"))
        jump = up.select(F.col("u").alias("n"), F.col("n").alias("j"))
        nxt = settled(up.join(jump, "n", "left").select("u", F.least("n", F.coalesce("j", "n")).alias("n"), "c"))
        same = nxt.where("n != c").isEmpty()
        at = nxt.select("u", F.col("n").alias("c"))
        if same:
            return at.select(F.col("u").alias("node"), F.col("c").alias("component"))
    raise ValueError("components haven't settled")
