"""River networks of any depth: reaches and their orders, nested basins, travel upstream.

A network is a table of nodes (long ids) with the node that each drains to: null, or a node that
isn't in the table, ends a way.  Nothing here goes level by level.  Ways are followed by pointer
jumping, trees are reduced by contraction, and sums of subtrees are differences of prefix sums along
a tour of the tree; the number of joins grows with the logarithm of the number of nodes, be the
network a star or one single path.  A table that several steps read is stored in the shared
folder.  Cycles raise.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored

ROUNDS = 64


def ways(nodes: DataFrame, node: str, to: str, sums: Mapping[str, Column] = {}) -> DataFrame:
    """(node, end, sums): where each node's way ends and the totals of its steps, by pointer jumping.
    A step's addends are those of the node that it leaves; an end's own aren't counted.  Integers and
    decimals are added up exactly."""
    names, c = list(sums), F.col
    own = nodes.select(c(node).cast("long").alias("node"), c(to).cast("long").alias("to"), *[v.alias(s) for s, v in sums.items()])
    there = own.select(c("node").alias("to"), c("to").isNull().alias("__end"))
    # a way ends at a node that drains nowhere; a step out of the table isn't made
    at = own.join(there, "to", "left").select("node", F.when(c("__end").isNotNull(), c("to")).alias("__to"), *names, "__end")
    kinds = {s: _total(own.schema[s].dataType) for s in names}
    zero = {s: F.lit(0).cast(k) for s, k in kinds.items()}
    at = at.select("node", F.coalesce("__to", "node").alias("to"), *[F.when(c("__to").isNotNull(), c(s)).otherwise(zero[s]).cast(k).alias(s) for s, k in kinds.items()], F.coalesce("__end", F.lit(True)).alias("there"))
    at = stored(at)
    for _ in range(ROUNDS):
        going = at.where("NOT there")
        if going.isEmpty():
            return at.select(c("node").alias(node), c("to").alias("end"), *names)
        ahead = at.select(c("node").alias("to"), c("to").alias("__to"), c("there").alias("__there"), *[c(s).alias(f"__{s}") for s in names])
        moved = going.drop("there").join(ahead, "to").select("node", c("__to").alias("to"), *[(c(s) + c(f"__{s}")).cast(k).alias(s) for s, k in kinds.items()], c("__there").alias("there"))
        at = stored(at.where("there").unionByName(moved))
    raise ValueError(f"a way of over 2 ** {ROUNDS} steps: the network has a cycle")


def _total(kind) -> str:
    """The type of a column's totals."""
    name = kind.simpleString()
    return f"decimal(38,{kind.scale})" if name.startswith("decimal") else "double" if name in ("double", "float") else "long"


# Reaches


def reach_members(nodes: DataFrame, node: str, down: str) -> DataFrame:
    """(node, reach, position): a reach begins at a source or below a confluence, is named by its first
    node, and goes on while its nodes have one inflow; positions count from 0 downstream."""
    ups = nodes.where(F.col(down).isNotNull()).groupBy(F.col(down).cast("long").alias("__n")).agg(F.count("*").alias("__k"), F.min(node).alias("__up"))
    one = nodes.select(F.col(node).cast("long").alias(node)).join(ups.where("__k = 1"), F.col(node) == F.col("__n"), "left").select(node, "__up", F.lit(1).cast("long").alias("position"))
    return ways(one, node, "__up", {"position": F.col("position")}).withColumnRenamed("end", "reach")


def reach_topology(nodes: DataFrame, node: str, down: str, length: str | None = None) -> DataFrame:
    """(reach, last, n, length, down_reach, strahler): each reach's last node, number of nodes, length
    (their sum; without a column their number), the reach that it drains to and its Strahler order."""
    own = nodes.select(F.col(node).cast("long").alias("__node"), F.col(down).cast("long").alias("__down"), (F.col(length) if length else F.lit(1)).alias("__length"))
    at = stored(reach_members(nodes, node, down))
    kind = _total(own.schema["__length"].dataType)
    reaches = at.join(own, at[node] == own["__node"]).groupBy("reach").agg(F.max_by(F.struct("__node", "__down"), "position").alias("__last"), F.count("*").alias("n"), F.sum("__length").cast(kind).alias("length"))
    # below a reach's last node is a confluence, which is the first node of its reach
    reaches = reaches.select("reach", F.col("__last.__node").alias("last"), "n", "length", F.col("__last.__down").alias("__to"))
    heads = reaches.select(F.col("reach").alias("down_reach"))
    reaches = stored(reaches.join(heads, F.col("__to") == F.col("down_reach"), "left").drop("__to"))
    return reaches.join(strahler(reaches, "reach", "down_reach"), "reach")


def strahler(tree: DataFrame, node: str, down: str) -> DataFrame:
    """(node, strahler): 1 at sources; below, the greatest order that comes in, and one more where
    it comes in twice or more.

    By contraction.  A node whose order is known reports it and leaves (rake).  One that waits for
    a single inflow x is a function of it: t where x < s, t + 1 where s <= x <= t, else x; such
    functions compose to one of the same form, so that chains of them are halved in each round
    (compress).  The id of the inflow that is missing is the exclusive or of all ids less the reported."""
    c = F.col
    own = tree.select(c(node).cast("long").alias("v"), c(down).cast("long").alias("to"))
    ups = own.where("to IS NOT NULL").groupBy(c("to").alias("v")).agg(F.count("*").alias("pend"), F.expr("bit_xor(v)").alias("kids"))
    null, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    state = own.join(ups, "v", "left").select("v", "to", F.coalesce("pend", zero).alias("pend"), F.coalesce("kids", zero).alias("kids"), zero.alias("m"), zero.alias("k"), null.alias("child"), null.alias("s"), null.alias("t"), F.when(c("pend").isNull(), F.lit(1).cast("long")).alias("order"))
    state, done = stored(state), []
    names = state.columns
    for _ in range(2 * ROUNDS):
        known, rest = state.where("order IS NOT NULL"), state.where("order IS NULL")
        done.append(known.select("v", "order"))
        if rest.isEmpty():
            found = done[0]
            for d in done[1:]:
                found = found.unionByName(d)
            return found.select(c("v").alias(node), c("order").cast("int").alias("strahler"))
        # rake: the greatest reported order and whether it comes twice, summed up by order first
        told = known.where("to IS NOT NULL").groupBy("to", "order").agg(F.count("*").alias("n"), F.expr("bit_xor(v)").alias("x"))
        told = told.groupBy(c("to").alias("v")).agg(F.sum("n").alias("__n"), F.expr("bit_xor(x)").alias("__x"), F.max(F.struct("order", "n")).alias("__top"))
        o, n = c("__top.order"), c("__top.n")
        rest = rest.join(told, "v", "left").withColumns({"pend": c("pend") - F.coalesce("__n", zero), "kids": c("kids").bitwiseXOR(F.coalesce("__x", zero)), "k": F.when(o > c("m"), n).when(o == c("m"), n + c("k")).otherwise(c("k")), "m": F.greatest("m", o)})
        single = (c("pend") == 1) & c("child").isNull()
        rest = rest.withColumns({"order": F.when(c("pend") == 0, c("m") + F.when(c("k") > 1, 1).otherwise(0)), "child": F.when(single, c("kids")).otherwise(c("child")), "s": F.when(single, F.when(c("k") > 1, zero).otherwise(c("m"))).otherwise(c("s")), "t": F.when(single, c("m")).otherwise(c("t"))}).select(names)
        # compress: take the value of the node pointed at, or its pointer
        applied = lambda x: F.when(x < c("s"), c("t")).when(x <= c("t"), c("t") + 1).otherwise(x)
        values = known.select(c("v").alias("child"), c("order").alias("__o"))
        rest = stored(rest.join(values, "child", "left").withColumn("order", F.coalesce("order", applied(c("__o")))).select(names))
        ahead = rest.select(c("v").alias("child"), c("order").alias("__o"), c("child").alias("__child"), c("s").alias("__s"), c("t").alias("__t"))
        on = c("order").isNull() & c("__child").isNotNull() & c("__o").isNull()
        # this node's function after that of the node pointed at
        below, at = c("t") < c("__t"), c("t") == c("__t")
        s = F.when(below, c("__s")).when(at | (c("s") <= c("__t")), zero).when(c("s") == c("__t") + 1, c("__s")).otherwise(c("s"))
        new = {"order": F.coalesce("order", applied(c("__o"))), "child": F.when(on, c("__child")).otherwise(c("child")), "s": F.when(on, s).otherwise(c("s")), "t": F.when(on, F.greatest("t", "__t")).otherwise(c("t"))}
        state = stored(rest.join(ahead, "child", "left").withColumns(new).select(names))
    raise ValueError("orders haven't settled: the network has a cycle")


# Nested basins


def ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """df in ranges of its keys (distinct, not null), with ``__range``, stored."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *keys).withColumn("__range", F.spark_partition_id()))


def following(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """df with ``__next``: a struct of cols of the next row in the order of keys.  Each range has its
    windows; the first of the next range, one row a range, is carried over."""
    df, me = ranged(df, keys), F.struct(*cols)
    first = df.groupBy("__range").agg(F.min_by(me, F.struct(*keys)).alias("__first"))
    first = first.select("__range", F.lead("__first").over(Window.orderBy("__range")).alias("__after"))
    w = Window.partitionBy("__range").orderBy(*keys)
    return df.withColumn("__next", F.lead(me).over(w)).join(first, "__range").withColumn("__next", F.coalesce("__next", "__after")).drop("__range", "__after")


def prefix_sums(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """df with the cols replaced by their running totals in the order of keys: windows within
    ranges, and the totals of the ranges before, one row a range."""
    df = ranged(df, keys)
    totals = df.groupBy("__range").agg(*[F.sum(c).alias(f"__{c}") for c in cols])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__range", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in cols])
    w = Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({c: F.sum(c).over(w) for c in cols}).join(totals, "__range")
    return df.withColumns({c: F.col(c) + F.col(f"__{c}") for c in cols}).drop("__range", *[f"__{c}" for c in cols])


def nested_sums(nodes: DataFrame, node: str, down: str, sums: Mapping[str, Column]) -> DataFrame:
    """(node, n, sums): for every node the number of nodes that drain to it, itself included, and totals
    over them.  Numbers have to be integers or decimals: totals are differences of long running sums.

    A tour enters each node, goes through all that drains to it and leaves it.  Places in the tour
    come from pointer jumping along it; a node's total is what the running sums gain between
    entering and leaving it."""
    c = F.col
    own = nodes.select(c(node).cast("long").alias("v"), c(down).cast("long").alias("__d"), *[x.alias(s) for s, x in sums.items()])
    if any(own.schema[s].dataType.simpleString() in ("double", "float") for s in sums):
        raise TypeError("totals are exact: cast doubles to decimals first")
    inside = own.select(c("v").alias("to"))
    own = stored(own.join(inside, c("__d") == c("to"), "left").drop("__d"))
    # siblings in a row, those without a way down among themselves
    row = following(own.where("to IS NOT NULL").select("v", "to"), ["to", "v"], ["to", "v"]).select("v", F.when(c("__next.to") == c("to"), c("__next.v")).alias("sibling"))
    first = own.where("to IS NOT NULL").groupBy(c("to").alias("v")).agg(F.min("v").alias("child"))
    tour = own.select("v", "to").join(row, "v", "left").join(first, "v", "left")
    enter, leave = lambda x: c(x) * 2, lambda x: c(x) * 2 + 1
    steps = tour.select(F.explode(F.array(F.struct(enter("v").alias("event"), F.coalesce(enter("child"), leave("v")).alias("next")), F.struct(leave("v").alias("event"), F.coalesce(enter("sibling"), leave("to")).alias("next")))).alias("e")).select("e.event", "e.next")
    placed = ways(steps, "event", "next", {"left": F.lit(1).cast("long")})
    placed = placed.select(F.shiftright("event", 1).alias("v"), (c("event") % 2 == 0).alias("enters"), "end", (-c("left")).alias("place"))
    names = ["n", *sums]
    weights = own.withColumn("n", F.lit(1).cast("long"))
    kinds = {s: _total(weights.schema[s].dataType) for s in names}
    placed = placed.join(weights.select("v", *names), "v").select("v", "enters", "end", "place", *[F.when(c("enters"), F.coalesce(c(s), F.lit(0))).otherwise(F.lit(0)).cast(k).alias(s) for s, k in kinds.items()], *[c(s).alias(f"own_{s}") for s in names])
    run = prefix_sums(placed, ["end", "place"], names)
    gain = [(F.sum(F.when(c("enters"), -c(s)).otherwise(c(s))) + F.coalesce(F.max(f"own_{s}"), F.lit(0))).cast(k).alias(s) for s, k in kinds.items()]
    return run.groupBy(c("v").alias(node)).agg(*gain)


# Travel upstream


def upstream_travel(nodes: DataFrame, node: str, down: str, length: str, roots: DataFrame, most_reaches: int = 0, most_time: float = 0.0, celerity: float = 1.0) -> DataFrame:
    """(root, node, reaches, length, stopped): all that drains to each root as far as it is followed.
    Going upstream adds up reaches and lengths; a way stops at the first node at which it has passed
    ``most_reaches`` reaches and ``most_time`` (length over celerity) both; that node is given as
    stopped.  Each root's ways stop by themselves.  roots: ids in a column named as node's.
    Lengths aren't negative.

    No step goes level by level: each node's nearest root is found by pointer jumping; roots that drain to
    roots meet theirs by doubling, at 1, 2, 4, .. roots' distance, and a way that is stopped isn't carried on."""
    c = F.col
    own = nodes.select(c(node).cast("long").alias("v"), c(down).cast("long").alias("to"), c(length).alias("length"))
    kind = _total(own.schema["length"].dataType)
    marks = roots.select(c(node).cast("long").alias("v")).distinct().withColumn("root", F.lit(True))
    own = stored(own.withColumn("length", c("length").cast(kind)).join(marks, "v", "left"))
    goes = own.withColumn("stop_here", F.when(c("root").isNull(), c("to")))
    near = ways(goes, "v", "stop_here", {"reaches": F.lit(1).cast("long"), "length": c("length")})
    # far: the step into the node itself, which tells whether the way was stopped before it
    near = near.join(marks.select(c("v").alias("end")), "end", "left_semi").select("v", c("end").alias("root"), "reaches", "length")
    near = stored(near.join(own.select("v", c("length").alias("last")), "v"))
    most = F.lit(most_time * celerity)
    stopped = (c("reaches") >= most_reaches) & (c("length") >= most)
    open_ = (c("reaches") <= 1) | ~((c("reaches") - 1 >= most_reaches) & (c("length") - c("last") >= most))
    # a root and the nearest root that it drains to
    pairs = own.where("root AND to IS NOT NULL").select("v", "to", c("length").alias("last")).join(near.select(c("v").alias("to"), "root", "reaches", "length"), "to")
    pairs = pairs.select("v", "root", (c("reaches") + 1).alias("reaches"), (c("length") + c("last")).cast(kind).alias("length"), "last").where(open_)
    ahead = found = stored(pairs)
    for _ in range(ROUNDS):
        if ahead.isEmpty():
            break
        on = lambda df: df.select(c("v").alias("__r"), c("root").alias("__root"), c("reaches").alias("__n"), c("length").alias("__l"))
        far = lambda df: ahead.join(on(df), c("root") == c("__r")).select("v", c("__root").alias("root"), (c("reaches") + c("__n")).alias("reaches"), (c("length") + c("__l")).cast(kind).alias("length"), "last").where(open_)  # noqa: E731, B023
        found, ahead = stored(found.unionByName(far(found))), stored(far(ahead))
    else:
        raise ValueError("roots haven't settled: the network has a cycle")
    every = near.join(found.select(c("v").alias("root"), c("root").alias("__root"), c("reaches").alias("__n"), c("length").alias("__l")), "root")
    every = every.select("v", c("__root").alias("root"), (c("reaches") + c("__n")).alias("reaches"), (c("length") + c("__l")).cast(kind).alias("length"), "last")
    out = near.select("v", "root", "reaches", "length", "last").unionByName(every).where(open_)
    return out.select("root", c("v").alias(node), "reaches", "length", (stopped & (c("reaches") > 0)).alias("stopped"))
