"""A streaming runner of the hourly loop: runoff arrives, queues are state.

``route_queue`` takes rows in the order of their steps; it keeps for each unit what past steps
have still to give (the unit hydrograph's tail) and sends out each step's routed runoff, once
all of its input is there.  ``route_timed`` takes rows in any order: a step is sent out when the
watermark passes its end, by a timer, and rows that come later than that are given back as late.
The batch form of both is ``operators.sequence.convolve``.

``open_steps`` reads what a stopped stream of ``route_timed`` had still to give from its
checkpoint, as a table; another stream begins with it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

STATE = "step long, queue array<double>"


def route_queue(stream: DataFrame, key: str, step: str, value: str, kernel: Sequence[float]) -> DataFrame:
    """(key, step, routed).  A step that is missing counts as 0; a step at or before one that
    is out already raises, as its water can't be put back in."""
    weights = [float(w) for w in kernel]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, queue = state.get if state.exists else (None, [0.0] * len(weights))
        queue = list(queue)
        rows = pd.concat(list(batches)).groupby(step, sort=True)[value].sum()
        out = []
        for t, v in rows.items():
            if at is not None and t <= at:
                raise ValueError(f"step {t} of {k[0]} comes after step {at}")
            while at is not None and at + 1 < t:
                at += 1
                out.append((at, queue[0]))
                queue = [*queue[1:], 0.0]
            queue = [q + v * w for q, w in zip(queue, weights, strict=True)]
            out.append((t, queue[0]))
            queue = [*queue[1:], 0.0]
            at = int(t)
        state.update((at, queue))
        yield pd.DataFrame({key: [k[0]] * len(out), step: [o[0] for o in out], "routed": [o[1] for o in out]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {step} long, routed double", STATE, "append", GroupStateTimeout.NoTimeout)


class _Steps(StatefulProcessor):
    """For each open step what is to be routed out in it: a map from step to amount, and a timer at
    each step's end.  A row adds its shares to the steps from its own on, so no order is needed.  A
    step leaves the state as it goes out: a unit holds no more steps than the watermark's delay and
    the kernel are long, and none once its tail is out."""

    def __init__(self, key: str, step: str, value: str, weights: list[float], seconds: int, first: int | None):
        self.names, self.weights, self.millis, self.first = (key, step, value), weights, seconds * 1000, first

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "step long", "amount double")

    def _add(self, step: int, amount: float) -> None:
        now = self.open.getValue((step,)) if self.open.containsKey((step,)) else None
        if now is None:
            self.handle.registerTimer((step + 1) * self.millis)
        self.open.updateValue((step,), (amount + (now[0] if now else 0.0),))

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        name, step, value = self.names
        columns = ([key[0]] * len(rows), *(zip(*rows, strict=True) if rows else ([], [], [], [])))
        return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in zip((name, step, "routed", value, "late"), columns, strict=True)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, step, value = self.names
        closed, late, sums = timerValues.getCurrentWatermarkInMs(), [], {}
        for b in rows:
            for t, v in zip(b[step].tolist(), b[value].tolist(), strict=True):
                if pd.isna(t) or (t + 1) * self.millis <= closed or self.first is not None and t < self.first:
                    late.append((None if pd.isna(t) else int(t), None, None if pd.isna(v) else v, True))
                else:
                    sums[int(t)] = sums.get(int(t), 0.0) + (0.0 if pd.isna(v) else v)
        shares: dict[int, float] = {}
        for t, v in sorted(sums.items()):
            for lag, w in enumerate(self.weights):
                shares[t + lag] = shares.get(t + lag, 0.0) + v * w
        for t, v in shares.items():
            self._add(t, v)
        yield self._frame(key, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t = expiredTimerInfo.getExpiryTimeInMs() // self.millis - 1
        out = [(t, self.open.getValue((t,))[0], None, False)] if self.open.containsKey((t,)) else []
        self.open.removeKey((t,))
        yield self._frame(key, out)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for t, v in zip(initialState[self.names[1]].tolist(), initialState["amount"].tolist(), strict=True):
            self._add(int(t), v)

    def close(self) -> None:
        pass


def route_timed(
    stream: DataFrame, key: str, ts: str, value: str, kernel: Sequence[float], seconds: int = 3600, late: str = "2 hours", step: str = "step", begin: DataFrame | None = None, first: int | None = None
) -> DataFrame:
    """(key, step, routed, value, late).  step: whole steps of so many seconds since 1970.

    Rows may come in any order and several to a step.  Once the watermark (``late`` behind the latest
    ts) passes a step's end, its routed amount goes out, once, late being false and value null; so
    do the steps of the tail.  A row whose step is already out comes back as it was (late true, routed null) and
    changes nothing; so does a row without a time.  A null value counts as 0, a null key is a key,
    an empty stream gives nothing.  A step to which no row gives a share has no row.

    begin: (key, step, amount), what another stream had still to give, as open_steps() reads it; first: the
    first step that it hadn't sent out; rows of earlier steps are late.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    if not len(kernel):
        raise ValueError("a kernel has one weight at least")
    kind = stream.schema[key].dataType.simpleString()
    at = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")
    # without ts: Spark would drop late rows before they could be given back
    rows = stream.withWatermark(ts, late).select(key, at.alias(step), F.col(value).cast("double").alias(value))
    schema = f"`{key}` {kind}, `{step}` long, routed double, `{value}` double, late boolean"
    steps = _Steps(key, step, value, [float(w) for w in kernel], seconds, first)
    begun = begin.select(F.col(key).cast(kind).alias(key), F.col(step).cast("long").alias(step), F.col("amount").cast("double")).groupBy(key) if begin is not None else None
    return rows.groupBy(key).transformWithStateInPandas(steps, schema, "Append", "EventTime", begun)


def open_steps(spark: SparkSession, checkpoint: str, key: str, step: str = "step") -> DataFrame:
    """(key, step, amount): what the stream of route_timed with this checkpoint has still to give."""
    state = spark.read.format("statestore").option("stateVarName", "open").option("flattenCollectionTypes", True).load(checkpoint)
    return state.select(F.col(f"key.{key}").alias(key), F.col("user_map_key.step").alias(step), "user_map_value.amount")


def daily_balance(stream: DataFrame, key: str, ts: str, values: Sequence[str], late: str = "2 hours") -> DataFrame:
    """Sums by day as they close, with a bound for late steps."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("w"), key)
    return w.agg(*[F.sum(v).alias(v) for v in values]).select(key, F.col("w.start").alias("day"), *values)
