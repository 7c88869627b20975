"""Selectors, the time grid, and functions over a window of a series.

With interval I and lookback L the instants are t0 + min(L, I) - 1 + k * I; a
sample at t belongs to those with instant - L < t <= instant. t0 is ``since``,
else the time of the selector's own first sample. Input counts as ordered by
(ts_ms, line_no).

* L = I: one instant a sample, by arithmetic.
* I divides L: samples are first combined in panes of width I, then only the
  panes' states are spread over the L / I instants that they reach.
* else each sample is spread over its instants.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions import patterns
from loglathe.plans.expr import LINE, Matcher, Selector

from .records import Records
from .vectors import NAME, Vector


@dataclass(frozen=True)
class State:
    """How a function's result comes from partial results: each is (name, first aggregate, merging aggregate)."""

    parts: tuple[tuple[str, Column, Column], ...]
    result: Column


def _order() -> Column:
    """(ts_ms, line_no) as one number that a hash aggregate can hold."""
    return F.col("ts_ms").cast("decimal(19,0)") * F.lit("1000000000000000000").cast("decimal(19,0)") + F.coalesce("line_no", F.lit(0))


def _sum(x: str) -> Column:
    return F.sum(x)


def states(function: str, oldest: bool = False) -> State:
    value = F.col("value")
    real = F.when(~F.isnan(value), value)
    n = ("n", F.count(F.lit(1)), _sum("n"))
    total = ("total", F.sum(value), _sum("total"))
    if function == "count_over_time":
        return State((n,), F.col("n").cast("double"))
    if function == "sum_over_time":
        return State((total,), F.col("total"))
    if function == "avg_over_time":
        return State((n, total), F.col("total") / F.col("n"))
    if function == "min_over_time":
        return State((("low", F.min(real), F.min("low")),), F.coalesce("low", F.lit(math.inf)))
    if function == "max_over_time":
        return State((("high", F.max(real), F.max("high")),), F.coalesce("high", F.lit(-math.inf)))
    # The latest sample, for selectors of instants too.
    by, edge = (F.min_by, F.min) if oldest else (F.max_by, F.max)
    return State((("own", by(value, _order()), by("own", "at")), ("at", edge(_order()), edge("at"))), F.col("own"))


def _takes(m: Matcher, records: Records) -> Column:
    """A matcher on a label that a series lacks never holds, whatever its operator."""
    if m.label not in records.labels:
        return F.lit(False)
    c = F.col(f"l_{m.label}")
    if m.op in ("=", "!="):
        return c == m.value if m.op == "=" else c != m.value
    hit = c.rlike(patterns.whole(m.value))
    return hit if m.op == "=~" else ~hit


def samples(records: Records, e: Selector) -> tuple[DataFrame, list[str]]:
    """(ts_ms, line_no, labels, [__name__], value) of the matching series, and the metrics that can match.

    Metrics are chosen when planning, so a scan reads the columns of those alone.
    """
    known = [v for v in records.values if v != LINE] + [LINE]
    names = [v for v in known if e.metric in (None, v) and all(m.takes(v) for m in e.matchers if m.label == NAME)]
    df = records.df.where(F.col("ts_ms").isNotNull())
    for m in e.matchers:
        if m.label != NAME:
            df = df.where(_takes(m, records))
    keep = ["ts_ms", "line_no", *[f"l_{x}" for x in records.labels]]
    column = {v: F.col("line_no").cast("double") if v == LINE else F.col(f"v_{v}") for v in names}
    if len(names) == 1:
        out = df.select(*keep, F.lit(names[0]).alias(NAME), column[names[0]].alias("value"))
    elif names:
        every = F.array(*[F.struct(F.lit(v).alias("n"), column[v].alias("x")) for v in names])
        out = df.select(*keep, F.explode(every).alias("s")).select(*keep, F.col("s.n").alias(NAME), F.col("s.x").alias("value"))
    else:
        out = df.select(*keep, F.lit("").alias(NAME), F.lit(None).cast("double").alias("value")).where(F.lit(False))
    return out.where(F.col("value").isNotNull()), names


def _floor_div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


@dataclass(frozen=True)
class Grid:
    interval: int
    lookback: int
    since: int | None

    def placed(self, s: DataFrame) -> DataFrame:
        """Adds t0: a literal, or the one-row minimum of the samples themselves, joined lazily."""
        if self.since is not None:
            return s.withColumn("t0", F.lit(self.since).cast("long"))
        return s.crossJoin(F.broadcast(s.agg(F.min("ts_ms").alias("t0"))))

    def tumbling(self) -> bool:
        return self.lookback == self.interval

    def paned(self) -> bool:
        return self.lookback > self.interval and self.lookback % self.interval == 0

    def pane(self) -> Column:
        """Instant of the sample's pane: the first that it belongs to."""
        k = _floor_div(F.col("ts_ms") - F.col("t0"), self.interval)
        return F.col("t0") + (k + 1) * self.interval - 1

    def spread(self, s: DataFrame) -> DataFrame:
        """A row for each instant of each sample."""
        first = F.col("t0") + (min(self.lookback, self.interval) - 1)
        lo = F.greatest(F.lit(0), -_floor_div(first - F.col("ts_ms"), self.interval))
        hi = _floor_div(F.col("ts_ms") + (self.lookback - 1) - first, self.interval)
        s = s.withColumn("lo", lo.cast("long")).withColumn("hi", hi).where(F.col("lo") <= F.col("hi"))
        return s.withColumn("k", F.explode(F.sequence("lo", "hi"))).withColumn("instant", first + F.col("k") * self.interval).drop("lo", "hi", "k")

    def reached(self) -> Column:
        """From a pane's instant, all that it belongs to."""
        return F.explode(F.sequence(F.col("instant"), F.col("instant") + (self.lookback - self.interval), F.lit(self.interval)))

    def instants(self, s: DataFrame) -> DataFrame:
        """Every instant from the first to the last that can hold a sample."""
        t0 = F.lit(self.since).cast("long") if self.since is not None else F.min("ts_ms")
        first = F.col("t0") + (min(self.lookback, self.interval) - 1)
        ends = s.agg(t0.alias("t0"), F.max("ts_ms").alias("last")).where(F.col("last").isNotNull())
        n = _floor_div(F.col("last") + self.lookback - 1 - first, self.interval)
        return ends.where(n >= 0).select(F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("k"), first.alias("first")).select((F.col("first") + F.col("k") * self.interval).alias("instant"))


def window_values(records: Records, e: Selector, grid: Grid, function: str, drop_name: bool, oldest: bool = False) -> Vector:
    """One value for each series and instant."""
    s, names = samples(records, e)
    state = states(function, oldest)
    keys = [NAME, *[f"l_{x}" for x in records.labels]]
    placed = grid.placed(s)
    firsts = [a.alias(n) for n, a, _ in state.parts]
    if grid.tumbling() or grid.paned():
        df = placed.withColumn("instant", grid.pane()).groupBy("instant", *keys).agg(*firsts)
        if grid.paned():
            rows = df.withColumn("instant", grid.reached())
            df = rows.groupBy("instant", *keys).agg(*[m.alias(n) for n, _, m in state.parts])
    else:
        df = grid.spread(placed).groupBy("instant", *keys).agg(*firsts)
    labels = keys[1:]
    out = df.select("instant", *([] if drop_name else [NAME]), *labels, state.result.alias("value"))
    # Names of several metrics may leave equal series once dropped; they stay apart, as rows.
    return Vector(out, records.labels, not drop_name, len(names) <= 1, lambda: grid.instants(s))


def window_points(records: Records, e: Selector, grid: Grid) -> Vector:
    """All points of each series and instant, in order."""
    s, names = samples(records, e)
    keys = [NAME, *[f"l_{x}" for x in records.labels]]
    point = F.struct("ts_ms", F.coalesce("line_no", F.lit(0)).alias("line_no"), "value")
    df = grid.spread(grid.placed(s)).groupBy("instant", *keys).agg(F.sort_array(F.collect_list(point)).alias("p"))
    points = F.transform("p", lambda x: F.struct(x["ts_ms"].alias("ts"), x["value"].alias("value")))
    return Vector(df.select("instant", *keys, points.alias("points")), records.labels, True, len(names) <= 1, lambda: grid.instants(s), True)
