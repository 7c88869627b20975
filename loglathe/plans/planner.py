"""Expressions to vectors: each node becomes DataFrame operations, Catalyst does the rest."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import functions as F

from loglathe.errors import KindError
from loglathe.functions import patterns
from loglathe.functions.arithmetic import fold
from loglathe.operators import aggregate as agg
from loglathe.operators import binary, selector
from loglathe.operators.records import Records
from loglathe.operators.vectors import NAME, Vector, label

from .expr import OVER_TIME, Aggregate, Binary, Call, Number, Selector, Unary, interval_of, kind_of

DEFAULT_INTERVAL = 1000


@dataclass(frozen=True)
class Options:
    since: int | None = None
    until: int | None = None
    interval: int | None = None
    lookback: int | None = None
    #: Reproduce what the reference computes where that contradicts its documentation.
    compat: bool = False


class Planner:
    def __init__(self, records: Records, options: Options, expression: object) -> None:
        self.records, self.options = records, options
        self.interval = options.interval or interval_of(expression) or DEFAULT_INTERVAL
        self.memo: dict = {}

    def plan(self, e: object) -> Vector | float:
        """A vector, or a number where no operand needs data."""
        if isinstance(e, Number):
            return e.value
        if e not in self.memo:
            self.memo[e] = self._plan(e)
        return self.memo[e]

    def _grid(self, lookback: int) -> selector.Grid:
        return selector.Grid(self.interval, lookback, self.options.since)

    def _plan(self, e: object) -> Vector | float:
        if isinstance(e, Selector):
            if e.range_ms:
                return selector.window_points(self.records, e, self._grid(e.range_ms))
            return selector.window_values(self.records, e, self._grid(self.options.lookback or self.interval), "last", False)
        if isinstance(e, Unary):
            v = self.plan(e.operand)
            if isinstance(v, float):
                return -v if e.op == "-" else v
            if e.op == "+":
                return v
            return Vector(v.df.withColumn("value", -F.col("value")), v.labels, v.named, v.one_name, v.grid)
        if isinstance(e, Aggregate):
            parameter = self.plan(e.parameter) if e.parameter is not None and not isinstance(e.parameter, str) else None
            return agg.aggregate(self.plan(e.operand), e, parameter, self.options.compat)
        if isinstance(e, Call):
            return self._call(e)
        assert isinstance(e, Binary)
        a, b = self.plan(e.left), self.plan(e.right)
        if isinstance(a, float) and isinstance(b, float):
            return fold(e.op, a, b)
        if isinstance(b, float):
            return binary.with_scalar(a, e.op, b, e.returns_bool, False)
        if isinstance(a, float):
            return binary.with_scalar(b, e.op, a, e.returns_bool, True)
        return binary.between(e, a, b)

    def _call(self, e: Call) -> Vector:
        if e.function in OVER_TIME:
            inner = e.args[0]
            if not isinstance(inner, Selector):
                raise KindError(f"{e.function}() takes a selector with a range")
            oldest = self.options.compat and e.function == "last_over_time"
            return selector.window_values(self.records, inner, self._grid(inner.range_ms), e.function, True, oldest)
        if e.function == "vector":
            return self._constant(self.plan(e.args[0]))
        v = self.plan(e.args[0])
        if e.function == "label_replace":
            return self._label_replace(v, *e.args[1:])
        low, high = {"clamp": e.args[1:], "clamp_min": (e.args[1], None), "clamp_max": (None, e.args[-1])}[e.function]
        value = F.col("value")
        clamped = value
        if high is not None:
            clamped = F.least(clamped, F.lit(self.plan(high)))
        if low is not None:
            clamped = F.greatest(clamped, F.lit(self.plan(low)))
        bounds = [self.plan(x) for x in (low, high) if x is not None]
        if any(math.isnan(x) for x in bounds):
            clamped = F.lit(math.nan)
        clamped = F.when(F.isnan(value), value).otherwise(clamped)
        return Vector(v.df.select("instant", *v.label_columns, clamped.alias("value")), v.labels, False, v.one_name, v.grid)

    def _constant(self, x: float) -> Vector:
        """The number at every instant of a grid over all records."""
        grid = self._grid(self.options.lookback or self.interval)
        own = self.records.df.where(F.col("ts_ms").isNotNull())
        df = grid.instants(own).withColumn("value", F.lit(x))
        return Vector(df, (), False, True, lambda: grid.instants(own))

    def _label_replace(self, v: Vector, target: str, replacement: str, source: str, pattern: str) -> Vector:
        """Sets a label where the whole source label fits the pattern; an empty result removes it."""
        text = F.coalesce(label(v, source) if source != NAME else (F.col(NAME) if v.named else F.lit(None).cast("string")), F.lit(""))
        p = patterns.whole(pattern)
        new = F.regexp_replace(text, F.lit(p), F.lit(replacement))
        fits = text.rlike(p)
        if target == NAME:
            had = F.col(NAME) if v.named else F.lit(None).cast("string")
            df = v.df.withColumn(NAME, F.when(fits, F.nullif(new, F.lit(""))).otherwise(had))
            return Vector(df.select("instant", NAME, *v.label_columns, "value"), v.labels, True, False, v.grid)
        value = F.when(fits, F.nullif(new, F.lit(""))).otherwise(label(v, target))
        labels = v.labels if target in v.labels else (*v.labels, target)
        df = v.df.withColumn(f"l_{target}", value)
        # Replacing may make series equal; whoever joins on them then checks.
        return Vector(df, labels, v.named, False, v.grid)


def plan(records: Records, expression: object, options: Options) -> Vector | float:
    kind_of(expression)
    return Planner(records, options, expression).plan(expression)
