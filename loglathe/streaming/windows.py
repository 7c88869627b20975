"""Windowed queries over an unbounded source.

The same instants as in batch, by event-time windows: an instant is the last
millisecond of a sliding window. The phase comes from ``since`` (else it is 0),
as an unbounded source has no first sample to ask for. The watermark bounds
state; append mode emits an instant once no more samples can come for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.errors import KindError
from loglathe.operators import aggregate as agg
from loglathe.operators import binary, selector
from loglathe.operators.records import Records
from loglathe.operators.vectors import NAME, Vector
from loglathe.plans.expr import OVER_TIME, Aggregate, Binary, Call, Number, Selector, Unary, interval_of, parse
from loglathe.plans.planner import DEFAULT_INTERVAL


def _windowed(records: Records, e: Selector, function: str, lookback: int, interval: int, since: int | None, late: str) -> Vector:
    if lookback < interval:
        raise KindError("a stream needs windows that are at least as long as the interval")
    s, names = selector.samples(records, e)
    state = selector.states(function)
    keys = [f"l_{x}" for x in records.labels]
    name = [NAME] if function == "last" else []
    phase = f"{(since or 0) % interval} milliseconds"
    timed = s.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", late)
    if since is not None:
        timed = timed.where(F.col("ts_ms") >= since)
    w = F.window("ts", f"{lookback} milliseconds", f"{interval} milliseconds", phase)
    df = timed.groupBy(w.alias("w"), *name, *keys).agg(*[a.alias(n) for n, a, _ in state.parts])
    # The event-time window stays as a column: further aggregation must group by it.
    df = df.select("w", (F.unix_millis("w.end") - 1).alias("instant"), *name, *keys, state.result.alias("value"))
    return Vector(df, records.labels, bool(name), len(names) <= 1, lambda: df.select("instant"))


def _plan(e: object, records: Records, interval: int, since: int | None, late: str) -> Vector | float:
    deeper = lambda x: _plan(x, records, interval, since, late)
    if isinstance(e, Number):
        return e.value
    if isinstance(e, Selector) and not e.range_ms:
        return _windowed(records, e, "last", interval, interval, since, late)
    if isinstance(e, Call) and e.function in OVER_TIME:
        return _windowed(records, e.args[0], e.function, e.args[0].range_ms, interval, since, late)
    if isinstance(e, Aggregate) and e.op in ("sum", "min", "max", "avg", "count", "group", "stddev", "stdvar"):
        v = deeper(e.operand)
        kept = agg.grouping(v, e.modifier, e.labels)
        df = v.df.groupBy("w", *[f"l_{x}" for x in kept]).agg(agg._result(e.op, v, None, False).alias("value"))
        df = df.withColumn("instant", F.unix_millis("w.end") - 1)
        return Vector(df, kept, False, True, v.grid)
    if isinstance(e, Unary):
        v = deeper(e.operand)
        return v if e.op == "+" else Vector(v.df.withColumn("value", -F.col("value")), v.labels, v.named, v.one_name, v.grid)
    if isinstance(e, Binary):
        a, b = deeper(e.left), deeper(e.right)
        if isinstance(a, float) != isinstance(b, float):
            v, x = (b, a) if isinstance(a, float) else (a, b)
            return binary.with_scalar(v, e.op, x, e.returns_bool, isinstance(a, float))
    raise KindError("a stream takes selectors, over-time functions, aggregates, signs and operators with a number")


def stream(expression: str, records: Records, interval: int | None = None, since: int | None = None, late: str = "0 seconds") -> DataFrame:
    """A streaming DataFrame of (instant, [__name__], labels, value); write it in append mode."""
    e = parse(expression)
    v = _plan(e, records, interval or interval_of(e) or DEFAULT_INTERVAL, since, late)
    if isinstance(v, float):
        raise KindError("a number is no stream")
    fixed = {"instant", NAME, "value"}
    labels = [F.col(c).alias(c[2:]) if c.startswith("l_") and c[2:] not in fixed else F.col(c) for c in v.series_columns]
    return v.df.select("instant", *labels, "value")
