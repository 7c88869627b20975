"""Aggregation across the series of an instant."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from loglathe.functions.numbers import plain_column
from loglathe.plans.expr import Aggregate

from .vectors import NAME, Vector, signature


def grouping(v: Vector, modifier: str | None, labels: tuple[str, ...]) -> tuple[str, ...]:
    """The labels that groups keep; the name never stays."""
    if modifier == "by":
        return tuple(x for x in v.labels if x in labels)
    if modifier == "without":
        return tuple(x for x in v.labels if x not in labels)
    return ()


def _result(op: str, v: Vector, parameter: float | None, compat: bool) -> Column:
    value = F.col("value")
    if op in ("count", "group") and compat:
        first = F.min_by("value", signature(v))
        return first + F.count(F.lit(1)) - 1 if op == "count" else F.when(F.count(F.lit(1)) == 1, first).otherwise(F.lit(1.0))
    if op == "max":
        return F.coalesce(F.max(F.when(~F.isnan(value), value)), F.lit(math.nan))
    if op == "quantile":
        if math.isnan(parameter):
            return F.max(F.lit(math.nan))
        if not 0 <= parameter <= 1:
            return F.max(F.lit(math.copysign(math.inf, parameter - 0.5)))
        return F.percentile(value, parameter)
    simple = {"sum": F.sum, "min": F.min, "avg": F.avg, "stddev": F.stddev_pop, "stdvar": F.var_pop}
    if op in simple:
        return simple[op](value)
    return F.count(F.lit(1)).cast("double") if op == "count" else F.max(F.lit(1.0))


def aggregate(v: Vector, e: Aggregate, parameter: float | None = None, compat: bool = False) -> Vector:
    kept = grouping(v, e.modifier, e.labels)
    keys = ["instant", *[f"l_{x}" for x in kept]]
    if e.op in ("topk", "bottomk"):
        return _ranked(v, e.op, keys, parameter, compat)
    if e.op == "count_values":
        counted = v.df.withColumn("__text", plain_column(F.col("value"))).groupBy(*keys, "__text").agg(F.count(F.lit(1)).cast("double").alias("value"))
        kept = tuple(x for x in kept if x != e.parameter)
        df = counted.select("instant", *[f"l_{x}" for x in kept], F.col("__text").alias(f"l_{e.parameter}"), "value")
        return Vector(df, (*kept, e.parameter), False, True, v.grid)
    df = v.df.groupBy(*keys).agg(_result(e.op, v, parameter, compat).alias("value"))
    return Vector(df, kept, False, True, v.grid)


def _ranked(v: Vector, op: str, keys: list[str], k: float, compat: bool) -> Vector:
    """The k largest or smallest of each group with all their labels; ties by label order, NaN last."""
    most = max(int(k), 0) if not math.isnan(k) else 0
    if compat:
        most = max(most, 1)
    value = F.when(~F.isnan("value"), F.col("value"))
    best = value.desc_nulls_last() if op == "topk" else value.asc_nulls_last()
    order = Window.partitionBy(*keys).orderBy(best, *[F.col(c).asc_nulls_first() for c in v.series_columns])
    df = v.df.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most).drop("__rank")
    return Vector(df, v.labels, v.named, v.one_name, v.grid)


def rename(v: Vector) -> Vector:
    """The same without names."""
    return Vector(v.df.drop(NAME), v.labels, False, v.one_name, v.grid)
