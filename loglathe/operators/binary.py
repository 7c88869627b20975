"""Operators between vectors and scalars and between two vectors.

Vectors join on equal instants and matched labels, null-safely, so an absent
label matches an absent label. One-to-one matching keeps the matched labels
only. Series that would share a key are an error; where a side's labels are
all in the key they can't, and nothing is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglathe.functions.arithmetic import COMPARISONS, LOGICAL, calculate, compare
from loglathe.plans.expr import Binary

from .vectors import NAME, Vector, label


def with_scalar(v: Vector, op: str, number: float, returns_bool: bool, scalar_first: bool) -> Vector:
    a, b = F.col("value"), F.lit(float(number))
    if scalar_first:
        a, b = b, a
    if op in COMPARISONS and not returns_bool:
        return Vector(v.df.where(compare(op, a, b)), v.labels, v.named, v.one_name, v.grid)
    value = compare(op, a, b).cast("double") if op in COMPARISONS else calculate(op, a, b)
    df = v.df.select("instant", *v.label_columns, value.alias("value"))
    return Vector(df, v.labels, False, v.one_name, v.grid)


def matched(e: Binary, left: Vector, right: Vector) -> tuple[str, ...]:
    every = tuple(dict.fromkeys((*left.labels, *right.labels)))
    if e.matching == "on":
        return tuple(x for x in every if x in e.labels)
    return tuple(x for x in every if x not in e.labels)


def _side(v: Vector, keys: tuple[str, ...], mark: str) -> DataFrame:
    own = [F.col(c).alias(f"{mark}_{c}") for c in (*v.series_columns, "instant", "value")]
    return v.df.select(*own, *[label(v, x).alias(f"{mark}_key_{i}") for i, x in enumerate(keys)])


def _on(keys: tuple[str, ...]) -> Column:
    out = F.col("a_instant") == F.col("b_instant")
    for i in range(len(keys)):
        out = out & F.col(f"a_key_{i}").eqNullSafe(F.col(f"b_key_{i}"))
    return out


def _distinct(df: DataFrame, v: Vector, keys: tuple[str, ...], mark: str, message: str) -> DataFrame:
    """Fails at run time on two series of one key; nothing to check where the key holds all labels."""
    if v.one_name and set(v.labels) <= set(keys):
        return df
    w = Window.partitionBy(f"{mark}_instant", *[f"{mark}_key_{i}" for i in range(len(keys))])
    counted = df.withColumn("__n", F.count(F.lit(1)).over(w))
    return counted.where(F.when(F.col("__n") > 1, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))).drop("__n")


def _grid(left: Vector, right: Vector):
    def instants() -> DataFrame:
        a, b = left.grid(), right.grid()
        last = a.agg(F.max("instant").alias("m")).crossJoin(F.broadcast(b.agg(F.max("instant").alias("n")))).select(F.least("m", "n").alias("end"))
        return a.unionAll(b).distinct().crossJoin(F.broadcast(last)).where(F.col("instant") <= F.col("end")).select("instant")

    return instants


def between(e: Binary, left: Vector, right: Vector) -> Vector:
    keys = matched(e, left, right)
    if e.op in LOGICAL:
        return _logical(e.op, left, right, keys)
    if e.group == "right":
        return _many(e, right, left, keys, True)
    if e.group == "left":
        return _many(e, left, right, keys, False)
    b = _distinct(_side(right, keys, "b"), right, keys, "b", "series collision: two series on the right share the matched labels")
    joined = _side(left, keys, "a").join(b, _on(keys))
    test = None
    if e.op in COMPARISONS:
        test = compare(e.op, F.col("a_value"), F.col("b_value"))
        if not e.returns_bool:
            joined = joined.where(test)
    joined = _distinct(joined, left, keys, "a", "many-to-one matching needs group_left: two series on the left share the matched labels")
    filters = e.op in COMPARISONS and not e.returns_bool
    value = F.col("a_value") if filters else test.cast("double") if test is not None else calculate(e.op, F.col("a_value"), F.col("b_value"))
    named = filters and left.named
    name = [F.col(f"a_{NAME}").alias(NAME)] if named else []
    df = joined.select(F.col("a_instant").alias("instant"), *name, *[F.col(f"a_key_{i}").alias(f"l_{x}") for i, x in enumerate(keys)], value.alias("value"))
    return Vector(df, keys, named, left.one_name, _grid(left, right))


def _many(e: Binary, many: Vector, one: Vector, keys: tuple[str, ...], swapped: bool) -> Vector:
    """Each series of the many side keeps its labels and takes the included ones of the other."""
    b = _distinct(_side(one, keys, "b"), one, keys, "b", "series collision: two series on the one side share the matched labels")
    joined = _side(many, keys, "a").join(b, _on(keys))
    x, y = F.col("a_value"), F.col("b_value")
    l, r = (y, x) if swapped else (x, y)
    filters = e.op in COMPARISONS and not e.returns_bool
    if filters:
        joined = joined.where(compare(e.op, l, r))
    value = l if filters else compare(e.op, l, r).cast("double") if e.op in COMPARISONS else calculate(e.op, l, r)
    named = filters and many.named
    name = [F.col(f"a_{NAME}").alias(NAME)] if named else []
    taken = tuple(x for x in e.include if x in one.labels)
    labels = tuple(x for x in many.labels if x not in taken) + taken
    cols = [F.col(f"b_l_{x}" if x in taken else f"a_l_{x}").alias(f"l_{x}") for x in labels]
    df = joined.select(F.col("a_instant").alias("instant"), *name, *cols, value.alias("value"))
    return Vector(df, labels, named, many.one_name, _grid(many, one))


def _logical(op: str, left: Vector, right: Vector, keys: tuple[str, ...]) -> Vector:
    def semi(a: Vector, b: Vector, how: str) -> DataFrame:
        joined = _side(a, keys, "a").join(_side(b, keys, "b"), _on(keys), how)
        return joined.select(*[F.col(f"a_{c}").alias(c) for c in ("instant", *a.series_columns, "value")])

    if op == "and":
        return Vector(semi(left, right, "left_semi"), left.labels, left.named, left.one_name, _grid(left, right))
    if op == "unless":
        return Vector(semi(left, right, "left_anti"), left.labels, left.named, left.one_name, left.grid)
    more = semi(right, left, "left_anti")
    df = left.df.unionByName(more, allowMissingColumns=True)
    labels = tuple(dict.fromkeys((*left.labels, *right.labels)))
    named = left.named or right.named
    out = Vector(df, labels, named, False, lambda: left.grid().unionAll(right.grid()).distinct())
    return Vector(df.select("instant", *out.series_columns, "value"), labels, named, False, out.grid)
