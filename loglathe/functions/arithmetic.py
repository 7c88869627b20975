"""Floating-point operators with IEEE results, as columns and as Python numbers.

Spark raises on division by zero and orders NaN above all, hence the guards.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = sys.float_info.epsilon
ARITHMETIC = ("+", "-", "*", "/", "%", "^")
COMPARISONS = ("==", "!=", ">=", ">", "<", "<=")
LOGICAL = ("and", "or", "unless")


def calculate(op: str, a: Column, b: Column) -> Column:
    nan = F.lit(math.nan)
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))
    if op == "%":
        infinite = F.abs(b) == F.lit(math.inf)
        return F.when((b == 0) | F.isnan(a) | (F.abs(a) == F.lit(math.inf)), nan).when(infinite, a).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))
    one = (a == 1) | ((a == -1) & (F.abs(b) == F.lit(math.inf)))
    return F.when(one, F.lit(1.0)).otherwise(F.pow(a, b))


def compare(op: str, a: Column, b: Column) -> Column:
    gap = a - b
    if op == "==":
        return ~F.isnan(gap) & (F.abs(gap) < EPSILON)
    if op == "!=":
        return ~F.isnan(gap) & (F.abs(gap) > EPSILON)
    real = ~F.isnan(a) & ~F.isnan(b)
    return real & {">=": a >= b, ">": a > b, "<": a < b, "<=": a <= b}[op]


def fold(op: str, a: float, b: float) -> float:
    """Both operands are known: the same results in Python."""
    if op in COMPARISONS:
        gap = a - b
        if op in ("==", "!="):
            return float(not math.isnan(gap) and (abs(gap) < EPSILON if op == "==" else abs(gap) > EPSILON))
        return float({">=": a >= b, ">": a > b, "<": a < b, "<=": a <= b}[op])
    if op == "/":
        if b == 0:
            return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)
        return a / b
    if op == "%":
        return math.nan if b == 0 or math.isinf(a) or math.isnan(a) or math.isnan(b) else math.fmod(a, b)
    if op == "^":
        try:
            return math.pow(a, b)
        except OverflowError:
            return -math.inf if a < 0 and b % 2 == 1 else math.inf
        except ValueError:
            return (math.copysign(math.inf, a) if b % 2 == 1 else math.inf) if a == 0 else math.nan
    return {"+": a + b, "-": a - b, "*": a * b}[op]
