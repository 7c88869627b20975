"""Numbers: what counts as one in a text, and how one is written."""

from __future__ import annotations

import math
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"^[+-]?(?:(?i:infinity|inf|nan)|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"


def to_number(text: Column) -> Column:
    """DOUBLE of texts that are numbers in full, else NULL. A cast alone would take ``' 1 '`` and ``1d``."""
    # Of these, a cast knows all but a NaN with a sign.
    return F.when(text.rlike(NUMERIC.replace("$", r"\z")), F.coalesce(text.try_cast("double"), F.lit(math.nan)))


def plain(x: float) -> str:
    """Shortest digits that read back, never with an exponent; integers without a point."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    digits = format(Decimal(repr(float(x))), "f")
    return digits[:-2] if digits.endswith(".0") else digits


def json_number(x: float) -> str:
    """A JSON number that keeps its point; what JSON lacks is null."""
    return repr(float(x)) if math.isfinite(x) else "null"


def plain_column(x: Column) -> Column:
    """The same text for label values, JVM-side; beyond 15 digits as Spark writes it."""
    whole = (F.abs(x) < 1e15) & (x == F.floor(x))
    return (
        F.when(F.isnan(x), "NaN")
        .when(x == F.lit(math.inf), "inf")
        .when(x == F.lit(-math.inf), "-inf")
        .when(whole, x.cast("long").cast("string"))
        .otherwise(x.cast("string"))
    )


_NUMBER = re.compile(r"[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?:infinity|inf|nan)(?![A-Za-z0-9_:]))", re.I)


def scan_number(text: str, at: int) -> tuple[float, int] | None:
    m = _NUMBER.match(text, at)
    return (float(m[0]), m.end()) if m else None
