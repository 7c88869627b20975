"""What operators pass on: a DataFrame with its labels and its grid."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = "__name__"


@dataclass(frozen=True)
class Vector:
    """Rows of (instant, [__name__], l_<label>…, value or points); instants without rows aren't there.

    ``grid`` gives the instants including those without rows, lazily: only
    formatters ask. ``one_name`` tells that every row has the same name.
    """

    df: DataFrame
    labels: tuple[str, ...]
    named: bool
    one_name: bool
    grid: Callable[[], DataFrame]
    ranged: bool = False

    @property
    def label_columns(self) -> list[str]:
        return [f"l_{x}" for x in self.labels]

    @property
    def series_columns(self) -> list[str]:
        return ([NAME] if self.named else []) + self.label_columns


def label(v: Vector, name: str) -> Column:
    """A label's column; NULL where no series can have it."""
    return F.col(f"l_{name}") if name in v.labels else F.lit(None).cast("string")


def signature(v: Vector) -> Column:
    """Bytes that order series as their labels do: name, 0xFF, value, by label name."""
    parts = []
    names = sorted(([(NAME, F.col(NAME))] if v.named else []) + [(x, F.col(f"l_{x}")) for x in v.labels], key=lambda p: p[0].encode())
    for name, column in names:
        pair = F.concat(F.lit(name).cast("binary"), F.unhex(F.lit("FF")), column.cast("binary"))
        parts.append(F.coalesce(pair, F.unhex(F.lit(""))))
    return F.concat(*parts) if parts else F.unhex(F.lit(""))
