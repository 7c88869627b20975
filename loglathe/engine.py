"""The public calls: run a program on lines, or an expression on records."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.functions.duration import parse_duration
from loglathe.functions.times import check_range, parse_time
from loglathe.operators import records as rec
from loglathe.operators.records import Records
from loglathe.operators.vectors import NAME, Vector
from loglathe.plans.expr import parse
from loglathe.plans.planner import Options, plan
from loglathe.plans.program import parse_program
from loglathe.sinks import formats


@dataclass(frozen=True)
class Result:
    """What a program gives: entries, records, a vector or a number."""

    value: DataFrame | Records | Vector | float
    spark: SparkSession
    formatter: str | None = None
    #: Entries or records made from lines in order, where that is cheaper than to sort them afterwards.
    in_order: Callable[[], DataFrame | Records] | None = None

    @property
    def df(self) -> DataFrame:
        """As a DataFrame, lazily; labels are columns without a prefix where no name is taken twice."""
        v = self.value
        if isinstance(v, float):
            return self.spark.createDataFrame([(v,)], "value double")
        if isinstance(v, DataFrame):
            return v
        own = v.df
        if isinstance(v, Records):
            return own
        fixed = {"instant", NAME, "value", "points"}
        return own.select([F.col(c).alias(c[2:]) if c.startswith("l_") and c[2:] not in fixed else F.col(c) for c in own.columns])

    def lines(self, verbose: bool = False, interactive: bool = False) -> Iterator[str]:
        """Formatted text, a piece for each entry, record or instant; it streams through the driver."""
        return formats.render(self.in_order() if self.in_order else self.value, self.formatter, verbose, interactive)

    def text(self, verbose: bool = False) -> DataFrame:
        """The same pieces as a DataFrame (text), made and kept by the executors: for large results."""
        if isinstance(self.value, float):
            return self.spark.createDataFrame([(formats.number_text(self.value, self.formatter),)], "text string")
        return formats.texts(self.in_order() if self.in_order else self.value, self.formatter, verbose)


def _options(since, until, interval, lookback, compat: bool) -> Options:
    since = None if since is None else parse_time(since)
    until = None if until is None else parse_time(until)
    check_range(since, until)
    return Options(since, until, interval and parse_duration(interval), lookback and parse_duration(lookback), compat)


def run(program: str, lines: DataFrame, since=None, until=None, interval=None, lookback=None, compat: bool = False) -> Result:
    """A whole program on (line_no, value) rows."""
    p = parse_program(program)
    o = _options(since, until, interval, lookback, compat)
    spark = lines.sparkSession

    def made(rows: DataFrame) -> DataFrame | Records:
        return rec.decode(rows, p.decoder) if p.fields is None else rec.map_entries(rows, p.decoder, p.fields, o.since, o.until)

    if p.query is None:
        # A sort samples what it sorts: lines before they are decoded, so that each is decoded once.
        return Result(made(lines), spark, p.formatter, lambda: made(lines.orderBy("line_no")))
    records = made(lines)
    return Result(plan(records, p.query, o), spark, p.formatter)


def query(expression: str, records: Records, since=None, until=None, interval=None, lookback=None, compat: bool = False) -> Result:
    """An expression on records, such as a table's."""
    o = _options(since, until, interval, lookback, compat)
    return Result(plan(records.within(o.since, o.until), parse(expression), o), records.df.sparkSession)


def rejected(program: str, lines: DataFrame) -> DataFrame:
    """(line_no, value) of the lines that the program's decoder or mapper skips."""
    p = parse_program(program)
    taken = rec.decode(lines, p.decoder) if p.fields is None else rec.map_entries(lines, p.decoder, p.fields).df
    return lines.join(taken.select("line_no"), "line_no", "left_anti")
