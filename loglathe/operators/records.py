"""Decoding lines and mapping entries to records.

A record has wide nullable columns: ``line_no``, ``ts_ms``, a STRING ``l_x``
for each field that can be a label and a DOUBLE ``v_x`` for each that can be a
value; NULL means absent. Lines that don't decode and records that don't map
are skipped, as filters, so they cost no shuffle and reach no later operator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglathe.functions import patterns, times
from loglathe.functions.numbers import to_number
from loglathe.plans.program import Decoder, Field


@dataclass(frozen=True)
class Records:
    """Mapped rows with the names that can be labels and values."""

    df: DataFrame
    labels: tuple[str, ...]
    values: tuple[str, ...]
    #: Makes them anew within (since, until), where the source can do that before it reads.
    again: Callable[[int | None, int | None], Records] | None = None

    def within(self, since: int | None, until: int | None) -> Records:
        if self.again is not None:
            return self.again(since, until)
        return Records(in_range(self.df, since, until), self.labels, self.values)


def _line(lines: DataFrame) -> Column:
    # Patterns see the line's own end.
    return F.concat(F.col("value"), F.lit("\n"))


def decode(lines: DataFrame, decoder: Decoder) -> DataFrame:
    """(line_no, value) -> (line_no, tuple ARRAY<STRING>) or, of JSON, with dict MAP<STRING, STRING> too."""
    if decoder.pattern is None:
        return _decode_json(lines)
    n = patterns.groups(decoder.pattern)
    return _captures(lines, decoder.pattern, list(range(n or 1))).select("line_no", F.slice("c", 2, n or 1).alias("tuple"))


#: Stands between captures; lines that hold it themselves take a slower way.
_SEAM = "\x01"


def _captures(lines: DataFrame, pattern: str, positions: list[int]) -> DataFrame:
    """(line_no, c): the captures at those positions from place 2 on, of the lines that match; each line is matched once.

    The pattern is replaced by its captures with a seam between, which is split
    again. A generator drops the other lines: a filter would be pushed below
    and match a second time.
    """
    n, line = patterns.groups(pattern), _line(lines)
    numbers = [i + 1 for i in positions]
    joined = F.regexp_replace(line, patterns.around(pattern), "".join(f"{_SEAM}${i}" for i in numbers))
    p = patterns.search(pattern)
    slow = F.when(line.rlike(p), F.array(F.lit(""), *[F.regexp_extract(line, p, i if n else 0) for i in numbers]))
    parts = F.when(F.contains("value", F.lit(_SEAM)), slow).otherwise(F.split(joined, _SEAM, -1))
    found = F.filter(F.array(parts), lambda c: F.size(c) > len(numbers))
    return lines.select("line_no", F.explode(found).alias("c"))


def _flat(kind: Column) -> Column:
    return ~(kind.startswith("ARRAY") | kind.startswith("OBJECT"))


def _decode_json(lines: DataFrame) -> DataFrame:
    """Objects and arrays; nested values go (of an array, later ones move up), null is the text ``null``."""
    text = F.trim(F.col("value"))
    whole = lines.select("line_no", "value", F.try_parse_json("value").alias("v"), text.substr(1, 1).alias("c")).where(F.col("v").isNotNull() & F.col("c").isin("{", "["))
    both = whole.select(
        "line_no",
        "c",
        F.when(F.col("c") == "{", F.from_json("value", "map<string,string>")).alias("m"),
        F.when(F.col("c") == "{", F.try_variant_get("v", "$", "map<string,variant>")).alias("mk"),
        F.when(F.col("c") == "[", F.from_json("value", "array<string>")).alias("a"),
        F.when(F.col("c") == "[", F.try_variant_get("v", "$", "array<variant>")).alias("ak"),
    )
    kept = F.map_filter("m", lambda k, v: F.coalesce(_flat(F.schema_of_variant(F.element_at("mk", k))), F.lit(True)))
    flat = F.filter(F.arrays_zip("a", F.transform("ak", lambda v: F.schema_of_variant(v)).alias("k")), lambda x: F.coalesce(_flat(x["k"]), F.lit(True)))
    return both.select(
        "line_no",
        F.transform(flat, lambda x: F.coalesce(x["a"], F.lit("null"))).alias("tuple"),
        F.transform_values(kept, lambda k, v: F.coalesce(v, F.lit("null"))).alias("dict"),
    )


def map_entries(lines: DataFrame, decoder: Decoder, fields: tuple[Field, ...], since: int | None = None, until: int | None = None) -> Records:
    """Lines to records; only the captures that fields use are taken from a line."""
    if decoder.pattern is not None:
        n = max(patterns.groups(decoder.pattern), 1)
        used = sorted({f.position for f in fields if f.position is not None and f.position < n}) or [0]
        rows = _captures(lines, decoder.pattern, used)

        def get(f: Field) -> Column:
            if f.position not in used:
                return F.lit(None).cast("string")
            return F.get("c", used.index(f.position) + 1)
    else:
        rows = _decode_json(lines)

        def get(f: Field) -> Column:
            if f.position is not None:
                return F.try_element_at("tuple", F.lit(f.position + 1))
            return F.try_element_at("dict", F.lit(f.source))

    # Extracted once, below: expressions used more than once aren't merged into what uses them.
    taken = [f for f in fields if f.type != "const"]
    raws = {f.name: f"__raw_{i}" for i, f in enumerate(taken)}
    rows = rows.select("line_no", *[get(f).alias(raws[f.name]) for f in taken])
    for c in raws.values():
        rows = rows.where(F.col(c).isNotNull())

    columns = [F.col("line_no")]
    labels, values = [], []
    ts = F.lit(None).cast("long")
    for f in fields:
        if f.type == "const":
            columns.append(F.lit(f.value).alias(f"l_{f.name}"))
            labels.append(f.name)
            continue
        raw = F.col(raws[f.name])
        if f.type == "ts":
            ts = times.by_format(raw, f.format) if f.format else times.detect(raw)
        elif f.type == "str":
            columns.append(raw.alias(f"l_{f.name}"))
            labels.append(f.name)
        elif f.type == "num":
            columns.append(to_number(raw).alias(f"v_{f.name}"))
            values.append(f.name)
        else:
            number = to_number(raw)
            columns += [F.when(number.isNull(), raw).alias(f"l_{f.name}"), number.alias(f"v_{f.name}")]
            labels.append(f.name)
            values.append(f.name)
    out = rows.select(*columns, ts.alias("ts_ms"))
    for f in fields:
        if f.type == "ts":
            out = out.where(F.col("ts_ms").isNotNull())
        elif f.type == "num":
            out = out.where(F.col(f"v_{f.name}").isNotNull())
    return Records(in_range(out, since, until), tuple(labels), tuple(values))


def in_range(df: DataFrame, since: int | None, until: int | None) -> DataFrame:
    """Both ends count; records without a timestamp pass."""
    if since is not None:
        df = df.where(F.col("ts_ms").isNull() | (F.col("ts_ms") >= since))
    if until is not None:
        df = df.where(F.col("ts_ms").isNull() | (F.col("ts_ms") <= until))
    return df


def _later(a: int | None, b: int | None) -> int | None:
    return a if b is None else b if a is None else max(a, b)


def _sooner(a: int | None, b: int | None) -> int | None:
    return a if b is None else b if a is None else min(a, b)


def from_table(df: DataFrame, ts: str, labels: list[str], values: list[str], line_no: str | Column | None = None, since: int | None = None, until: int | None = None) -> Records:
    """A structured table as records, without text between; bounds go to the scan as a filter on ``ts`` (rows without one don't pass it)."""
    from datetime import datetime, timezone

    whole, kind = df, df.schema[ts].dataType.simpleString()
    stamp = F.col(ts).cast("timestamp") if kind != "bigint" else None
    if stamp is not None and kind in ("timestamp_ntz", "date", "timestamp"):
        for bound, late in ((since, False), (until, True)):
            if bound is not None:
                at = datetime.fromtimestamp((bound + late) / 1000, timezone.utc)
                edge = F.lit(at.replace(tzinfo=None)).cast("timestamp_ntz") if kind == "timestamp_ntz" else F.lit(at.isoformat()).cast("timestamp")
                if kind != "date":
                    df = df.where((F.col(ts) < edge) if late else (F.col(ts) >= edge))
    ms = F.unix_millis(stamp) if stamp is not None else F.col(ts)
    number = F.lit(None).cast("long") if line_no is None else (F.col(line_no) if isinstance(line_no, str) else line_no).cast("long")
    given = (ts, labels, values, line_no)
    out = df.select(number.alias("line_no"), ms.alias("ts_ms"), *[F.col(c).cast("string").alias(f"l_{c}") for c in labels], *[F.col(c).cast("double").alias(f"v_{c}") for c in values])
    exact = kind in ("timestamp", "timestamp_ntz")
    return Records(out if exact else in_range(out, since, until), tuple(labels), tuple(values), lambda a, b: from_table(whole, *given, _later(since, a), _sooner(until, b)))
