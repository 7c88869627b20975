"""Human-readable, JSON and query-API text of results.

Rows are ordered by instant and series, or by line, and the executors write
their text; a task holds one instant at a time. Vectors are dense here:
instants without rows show as empty vectors.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace
from datetime import datetime, timezone
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from loglathe.functions.numbers import json_number, plain
from loglathe.operators.records import Records
from loglathe.operators.vectors import NAME, Vector, signature


def clock(ms: int) -> str:
    """Whole seconds; the fraction always shows as zero."""
    return datetime.fromtimestamp(ms // 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000")


_compact = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


#: Names and label sets come again and again.
_quoted = lru_cache(1024)(_compact)
_quoted_labels = lru_cache(1024)(lambda pairs: _compact(dict(pairs)))


def instants(v: Vector) -> DataFrame:
    """The grid's instants with their series in label order, empty ones too; the rows of one lie in one partition."""
    own = v.df.withColumn("__signature", signature(v)).withColumnRenamed("instant", "__at")
    rows = v.grid().join(own, F.col("instant") == F.col("__at"), "left")
    return rows.repartitionByRange("instant").sortWithinPartitions("instant", "__signature").drop("__signature")


def _labels(v: Vector, r: Row, name: bool = True) -> dict[str, str]:
    out = {x: r[f"l_{x}"] for x in v.labels if r[f"l_{x}"] is not None}
    if name and v.named and r[NAME] is not None:
        out[NAME] = r[NAME]
    return dict(sorted(out.items(), key=lambda p: p[0].encode()))


def _seconds(ms: int) -> str:
    return json_number(ms / 1000)


def promapi_vector(v: Vector, rows: list[Row], at: int) -> str:
    items = []
    for r in rows:
        metric = _compact(_labels(v, r))
        if v.ranged:
            points = ",".join(f"[{_seconds(p['ts'])},{_compact(plain(p['value']))}]" for p in r["points"])
            items.append(f'{{"metric":{metric},"values":[{points}]}}')
        else:
            items.append(f'{{"metric":{metric},"value":[{_seconds(at)},{_compact(plain(r["value"]))}]}}')
    return f'{{"resultType":"{"matrix" if v.ranged else "vector"}","result":[{",".join(items)}]}}'


def promapi_scalar(x: float) -> str:
    return f'{{"resultType":"scalar","result":[0.0,{_compact(plain(x))}]}}'


def _pairs(d: dict[str, str], between: str) -> str:
    return between.join(f"{k}={d[k]}" for k in sorted(d, key=str.encode))


def human_vector(v: Vector, rows: list[Row], at: int, verbose: bool) -> str | None:
    out = []
    for r in rows:
        labels, name = _labels(v, r, False), r[NAME] if v.named else None
        head = f"{clock(at)}\t" + (name or "")
        if labels or not v.named:
            shown = f"{{{_pairs(labels, ', ')}}}\t\t\t" if labels else ""
        else:
            shown = ""
        if v.ranged:
            out.append(head + shown)
            out += [f"\t{plain(p['value'])} @ {clock(p['ts'])}" for p in r["points"]]
        else:
            out.append(head + shown + plain(r["value"]))
    if not out:
        return f"{clock(at)} <no data>" if verbose else None
    return "\n".join(out)


def interactive_vector(v: Vector, rows: list[Row], at: int) -> str:
    """Clears the screen and shows one instant."""
    out = ["\x1b[2J\x1b[1;1H", datetime.fromtimestamp(at // 1000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S"), "-"]
    indent = ""
    for r in rows:
        if v.named and r[NAME] is not None:
            out += [r[NAME], "\n"]
            indent = "\t"
        out.append("\t\t".join([f"{indent}{k}: '{x}'" for k, x in _labels(v, r).items()] + [f"\t\t\t{plain(r['value'])}"]))
    return "\n".join(out)


def _record(names: Records, r: Row) -> tuple[dict[str, str], dict[str, float]]:
    pick = lambda prefix, which: {x: r[prefix + x] for x in which if r[prefix + x] is not None}
    return pick("l_", names.labels), pick("v_", names.values)


def _entry(r: Row, formatter: str | None, verbose: bool) -> str:
    data = r["tuple"] if r["tuple"] is not None else dict(sorted(dict(r["dict"]).items(), key=lambda p: p[0].encode()))
    if formatter == "to_json":
        return _compact({"line": r["line_no"], "data": data}) if verbose else _compact(data)
    text = "\t".join(data) if isinstance(data, list) else _pairs(data, "\t")
    return f"{r['line_no']}: {text}" if verbose else text


def _record_text(names: Records, r: Row, formatter: str | None, verbose: bool) -> str:
    labels, values = _record(names, r)
    if formatter == "to_json":
        parts = ([f'"line":{r["line_no"]}'] if verbose else []) + ([f'"timestamp":{r["ts_ms"]}'] if r["ts_ms"] is not None else [])
        numbers = ",".join(f"{_quoted(k)}:{json_number(x)}" for k, x in values.items())
        return "{" + ",".join([*parts, f'"labels":{_quoted_labels(tuple(labels.items()))}', f'"values":{{{numbers}}}']) + "}"
    parts = [clock(r["ts_ms"])] if r["ts_ms"] is not None else []
    parts += [_pairs(labels, "\t")] if labels else []
    parts += [_pairs({k: plain(x) for k, x in values.items()}, "\t")] if values else []
    text = "\t".join(parts)
    return f"{r['line_no']}: {text}" if verbose else text


#: Characters of text in a batch that goes back to the JVM.
BATCH = 1 << 20


def _batches(texts: Iterable[str]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BATCH or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["text"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["text"])


def _by_executors(df: DataFrame, write: Callable[[Iterator[dict]], Iterable[str]]) -> DataFrame:
    """(text) of each partition's rows, in their order."""
    # A table's texts may hold bytes that aren't UTF-8; they show as U+FFFD.
    valid = [F.make_valid_utf8(c).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes]
    return df.select(valid).mapInArrow(lambda batches: _batches(write(r for b in batches for r in b.to_pylist())), "text string")


def _joined(df: DataFrame, verbose: bool) -> DataFrame:
    """(text) of a pattern's captures, a batch at once: no row of them becomes a Python object."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.binary_join(b.column("tuple").cast(pa.list_(pa.string())), "\t")
            if verbose:
                text = pc.binary_join_element_wise(pc.fill_null(b.column("line_no").cast(pa.string()), "None"), text, ": ")
            yield pa.RecordBatch.from_arrays([text], ["text"])

    return df.select("line_no", "tuple").mapInArrow(write, "text string")


def texts(value: DataFrame | Records | Vector, formatter: str | None, verbose: bool = False, interactive: bool = False) -> DataFrame:
    """(text): one for each entry, record or instant, in order; empty ones aren't given."""
    if interactive and formatter:
        raise ValueError("interactive output can't go through a formatter")
    if interactive and not (isinstance(value, Vector) and not value.ranged):
        raise ValueError("interactive output shows instant vectors only")
    if isinstance(value, Vector):
        v = replace(value, df=None, grid=None)  # the names alone go to the executors

        def one(at: int, rows: list[dict]) -> str | None:
            if interactive:
                return interactive_vector(v, rows, at)
            return promapi_vector(v, rows, at) if formatter else human_vector(v, rows, at, verbose)

        def write(rows: Iterator[dict]) -> Iterator[str]:
            for at, group in groupby(rows, key=lambda r: r["instant"]):
                text = one(at, [r for r in group if r["__at"] is not None])
                if text:
                    yield text

        return _by_executors(instants(value), write)
    if formatter == "to_promapi":
        raise ValueError("to_promapi shows vectors and numbers only: add a select")
    if isinstance(value, Records):
        in_order = lambda which: tuple(sorted(which, key=str.encode))
        names = Records(None, in_order(value.labels), in_order(value.values))
        return _by_executors(value.df.orderBy("line_no"), lambda rows: (_record_text(names, r, formatter, verbose) for r in rows))
    if formatter is None and "dict" not in value.columns:
        return _joined(value.orderBy("line_no"), verbose)
    df = value if "dict" in value.columns else value.withColumn("dict", F.lit(None).cast("map<string,string>"))
    return _by_executors(df.orderBy("line_no"), lambda rows: (_entry(r, formatter, verbose) for r in rows))


def number_text(x: float, formatter: str | None) -> str:
    return promapi_scalar(x) if formatter == "to_promapi" else plain(x)


def render(value: DataFrame | Records | Vector | float, formatter: str | None, verbose: bool = False, interactive: bool = False) -> Iterator[str]:
    """The same texts through the driver, and a number's, in order."""
    if isinstance(value, float) and not interactive:
        yield number_text(value, formatter)
        return
    for r in texts(value, formatter, verbose, interactive).toLocalIterator():
        yield r["text"]


def json_rows(v: Vector) -> DataFrame:
    """A vector as JSON text, a row for each series and instant, made by the executors: for large results."""
    metric = F.map_filter(F.create_map(*[x for c in v.series_columns for x in (F.lit(c.removeprefix("l_")), F.col(c))]), lambda k, x: x.isNotNull()) if v.series_columns else F.create_map()
    body = F.col("points") if v.ranged else F.col("value")
    return v.df.select(F.to_json(F.struct("instant", metric.cast("map<string,string>").alias("metric"), body.alias("points" if v.ranged else "value"))).alias("value"))
