"""Example queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglathe.cli import main
from loglathe.engine import query, run
from loglathe.errors import ProgramError
from loglathe.operators.records import Records, from_table
from loglathe.plans.program import parse_program
from loglathe.sinks.formats import json_rows
from loglathe.sources import tables
from loglathe.sources.lines import read_lines
from loglathe.streaming.windows import stream

HOUR, DAY = 3_600_000, 86_400_000
JAN = 1_704_067_200_000  # 2024-01-01
Y1992 = 694_224_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EVENTS = "SELECT event_type, user_id::VARCHAR AS user_id, value, epoch_us(ts) // 1000 AS ms, event_id + 1 AS line FROM events"
LINEITEM = "SELECT l_returnflag, l_linestatus, l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice, epoch_us(l_shipdate::TIMESTAMP) // 1000 AS ms, l_orderkey * 8 + l_linenumber AS line FROM lineitem"
ORDERS = "SELECT o_orderstatus, o_orderpriority, o_totalprice::DOUBLE AS o_totalprice, epoch_us(o_orderdate::TIMESTAMP) // 1000 AS ms, o_orderkey AS line FROM orders"
BOTH = ["event_type", "user_id"]


def _flat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Values rounded, as sums of floats depend on their order; names shown as ``metric``."""
    cols = [F.round(c, digits).alias(c) if c == "value" else F.col(c).alias("metric") if c == "__name__" else F.col(c) for c in df.columns]
    return df.select(cols)


def window_sql(base: str, value: str, aggregate: str, labels: list[str], lookback: int, interval: int, where: str = "TRUE", since: int | None = None) -> str:
    """The grid written out: instants joined to the samples in reach."""
    t0 = str(since) if since is not None else "min(ms)"
    late = f" AND ms >= {since}" if since is not None else ""
    cols = "".join(f", {c}" for c in labels)
    return f"""
WITH s AS (SELECT *, {value} AS x FROM ({base}) WHERE ({where}){late}),
o AS (SELECT {t0} + least({lookback}, {interval}) - 1 AS i0, max(ms) AS t1 FROM s),
g AS (SELECT i0 + k * {interval} AS instant FROM o, range(0, 100000) r(k) WHERE i0 + k * {interval} < t1 + {lookback})
SELECT instant{cols}, {aggregate} AS value FROM s JOIN g ON ms > instant - {lookback} AND ms <= instant GROUP BY instant{cols}"""


def _events(expression: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _flat(query(expression, tables.events(spark, d), **options).df)


def _add(name: str, run_it: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLES[name] = run_it, sql


def _wrap(inner: str, select: str, tail: str = "") -> str:
    return f"SELECT {select} FROM ({inner}) AS v {tail}"


R = "round(value, 6) AS value"
LAST = "arg_max(x, ms * 1000000 + line)"
IN_WINDOW = {"count": "count(*)::DOUBLE", "sum": "sum(x)", "min": "min(x)", "max": "max(x)", "avg": "avg(x)", "last": LAST}


def _sum_day(where: str = "TRUE", labels: list[str] = BOTH) -> str:
    return window_sql(EVENTS, "value", "sum(x)", labels, DAY, DAY, where, JAN)


DAYS = "sum_over_time(value[1d])"

# Over-time functions: tumbling, in panes, spread, and with gaps.
_add("flagship", _events("sum(count_over_time(value[1h])) by (event_type)"), window_sql(EVENTS, "value", "count(*)::DOUBLE", ["event_type"], HOUR, HOUR))
for _n, _sql in IN_WINDOW.items():
    _add(f"{_n}_over_time_tumbling", _events(f"{_n}_over_time(value[1d])"), _wrap(window_sql(EVENTS, "value", _sql, BOTH, DAY, DAY), f"instant, event_type, user_id, {R}"))
    _add(f"{_n}_over_time_sliding", _events(f"{_n}_over_time(value[6h])", interval="1h"), _wrap(window_sql(EVENTS, "value", _sql, BOTH, 6 * HOUR, HOUR), f"instant, event_type, user_id, {R}"))
_add("window_not_in_panes", _events("sum_over_time(value[5h])", interval="2h"), _wrap(window_sql(EVENTS, "value", "sum(x)", BOTH, 5 * HOUR, 2 * HOUR), f"instant, event_type, user_id, {R}"))
_add("window_with_gaps", _events("count_over_time(value[1h])", interval="6h"), window_sql(EVENTS, "value", "count(*)::DOUBLE", BOTH, HOUR, 6 * HOUR))
_add("line_numbers", _events("max_over_time(__line__[1d])"), window_sql(EVENTS, "line::DOUBLE", "max(x)", BOTH, DAY, DAY))

# Selectors and matchers, instants and ranges.
for _n, _m, _w in (
    ("equal", 'event_type="click"', "event_type = 'click'"),
    ("not_equal", 'event_type!="click"', "event_type <> 'click'"),
    ("regex", 'event_type=~"c.*|view"', "regexp_full_match(event_type, 'c.*|view')"),
    ("not_regex", 'event_type!~"c.*|view"', "NOT regexp_full_match(event_type, 'c.*|view')"),
    ("two_matchers", 'event_type=~"p.*|c.*",user_id!~"1.*"', "regexp_full_match(event_type, 'p.*|c.*') AND NOT regexp_full_match(user_id, '1.*')"),
    ("no_such_label", 'region!="x",event_type=~".+"', "FALSE"),
):
    _add(f"selector_{_n}", _events(f"value{{{_m}}}", interval="1h"), _wrap(window_sql(EVENTS, "value", LAST, BOTH, HOUR, HOUR, _w), f"instant, 'value' AS metric, event_type, user_id, {R}"))
_add("selector_lookback", _events("value", interval="1h", lookback="3h"), _wrap(window_sql(EVENTS, "value", LAST, BOTH, 3 * HOUR, HOUR), f"instant, 'value' AS metric, event_type, user_id, {R}"))
_add("selector_by_name", _events('{__name__=~"val.*"}', interval="1d"), _wrap(window_sql(EVENTS, "value", LAST, BOTH, DAY, DAY), f"instant, 'value' AS metric, event_type, user_id, {R}"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    df = query('value{event_type="click"}[1d]', tables.events(spark, d)).df
    return df.select("instant", "event_type", "user_id", F.posexplode("points").alias("place", "p")).select("instant", "event_type", "user_id", "place", F.col("p.ts").alias("at"), F.round("p.value", 6).alias("value"))


_add("range_selector", _points, f"""
WITH s AS (SELECT * FROM ({EVENTS}) WHERE event_type = 'click'),
o AS (SELECT min(ms) + {DAY} - 1 AS i0, max(ms) AS t1 FROM s),
g AS (SELECT i0 + k * {DAY} AS instant FROM o, range(0, 10000) r(k) WHERE i0 + k * {DAY} < t1 + {DAY})
SELECT instant, event_type, user_id, (row_number() OVER (PARTITION BY instant, event_type, user_id ORDER BY ms, line) - 1)::INTEGER AS place, ms AS at, round(value, 6) AS value
FROM s JOIN g ON ms > instant - {DAY} AND ms <= instant""")

# Time range.
_add("since_until", _events("sum(sum_over_time(value[1d])) by (event_type)", since="2024-01-05T00:00:00Z", until="2024-01-15T12:00:00Z"), _wrap(window_sql(EVENTS, "value", "sum(x)", ["event_type"], DAY, DAY, "ms <= 1705320000000", 1_704_412_800_000), f"instant, event_type, {R}"))

# Aggregation across series.
for _n, _sql in (("sum", "sum(value)"), ("min", "min(value)"), ("max", "max(value)"), ("avg", "avg(value)"), ("count", "count(*)::DOUBLE"), ("group", "1.0::DOUBLE"), ("stddev", "stddev_pop(value)"), ("stdvar", "var_pop(value)")):
    for _mod, _keys in (("", []), (" by (event_type)", ["event_type"]), (" without (event_type)", ["user_id"])):
        _cols = "".join(f", {k}" for k in _keys)
        _suffix = {"": "all", " by (event_type)": "by", " without (event_type)": "without"}[_mod]
        _add(f"agg_{_n}_{_suffix}", _events(f"{_n}({DAYS}){_mod}", since=JAN), _wrap(_sum_day(), f"instant{_cols}, round({_sql}, 6) AS value", f"GROUP BY instant{_cols}"))
_add("agg_quantile_by", _events(f"quantile(0.9, {DAYS}) by (event_type)", since=JAN), _wrap(_sum_day(), "instant, event_type, round(quantile_cont(value, 0.9), 6) AS value", "GROUP BY instant, event_type"))
_add("agg_count_values", _events('count_values("times", count_over_time(value[1d])) by (event_type)', since=JAN), _wrap(window_sql(EVENTS, "value", "count(*)", BOTH, DAY, DAY, "TRUE", JAN), "instant, event_type, value::VARCHAR AS times, count(*)::DOUBLE AS value", "GROUP BY instant, event_type, v.value"))
for _n, _way in (("topk", "DESC"), ("bottomk", "ASC")):
    for _mod, _keys in (("", ""), (" by (event_type)", ", event_type")):
        _ranked = _wrap(_sum_day(), f"*, row_number() OVER (PARTITION BY instant{_keys} ORDER BY value {_way}, event_type, user_id) AS n")
        _add(f"agg_{_n}_{'by' if _mod else 'all'}", _events(f"{_n}(3, {DAYS}){_mod}", since=JAN), f"SELECT instant, event_type, user_id, {R} FROM ({_ranked}) WHERE n <= 3")

# Numbers on one side.
for _n, _op, _sql in (("add", "+ 2.5", "value + 2.5"), ("sub", "- 2.5", "value - 2.5"), ("mul", "* 8", "value * 8"), ("div", "/ 1000", "value / 1000"), ("mod", "% 7", "value % 7"), ("pow", "^ 2", "value ^ 2")):
    _add(f"scalar_{_n}", _events(f"{DAYS} {_op}", since=JAN), _wrap(_sum_day(), f"instant, event_type, user_id, round({_sql}, 6) AS value"))
_add("scalar_first", _events(f"1000 - {DAYS} * 2 ^ 3", since=JAN), _wrap(_sum_day(), "instant, event_type, user_id, round(1000 - value * 8, 6) AS value"))
_add("scalar_divide_by_zero", _events(f"sum(count_over_time(value[1d])) / 0 > 1", since=JAN), _wrap(window_sql(EVENTS, "value", "count(*)", [], DAY, DAY, "TRUE", JAN), "instant, 'inf'::DOUBLE AS value"))
for _n, _op, _sql in (("eq", "==", "="), ("ne", "!=", "<>"), ("ge", ">=", ">="), ("gt", ">", ">"), ("lt", "<", "<"), ("le", "<=", "<=")):
    _counts = window_sql(EVENTS, "value", "count(*)::DOUBLE", BOTH, DAY, DAY, "TRUE", JAN)
    _add(f"compare_{_n}", _events(f"count_over_time(value[1d]) {_op} 2", since=JAN), _wrap(_counts, "*", f"WHERE value {_sql} 2"))
    _add(f"compare_{_n}_bool", _events(f"count_over_time(value[1d]) {_op} bool 2", since=JAN), _wrap(_counts, f"* REPLACE ((value {_sql} 2)::INTEGER::DOUBLE AS value)"))
_add("compare_keeps_name", _events("50 > value", interval="1d"), _wrap(window_sql(EVENTS, "value", LAST, BOTH, DAY, DAY), f"instant, 'value' AS metric, event_type, user_id, {R}", "WHERE value < 50"))
_add("scalar_only", _events("(1 + 2) * 3 > bool 2 ^ 3"), "SELECT 1.0::DOUBLE AS value")
_add("unary_minus_keeps_name", _events("-value", interval="1d"), _wrap(window_sql(EVENTS, "value", LAST, BOTH, DAY, DAY), "instant, 'value' AS metric, event_type, user_id, round(-value, 6) AS value"))

# Two vectors.
CLICK, VIEW = 'sum_over_time(value{event_type="click"}[1d])', 'sum_over_time(value{event_type="view"}[1d])'
_click, _view = _sum_day("event_type = 'click'"), _sum_day("event_type = 'view'")
_by_user = "a.instant = b.instant AND a.user_id = b.user_id"
_add("join_ignoring", _events(f"{CLICK} + ignoring (event_type) {VIEW}", since=JAN), f"SELECT a.instant, a.user_id, round(a.value + b.value, 6) AS value FROM ({_click}) a JOIN ({_view}) b ON {_by_user}")
_add("join_on", _events(f"{CLICK} / on (user_id) {VIEW}", since=JAN), f"SELECT a.instant, a.user_id, round(a.value / b.value, 6) AS value FROM ({_click}) a JOIN ({_view}) b ON {_by_user}")
_add("join_default", _events(f"{DAYS} / count_over_time(value[1d])", since=JAN), _wrap(window_sql(EVENTS, "value", "avg(x)", BOTH, DAY, DAY, "TRUE", JAN), f"instant, event_type, user_id, {R}"))
_add("join_on_nothing", _events(f"sum({CLICK}) - on () sum({VIEW})", since=JAN), f"SELECT a.instant, round(a.value - b.value, 6) AS value FROM (SELECT instant, sum(value) AS value FROM ({_click}) GROUP BY 1) a JOIN (SELECT instant, sum(value) AS value FROM ({_view}) GROUP BY 1) b ON a.instant = b.instant")
_add("join_compare", _events(f"{CLICK} > ignoring (event_type) {VIEW}", since=JAN), f"SELECT a.instant, a.user_id, round(a.value, 6) AS value FROM ({_click}) a JOIN ({_view}) b ON {_by_user} WHERE a.value > b.value")
_add("join_compare_bool", _events(f"{CLICK} <= bool ignoring (event_type) {VIEW}", since=JAN), f"SELECT a.instant, a.user_id, (a.value <= b.value)::INTEGER::DOUBLE AS value FROM ({_click}) a JOIN ({_view}) b ON {_by_user}")
_total = _wrap(_sum_day(), "instant, user_id, sum(value) AS value", "GROUP BY instant, user_id")
_add("join_group_left", _events(f"{DAYS} / on (user_id) group_left () sum({DAYS}) by (user_id)", since=JAN), f"SELECT a.instant, a.event_type, a.user_id, round(a.value / b.value, 6) AS value FROM ({_sum_day()}) a JOIN ({_total}) b ON {_by_user}")
_add("join_group_right", _events(f"sum({DAYS}) by (user_id) - on (user_id) group_right () {DAYS}", since=JAN), f"SELECT a.instant, a.event_type, a.user_id, round(b.value - a.value, 6) AS value FROM ({_sum_day()}) a JOIN ({_total}) b ON {_by_user}")
_add("set_and", _events(f"{CLICK} and ignoring (event_type) {VIEW}", since=JAN), f"SELECT instant, event_type, user_id, {R} FROM ({_click}) a WHERE EXISTS (FROM ({_view}) b WHERE {_by_user})")
_add("set_unless", _events(f"{CLICK} unless ignoring (event_type) {VIEW}", since=JAN), f"SELECT instant, event_type, user_id, {R} FROM ({_click}) a WHERE NOT EXISTS (FROM ({_view}) b WHERE {_by_user})")
_add("set_or", _events(f"{CLICK} or ignoring (event_type) {VIEW}", since=JAN), f"SELECT instant, event_type, user_id, {R} FROM ({_click}) UNION ALL SELECT instant, event_type, user_id, {R} FROM ({_view}) a WHERE NOT EXISTS (FROM ({_click}) b WHERE {_by_user})")

# Other functions.
for _n, _e, _sql in (("clamp", f"clamp({DAYS}, 50, 150)", "greatest(least(value, 150), 50)"), ("clamp_min", f"clamp_min({DAYS}, 50)", "greatest(value, 50)"), ("clamp_max", f"clamp_max({DAYS}, 150)", "least(value, 150)")):
    _add(_n, _events(_e, since=JAN), _wrap(_sum_day(), f"instant, event_type, user_id, round({_sql}, 6) AS value"))
_add("label_replace", _events(f'label_replace({DAYS}, "tens", "$1x", "user_id", "([0-9])[0-9]")', since=JAN), _wrap(_sum_day(), f"instant, event_type, user_id, CASE WHEN regexp_full_match(user_id, '[0-9][0-9]') THEN user_id[1] || 'x' END AS tens, {R}"))
_add("vector", _events("vector(2 ^ 3)", interval="1d", since=JAN), f"SELECT {JAN} + {DAY} - 1 + k * {DAY} AS instant, 8.0::DOUBLE AS value FROM (SELECT max(ms) AS t1 FROM ({EVENTS})), range(0, 10000) r(k) WHERE {JAN} - 1 + k * {DAY} < t1")

# Text in front: lines decoded by a regular expression or as JSON.
TEXT = "SELECT event_id + 1 AS line, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type, value FROM events"


def _lines(spark: SparkSession, d: str, *parts) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") + 1).alias("line_no"), F.concat_ws(" ", *parts).alias("value"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "event_type", F.col("value").cast("string"))


_LOG = r'/^(\S+) (\w+) (\S+)$/ | map { .0:ts "%Y-%m-%dT%H:%M:%S", .1 as kind, .2 as amount, source: "events" }'


def _records_of(program: str, lines: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def go(spark: SparkSession, d: str) -> DataFrame:
        r = run(program, lines(spark, d)).value
        assert isinstance(r, Records)
        return r.df

    return go


_add("decode_regex", lambda s, d: run(r"/(\w+) ([0-9]+)[.]/", _log(s, d)).df.select("line_no", F.col("tuple")[0].alias("a"), F.col("tuple")[1].alias("b")), "SELECT event_id + 1 AS line_no, event_type AS a, regexp_extract(value::VARCHAR, '^[0-9]+') AS b FROM events WHERE value::VARCHAR LIKE '%.%'")
_add("map_regex", _records_of(_LOG, _log), "SELECT event_id + 1 AS line_no, event_type AS l_kind, NULL::VARCHAR AS l_amount, NULL::DOUBLE AS v_kind, value AS v_amount, 'events' AS l_source, epoch_us(date_trunc('second', ts)) // 1000 AS ts_ms FROM events")
_add("program_regex", lambda s, d: _flat(run(f"{_LOG} | select sum(sum_over_time(amount[1d])) by (kind)", _log(s, d), since=JAN).df), _wrap(window_sql("SELECT event_type AS kind, value, epoch_us(date_trunc('second', ts)) // 1000 AS ms, event_id AS line FROM events", "value", "sum(x)", ["kind"], DAY, DAY, "TRUE", JAN), f"instant, kind, {R}"))


def _json(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") + 1).alias("line_no"), F.col("props").alias("value"))


_add("decode_json", lambda s, d: run("json", _json(s, d)).df.select("line_no", F.col("dict")["k"].alias("k")), "SELECT event_id + 1 AS line_no, json_extract_string(props, '$.k') AS k FROM events")
_add("map_json", _records_of('json | map { .k:num as k, from: "props" }', _json), "SELECT event_id + 1 AS line_no, json_extract_string(props, '$.k')::DOUBLE AS v_k, 'props' AS l_from, NULL::BIGINT AS ts_ms FROM events")

# Other tables.
_add("lineitem_sum", lambda s, d: _flat(query("sum(sum_over_time(l_quantity[52w])) by (l_returnflag, l_linestatus)", tables.lineitem(s, d), since=Y1992).df), _wrap(window_sql(LINEITEM, "l_quantity", "sum(x)", ["l_returnflag", "l_linestatus"], 364 * DAY, 364 * DAY, "TRUE", Y1992), "instant, l_returnflag, l_linestatus, round(value, 6) AS value"))
_add("lineitem_price_sliding", lambda s, d: _flat(query("sum_over_time(l_extendedprice[12w])", tables.lineitem(s, d), since=Y1992, interval="4w").df), _wrap(window_sql(LINEITEM, "l_extendedprice", "sum(x)", ["l_returnflag", "l_linestatus"], 84 * DAY, 28 * DAY, "TRUE", Y1992), "instant, l_returnflag, l_linestatus, round(value, 6) AS value"))
_add("orders_top", lambda s, d: _flat(query("topk(2, max_over_time(o_totalprice[52w])) by (o_orderstatus)", tables.orders(s, d), since=Y1992).df), f"SELECT instant, o_orderstatus, o_orderpriority, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY instant, o_orderstatus ORDER BY value DESC, o_orderpriority) AS n FROM ({window_sql(ORDERS, 'o_totalprice', 'max(x)', ['o_orderpriority', 'o_orderstatus'], 364 * DAY, 364 * DAY, 'TRUE', Y1992)})) WHERE n <= 2")

# Text files as the source, in order of their names and whatever their sizes.
def _scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    top = (top or f"file://{tempfile.mkdtemp(prefix='loglathe-')}").rstrip("/")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top}/loglathe-text/{uuid.uuid4().hex}")
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return path.toString()


#: Lines of a file, so that no task sorts more, however many there are.
FILE_LINES = 250_000


def _files(spark: SparkSession, d: str) -> str:
    """The log of events as text of unequal sizes: two files, and a folder of files in order for the rest."""
    top, log = _scratch(spark), _log(spark, d)
    rest = F.col("line_no") > 700
    files = log.where(rest).count() // FILE_LINES + 1
    for name, rows, n in (("a", F.col("line_no") <= 30, 1), ("b", (F.col("line_no") > 30) & (F.col("line_no") <= 700), 1), ("c", rest, files)):
        log.where(rows).repartitionByRange(n, "line_no").sortWithinPartitions("line_no").select("value").write.text(f"{top}/{name}")
    return f"{top}/*"


LOG_TEXT = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || event_type || ' ' || value::VARCHAR"
LOG_ROWS = "SELECT event_type AS kind, value, epoch_us(date_trunc('second', ts)) // 1000 AS ms, event_id AS line FROM events"
CLOCK = "strftime(make_timestamp(instant * 1000), '%Y-%m-%dT%H:%M:%S.000')"
_add("source_text", lambda s, d: read_lines(s, _files(s, d)), f"SELECT event_id + 1 AS line_no, {LOG_TEXT} AS value FROM events")


def _rows(texts: DataFrame) -> DataFrame:
    """Formatted text as rows, a line each."""
    return texts.select(F.explode(F.split("text", "\n")).alias("text"))


def _cli(spark: SparkSession, d: str) -> DataFrame:
    out = io.StringIO()
    assert main([f"{_LOG} | select sum(count_over_time(amount[1d])) by (kind)", _files(spark, d), "--since", "2024-01-03T00:00:00Z", "--until", "2024-01-09T23:59:59Z", "--interval", "2d"], stdout=out, spark=spark) == 0
    return _rows(spark.createDataFrame([(out.getvalue().rstrip("\n"),)], "text string"))  # a line for each kind and instant of a fixed time


_counts_by_kind = window_sql(LOG_ROWS, "value", "count(*)", ["kind"], DAY, 2 * DAY, f"ms <= {JAN + 9 * DAY - 1000}", JAN + 2 * DAY)
_add("cli_program", _cli, _wrap(_counts_by_kind, f"{CLOCK} || chr(9) || '{{kind=' || kind || '}}' || chr(9) || chr(9) || chr(9) || value AS text"))

# Mapping: detected times in several spellings, text kept as text, arrays.
def _spelt(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose time is spelt in one of five ways."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    ways = [F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), seconds.cast("string"), (seconds * 1000).cast("string"), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss '+0000'")]
    return _lines(spark, d, F.concat(F.lit("["), F.element_at(F.array(*ways), (F.col("event_id") % 5 + 1).cast("int")), F.lit("]")), "event_type")


_add("map_detected_times", _records_of(r"/^\[(.*)\] (\w+)$/ | map { .0:ts, .1 as kind }", _spelt), "SELECT event_id + 1 AS line_no, event_type AS l_kind, NULL::DOUBLE AS v_kind, epoch_us(date_trunc('second', ts)) // 1000 AS ts_ms FROM events")
_add("map_text", _records_of(r"/(\w+) (\d+)/ | map { .0:str as kind, .1:str as user }", lambda s, d: _lines(s, d, "event_type", "user_id")), "SELECT event_id + 1 AS line_no, event_type AS l_kind, user_id::VARCHAR AS l_user, NULL::BIGINT AS ts_ms FROM events")
_add("decode_json_array", lambda s, d: run("json", _lines(s, d, F.format_string('["%s", [1, 2], %d, null, {"a": 1}, true]', "event_type", "user_id"))).df.select("line_no", F.array_join("tuple", "|").alias("parts")), "SELECT event_id + 1 AS line_no, event_type || '|' || user_id || '|null|true' AS parts FROM events")
_add("unary_plus", _events("+value", interval="1d"), _wrap(window_sql(EVENTS, "value", LAST, BOTH, DAY, DAY), f"instant, 'value' AS metric, event_type, user_id, {R}"))

# Matching: included labels, more operators, series that match twice.
_tens = "CASE WHEN regexp_full_match(a.user_id, '[0-9][0-9]') THEN a.user_id[1] || 'x' END"
_add("join_group_left_include", _events(f'{DAYS} * on (user_id) group_left (tens) label_replace(sum({DAYS}) by (user_id), "tens", "$1x", "user_id", "([0-9])[0-9]")', since=JAN), f"SELECT a.instant, a.event_type, a.user_id, {_tens} AS tens, round(a.value * b.value, 6) AS value FROM ({_sum_day()}) a JOIN ({_total}) b ON {_by_user}")
_click_n, _view_n = (window_sql(EVENTS, "value", "count(*)::DOUBLE", BOTH, DAY, DAY, f"event_type = '{t}'", JAN) for t in ("click", "view"))
for _n, _op, _sql in (("mod", "%", "a.value % b.value"), ("pow", "^", "a.value ^ b.value")):
    _add(f"join_{_n}", _events(f'count_over_time(value{{event_type="click"}}[1d]) {_op} ignoring (event_type) count_over_time(value{{event_type="view"}}[1d])', since=JAN), f"SELECT a.instant, a.user_id, {_sql} AS value FROM ({_click_n}) a JOIN ({_view_n}) b ON {_by_user}")


def _failures(spark: SparkSession, cases) -> DataFrame:
    """(name, failed with): an error class for each case, empty where it runs."""
    out = []
    for name, go in cases:
        try:
            go()
            out.append((name, ""))
        except ProgramError as e:
            out.append((name, type(e).__name__))
        except Exception as e:
            out.append((name, "duplicates" if "match" in str(e) else type(e).__name__))
    return spark.createDataFrame(out, "name string, failed string")


def _duplicates(spark: SparkSession, d: str) -> DataFrame:
    of = lambda e: lambda: query(e, tables.events(spark, d), since=JAN).df.count()
    return _failures(spark, (("right", of(f"sum({DAYS}) by (user_id) + on (user_id) {DAYS}")), ("left", of(f"{DAYS} + on (user_id) sum({DAYS}) by (user_id)")), ("none", of(f"{DAYS} + on (user_id, event_type) {DAYS}"))))


_add("join_duplicates", _duplicates, "SELECT * FROM (VALUES ('right', 'duplicates'), ('left', 'duplicates'), ('none', '')) v(name, failed)")

_BAD = (
    ("a field named twice", "json | map { .a as x, .b as x }", "ProgramError"),
    ("two timestamps", "json | map { .a:ts, .b:ts }", "ProgramError"),
    ("an empty matcher alone", 'json | map { .a as x } | select {x=""}', "ProgramError"),
    ("a malformed pattern", 'json | map { .a as x } | select x{y=~"("}', "ProgramError"),
    ("a look-around", "/(?=a)/", "ProgramError"),
    ("bool on a number's side only", "json | map { .a as x } | select x + bool x", "KindError"),
    ("a range in a sum", "json | map { .a as x } | select sum(x[1m])", "KindError"),
    ("a sign on a range", "json | map { .a as x } | select -x[1m]", "KindError"),
    ("a sign on a number", "json | map { .a as x } | select -(1 + 2) + x", ""),
    ("a set of a number", "json | map { .a as x } | select x and 1", "KindError"),
    ("a comparison of numbers without bool", "json | map { .a as x } | select 1 > 2", "KindError"),
)
_add("validation", lambda s, d: _failures(s, [(n, partial(parse_program, p)) for n, p, _ in _BAD] + [("a range that ends before it begins", partial(query, "value", tables.events(s, d), since=2000, until=1000))]), "SELECT * FROM (VALUES " + ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', '{k}')" for n, _, k in (*_BAD, ("a range that ends before it begins", "", "ProgramError"))) + ") v(name, failed)")

# Formatted text, dense over the grid: instants without series show too.
_RARE = 'count_over_time(value{event_type="purchase",user_id=~"1.?"}[6h])'
_rare = window_sql(EVENTS, "value", "count(*)", BOTH, HOUR * 6, HOUR * 6, "event_type = 'purchase' AND regexp_full_match(user_id, '1.?')", JAN)
_grid = f"SELECT {JAN} + {6 * HOUR} - 1 + k * {6 * HOUR} AS instant FROM (SELECT max(ms) AS t1 FROM ({EVENTS}) WHERE event_type = 'purchase' AND regexp_full_match(user_id, '1.?')), range(0, 10000) r(k) WHERE {JAN} - 1 + k * {6 * HOUR} < t1"
_add("text_human_dense", lambda s, d: _rows(query(_RARE, tables.events(s, d), since=JAN).text(verbose=True)), f"SELECT {CLOCK} || coalesce(chr(9) || '{{event_type=purchase, user_id=' || user_id || '}}' || chr(9) || chr(9) || chr(9) || value, ' <no data>') AS text FROM ({_grid}) LEFT JOIN ({_rare}) USING (instant)")
_both = f"{_RARE} + {_RARE}"
_add("text_human_dense_join", lambda s, d: _rows(query(_both, tables.events(s, d), since=JAN).text(verbose=True)), f"SELECT {CLOCK} || coalesce(chr(9) || '{{event_type=purchase, user_id=' || user_id || '}}' || chr(9) || chr(9) || chr(9) || 2 * value, ' <no data>') AS text FROM ({_grid}) LEFT JOIN ({_rare}) USING (instant)")
_day_kinds = window_sql(LOG_ROWS, "value", "count(*)", ["kind"], DAY, DAY, "TRUE", JAN)
_item = """'{"metric":{"kind":"' || kind || '"},"value":[' || (instant // 1000) || '.999,"' || value || '"]}'"""
_add("text_promapi", lambda s, d: _rows(run(f"{_LOG} | select sum(count_over_time(amount[1d])) by (kind) | to_promapi", _log(s, d), since=JAN).text()), f"""SELECT '{{"resultType":"vector","result":[' || string_agg({_item}, ',' ORDER BY kind) || ']}}' AS text FROM ({_day_kinds}) GROUP BY instant""")
_add("text_json_records", lambda s, d: _rows(run(f"{_LOG} | to_json", _log(s, d)).text()), """SELECT '{"timestamp":' || epoch_us(date_trunc('second', ts)) // 1000 || ',"labels":{"kind":"' || event_type || '","source":"events"},"values":{"amount":' || value || '}}' AS text FROM events""")
_add("text_human_entries", lambda s, d: _rows(run(r"/(\w+) ([0-9]+)[.]/", _log(s, d)).text(verbose=True)), "SELECT event_id + 1 || ': ' || event_type || chr(9) || regexp_extract(value::VARCHAR, '^[0-9]+') AS text FROM events WHERE value::VARCHAR LIKE '%.%'")
_add("json_rows", lambda s, d: json_rows(query(f"sum(count_over_time(value[1d])) by (event_type)", tables.events(s, d), since=JAN).value).withColumnRenamed("value", "text"), _wrap(window_sql(EVENTS, "value", "count(*)::DOUBLE", ["event_type"], DAY, DAY, "TRUE", JAN), """'{"instant":' || instant || ',"metric":{"event_type":"' || event_type || '"},"value":' || value || '}' AS text"""))


#: Windows of all series are state at once: kept on disk, not in the executors' heaps, and not counted row by row.
_STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files, read to its present end."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    live = from_table(spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet"), "ts", ["event_type", "user_id"], ["value"], F.col("event_id") + 1)
    out = stream("count_over_time(value[1h])", live, since=JAN)
    rows = _scratch(spark)
    # A batch gives all windows so far and replaces what the one before wrote; no row comes to the driver.
    write = out.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(rows)).outputMode("complete").option("checkpointLocation", _scratch(spark)).trigger(availableNow=True)
    before = {k: spark.conf.get(k, None) for k in _STATE_ON_DISK}
    try:
        for k, x in _STATE_ON_DISK.items():
            spark.conf.set(k, x)
        q = write.start()  # takes its own copy of the settings
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(rows)


_add("stream_windows", _stream, window_sql(EVENTS, "value", "count(*)::DOUBLE", BOTH, HOUR, HOUR, "TRUE", JAN))
