"""The time grid against a brute-force evaluator, streams against batch, every query against SQL."""

import random
from pathlib import Path

import pytest

import __spark_entry__ as entry
from loglathe import catalogue
from loglathe.engine import query
from loglathe.operators.records import Records

SF = "/root/testdata/sf0.001"


def brute(rows, lookback, interval, since, fn):
    rows = sorted(r for r in rows if since is None or r[0] >= since)
    out = {}
    if rows:
        first = (rows[0][0] if since is None else since) + min(lookback, interval) - 1
        at = first
        while at < rows[-1][0] + lookback:
            for s in {r[2] for r in rows}:
                inside = [r[3] for r in rows if r[2] == s and at - lookback < r[0] <= at]
                if inside:
                    out[at, s] = float(fn(inside))
            at += interval
    return out


FUNCTIONS = {"count": len, "sum": sum, "min": min, "max": max, "avg": lambda x: sum(x) / len(x), "last": lambda x: x[-1]}


@pytest.mark.parametrize("seed", range(6))
def test_grid(spark, seed):
    rng = random.Random(seed)
    interval = rng.choice([7, 50, 100])
    lookback = (interval, interval * 4, interval * 3 + 2, max(1, interval // 3))[seed % 4]
    since = rng.choice([None, 1000, 1500])
    rows = [(1000 + rng.randrange(2000), i, rng.choice("ab"), float(rng.randrange(50))) for i in range(60)]
    df = spark.createDataFrame(rows, "ts_ms long, line_no long, l_s string, v_x double")
    name = sorted(FUNCTIONS)[seed]
    got = query(f"{name}_over_time(x[{lookback}ms])", Records(df, ("s",), ("x",)), since=since, interval=interval).df.collect()
    want = brute(rows, lookback, interval, since, FUNCTIONS[name])
    assert {(r.instant, r.s): round(r.value, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "ts_ms long, line_no long, l_s string, v_x double")
    for e in ("sum(x)", "count_over_time(x[1m])", "x + on (s) x", "topk(2, x)"):
        assert query(e, Records(df, ("s",), ("x",))).df.count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from loglathe.sources import tables
    from loglathe.streaming.windows import stream

    d = Path(tmp_path / "in")
    spark.read.parquet(f"{SF}/events.parquet").coalesce(1).write.parquet(str(d / "events.parquet"))
    schema = spark.read.parquet(str(d / "events.parquet")).schema
    from pyspark.sql import functions as F

    from loglathe.operators.records import from_table

    live = from_table(spark.readStream.schema(schema).parquet(str(d / "events.parquet")), "ts", ["event_type", "user_id"], ["value"], F.col("event_id") + 1)
    expression = "sum_over_time(value[6h])"
    out = stream(expression, live, 3_600_000, catalogue.JAN)
    q = out.writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda r: (r["instant"], r["event_type"], r["user_id"], round(r["value"], 6))
    batch = query(expression, tables.events(spark, SF), since=catalogue.JAN, interval="1h").df
    first = batch.agg({"instant": "min"}).first()[0]
    assert sorted(key(r) for r in spark.table("sums").collect() if r["instant"] >= first) == sorted(key(r) for r in batch.collect())


def test_plans_read_few_columns_and_push_filters(spark):
    from loglathe.sources import tables

    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df = query('sum(sum_over_time(l_quantity{l_returnflag="A"}[4w]))', tables.lineitem(spark, SF), since=catalogue.Y1992).df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "EqualTo(l_returnflag,A)" in plan and "Python" not in plan
    plan = catalogue.QUERIES["since_until"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in plan and "LessThan(ts,2024-01-15T12:00:00.001)" in plan
    plan = catalogue.QUERIES["program_regex"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(?s:.*)") == 1  # one match a line


def test_bounds_of_a_table_add_up(spark):
    from loglathe.sources import tables

    own = tables.events(spark, SF, since=catalogue.JAN + 5 * catalogue.DAY)
    narrow = own.within(catalogue.JAN, catalogue.JAN + 6 * catalogue.DAY - 1)
    got = narrow.df.selectExpr("min(ts_ms)", "max(ts_ms)", "count(*)").first()
    times = [r.ts_ms for r in tables.events(spark, SF).df.collect()]
    inside = [t for t in times if catalogue.JAN + 5 * catalogue.DAY <= t < catalogue.JAN + 6 * catalogue.DAY]
    assert tuple(got) == (min(inside), max(inside), len(inside))


@pytest.mark.parametrize("pattern", [r"(b+)(c*)", r"^(a)(.*)", r"a|(b)", r"(x)?b", r"b", r"^a|(c)", r"(.)\s\z", r"(\s)$", r"(a*?)(b)"])
def test_captures_equal_an_extraction_each(spark, pattern):
    from pyspark.sql import functions as F

    from loglathe.functions import patterns
    from loglathe.operators.records import decode
    from loglathe.plans.program import Decoder

    rng = random.Random(5)
    lines = ["".join(rng.choice("abcx \x01$\\") for _ in range(rng.randrange(9))) for _ in range(150)] + ["", "b", "aab", "ca\nb"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    got = {r.line_no: list(r.tuple) for r in decode(df, Decoder(pattern)).collect()}
    p, n, line = patterns.search(pattern), patterns.groups(pattern), F.concat("value", F.lit("\n"))
    places = range(1, n + 1) if n else [0]
    want = df.where(line.rlike(p)).select("line_no", F.array(*[F.regexp_extract(line, p, i) for i in places]).alias("t")).collect()
    assert got == {r.line_no: list(r.t) for r in want} and got


def test_line_numbers_follow_files(spark, tmp_path):
    from loglathe.sources.lines import read_lines

    for name, n in (("a", 3), ("b", 4000), ("c", 10)):
        (tmp_path / name).write_text("".join(f"{name} {i} {'x' * 90}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line_no for r in rows] == list(range(1, 4014))
    assert [r.value.split()[:2] for r in rows] == [[name, str(i)] for name, n in (("a", 3), ("b", 4000), ("c", 10)) for i in range(n)]


def test_skipped_lines_show_when_asked(spark, tmp_path, capsys):
    import io

    from loglathe.cli import main

    (tmp_path / "log").write_text("1 a\nno number\n2 b\n")
    out = io.StringIO()
    assert main([r"/^(\d+) (\w+)$/ | map { .0:num as n, .1 as s }", str(tmp_path / "log"), "-v"], stdout=out, spark=spark) == 0
    assert [x.split(":")[0] for x in out.getvalue().splitlines()] == ["1", "3"]
    assert capsys.readouterr().err == "2: skipped: no number\n"


def test_append_stream_drops_late_rows(spark, tmp_path):
    """An instant comes out once the watermark has passed it; rows later than that are left out."""
    from loglathe.streaming.windows import stream

    schema = "ts_ms long, line_no long, l_s string, v_x double"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(n)))
    put(0, [(100, 1, "a", 1.0), (900, 2, "a", 2.0), (2500, 3, "b", 4.0)])
    live = Records(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), ("s",), ("x",))
    out = stream("sum_over_time(x[1s])", live, 1000, 0)

    def more():
        q = out.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    more()
    put(1, [(950, 4, "a", 64.0), (2600, 5, "b", 8.0), (9000, 6, "b", 1.0)])  # 950 is late: 2500 has been seen
    more()
    put(2, [(9100, 7, "b", 1.0)])
    more()
    got = sorted((r.instant, r.s, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(999, "a", 3.0), (2999, "b", 12.0)]


def _values(rows, names):
    return sorted(tuple(repr(round(float(r[n]), 5)) if isinstance(r[n], (int, float)) and not isinstance(r[n], bool) else str(r[n]) for n in names) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got = catalogue.QUERIES[name](spark, SF)
    want = con.execute(catalogue.ORACLES[name])
    names = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == names
    place = {d[0]: i for i, d in enumerate(want.description)}
    rows = [{n: r[place[n]] for n in names} for r in want.fetchall()]
    assert _values([r.asDict() for r in got.collect()], names) == _values(rows, names)


def test_entry_points(spark):
    assert entry.entry(spark).columns == ["instant", "event_type", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_result_stays_off_the_driver(spark):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    df = catalogue.QUERIES["stream_windows"](spark, SF)
    assert df.inputFiles()  # files, not a table in the driver's memory
    assert spark.conf.get(provider) == before


@pytest.mark.parametrize("name", ["text_human_entries", "text_json_records", "text_human_dense", "text_human_dense_join", "text_promapi"])
def test_texts_stay_off_the_driver(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FileScan parquet" in plan and "ExistingRDD" not in plan and "LocalTableScan" not in plan


def test_log_files_of_bounded_size_are_in_order(spark, monkeypatch):
    from loglathe.sources.lines import read_lines

    monkeypatch.setattr(catalogue, "FILE_LINES", 50)
    path = catalogue._files(spark, SF)
    lines = read_lines(spark, path)
    files = spark.read.text(path).inputFiles()
    assert len(files) > 5  # 1,000 lines: no task sorts all
    assert "SortMergeJoin" not in lines._jdf.queryExecution().executedPlan().toString()
    want = catalogue._log(spark, SF).orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in lines.orderBy("line_no").collect()] == [(r.line_no, r.value) for r in want]


def test_cli_program_over_many_files(spark, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(catalogue, "FILE_LINES", 50)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    want = sorted(r[0] for r in con.execute(catalogue.ORACLES["cli_program"]).fetchall())
    assert sorted(r.text for r in catalogue.QUERIES["cli_program"](spark, SF).collect()) == want


@pytest.mark.parametrize("verbose", [True, False])
def test_captures_are_joined_without_row_objects(spark, monkeypatch, verbose):
    from loglathe.engine import run
    from loglathe.sinks import formats

    lines = [(1, "ab é\tx"), (2, ""), (3, "\x01b"), (4, "c\\b="), (None, "ab")]
    for pattern in (r"(.)?(b)", r"(.*)", "b"):
        entries = run(f"/{pattern}/", spark.createDataFrame(lines, "line_no long, value string")).value
        want = [formats._entry({**r.asDict(), "dict": None}, None, verbose) for r in entries.orderBy("line_no").collect()]
        with monkeypatch.context() as m:
            m.setattr(formats, "_entry", None)
            assert [r.text for r in formats.texts(entries, None, verbose).collect()] == want
