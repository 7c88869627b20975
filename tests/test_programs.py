"""Whole programs on log lines, with the text that they print; shapes from FIXTURES.md."""

import io
import json

import pytest

from loglathe.engine import run
from loglathe.sources.lines import from_texts

# Programs, lines and texts that must give the same as the tool whose language this is.
PEOPLE = r'/([^\s]+)\s(\w+)\s(\d+)/ | map {.0:ts "%Y-%m-%dT%H:%M:%S", .1 as name, .2 as age} | select '
PEOPLE4 = r'/([^\s]+)\s(\w+)\s(\d+)\s(\w+)\s(\w+)/ | map {.0:ts "%Y-%m-%dT%H:%M:%S", .1 as name, .3 as country, .4 as job, .2 as age} | select '
ACCESS = r'/([^\s]+)[^\[]+\[([^\]]+)]\s+"([^\s]+)[^"]*?"\s+(\d+)\s+(\d+).*/ | map {.1:ts "%d/%b/%Y:%H:%M:%S", .0 as ip, .2 as method, .3 as status_code, .4 as content_length} | select '
PLAIN = r"/(.*?)\s(\w+)\s(\d+)/ | map {.0:ts, .1 as l, .2 as m} | select "

D1, D2 = "2021-01-01T23:59:", "2021-01-02T00:00:"
A1 = [f"{D1}58 bob 42", f"{D1}58 sarah 25", f"{D2}02 bob 42", f"{D2}02 sarah 26"]
A3 = ["2021-01-01T05:40:41 bob 42", f"{D1}58 sarah 25", f"{D2}02 bob 42", f"{D2}03 sarah 26"]
A4 = [f"{D1}55 bob 42", f"{D1}58 sarah 25", f"{D2}02 bob 42", f"{D2}03 sarah 26"]
A5 = [f"{D1}57 bob 42", f"{D1}59 sarah 25", f"{D2}01 bob 42", f"{D2}03 sarah 26"]
A2 = [f"{D1}58 bob 42 uk driver", f"{D1}58 sam 12 uk null", f"{D1}58 sarah 25 nl nurse", f"{D2}02 bob 42 uk driver", f"{D2}02 sarah 26 nl nurse"]


def access(rows):
    return [f'192.168.101.{ip} - - [07/Jun/2021:03:39:{s:02d}] "{method} / HTTP/1.1" {status} {size} "-"' for ip, s, method, status, size in rows]


B = [(12, 3, "POST"), (12, 3, "GET"), (13, 3, "GET"), (13, 3, "POST"), (13, 4, "GET"), (13, 4, "POST"), (12, 4, "POST"), (12, 4, "GET")]
B1 = access([(*b, 200, n) for b, n in zip(B, (1000, 20, 300, 400, 300, 4, 1000, 2000), strict=True)])
B3 = access([(*b, 200, n) for b, n in zip(B, (10, 20, 30, 40, 3, 4, 1, 2), strict=True)])
B4 = access([(12, 3, "POST", 200, 10), (12, 3, "GET", 200, 20), (13, 4, "GET", 200, 3), (13, 4, "POST", 200, 4)])
DAY = "2021-07-07 03:39:"
DD = [f"{DAY}03 foo 100", f"{DAY}03 bar 200", f"{DAY}04 foo 101", f"{DAY}05 bar 201", f"{DAY}06 foo 102", f"{DAY}06 bar 202"]


def got(spark, program, texts, **options):
    """Per instant the sorted (labels, value) pairs."""
    out = []
    for line in run(program + " | to_promapi", from_texts(spark, texts), **options).lines():
        out.append([("/".join(f"{v}" for _, v in sorted(r["metric"].items())), r["value"][1] if "value" in r else len(r["values"])) for r in json.loads(line)["result"]])
    return out


E = []
CASES = [
    (PEOPLE + "sum(age)", A1, [[("", "67")], E, E, E, [("", "68")]]),
    (PEOPLE + "sum(age) by(name)", A1, [[("bob", "42"), ("sarah", "25")], E, E, E, [("bob", "42"), ("sarah", "26")]]),
    (PEOPLE4 + "min(age) without(name,job)", A2, [[("nl", "25"), ("uk", "12")], E, E, E, [("nl", "26"), ("uk", "42")]]),
    (PEOPLE + '42.0 + -age{name=~"(bob|sarah)", name!~"b.*"} * 2^3 -1', A3, [[("sarah", "-159")], E, E, E, E, [("sarah", "-167")]]),
    (PEOPLE + 'age{name="bob"} + age{name="sarah"} * 2 - 10', A4, [E] * 8),
    (PEOPLE + '-age{name=~"(bob|sarah)", name!~"b.*"}', A3, [[("age/sarah", "-25")], E, E, E, E, [("age/sarah", "-26")]]),
    (PEOPLE + "30 > age", A5, [E, E, [("age/sarah", "25")], E, E, E, [("age/sarah", "26")]]),
    (PEOPLE + "age != 42", A5, [E, E, [("age/sarah", "25")], E, E, E, [("age/sarah", "26")]]),
    (PEOPLE + "30 > bool age", A5, [[("bob", "0")], E, [("sarah", "1")], E, [("bob", "0")], E, [("sarah", "1")]]),
    (PEOPLE + "age <= bool 26", A5, [[("bob", "0")], E, [("sarah", "1")], E, [("bob", "0")], E, [("sarah", "1")]]),
    (ACCESS + "status_code < bool content_length", B1, [[("192.168.101.12/GET", "0"), ("192.168.101.12/POST", "1"), ("192.168.101.13/GET", "1"), ("192.168.101.13/POST", "1")], [("192.168.101.12/GET", "1"), ("192.168.101.12/POST", "1"), ("192.168.101.13/GET", "1"), ("192.168.101.13/POST", "0")]]),
    (ACCESS + "status_code > content_length", B1, [[("status_code/192.168.101.12/GET", "200")], [("status_code/192.168.101.13/POST", "200")]]),
    (ACCESS + 'content_length{method="GET"} + ignoring(method) content_length{method="POST"}', B3, [[("192.168.101.12", "30"), ("192.168.101.13", "70")], [("192.168.101.12", "3"), ("192.168.101.13", "7")]]),
    (ACCESS + 'content_length{method="GET"} + on() content_length{method="POST"}', B4, [[("", "30")], [("", "7")]]),
    (PLAIN + 'm{l="foo"} + on() m{l="bar"}', DD, [[("", "300")], E, E, [("", "304")]]),
]


@pytest.mark.parametrize(("program", "texts", "wanted"), CASES, ids=[c[0].rpartition("select ")[2] for c in CASES])
def test_printed(spark, program, texts, wanted):
    assert got(spark, program, texts) == wanted


def test_sliding_counts_and_points(spark):
    texts = [*B1, access([(12, 3, "POST", 200, 1000)])[0]]
    texts = sorted(texts, key=lambda t: t.split("03:39:")[1][:2])
    counts = [{k: v for k, v in x} for x in got(spark, ACCESS + "sum(count_over_time(status_code[3s])) by (method)", texts, interval="1s")]
    assert counts == [{"GET": "2", "POST": "3"}, {"GET": "4", "POST": "5"}, {"GET": "4", "POST": "5"}, {"GET": "2", "POST": "2"}]
    points = got(spark, ACCESS + 'status_code{ip="192.168.101.12"}[3s]', texts, interval="1s")
    assert [[n for _, n in x] for x in points] == [[1, 2], [2, 3], [2, 3], [1, 1]]


def test_exact_text(spark):
    lines = list(run(PEOPLE + "sum(age) by(name) | to_promapi", from_texts(spark, A1)).lines())
    assert lines[0] == '{"resultType":"vector","result":[{"metric":{"name":"bob"},"value":[1609545598.999,"42"]},{"metric":{"name":"sarah"},"value":[1609545598.999,"25"]}]}'
    assert list(run(PEOPLE + "(1 + 2) * 3 | to_promapi", from_texts(spark, [])).lines()) == ['{"resultType":"scalar","result":[0.0,"9"]}']


def test_json_entries(spark):
    texts = ['{"b": 1, "a": null, "c": true, "d": {"x": 1}, "e": 1e3}', '["x", [1], 2, null]', "7", "not json", ""]
    out = list(run("json | to_json", from_texts(spark, texts)).lines())
    assert out == ['{"a":"null","b":"1","c":"true","e":"1000.0"}', '["x","2","null"]']


def test_records(spark):
    texts = ['{"k": "12", "t": "2021-01-01T00:00:00Z", "n": "x"}', '{"k": "bad", "t": "2021-01-01T00:00:00Z"}', '{"k": "1"}', '{"k": "1", "t": "never", "n": "x"}']
    program = "json | map {.k:num as k, .t:ts, .n} | to_json"
    assert list(run(program, from_texts(spark, texts)).lines(verbose=True)) == ['{"line":1,"timestamp":1609459200000,"labels":{"n":"x"},"values":{"k":12.0}}']
    assert list(run(program, from_texts(spark, texts), until="2020-01-01T00:00:00Z").lines()) == []


def test_collisions_are_errors(spark):
    with pytest.raises(Exception, match="series collision"):
        got(spark, ACCESS + "content_length + on(ip) content_length", B1)
    with pytest.raises(Exception, match="many-to-one"):
        got(spark, ACCESS + 'content_length + on(ip) content_length{method="GET"}', B1)


def test_compat_follows_computed_results(spark):
    assert got(spark, PEOPLE + "count(age)", A1)[0] == [("", "2")]
    assert run(PEOPLE + "count(age)", from_texts(spark, A1), compat=True).df.orderBy("instant").first()["value"] == 43
    twice = [f"{D1}58 bob 1", f"{D1}58 bob 2"]
    assert got(spark, PEOPLE + "last_over_time(age[5s])", twice)[0] == [("bob", "2")]


def test_command_line(spark, tmp_path):
    from loglathe.cli import main

    out = io.StringIO()
    assert main([PEOPLE + "sum(age)"], io.StringIO("\n".join(A1)), out) == 0
    assert out.getvalue() == "2021-01-01T23:59:58.000\t67\n2021-01-02T00:00:02.000\t68\n"
    (tmp_path / "log").write_text("\n".join(A1))
    out = io.StringIO()
    assert main([PEOPLE + "max_over_time(__line__[10s]) | to_promapi", str(tmp_path / "log")], stdout=out) == 0
    assert '"3"' in out.getvalue() and '"4"' in out.getvalue()
    assert main(["nonsense"], io.StringIO(""), io.StringIO()) == 1


def test_executors_write_the_text(spark):
    """The text of entries and records is made by tasks, in the lines' order, each line decoded once."""
    texts = [f"{D1}58 bob {i}" for i in range(5000)]
    lines = from_texts(spark, texts).repartition(7)
    entries = run(r"/(\w+) (\d+)$/", lines)
    records = run(PEOPLE.removesuffix("| select ") + "| to_json", lines)
    for result, verbose, want in ((entries, True, [f"{i + 1}: bob\t{i}" for i in range(5000)]), (records, False, ['{"timestamp":1609545598000,"labels":{"name":"bob"},"values":{"age":%d.0}}' % i for i in range(5000)])):
        df = result.text(verbose)
        assert [r.text for r in df.collect()] == want == list(result.lines(verbose))
        plan = result.text(verbose)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and plan.count("rangepartitioning") == 1
        assert plan.index("Generate") < plan.index("Exchange")  # sorted below the decoder


def test_text_of_instants_by_executors(spark):
    result = run(PEOPLE + "sum(age) by(name) | to_promapi", from_texts(spark, A1).repartition(3))
    want = list(result.lines())
    assert len(want) == 5 and [r.text for r in result.text().collect()] == want
    assert [r.text for r in run(PEOPLE + "1 + 2", from_texts(spark, [])).text().collect()] == ["3"]


def test_text_that_is_no_utf8(spark):
    from loglathe.operators.records import Records
    from loglathe.sinks.formats import render

    df = spark.sql("SELECT 1L AS line_no, 5L AS ts_ms, CAST(unhex('61FF62') AS STRING) AS l_s, 2D AS v_x")
    assert list(render(Records(df, ("s",), ("x",)), "to_json")) == ['{"timestamp":5,"labels":{"s":"a�b"},"values":{"x":2.0}}']


def test_numbers_and_times_read_alike(spark):
    from pyspark.sql import functions as F

    from loglathe.functions.numbers import to_number
    from loglathe.functions.times import by_format

    numbers = {"1": 1.0, "+1.5e3": 1500.0, ".5": 0.5, "1.": 1.0, "-Inf": float("-inf"), "+infinity": float("inf"), "inf": float("inf"), "1d": None, " 1": None, "0x1": None, "": None, "NaN": "nan", "-nan": "nan", "+NAN": "nan", "1_0": None}
    df = spark.createDataFrame([(x,) for x in numbers], "t string")
    got = {r.t: r.n for r in df.select("t", to_number(F.col("t")).alias("n")).collect()}
    assert {k: "nan" if v is not None and v != v else v for k, v in got.items()} == numbers
    times = ["2021-01-01T23:59:58", "2021-02-30T00:00:00", "2021-01-01T24:00:00", "2021-01-01T23:59:60", "0000-01-01T00:00:00", "0001-01-01T00:00:00", "1500-02-29T00:00:00", "12021-01-01T00:00:00", "2021-1-1T00:00:00", "2021-01-01 00:00:00", ""]
    df = spark.createDataFrame([(x,) for x in times], "t string")
    slow = F.unix_millis(F.try_to_timestamp(F.concat("t", F.lit(" +0000")), F.lit("yyyy-MM-dd'T'HH:mm:ss xx")))
    rows = df.select("t", by_format(F.col("t"), "%Y-%m-%dT%H:%M:%S").alias("a"), slow.alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and rows[0].a == 1609545598000
