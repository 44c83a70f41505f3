"""Scalar functions and expression rules on literals."""

import duckdb
import pytest
from pyspark.sql import functions as F

from skerry.functions import scalar as S
from skerry.functions import semantics as M

def cases():
    NULL = F.lit(None).cast("string")
    T = lambda s: F.lit(s)
    TS = lambda s: F.lit(s).cast("timestamp")
    return [
        (S.text(NULL), "NULL"), (S.text(F.lit(b"abc"), "binary"), "[3 bytes]"), (S.length(T("a\U0001f600")), 3),
        (S.iif(F.lit(1), T("a"), T("b")), "a"), (S.iif(F.lit(0.0), T("a"), T("b")), "b"), (S.iif(T(" "), T("a"), T("b")), "b"), (S.iif(NULL, T("a"), T("b")), "b"),
        (S.year(T("nope")), None), (S.hour(T("nope")), None), (S.year(F.lit(45292)), 2024), (S.day(T("45292.75")), 1), (S.hour(F.lit(45292)), None), (S.minute(T("2024-01-01 10:20:30")), 20), (S.nz(T(""), "d"), "d"), (S.isempty(NULL), 1), (S.isnull(T("")), 0),
        (S.choose(F.lit(2.5), T("a"), T("b"), T("c")), "b"), (S.choose(F.lit(9), T("a")), None),
        (S.left(T("abc"), -1), ""), (S.right(T("abc"), 2), "bc"), (S.right(T("abc"), 9), "abc"),
        (S.mid(T("abcdef"), -3, 2), "ab"), (S.mid(T("abcdef"), 3, -1), ""), (S.trim(T("\t x  ")), "x"),
        (S.instr(T("Hello"), "L"), 3), (S.instr(T("Hello"), "L", 4), 4), (S.instr(T("Hello"), "z"), 0),
        (S.replace(T("aXa"), "X", None), "aa"), (S.strcomp(T("a"), T("B"), True), -1), (S.strcomp(T("a"), NULL), None),
        (S.val(T(" 12.5kg")), 12.5), (S.val(T("kg")), 0.0), (S.val(NULL), 0.0),
        (S.ordinal_starts_with(T("Alpha"), "al"), 0), (S.ordinal_contains(T("a%_b"), "%_"), 1), (S.ordinal_ends_with(T(""), ""), 1),
        (S.dateadd("m", 1, TS("2024-01-31")), "2024-02-29"), (S.dateadd("h", 1, TS("2024-01-31")), "2024-01-31 01:00:00"),
        (S.datediff("yyyy", TS("2023-12-31"), TS("2024-01-01")), 1), (S.datediff("h", TS("2024-01-01 00:59:00"), TS("2024-01-01 02:00:00")), 1),
        (S.datediff("ww", TS("2024-01-08"), TS("2024-01-01")), -1), (S.datepart("w", TS("2024-01-07")), 1), (S.datepart("ww", TS("2024-12-30")), 1),
        (S.dateserial(F.lit(2024), F.lit(14), F.lit(0)), "2025-01-31"), (S.timeserial(F.lit(25), F.lit(0), F.lit(5)), "01:00:05"),
        (S.monthname(F.lit(3)), "March"), (S.monthname(F.lit(13)), None), (S.round_(F.lit(2.5)), 2.0), (S.round_(F.lit(2.5), 16), None),
        (S.int_(F.lit(-12.55)), -13.0), (S.fix(F.lit(-12.55)), -12.0), (S.sgn(F.lit(-2)), -1), (S.cint(T("3,000.5")), 3000), (S.clng(T("9007199254740993")), 9007199254740993), (S.cint(T("1e3")), 1000),
        (S.clng(T("9e30")), None), (S.cbool(T("YES")), 1), (S.cbool(T("what")), None), (S.cstr(NULL), ""), (S.cdate(T("2024-02-03 00:00:00")), "2024-02-03"),
        (S.format_(F.lit(1234.5), "#,##0.00"), "1,234.50"), (S.format_(F.lit(1234.5), "0.0##"), "1234.5"),
        (S.xml_value(T("<a><b>x</b></a>"), "/a/b"), "x"), (S.xml_value(T("<a/>"), "/a/b"), None), (S.xml_exists(T("<a/>"), "/a"), 1),
        (M.int_div(F.lit(-7), F.lit(2)), -3), (M.between3(F.lit(5), F.lit(6), F.lit(None).cast("int")), None),
        (M.like(T("Hello"), "h_LLo"), True), (M.like(T("50%"), "50!%", "!"), True), (M.like(T("50%"), "50!", "!"), False),
        (M.like(T("a\nb"), "a%b"), True), (M.collation_key(T("abc"), "NOCASE"), "ABC"), (M.tinyint(F.lit(255)), 255), (M.strict_int(F.lit(3.0), "int"), 3),
    ]


def test_literals(spark):
    found = cases()
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(found))).first()
    assert [(i, row[i]) for i in range(len(found))] == [(i, want) for i, (_, want) in enumerate(found)]


def test_errors(spark):
    bad = [M.strict_int(F.lit(1.5), "int"), M.tinyint(F.lit(256)), S.xml_value(F.lit("<a><b>1</b><b>2</b></a>"), "/a/b"), M.int_div(F.lit(1), F.lit(0))]
    for x in bad:
        with pytest.raises(Exception):
            spark.range(1).select(x.alias("x")).collect()


def test_day_numbers_beyond_year_9999(spark):
    """As text they go as far as dates do, as numbers they end with the year 9999."""
    keys = [1, 2958465, 2958466, 2958467, 8999999, 54000000]
    days = spark.createDataFrame([(k,) for k in keys], "k long")
    got = [tuple(r) for r in days.select(S.month(F.col("k").cast("string")), S.month(F.col("k"))).collect()]
    duck = duckdb.sql(f"SELECT month(DATE '1899-12-30' + k::INTEGER) FROM (SELECT unnest({keys}) AS k)").fetchall()
    assert [text for text, _ in got] == [month for (month,) in duck]
    assert [number for _, number in got[:2]] == [12, 12] and [number for _, number in got[3:]] == [None] * 3


def test_xml_parts_are_those_of_single_paths(spark):
    """One evaluation in the plan for several paths, with the results of one for each."""
    texts = ["<o><c id='1'>x</c></o>", "<o><c id=''>y<d>z</d></c></o>", "<o><d/></o>", "<o><c><d>only</d></c></o>", "", None]
    docs = spark.createDataFrame([(t,) for t in texts], "x string")
    x, tests, values = F.col("x"), ["/o/c", "/o/c/d"], ["/o/c", "/o/c/@id", "/o/c/d/text()"]
    single = [S.xml_exists(x, p) for p in tests] + [S.xml_value(x, p) for p in values]
    name = lambda found: [c.alias(f"c{i}") for i, c in enumerate(found)]
    at_once = docs.select(*name(S.xml_parts(x, tests, values)))
    assert at_once.dtypes == docs.select(*name(single)).dtypes
    got = [tuple(r) for r in at_once.collect()]
    assert got == [tuple(r) for r in docs.select(*name(single)).collect()]
    assert got[:2] == [(1, 0, "x", "1", None), (1, 1, "yz", "", "z")] and got[4:] == [(None,) * 5] * 2
    with pytest.raises(Exception, match="several nodes"):
        docs.select(S.xml_parts(F.lit("<o><c>1</c><c>2</c></o>"), tests, ["/o/c"])[2]).collect()


def test_fn_xml_parses_once(spark):
    """Both columns share one evaluation; that of a path alone would be another."""
    from skerry.plans import catalogue

    plan = catalogue.QUERIES["fn_xml"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "xpath_string(" in plan and "xpath_boolean(" not in plan and "xpath(" not in plan
