"""Hygiene, pipelines, sources, collections on the rows of small fixtures."""

import json
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from skerry.operators import collections as C
from skerry.operators import hygiene as H
from skerry.operators import packages
from skerry.operators import pipeline as P
from skerry.operators.joins import not_in
from skerry.sources import files
from skerry.sql.engine import Engine
from skerry.streaming import incremental


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def customers(spark):
    data = [(1, "A@EXAMPLE.COM", "A"), (2, "a@example.com", "B"), (3, None, "N1"), (4, None, "N2"), (5, "b@example.com", "C")]
    return spark.createDataFrame(data, "id int, email string, name string")


def test_duplicates_and_dedup(customers):
    on = [("email", "NOCASE")]
    assert rows(H.find_duplicates(customers, on, "id")) == [("['A@EXAMPLE.COM']", 2, 1, "1", "2", "2"), ("[NULL]", 2, 3, "3", "4", "4")]
    assert rows(H.duplicate_members(customers, on, "id")) == [(1, 1), (2, 1), (3, 3), (4, 3)]
    assert [r["id"] for r in H.dedup(customers, on, "id", "last").orderBy("id").collect()] == [2, 4, 5]
    assert tuple(H.dedup_summary(customers, on, "id", "customers").first()) == ("customers", 2, 2, 3)


def test_merge(spark):
    df = spark.createDataFrame([(1, "a", "111", None), (2, "a", None, "Seattle"), (3, "a", None, "Seattle")], "id int, email string, phone string, city string")
    assert rows(H.merge_duplicates(df, ["email"], "id")) == [(1, "a", "111", "Seattle")]
    assert rows(H.merge_summary(df, ["email"], "id", "t")) == [("t", 1, 2, 1, 1, 0, None)]
    clash = df.unionAll(spark.createDataFrame([(4, "a", None, "Oslo")], df.schema))
    assert rows(H.merge_summary(clash, ["email"], "id", "t")) == [("t", 1, 3, 1, 0, 1, "city: 1")]


def test_keys_are_told_apart(spark):
    df = spark.createDataFrame([(1, "a|b", "c"), (2, "a|b", "c"), (3, "a", "b|c"), (4, "a", "b|c"), (5, None, "x"), (6, None, "x"), (7, "NULL", "x"), (8, "NULL", "x")], "id int, p string, q string")
    assert len({r["key_values"] for r in H.find_duplicates(df, ["p", "q"], "id").collect()}) == 4


def test_compare_null_keys(spark):
    a = spark.createDataFrame([(None, 1), (1, 1)], "k int, v int")
    b = spark.createDataFrame([(1, 2), (2, 1)], "k int, v int")
    assert rows(H.compare(a, b, "k")) == [(1, "Changed", "v"), (2, "TargetOnly", ""), (None, "SourceOnly", "")]
    assert rows(H.compare(b, a, "k")) == [(1, "Changed", "v"), (2, "SourceOnly", ""), (None, "TargetOnly", "")]
    assert rows(H.compare(a, a, "k")) == []


def test_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    right = lambda *v: spark.createDataFrame([(i,) for i in v], "y int")
    assert rows(not_in(left, "x", right(2), "y")) == [(1,)]
    assert rows(not_in(left, "x", right(2, None), "y")) == []
    assert rows(not_in(left, "x", right(), "y")) == [(1,), (2,), (None,)]


def test_validate_null_is_a_violation(spark):
    df = spark.createDataFrame([(1, "q@w.org"), (2, "neither"), (3, None)], "id int, mail string")
    assert [r["rowid"] for r in H.validate(df, [("r", "mail", "mail LIKE '%@%'", "m")], "id", "t").orderBy("rowid").collect()] == [2, 3]


def test_orphans(spark):
    books = spark.createDataFrame([(1,)], "id int")
    bookings = spark.createDataFrame([(1, 1), (2, 99), (3, None)], "id int, book_id int")
    assert rows(H.find_orphans(bookings, "book_id", books, "id", "id", "bookings", "books")) == [(None, "bookings", "book_id", 2, "99", "books", "id")]


def test_statistics(spark):
    df = spark.createDataFrame([(1, 20, "Alice"), (2, None, "Bob"), (3, 40, "Bob")], "id int, age int, name string")
    assert rows(H.column_stats(df)) == [("age", 2, 2, "20", "40"), ("id", 3, 3, "1", "3"), ("name", 2, 3, "Alice", "Bob")]


def test_checksum_keeps_repeats(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    assert rows(H.checksum(a)) == rows(H.checksum(a.orderBy("b", ascending=False)))
    assert rows(H.checksum(a)) != rows(H.checksum(a.distinct()))


def test_pipeline(spark):
    df = spark.createDataFrame([(1, "1", "Alice", "active"), (2, "1", "Alice", "active"), (3, "2", "Bob", "inactive"), (4, "x", "Eve", "active")], "n int, id string, name string, status string")
    steps = [
        P.Step("rename", {"name": "full_name"}), P.Step("cast", {"id": "integer"}), P.Step("filter", "status == 'active'"),
        P.Step("derive", {"name_copy": "full_name"}), P.Step("deduplicate", {"keys": ["id"], "by": "n"}), P.Step("select", ["id", "full_name", "name_copy", "none"]),
    ]
    good, bad = P.run(P.Package("p", steps, skip_bad_rows=True), df)
    assert rows(good) == [(1, "Alice", "Alice", None)] and bad.count() == 1
    with pytest.raises(ValueError):
        P.run(P.Package("p", steps, skip_bad_rows=True, max_rejects=0), df)
    assert P.Package("", [P.Step("what", None)]).validate() == ["name_required", "steps[0]: unknown_kind"]


def test_filter_is_type_strict(spark):
    df = spark.createDataFrame([(1, "1"), (2, None)], "a int, b string")
    assert df.filter(P.predicate(df, "b == 1")).count() == 0
    assert df.filter(P.predicate(df, "b < '0'")).count() == 1


def test_collections(spark):
    docs = spark.createDataFrame(
        [("u:1", '{"Age":20,"orders":[{"sku":"a"},{"sku":"b"}]}'), ("u:2", '{"Age":30,"orders":[{"sku":"g"}]}'), ("u:3", '{"Age":40,"orders":[{"sku":"b"}]}')], "key string, doc string"
    )
    assert [r["key"] for r in C.find_by_path(docs, "$.orders[].sku", "b").orderBy("key").collect()] == ["u:1", "u:3"]
    assert [r["key"] for r in C.find_by_range(docs, "$.Age", 25, 45).orderBy("key").collect()] == ["u:2", "u:3"]
    assert C.put(docs, spark.createDataFrame([("u:2", "{}")], "key string, doc string")).count() == 3
    assert C.delete(docs, docs.filter("key = 'u:1'")).count() == 2


def test_full_text(spark):
    docs = spark.createDataFrame([(1, "Alpha", "Quick brown fox jumps"), (2, "Beta", "Runner's high and steady pace"), (3, "Gamma", "Brown bear near river")], "id int, title string, body string")
    found = lambda q: [r["id"] for r in C.search(docs, ["title", "body"], q).orderBy("id").collect()]
    assert found("brown") == [1, 3] and found("brown fox") == [1] and found("RUNNER'S") == [2] and found("") == []
    index = C.index_terms(docs, "id", ["title", "body"])
    for q in ("brown", "brown fox", "RUNNER'S", "", "'tis"):
        assert sorted(r["id"] for r in C.search_index(index, q).collect()) == found(q)
    odd = spark.createDataFrame([(1, "'tis \uff30\uff59")], "id int, t string")
    assert C.search(odd, ["t"], "'tis py").count() == 1 and C.search(odd, ["t"], "tis").count() == 0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"', 1.5), (2, None, 2.5)], "id int, name string, x double")
    files.write_archive(df, f"{tmp_path}/a")
    assert rows(files.read_archive(spark, f"{tmp_path}/a")) == rows(df)
    files.write_csv(df, f"{tmp_path}/c")
    back = files.read_csv(spark, f"{tmp_path}/c")
    assert dict(back.dtypes) == {"id": "string", "name": "string", "x": "string"}
    assert files.infer_types(back) == {"id": "bigint", "name": "string", "x": "decimal(18,1)"}
    texts = spark.createDataFrame(
        [("0.00001", "007", "18446744073709551615", "2024-01-01", "10:20", "2024-01-01 10:20:30", "2024-01-01T10:20:30Z", "123e4567-e89b-12d3-a456-426614174000", "1e3", "")],
        "a string, b string, c string, d string, e string, f string, g string, h string, i string, j string",
    )
    want = {"a": "decimal", "b": "text", "c": "unsigned", "d": "date", "e": "time", "f": "datetime", "g": "datetimeoffset", "h": "guid", "i": "text", "j": "text"}
    found = files.inferred(texts)
    assert {c: n for c, (n, _) in found.items()} == want and found["a"][1] == "decimal(18,5)"
    files.write_json(df, f"{tmp_path}/array")
    (array,) = (tmp_path / "array").glob("part-*")
    assert json.loads(array.read_text()) == [{"id": 1, "name": 'a "q"', "x": 1.5}, {"id": 2, "name": None, "x": 2.5}]
    files.write_table(spark.createDataFrame([("3", "z")], "ID string, name string"), f"{tmp_path}/a/data")
    assert spark.read.parquet(f"{tmp_path}/a/data").count() == 3
    with pytest.raises(ValueError):
        files.write_table(df.withColumn("more", F.lit(1)), f"{tmp_path}/a/data")
    df.createOrReplaceTempView("paged")
    assert [[r["id"] for r in p.collect()] for p in files.sql_source(spark, "SELECT * FROM paged", ["id"], 1)] == [[1], [2]]
    (tmp_path / "k.json").write_text('[{"t": "1", "b": true, "i": 1, "u": 18446744073709551615, "d": 1.5, "m": {"x": 1}, "n": null}, {"t": "x", "i": -2, "d": 3}]')
    names = {c: n for c, (n, _) in files.infer_json(spark, f"{tmp_path}/k.json").items()}
    assert names == {"t": "text", "b": "boolean", "i": "int", "u": "uint", "d": "decimal", "m": "json", "n": "text"}
    (tmp_path / "j.json").write_text('[{"a": 1, "b": {"c": [1, 2]}}]')
    assert tuple(files.read_json(spark, f"{tmp_path}/j.json").first()) == (1, '{"c":[1,2]}')


def test_incremental(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        incremental.load_new_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", lambda d: d.filter(F.col("id") > 1))
    spark.range(5, 7).write.mode("append").parquet(f"{tmp_path}/in")
    incremental.load_new_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp", lambda d: d.filter(F.col("id") > 1))
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [2, 3, 4, 5, 6]


PACKAGE = {
    "name": "p", "version": "1", "source": {"kind": "csvFile", "path": ""}, "destination": {"kind": "table", "tableName": "goods"},
    "options": {"errorMode": "skipBadRows", "batchSize": 2}, "hooks": [{"event": "onRunSucceeded", "commandName": "note", "arguments": {"k": 1}}],
    "transforms": [{"kind": "cast", "castMappings": [{"column": "id", "targetType": "integer"}]}, {"kind": "deduplicate", "deduplicateKeys": ["id"]}],
}


def test_packages(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name\n1,a\nx,b\n2,c\n1,d\n")
    package = PACKAGE | {"source": {"kind": "csvFile", "path": str(tmp_path / "in.csv")}}
    db, noted = Engine(spark), []
    db.execute("CREATE TABLE goods (id INTEGER PRIMARY KEY, name TEXT)")
    runner = packages.Runner(spark, db, f"{tmp_path}/state", {"Note": lambda event, out, args: noted.append((event, out.rows_written, args))})
    assert runner.run(package, "validate").rows_read == 0
    dry = runner.run(package, "dryRun")
    assert (dry.rows_read, dry.rows_rejected, dry.batches_completed, rows(dry.preview)) == (4, 1, 2, [(1, "a"), (2, "c")])
    assert db.execute("SELECT COUNT(*) FROM goods").first()[0] == 0
    done = runner.run(packages.dump(package))
    assert rows(db.execute("SELECT * FROM goods")) == [(1, "a"), (2, "c")] and done.rejects.first()["row"] == '{"id":"x","name":"b"}'
    assert noted[-1] == ("onRunSucceeded", 2, {"k": 1})
    assert runner.run(package, "resume", done.run_id).rows_written == 0 and db.execute("SELECT COUNT(*) FROM goods").first()[0] == 2
    with pytest.raises(ValueError):  # the keys are there already, and nothing of it is written
        runner.run(package)
    with pytest.raises(ValueError, match="row 2 of batch 1"):
        runner.run(package | {"options": {"errorMode": "failFast", "batchSize": 3}})
    with pytest.raises(ValueError, match="unknown command"):
        runner.run(package | {"destination": {"kind": "jsonFile", "path": f"{tmp_path}/out"}, "hooks": [{"event": "onRunStarted", "commandName": "no"}]})
    assert rows(runner.log().select("mode", "status")).count(("run", "failed")) == 3


def test_package_faults():
    bad = {"source": {"kind": "csvFile"}, "destination": {"kind": "table"}, "transforms": [{"kind": "select"}, {"kind": "no"}, {"kind": "derive", "derivedColumns": [{"name": "a", "expression": "F(1, (2))"}]}], "incremental": {}}
    codes = [c for c, _ in packages.validate(bad, {("F", 1): None})]
    assert codes == [f"pipeline.{c}" for c in (
        "name.required", "version.required", "source.path.required", "destination.table.required", "incremental.watermark.required",
        "transform.select.columns.required", "transform.kind.unsupported", "expression.function.unknown",
    )]
    assert packages.validate(packages.load(packages.dump(PACKAGE | {"source": {"kind": "SqlQuery", "QueryText": "SELECT 1"}}))) == []


def test_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, x DOUBLE, b BLOB, any_)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", [(i, f"n{i}", i / 2 if i % 3 else "odd", b"z", i) for i in range(5, 200)])
    db.close()
    assert files.sqlite_tables(str(tmp_path / "x.db")) == ["t"]
    out = files.read_sqlite(spark, str(tmp_path / "x.db"), "t", 4)
    assert dict(out.dtypes) == {"id": "bigint", "name": "string", "x": "double", "b": "binary", "any_": "string"}
    got = {r["id"]: r for r in out.collect()}
    assert sorted(got) == list(range(5, 200)) and got[7]["x"] == 3.5 and got[6]["x"] is None and got[8]["any_"] == "8" and got[9]["b"] == b"z"


def test_text_search_normalises_within_the_jvm(spark):
    """By the same form as unicodedata, and without a batch of texts in a Python worker."""
    texts = ["Ｐｙ ﬁne", "été été", "각 한", "① ½ Å", "plain", "", "ΐ́ͅ \U0001d400\U0001f600", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: r["t"] for r in C._normal(docs, "t").collect()}
    assert got == {i: t if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}
    assert [r["id"] for r in C.search(docs, ["t"], "fine PY").collect()] == [0]
    for df in (C.search(docs, ["t"], "fine"), C.index_terms(docs, "id", ["t"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan and "InArrow" not in plan and "EvalPython" not in plan
