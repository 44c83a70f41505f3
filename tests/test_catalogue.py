"""Every registered engine query against its DuckDB counterpart, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest
import xxhash

from skerry.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    found = duck.execute(catalogue.ORACLES[name])
    named = [c[0] for c in found.description]
    assert sorted(named) == cols
    want = [tuple(plain(r[named.index(c)]) for c in cols) for r in found.fetchall()]
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_top_n_plan_takes_ordered(spark):
    plan = catalogue.QUERIES["top_n_sort"](spark, DATA)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_scan_prunes_and_pushes(spark):
    plan = catalogue.QUERIES["scan_filter_project"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity" in plan and "l_comment" not in plan and "l_tax" not in plan


def test_not_in_is_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = catalogue.QUERIES["anti_not_in"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan and "LeftAnti" in plan


WHOLE = {"int_division": "lineitem", "fn_xml": "orders", "collate_join": "customer", "arithmetic": "lineitem", "sort_nulls": "orders", "sort_ordinal": "nation"}


def test_whole_table_queries_cut_nothing(spark):
    for name, table in WHOLE.items():
        assert catalogue.QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
    keys = [r["key_values"] for r in catalogue.QUERIES["hyg_find_duplicates"](spark, DATA).collect()]
    assert max(map(len, keys)) > 20


def brute_buckets(rows):
    """bucket to (rows, digest) of (long, string) rows: XXH64, each column seeded by the last one's hash."""
    out = {b: (0, 0) for b in range(256)}
    for n, text in rows:
        h = 42
        for v in (n.to_bytes(8, "little", signed=True), text.encode()):
            h = xxhash.xxh64_intdigest(v, seed=h)
        h -= (h >> 63) << 64
        out[h % 256] = (out[h % 256][0] + 1, out[h % 256][1] + h)
    return out


def test_checksum_buckets_against_brute_force(spark, tmp_path):
    first = [(i % 300 - 7, f"text {i % 300}") for i in range(500)]
    second = [(n, text + "x" * (n == 3)) for n, text in first]
    got = []
    for name, rows in (("a", first), ("b", second), ("c", first[:3])):
        spark.createDataFrame(rows, "k long, v string").write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        found = catalogue.QUERIES["checksum_buckets"](spark, f"{tmp_path}/{name}").collect()
        got.append({r["bucket"]: (r["rows"], int(r["digest"])) for r in found})
        assert len(found) == 256 and got[-1] == brute_buckets(rows)
    assert got[0] != got[1]
