"""The dialect: its lexical rules, what it refuses, and what an engine keeps."""

import decimal
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from skerry.sql import lexer
from skerry.sql.engine import Engine
from skerry.sql.lexer import SqlError, fingerprint, split, tokens
from skerry.sql.parser import parse


def kinds(sql):
    return [(t.kind, t.value) for t in tokens(sql)[:-1]]


def test_tokens():
    assert kinds("sElEcT \"a\"\"b\", 'it''s', X'0aFF', 12, 1.50, @p1 -- end\n/* c */ <> != <=") == [
        ("word", "sElEcT"), ("quoted", 'a"b'), ("op", ","), ("text", "it's"), ("op", ","), ("blob", b"\x0a\xff"), ("op", ","), ("int", "12"), ("op", ","),
        ("real", "1.50"), ("op", ","), ("param", "p1"), ("op", "<>"), ("op", "!="), ("op", "<="),
    ]
    assert kinds("1e5") == [("int", "1"), ("word", "e5")]  # no exponents


@pytest.mark.parametrize("sql", ["/* open", "'open", '"open', '""', "1.2.3", "X'0'", "@", "#", '"' + "a" * 129 + '"', "x" * (lexer.MAX_CHARS + 1)])
def test_bad_tokens(sql):
    with pytest.raises(SqlError):
        tokens(sql)


@given(st.text(max_size=40))
def test_any_text_is_a_literal(value):
    (token,) = tokens("'" + value.replace("'", "''") + "'")[:-1]
    assert token.value == value


def test_scripts():
    text = "CREATE TABLE a (x TEXT); -- ;\nINSERT INTO a VALUES (';');;IF EXISTS (SELECT 1) BEGIN DELETE FROM a; SELECT 1; END; SELECT 2"
    assert [s.split()[0] for s in split(text)] == ["CREATE", "INSERT", "IF", "SELECT"]
    assert len(split("CREATE TRIGGER t AFTER INSERT ON a BEGIN SELECT 1; SELECT 2; END; SELECT 3")) == 2
    with pytest.raises(SqlError):
        split("SELECT 1;" * (lexer.MAX_STATEMENTS + 1))
    with pytest.raises(SqlError):
        split("IF EXISTS (SELECT 1) BEGIN SELECT 2;")
    with pytest.raises(SqlError):
        parse("SELECT " + "(" * 200 + "1" + ")" * 200)


def test_fingerprints():
    one = fingerprint("SELECT a FROM t WHERE b = 'x' AND c <> 5 -- note")
    assert one == fingerprint("select A  from T where b='other' and c != @p;") and one != fingerprint("SELECT a FROM t WHERE b = 'x'")


REFUSED = {
    "SELECT CASE WHEN 1 = 1 THEN 1 END": "CASE", "SELECT TRY_CAST(1 AS TEXT)": "TRY_CAST", "INSERT INTO a VALUES (1) RETURNING x": "RETURNING", "DELETE FROM a RETURNING x": "RETURNING",
    "UPSERT INTO a VALUES (1)": "UPSERT", "REPLACE INTO a VALUES (1)": "REPLACE", "INSERT INTO a VALUES (1) ON CONFLICT DO NOTHING": "ON CONFLICT", "INSERT OR IGNORE INTO a VALUES (1)": "INSERT OR",
    "SELECT 1 INTERSECT ALL SELECT 1": "INTERSECT ALL", "SELECT 1 EXCEPT ALL SELECT 1": "EXCEPT ALL", "WITH RECURSIVE a AS (SELECT 1) SELECT 1 FROM a": "Recursive", "BEGIN": "transaction", "COMMIT": "transaction",
    "SELECT LAG(x) IGNORE NULLS OVER (ORDER BY x) FROM a": "NULLS", "CREATE PROCEDURE p AS SELECT 1": "PROCEDURE", "CALL p()": "Stored-procedure", "SELECT 1 FROM a FULL OUTER JOIN b ON 1 = 1": "FULL OUTER",
    "SELECT 1 FROM a NATURAL JOIN b": "NATURAL", "SELECT 1; SELECT 2": "Multiple statements", "CREATE TABLE c (p INTEGER REFERENCES q(i) MATCH FULL)": "MATCH FULL", "CREATE TABLE c (p INTEGER REFERENCES q(i) NOT DEFERRABLE)": "DEFERRABLE",
    "SELECT SUM(x) OVER (ORDER BY x RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) FROM a": "RANGE", "CREATE TRIGGER t AFTER UPDATE ON a WHEN (1) BEGIN SELECT 1; END": "WHEN", "CREATE TABLE c (x DECIMAL(19,2))": "DECIMAL",
    "INSERT INTO a SELECT 1": "SELECT", "SELECT FROM a": "expected", "": "expected", "SELECT 1 +": "expected",
}


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(sql):
    with pytest.raises(SqlError, match=REFUSED[sql]):
        parse(sql)


@pytest.fixture(scope="module")
def db(spark):
    made = Engine(spark)
    made.script(
        "CREATE TABLE t (id INTEGER PRIMARY KEY, name VARCHAR(5) NOT NULL, x DECIMAL(6,2) CHECK (x < 100), UNIQUE (name, x));"
        "CREATE TABLE child (id INTEGER PRIMARY KEY, t INTEGER REFERENCES t(id)); INSERT INTO t VALUES (1, 'a', 1.5), (2, 'b', NULL); INSERT INTO child VALUES (1, 1)"
    )
    return made


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT missing FROM t", "SELECT id FROM t a JOIN t b ON a.id = b.id", "SELECT 1 FROM nowhere", "SELECT POWER(2, 3)", "SELECT LEN()", "SELECT @p", "SELECT x FROM t WHERE ROW_NUMBER() OVER (ORDER BY x) = 1",
        "INSERT INTO t VALUES (1, 'c', 2)", "INSERT INTO t VALUES (9, NULL, 2)", "INSERT INTO t VALUES (9, 'c', 100)", "INSERT INTO t VALUES (9, 'a', 1.5)", "INSERT INTO t (id) VALUES (1, 2)", "INSERT INTO child VALUES (5, 77)",
        "UPDATE t SET name = 'a', x = 1.5", "UPDATE t SET name = NULL WHERE id = 1", "DELETE FROM t WHERE id = 1", "DROP TABLE t", "CREATE TABLE t (id INTEGER)", "ALTER TABLE t DROP COLUMN name", "ALTER TABLE t ADD CONSTRAINT c CHECK (x > 2)",
        "CREATE TABLE z (p INTEGER REFERENCES t(x))", "CREATE UNIQUE INDEX i ON child (nothing)", "FIND ORPHANS IN t", "EXPLAIN DELETE FROM child", "DROP VIEW v",
    ],
)
def test_errors_change_nothing(db, sql):
    before = [db.execute(f"SELECT * FROM {t} ORDER BY id").collect() for t in ("t", "child")]
    with pytest.raises(SqlError):
        db.execute(sql)
    assert [db.execute(f"SELECT * FROM {t} ORDER BY id").collect() for t in ("t", "child")] == before


def test_value_errors(db):
    for sql in ("INSERT INTO t VALUES (9, 'longer', 1)", "SELECT CAST(1.5 AS INTEGER)", "SELECT CAST(256 AS TINYINT)", "SELECT CAST('x' AS UUID)", "SELECT 1 / 0"):
        with pytest.raises(Exception):
            db.execute(sql).collect()


def test_an_engine_keeps_its_tables(spark, db):
    db.execute("CREATE TABLE kept (id INTEGER PRIMARY KEY, d DECIMAL(4,2) DEFAULT 1.25, b BLOB DEFAULT X'0a')")
    db.execute("INSERT INTO kept DEFAULT VALUES")
    db.save_query("all", "SELECT id, d FROM kept WHERE id >= @least")
    again = Engine(spark, db.root)
    assert [tuple(r) for r in again.execute("SELECT * FROM kept").collect()] == [(1, decimal.Decimal("1.25"), bytearray(b"\n"))]
    assert again.run_saved("ALL", {"@least": 1}).count() == 1 and again.execute("SELECT name FROM sys.saved_queries").first()[0] == "all"
    again.execute("ALTER TABLE kept RESEED 50")
    again.execute("INSERT INTO kept (d) VALUES (2)")
    assert again.execute("SELECT MAX(id) FROM kept").first()[0] == 50


def test_functions_of_the_users(spark):
    db = Engine(spark)
    db.register("Twice", 1, lambda n: n * 2, "bigint", null_propagating=True, description="doubles")
    for name, arity in (("LEN", 1), ("sum", 1), ("twice", 1)):
        with pytest.raises(SqlError):
            db.register(name, arity, lambda x: x)
    row = db.execute("SELECT signature, is_builtin, null_behavior FROM sys.functions WHERE function_name = 'Twice'").first()
    assert tuple(row) == ("Twice(1)", 0, "propagates") and db.execute("SELECT twice(NULL), TWICE(4)").first()[1] == 8


def test_plans(db):
    rows = db.execute("EXPLAIN SELECT name FROM t WHERE x = 12.5 AND name = 'secret'").collect()
    assert len(rows[0]) == 15 and rows[0]["parent_node_id"] is None and all(r["parent_node_id"] < r["node_id"] for r in rows[1:])
    assert any(r["access_path"] == "table_scan" for r in rows) and not any("secret" in (r["predicate"] or "") or "12.5" in (r["predicate"] or "") for r in rows)
    run = db.execute("EXPLAIN ANALYZE SELECT name FROM t").first()
    assert (run["actual_rows"], run["status"]) == (2, "executed")
    found = db.execute("EXPLAIN ESTIMATE FOR SELECT name FROM t WHERE x = 1").collect()
    assert len(found[0]) == 10 and found[0]["stats_state"] == "not_executed" and {"filter", "access_path"} & {r["node_kind"] for r in found}


@pytest.mark.parametrize("seed", range(4))
def test_random_foreign_keys(spark, seed):
    """Deletes through a random tree of cascading, nulling and restricting keys, against a walk by hand."""
    rng = random.Random(seed)
    db, parent, rows = Engine(spark), {}, {0: {i: None for i in range(1, 7)}}
    db.execute("CREATE TABLE t0 (id INTEGER PRIMARY KEY, up INTEGER)")
    db.execute("INSERT INTO t0 (id) VALUES (1), (2), (3), (4), (5), (6)")
    for t in range(1, 4):
        parent[t] = (rng.randrange(t), rng.choice(["CASCADE", "SET NULL", "RESTRICT"]))
        db.execute(f"CREATE TABLE t{t} (id INTEGER PRIMARY KEY, up INTEGER REFERENCES t{parent[t][0]}(id) ON DELETE {parent[t][1]})")
        rows[t] = {i: rng.choice([None, *rows[parent[t][0]]]) for i in range(1, 6)}
        db.execute(f"INSERT INTO t{t} VALUES " + ", ".join(f"({i}, {'NULL' if u is None else u})" for i, u in rows[t].items()))

    def remove(state, t, ids):
        for i in ids:
            state[t].pop(i, None)
        for child, (up, action) in parent.items():
            hit = [i for i, u in state[child].items() if up == t and u in ids]
            if hit and action == "RESTRICT":
                raise SqlError("restricted")
            if action == "CASCADE" and hit:
                remove(state, child, hit)
            for i in hit if action == "SET NULL" else []:
                state[child][i] = None

    for t in (0, 1):
        ids = rng.sample(sorted(rows[t]), min(2, len(rows[t])))
        want = {k: dict(v) for k, v in rows.items()}
        sql = f"DELETE FROM t{t} WHERE id IN ({', '.join(map(str, ids))})"
        try:
            remove(want, t, ids)
        except SqlError:
            with pytest.raises(SqlError):
                db.execute(sql)
        else:
            db.execute(sql)
            rows = want
        assert {k: dict(map(tuple, db.execute(f"SELECT id, up FROM t{k}").collect())) for k in rows} == rows
