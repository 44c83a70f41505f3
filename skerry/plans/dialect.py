"""Queries in the engine's own SQL dialect, with their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.session import table
from skerry.sql.engine import Engine

_TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def engine(spark: SparkSession, sf_dir: str, text: str) -> Engine:
    """An engine that can read the stored tables which a text names."""
    made = Engine(spark)
    for t in _TABLES:
        if re.search(rf"\b{t}\b", text):
            made.attach(t, table(spark, sf_dir, t))
    return made


def statement(text: str, **params: object) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: engine(spark, d, text).execute(text, params)


def script(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """The last statement's rows, after those before it."""
    return lambda spark, d: engine(spark, d, text).script(text)


#: name: (dialect text, parameters, oracle)
SELECTS: dict[str, tuple[str, dict, str]] = {
    "sql_where": (
        'SELECT o_orderkey, "o_custkey" AS k /* a comment */ FROM orders o -- another\nWHERE o.o_totalprice > @least AND NOT o_orderstatus = \'F\' oR o_orderkey = 1',
        {"least": 30000},
        "SELECT o_orderkey, o_custkey AS k FROM orders WHERE o_totalprice > 30000 AND NOT o_orderstatus = 'F' OR o_orderkey = 1",
    ),
    "sql_params": (
        "SELECT p_partkey FROM part WHERE p_type LIKE @pattern AND p_size BETWEEN @lo AND @hi AND p_brand <> @quote",
        {"pattern": "st%", "lo": 5, "hi": 30, "quote": "it's \\ 'x'"},
        "SELECT p_partkey FROM part WHERE p_type ILIKE 'st%' AND p_size BETWEEN 5 AND 30",
    ),
    "sql_whole_division": (
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey - 1000) / 7 AS q, l_partkey / 7.0 AS r FROM lineitem",
        {},
        "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey - 1000) // 7 AS q, l_partkey / 7.0::DOUBLE AS r FROM lineitem",
    ),
    "sql_truth": (
        "SELECT event_id FROM events WHERE event_id - event_id / 5 * 5 AND NOT user_id - 3 OR event_id = 3",
        {},
        "SELECT event_id FROM events WHERE (event_id % 5 <> 0 AND NOT (user_id - 3) <> 0) OR event_id = 3",
    ),
    "sql_functions": (
        "SELECT p_partkey, NZ(NULLIF(p_brand, 'Brand#13'), 'none') AS a, IIF(p_size - 10, 'y', 'n') AS b, LEFT(p_name, 3) AS c, MID(p_name, -2, 4) AS d, LEN(p_name) AS e, "
        "INSTR(2, p_type, 'E') AS f, CLNG(TEXT(p_partkey + 9007199254740993)) AS g, SWITCH(p_size < 10, 'small', p_size < 30, 'mid') AS h, CHOOSE(p_size, 'one', 'two') AS i, "
        "CDBL('1,5' ) AS j, VAL(TEXT(p_size) ) AS k, REPLACE(p_name, 'a', NULL) AS l, STRCOMP(p_name, p_type, 'text') AS m, SGN(p_size - 25) AS n FROM part",
        {},
        "SELECT p_partkey, coalesce(nullif(p_brand, 'Brand#13'), 'none') AS a, CASE WHEN p_size <> 10 THEN 'y' ELSE 'n' END AS b, left(p_name, 3) AS c, substring(p_name, 1, 4) AS d, "
        "CAST(length(p_name) AS INTEGER) AS e, CAST(CASE WHEN instr(lower(substring(p_type, 2)), 'e') > 0 THEN instr(lower(substring(p_type, 2)), 'e') + 1 ELSE 0 END AS INTEGER) AS f, "
        "p_partkey + 9007199254740993 AS g, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' END AS h, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS i, "
        "15.0::DOUBLE AS j, p_size::DOUBLE AS k, replace(p_name, 'a', '') AS l, CASE WHEN lower(p_name) < lower(p_type) THEN -1 WHEN lower(p_name) > lower(p_type) THEN 1 ELSE 0 END AS m, "
        "CAST(sign(p_size - 25) AS INTEGER) AS n FROM part",
    ),
    "sql_dates": (
        "SELECT o_orderkey, YEAR(o_orderdate) AS y, DATEADD('m', 1, o_orderdate) AS m, DATEDIFF('d', '1995-01-01', o_orderdate) AS d, DATEPART('q', o_orderdate) AS q, WEEKDAY(o_orderdate) AS w, "
        "MONTH(TEXT(o_orderkey) ) AS n, DATESERIAL(2020, 14, 0) AS s FROM orders WHERE HOUR(o_orderdate) = 0 AND MINUTE(o_orderdate) = 0",
        {},
        "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS m, datediff('day', TIMESTAMP '1995-01-01', o_orderdate) AS d, "
        "CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS w, CAST(month(DATE '1899-12-30' + CAST(o_orderkey AS INTEGER)) AS INTEGER) AS n, '2021-01-31' AS s "
        "FROM orders WHERE hour(o_orderdate) = 0 AND minute(o_orderdate) = 0 AND second(o_orderdate) = 0",
    ),
    "sql_aggregates": (
        "SELECT l_returnflag, COUNT(*) AS n, SUM(l_linenumber) AS s, MIN(l_shipdate) AS lo, COUNT(DISTINCT l_suppkey) AS d, AVG(CAST(l_quantity AS DECIMAL(10,2))) AS m FROM lineitem GROUP BY l_returnflag HAVING COUNT(*) > 5 ORDER BY n DESC",
        {},
        "SELECT l_returnflag, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_shipdate) AS lo, count(DISTINCT l_suppkey) AS d, round_even(sum(CAST(l_quantity AS DECIMAL(10,2))) / count(*), 6) AS m FROM lineitem GROUP BY l_returnflag HAVING count(*) > 5",
    ),
    "sql_empty_sum": ("SELECT SUM(o_custkey) AS s, COUNT(*) AS n, MAX(o_custkey) AS m FROM orders WHERE o_orderkey < 0", {}, "SELECT 0::BIGINT AS s, 0::BIGINT AS n, NULL::BIGINT AS m"),
    "sql_joins": (
        "SELECT n_name, COUNT(c_custkey) AS n, r.r_name FROM nation LEFT JOIN customer c ON c_nationkey = n_nationkey AND c_acctbal > 9000 JOIN region AS r ON r_regionkey = n_regionkey GROUP BY n_name, r.r_name",
        {},
        "SELECT n_name, count(c_custkey) AS n, r_name FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 JOIN region ON r_regionkey = n_regionkey GROUP BY n_name, r_name",
    ),
    "sql_subqueries": (
        "SELECT c_custkey, (SELECT COUNT(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 40000) "
        "AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND c_acctbal > (SELECT AVG(c_acctbal) FROM customer)",
        {},
        "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 40000) "
        "AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    ),
    "sql_not_in": ("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", {}, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "sql_not_in_null": ("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN (SELECT NULLIF(o_orderstatus, 'O') FROM orders)", {}, "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN (SELECT nullif(o_orderstatus, 'O') FROM orders)"),
    "sql_ctes": (
        "WITH big (k, p) AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 40000), lines AS (SELECT k, COUNT(*) AS n FROM big JOIN lineitem ON l_orderkey = k GROUP BY k) "
        "SELECT n, COUNT(*) AS orders_n FROM lines GROUP BY n ORDER BY n LIMIT 5 OFFSET 1",
        {},
        "WITH l AS (SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 40000 GROUP BY 1) SELECT n, count(*) AS orders_n FROM l GROUP BY n ORDER BY n LIMIT 5 OFFSET 1",
    ),
    "sql_compound": (
        "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT 3 UNION SELECT 99 ORDER BY k DESC",
        {},
        "((SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT 3) UNION SELECT 99",
    ),
    "sql_windows": (
        "SELECT o_orderkey, ROW_NUMBER() OVER w AS rn, COUNT(*) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, LAG(o_orderkey, 1, -1) OVER w AS prev, FIRST_VALUE(o_orderkey) OVER w AS f, MAX(o_orderkey) OVER (PARTITION BY o_custkey) AS top "
        "FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)",
        {},
        "SELECT o_orderkey, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, lag(o_orderkey, 1, -1) OVER w AS prev, "
        "first_value(o_orderkey) OVER w AS f, max(o_orderkey) OVER (PARTITION BY o_custkey) AS top FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)",
    ),
    "sql_collate": (
        "SELECT UPPER(k) AS k, n FROM (SELECT k COLLATE NOCASE AS k, COUNT(*) AS n FROM (SELECT IIF(c_custkey - c_custkey / 2 * 2, LOWER(c_mktsegment), c_mktsegment) AS k FROM customer) m GROUP BY k COLLATE NOCASE) g",
        {},
        "SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1",
    ),
    "sql_collated_distinct": (
        "SELECT COUNT(*) AS n, COUNT(DISTINCT k) AS d, UPPER(MIN(k)) AS lo, UPPER(MAX(k)) AS hi FROM (SELECT DISTINCT IIF(c_custkey - c_custkey / 2 * 2, LOWER(c_mktsegment), c_mktsegment) COLLATE NOCASE AS k FROM customer) s",
        {},
        "SELECT count(DISTINCT c_mktsegment) AS n, count(DISTINCT c_mktsegment) AS d, min(c_mktsegment) AS lo, max(c_mktsegment) AS hi FROM customer",
    ),
    "sql_xml": (
        "SELECT p_partkey, XML_VALUE(x, '/r:a/r:b', @names) AS v, XML_EXISTS(x, '/r:a/r:c', '{\"r\": \"urn:1\"}') AS e FROM (SELECT p_partkey, REPLACE('<a xmlns=\"urn:1\"><b>#</b></a>', '#', TEXT(p_size)) AS x FROM part) t",
        {"names": '{"r": "urn:1"}'},
        "SELECT p_partkey, CAST(p_size AS VARCHAR) AS v, 0 AS e FROM part",
    ),
    "sql_like_escape": ("SELECT p_partkey FROM part WHERE p_brand LIKE '%!#1_' ESCAPE '!' OR p_name NOT LIKE '%A%'", {}, "SELECT p_partkey FROM part WHERE p_brand ILIKE '%#1_' OR NOT p_name ILIKE '%a%'"),
    "sql_three_valued": (
        "SELECT o_orderkey FROM orders WHERE NOT (o_custkey BETWEEN 10 AND NULLIF(o_custkey, 20)) OR o_orderkey NOT IN (1, NULL, 3)",
        {},
        "SELECT o_orderkey FROM orders WHERE o_custkey <> 20 AND NOT (o_custkey BETWEEN 10 AND o_custkey)",
    ),
}

_NATIONS = """
CREATE TABLE regions (id INTEGER PRIMARY KEY, name TEXT COLLATE NOCASE NOT NULL UNIQUE, big BOOLEAN DEFAULT 0);
CREATE TABLE states (id INTEGER PRIMARY KEY IDENTITY, name VARCHAR(30), region INTEGER DEFAULT 1, area DECIMAL(9,2) CHECK (area >= 0),
  FOREIGN KEY (region) REFERENCES regions (id) ON DELETE {0} ON UPDATE CASCADE);
INSERT INTO regions VALUES (1, 'North', DEFAULT), (2, 'South', 1), (3, 'East', 0);
INSERT INTO states (name, region, area) VALUES ('a;b', 1, 1.10), ('it''s', 2, 22.5), ('c', 3, 3), ('d', NULL, NULL), ('e', 2, 0.01);
"""
#: name: (script, oracle)
SCRIPTS: dict[str, tuple[str, str]] = {
    "sql_insert_identity": (_NATIONS.format("RESTRICT") + "SELECT * FROM states", "SELECT * FROM (VALUES (1, 'a;b', 1, 1.10::DECIMAL(9,2)), (2, 'it''s', 2, 22.50), (3, 'c', 3, 3.00), (4, 'd', NULL, NULL), (5, 'e', 2, 0.01)) t(id, name, region, area)"),
    "sql_update_cascade": (
        _NATIONS.format("RESTRICT") + "UPDATE regions SET id = id + 10, name = UPPER(name) WHERE id IN (SELECT region FROM states WHERE area > 2); SELECT s.id, s.region, r.name FROM states s LEFT JOIN regions r ON r.id = s.region",
        "SELECT * FROM (VALUES (1, 1, 'North'), (2, 12, 'SOUTH'), (3, 13, 'EAST'), (4, NULL, NULL), (5, 12, 'SOUTH')) t(id, region, name)",
    ),
    "sql_delete_cascade": (_NATIONS.format("CASCADE") + "DELETE FROM regions WHERE name = 'SOUTH'; SELECT id FROM states", "SELECT * FROM (VALUES (1), (3), (4)) t(id)"),
    "sql_delete_set_null": (_NATIONS.format("SET NULL") + "DELETE FROM regions WHERE id = 2; SELECT id, region FROM states", "SELECT * FROM (VALUES (1, 1), (2, NULL), (3, 3), (4, NULL), (5, NULL)) t(id, region)"),
    "sql_delete_set_default": (_NATIONS.format("SET DEFAULT") + "DELETE FROM regions WHERE id = 2; SELECT id, region FROM states", "SELECT * FROM (VALUES (1, 1), (2, 1), (3, 3), (4, NULL), (5, 1)) t(id, region)"),
    "sql_correlated_update": (
        _NATIONS.format("RESTRICT") + "UPDATE regions SET big = (SELECT COUNT(*) FROM states WHERE region = regions.id) - 1; DELETE FROM states WHERE NOT EXISTS (SELECT 1 FROM regions WHERE regions.id = states.region AND big); SELECT id FROM states",
        "SELECT * FROM (VALUES (2), (5)) t(id)",
    ),
    "sql_alter": (
        _NATIONS.format("RESTRICT") + "ALTER TABLE states ADD COLUMN note TEXT DEFAULT 'x'; ALTER TABLE states RENAME COLUMN note TO memo; ALTER TABLE states DROP COLUMN name; ALTER TABLE states RENAME TO lands; ALTER TABLE lands ALTER COLUMN region DROP DEFAULT; INSERT INTO lands DEFAULT VALUES; SELECT * FROM lands WHERE id > 4",
        "SELECT * FROM (VALUES (5, 2, 0.01::DECIMAL(9,2), 'x'), (6, NULL, NULL, 'x')) t(id, region, area, memo)",
    ),
    "sql_temp_table": (_NATIONS.format("RESTRICT") + "CREATE TEMP TABLE states (x INTEGER); INSERT INTO states VALUES (7); PERSIST TEMP TABLE states AS kept; DROP TEMP TABLE states; SELECT COUNT(*) + (SELECT SUM(x) FROM kept) AS n FROM states", "SELECT 12::BIGINT AS n"),
    "sql_temp_shadows": (_NATIONS.format("RESTRICT") + "CREATE TEMPORARY TABLE states (x INTEGER); INSERT INTO states VALUES (7), (8); SELECT x FROM states", "SELECT * FROM (VALUES (7), (8)) t(x)"),
    "sql_views": (_NATIONS.format("RESTRICT") + "CREATE VIEW wide AS SELECT id, area * 2 AS twice FROM states WHERE area > 1; CREATE VIEW wider AS SELECT id FROM wide WHERE twice > 3; SELECT w.id, twice FROM wider w JOIN wide ON wide.id = w.id", "SELECT * FROM (VALUES (2, 45.0::DOUBLE), (3, 6.0)) t(id, twice)"),
    "sql_if_exists": (_NATIONS.format("RESTRICT") + "IF EXISTS (SELECT 1 FROM states WHERE area > 20) BEGIN DELETE FROM states WHERE area > 20; DELETE FROM states WHERE id = 1; END; IF NOT EXISTS (SELECT 1 FROM states) BEGIN DELETE FROM regions; END; SELECT id FROM states", "SELECT * FROM (VALUES (3), (4), (5)) t(id)"),
    "sql_catalogue": (
        _NATIONS.format("CASCADE") + "CREATE UNIQUE INDEX by_name ON states (name); CREATE VIEW v AS SELECT 1 AS one; SELECT object_name, object_type, parent_table_name FROM sys.objects",
        "SELECT * FROM (VALUES ('regions', 'TABLE', NULL), ('states', 'TABLE', NULL), ('by_name', 'INDEX', 'states'), ('v', 'VIEW', NULL), ('fk_states_1', 'FOREIGN KEY', 'states'), ('pk_regions_1', 'PRIMARY KEY', 'regions'), ('uq_regions_1', 'UNIQUE', 'regions'), ('pk_states_1', 'PRIMARY KEY', 'states'), ('ck_states_1', 'CHECK', 'states')) t(object_name, object_type, parent_table_name)",
    ),
    "sql_columns": (
        _NATIONS.format("CASCADE") + "SELECT collation, is_identity, data_type, column_name, is_primary_key, ordinal_position, is_nullable FROM sys.columns WHERE table_name = 'regions'",
        "SELECT * FROM (VALUES ('id', 1, 'INTEGER', 0, 1, 1, NULL), ('name', 2, 'TEXT', 0, 0, 0, 'NOCASE'), ('big', 3, 'BOOLEAN', 1, 0, 0, NULL)) t(column_name, ordinal_position, data_type, is_nullable, is_primary_key, is_identity, \"collation\")",
    ),
    "sql_foreign_keys": (_NATIONS.format("SET NULL") + "SELECT * FROM sys.foreign_keys", "SELECT 'fk_states_1' AS constraint_name, 'states' AS table_name, 'region' AS column_name, 'regions' AS referenced_table_name, 'id' AS referenced_column_name, 'SET NULL' AS on_delete, 'CASCADE' AS on_update"),
    "sql_analyze": (
        _NATIONS.format("CASCADE") + "ANALYZE states; INSERT INTO regions VALUES (9, 'x', NULL); ANALYZE regions; DELETE FROM regions WHERE id = 9; SELECT is_stale, table_name, column_name, max_value, min_value, non_null_count, distinct_count FROM sys.column_stats WHERE column_name <> 'big'",
        "SELECT * FROM (VALUES ('states', 'id', 5::BIGINT, 5::BIGINT, '1', '5', 0), ('states', 'name', 5, 5, 'a;b', 'it''s', 0), ('states', 'region', 3, 4, '1', '3', 0), ('states', 'area', 4, 4, '0.01', '22.50', 0), "
        "('regions', 'id', 4, 4, '1', '9', 1), ('regions', 'name', 4, 4, 'East', 'x', 1)) t(table_name, column_name, distinct_count, non_null_count, min_value, max_value, is_stale)",
    ),
    "sql_planner_statistics": (
        "CREATE TABLE n (a INTEGER, b INTEGER, c TEXT); CREATE INDEX ab ON n (a, b); INSERT INTO n VALUES (0, 1, 'x'), (0, 1, 'x'), (7, 2, 'y'), (8, 2, 'x'); ANALYZE n; "
        "SELECT column_name AS k, TEXT(bucket) AS v, row_count AS n FROM sys.planner_histograms WHERE column_name = 'a' UNION ALL SELECT column_name, value, frequency_ppm FROM sys.planner_heavy_hitters WHERE column_name = 'c' UNION ALL SELECT index_name, columns, distinct_count FROM sys.planner_index_prefix_stats",
        "SELECT * FROM (VALUES ('a', '0', 2::BIGINT), ('a', '7', 2), ('c', 'x', 750000), ('c', 'y', 250000), ('ab', 'a', 3), ('ab', 'a,b', 3)) t(k, v, n)",
    ),
    "sql_find_duplicates": (
        "CREATE TABLE people (id INTEGER PRIMARY KEY, mail TEXT COLLATE NOCASE, n DECIMAL(18,2)); INSERT INTO people VALUES (4, 'Q@x.org', 1.50), (7, 'q@X.ORG', 1.5), (8, NULL, 2), (9, NULL, 2), (10, 'o''k', 1); FIND DUPLICATES IN people ON mail, n",
        "SELECT * FROM (VALUES ('[''Q@x.org'', 1.50]', 2::BIGINT, 4::BIGINT, '4', '7', '7'), ('[NULL, 2.00]', 2, 8, '8', '9', '9')) t(key_values, group_size, winner_rowid, winner_primary_key, duplicate_rowids, duplicate_primary_keys)",
    ),
    "sql_dedup": (
        "CREATE TABLE people (id INTEGER PRIMARY KEY, mail TEXT COLLATE NOCASE); INSERT INTO people VALUES (4, 'Q@x.org'), (7, 'q@X.ORG'), (8, NULL), (9, NULL), (10, 'k'); DEDUP people ON mail KEEP LAST; SELECT id FROM people",
        "SELECT * FROM (VALUES (7), (9), (10)) t(id)",
    ),
    "sql_merge_duplicates": (
        "CREATE TABLE people (id INTEGER PRIMARY KEY, mail TEXT, phone TEXT, town TEXT); INSERT INTO people VALUES (4, 'm', '5', NULL), (7, 'm', NULL, 'Bern'), (8, 'm', NULL, 'Bern'), (9, 'k', NULL, 'Ulm'), (10, 'k', '1', NULL), (11, 'k', '2', NULL); MERGE DUPLICATES people ON mail",
        "SELECT 'people' AS table_name, 2::BIGINT AS duplicate_group_count, 4::BIGINT AS rows_deleted, 2::BIGINT AS rows_kept, 1::BIGINT AS rows_updated, 1::BIGINT AS merge_conflict_count, 'phone: 1' AS merge_conflicts",
    ),
    "sql_validate": (
        "CREATE TABLE people (id INTEGER PRIMARY KEY, mail TEXT); INSERT INTO people VALUES (4, 'm@x'), (7, 'none'), (8, NULL); CREATE VALIDATION RULE at ON people.mail AS mail LIKE '%@%' MESSAGE 'no at'; CREATE VALIDATION RULE low ON people AS id < 8 MESSAGE 'high'; VALIDATE TABLE people",
        "SELECT * FROM (VALUES ('at', 'people', 'mail', 7::BIGINT, '7', 'no at'), ('at', 'people', 'mail', 8, '8', 'no at'), ('low', 'people', NULL, 8, '8', 'high')) t(rule_name, table_name, column_name, rowid, primary_key, message)",
    ),
    "sql_find_orphans": (
        "CREATE TABLE shelf (id INTEGER PRIMARY KEY); CREATE TABLE copy (id INTEGER PRIMARY KEY, shelf INTEGER); INSERT INTO shelf VALUES (1); INSERT INTO copy VALUES (5, 1), (6, 70), (7, NULL); FIND ORPHANS IN copy.shelf REFERENCES shelf.id",
        "SELECT NULL::VARCHAR AS constraint_name, 'copy' AS child_table, 'shelf' AS child_column, 6::BIGINT AS child_rowid, '70' AS child_value, 'shelf' AS parent_table, 'id' AS parent_column",
    ),
    "sql_casts": (
        "SELECT CAST('ab' AS CHAR(4)) AS a, CAST(3.0 AS TINYINT) AS b, CAST('12' AS BIGINT) AS c, CAST(0.1 AS DECIMAL(5,3)) AS d, CAST('123E4567-E89B-12D3-A456-426614174000' AS UUID) AS e, CAST('07:05' AS TIME) AS f, CAST(2 AS BOOLEAN) AS g, CAST('2024-02-03' AS DATE) AS h, CAST('{\"b\": 1}' AS JSON) AS i",
        "SELECT 'ab  ' AS a, 3::SMALLINT AS b, 12::BIGINT AS c, 0.100::DECIMAL(5,3) AS d, '123e4567-e89b-12d3-a456-426614174000' AS e, '07:05:00' AS f, true AS g, DATE '2024-02-03' AS h, '{\"b\":1}' AS i",
    ),
}


def _udf(spark: SparkSession, d: str) -> DataFrame:
    text = "SELECT p_partkey, Twice(p_size) AS t, Twice(p_name, '-') AS u, Longest(p_name) AS l FROM part WHERE Twice(p_size) > 20"
    made = engine(spark, d, text)
    made.register("Twice", 1, lambda n: n * 2, "bigint", null_propagating=True)
    made.register("Twice", 2, lambda s, by: s + by + s, null_propagating=True)
    made.register("Longest", 1, lambda s: s.str.split(" ").map(lambda w: max(map(len, w))), "int", null_propagating=True, vectorized=True)
    return made.execute(text)


def _fingerprints(spark: SparkSession, d: str) -> DataFrame:
    texts = ["SELECT a FROM t WHERE b = 'x' AND c <> 5", "select A\nfrom T where b='y' /* other */ and c != @p;", "SELECT a FROM t"]
    return spark.createDataFrame([(i, Engine.fingerprint(t)) for i, t in enumerate(texts)], "id int, digest string")


def _explain(spark: SparkSession, d: str) -> DataFrame:
    text = "EXPLAIN SELECT n_name, COUNT(*) FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 123 GROUP BY n_name"
    return engine(spark, d, text).execute(text)


def _explain_shape(spark: SparkSession, d: str) -> DataFrame:
    """Of that plan: its columns, roots, scans and joins, and whether it shows the literal."""
    rows = _explain(spark, d)
    return rows.selectExpr("15 = " + str(len(rows.columns)) + " AS wide", "node_id", "parent_node_id", "access_path", "join_type", "predicate").groupBy("wide").agg(
        F.count(F.when(F.col("parent_node_id").isNull(), 1)).alias("roots"),
        F.count("access_path").alias("scans"),
        F.count("join_type").alias("joins"),
        F.max(F.coalesce(F.col("predicate").contains("123"), F.lit(False))).alias("shown"),
    )


QUERIES = {name: statement(text, **params) for name, (text, params, _) in SELECTS.items()} | {name: script(text) for name, (text, _) in SCRIPTS.items()}
ORACLES = {name: oracle for name, (_, _, oracle) in SELECTS.items()} | {name: oracle for name, (_, oracle) in SCRIPTS.items()}
QUERIES |= {"sql_fingerprints": _fingerprints, "sql_udf": _udf, "sql_explain": _explain, "sql_explain_shape": _explain_shape}
ORACLES["sql_explain_shape"] = "SELECT true AS wide, 1::BIGINT AS roots, 2::BIGINT AS scans, 1::BIGINT AS joins, false AS shown"
ORACLES["sql_udf"] = "SELECT p_partkey, p_size::BIGINT * 2 AS t, p_name || '-' || p_name AS u, CAST(list_max([length(w) FOR w IN string_split(p_name, ' ')]) AS INTEGER) AS l FROM part WHERE p_size * 2 > 20"
_SHOWN = "sha256('SELECT A FROM T WHERE B = ? AND C <> ?')"
ORACLES["sql_fingerprints"] = f"SELECT 0 AS id, {_SHOWN} AS digest UNION ALL SELECT 1, {_SHOWN} UNION ALL SELECT 2, sha256('SELECT A FROM T')"
