"""Relational queries whose text Spark and DuckDB read alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skerry.operators.joins import not_in
from skerry.session import table, views

_TABLES = "region nation customer supplier part orders lineitem events documents labels embeddings pages benchmark conversations".split()


def query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query callable over the tables that an SQL text names."""
    names = [t for t in _TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *names)
        return spark.sql(text)

    return run


_MONEY = "CAST(SUM(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"
_REVENUE = "CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE)"

TEXTS = {
    # scans, filters, expressions
    "scan_filter_project": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 2 AS double_qty FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'",
    "pk_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42",
    "range_scan": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 250",
    "index_ordered_scan": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 10 AND o_custkey < 40 ORDER BY o_custkey, o_orderkey",
    "in_list": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 13) AND p_partkey NOT IN (5, 6)",
    "is_null": "SELECT o_orderkey, NULLIF(o_orderstatus, 'O') AS status FROM orders WHERE NULLIF(o_orderstatus, 'O') IS NULL",
    "is_not_null": "SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'O') IS NOT NULL",
    "three_valued_logic": "SELECT o_orderkey FROM orders WHERE NOT (NULLIF(o_orderstatus, 'O') = 'F' AND o_totalprice > 0) OR NULLIF(o_orderstatus, 'F') <> 'O'",
    "in_list_null": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (1, 2, NULLIF(o_orderkey, o_orderkey))",
    "constant_row": "SELECT 1 + 2 AS three, 'x' AS letter",
    "arithmetic": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, -l_linenumber AS negated, CAST(l_quantity AS BIGINT) * 3 - 1 AS value FROM lineitem",
    "cast_types": "SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS price, CAST(p_size AS DOUBLE) AS size_real, CAST(p_partkey AS VARCHAR(20)) AS key_text FROM part",
    # joins
    "inner_join_equi": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 30000",
    "composite_join": "SELECT a.l_orderkey, COUNT(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey",
    "left_join": "SELECT o_orderkey, COUNT(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "right_join": "SELECT o_orderkey, COUNT(l_orderkey) AS n_lines FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey",
    "cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "theta_join": "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_nationkey + 20 < b.n_nationkey",
    "residual_join": "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 10",
    "self_join": "SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "three_table_chain": f"SELECT n_name, {_MONEY.format('o_totalprice')} AS total FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_name",
    "star_join": f"SELECT r_name, {_REVENUE} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY r_name",
    "semi_exists": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)",
    "semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 40000)",
    "anti_not_exists": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "anti_not_in": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "anti_not_in_null": "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN (SELECT NULLIF(o_orderstatus, 'O') FROM orders)",
    # aggregation
    "count_star": "SELECT COUNT(*) AS n FROM lineitem",
    "scalar_agg": f"SELECT COUNT(l_orderkey) AS n, {_MONEY.format('l_extendedprice')} AS total, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem",
    "filtered_agg": f"SELECT COUNT(*) AS n, {_MONEY.format('l_extendedprice')} AS total FROM lineitem WHERE l_discount > 0.05",
    "group_agg": f"SELECT l_returnflag, l_linestatus, COUNT(*) AS n, {_MONEY.format('l_quantity')} AS qty, MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 12",
    "count_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag",
    "sum_avg_distinct": "SELECT CAST(SUM(DISTINCT CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, AVG(DISTINCT l_quantity) AS a FROM lineitem",
    "group_expr": "SELECT YEAR(o_orderdate) AS y, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate), o_orderpriority",
    "sum_exact_bigint": "SELECT CAST(SUM(CAST(l_orderkey AS BIGINT) * 9007199) AS BIGINT) AS s FROM lineitem",
    # subqueries, CTEs, views
    "scalar_subquery": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders)",
    "scalar_projection": "SELECT n_name, (SELECT COUNT(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation",
    "corr_scalar": "SELECT o_orderkey FROM orders o WHERE o_totalprice > 1.5 * (SELECT AVG(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "corr_in": "SELECT c_custkey FROM customer WHERE 'F' IN (SELECT o_orderstatus FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 30000)",
    "corr_exists": "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9900)",
    "derived_table": "SELECT bucket, COUNT(*) AS n FROM (SELECT CAST(FLOOR(o_totalprice / 10000) AS BIGINT) AS bucket FROM orders) t GROUP BY bucket",
    "cte_multi": "WITH big (k) AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 40000), counted AS (SELECT l_orderkey, COUNT(*) AS n FROM lineitem JOIN big ON k = l_orderkey GROUP BY l_orderkey) SELECT n, COUNT(*) AS orders_n FROM counted GROUP BY n",
    # sort, limit, distinct, set operations
    "top_n_sort": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 20",
    "sort_nulls": "SELECT o_orderkey, NULLIF(o_orderstatus, 'O') AS status FROM orders ORDER BY status NULLS FIRST, o_orderkey",
    "sort_ordinal": "SELECT n_regionkey, n_name FROM nation ORDER BY 1 DESC, 2",
    "select_distinct": "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
    "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_all_decimal": "SELECT CAST(1.25 AS DECIMAL(4,2)) AS v UNION ALL SELECT CAST(3.1415 AS DECIMAL(8,4))",
    "intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem",
    "compound_order_limit": "SELECT k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey + 10 FROM supplier) u ORDER BY k DESC LIMIT 6 OFFSET 2",
    # windows
    "win_rank": "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders",
    "win_running": "SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DOUBLE) AS running, COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
    "win_rows_frame": "SELECT o_orderkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS DOUBLE) AS near, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS upto FROM orders",
    "win_lag_lead": "SELECT o_orderkey, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, LEAD(o_totalprice, 2, -1.0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next2, LAG(NULLIF(o_orderstatus, 'O'), 1, 'none') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev_status FROM orders",
    "win_first_last": "SELECT o_orderkey, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders",
    "win_named": "SELECT event_id, ROW_NUMBER() OVER w AS rn, MIN(value) OVER w AS lo, MAX(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "win_empty_frame": "SELECT o_orderkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS s, COUNT(*) OVER w AS n, FIRST_VALUE(o_orderkey) OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING)",
    "win_range_peers": "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS upto_peers FROM orders",
    # analytics over the star schema
    "pricing_summary": f"SELECT l_returnflag, l_linestatus, {_MONEY.format('l_quantity')} AS sum_qty, {_MONEY.format('l_extendedprice')} AS sum_base, {_REVENUE} AS sum_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "forecast_revenue": "SELECT CAST(SUM(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "top_customers": f"SELECT c_custkey, c_name, {_REVENUE} AS revenue, COUNT(DISTINCT o_orderkey) AS n_orders FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name HAVING COUNT(*) > 1 ORDER BY revenue DESC, c_custkey LIMIT 20",
    "ts_range_summary": "SELECT event_type, COUNT(*) AS n, MIN(value) AS lo, MAX(value) AS hi, CAST(SUM(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type",
}

QUERIES = {name: query(text) for name, text in TEXTS.items()}
# NOT IN over a subquery: the operator in place of Spark's broadcast
QUERIES["anti_not_in"] = lambda spark, d: not_in(
    table(spark, d, "documents").select("doc_id"), "doc_id", table(spark, d, "labels").filter("doc_id is not null"), "doc_id"
)
QUERIES["anti_not_in_null"] = lambda spark, d: not_in(
    table(spark, d, "orders"), "o_orderstatus", table(spark, d, "orders").selectExpr("nullif(o_orderstatus, 'O') AS status"), "status"
).select("o_orderkey")
ORACLES = dict(TEXTS)
