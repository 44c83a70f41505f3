"""The engine's registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import scalar as S
from skerry.functions import semantics as M
from skerry.operators import collections as C
from skerry.operators import hygiene as H
from skerry.operators import packages
from skerry.operators import pipeline as P
from skerry.operators import samples as X
from skerry.operators import tables as T
from skerry.plans import dialect, relational
from skerry.session import table
from skerry.sources import files
from skerry.sql.engine import Engine
from skerry.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = relational.QUERIES | dialect.QUERIES
ORACLES: dict[str, str] = relational.ORACLES | dialect.ORACLES


def register(oracle: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


# --- expression semantics
@register("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey - 1000) // 7 AS q FROM lineitem")
def int_division(spark: SparkSession, d: str) -> DataFrame:
    q = M.int_div(F.col("l_partkey") - 1000, F.lit(7))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.alias("q"))


@register("SELECT o_orderkey, CASE WHEN NULLIF(o_custkey % 3, 0) IS NULL THEN NULL ELSE o_custkey BETWEEN 10 AND 400 * NULLIF(o_custkey % 3, 0) END AS inside FROM orders")
def between_3vl(spark: SparkSession, d: str) -> DataFrame:
    high = F.lit(400) * F.nullif(F.col("o_custkey") % 3, F.lit(0))
    return table(spark, d, "orders").select("o_orderkey", M.between3(F.col("o_custkey"), F.lit(10), high).alias("inside"))


@register("SELECT p_partkey FROM part WHERE p_name ILIKE '%A_E%' OR p_type ILIKE 'st%'")
def like_ci(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(M.like(F.col("p_name"), "%A_E%") | M.like(F.col("p_type"), "st%")).select("p_partkey")


@register("SELECT p_partkey FROM part WHERE p_brand ILIKE '%#1%'")
def like_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(M.like(F.col("p_brand"), "%!#1%", "!")).select("p_partkey")


@register("SELECT 0 AS total, 0 AS n, NULL::DOUBLE AS mean")
def agg_empty_input(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").filter("o_orderkey < 0")
    return rows.agg(M.sum0(F.col("o_custkey")).cast("int").alias("total"), F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))


@register("SELECT o_orderpriority, CAST(round_even(SUM(CAST(o_totalprice AS DECIMAL(18,2))) / COUNT(*), 4) AS DOUBLE) AS mean FROM orders GROUP BY o_orderpriority")
def decimal_avg(spark: SparkSession, d: str) -> DataFrame:
    mean = M.avg_decimal(F.col("o_totalprice").cast("decimal(18,2)"), 4).cast("double")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(mean.alias("mean"))


@register("SELECT event_id FROM events WHERE CAST(floor(value) AS BIGINT) % 5 <> 0")
def truthy_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(M.truthy(F.floor("value") % 5, "bigint")).select("event_id")


@register("SELECT p_partkey, CAST(p_size AS INTEGER) AS whole, CAST(p_size AS SMALLINT) AS tiny FROM part")
def strict_cast(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", M.strict_int(size.cast("double"), "int").alias("whole"), M.tinyint(size).alias("tiny"))


_MIXED = "CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END"


@register(f"SELECT upper({_MIXED}) AS segment, COUNT(*) AS n, COUNT(DISTINCT upper({_MIXED})) AS names FROM customer GROUP BY upper({_MIXED})")
def collate_group(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").withColumn("mixed", F.expr(_MIXED)).withColumn("segment", M.collation_key(F.col("mixed"), "NOCASE"))
    return rows.groupBy("segment").agg(F.count("*").alias("n"), F.count_distinct("segment").alias("names"))


@register(f"SELECT a.c_custkey AS a_key, COUNT(*) AS n FROM customer a JOIN customer b ON upper({_MIXED.replace('c_', 'a.c_')}) = upper(lower(b.c_mktsegment)) AND a.c_nationkey = b.c_nationkey GROUP BY a.c_custkey")
def collate_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    a = c.select(F.col("c_custkey").alias("a_key"), "c_nationkey", M.collation_key(F.expr(_MIXED), "NOCASE").alias("k"))
    b = c.select("c_nationkey", M.collation_key(F.lower("c_mktsegment"), "NOCASE").alias("k")).groupBy("c_nationkey", "k").agg(F.count("*").alias("m"))
    return a.join(b, ["c_nationkey", "k"]).groupBy("a_key").agg(F.sum("m").alias("n"))


@register("SELECT o_orderkey, CASE WHEN p > 0 AND p <= n THEN prev ELSE -1 END AS back FROM (SELECT o_orderkey, rn - off AS p, n, (SELECT i.o_orderkey FROM ranked i WHERE i.o_custkey = r.o_custkey AND i.rn = r.rn - r.off) AS prev FROM (SELECT 1) x, (SELECT * FROM ranked) r)".replace("FROM (SELECT o_orderkey, rn", "FROM (WITH ranked AS (SELECT o_orderkey, o_custkey, o_orderkey % 3 AS off, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_orderkey, rn"))
def win_lag_dynamic(spark: SparkSession, d: str) -> DataFrame:
    """LAG by an offset that differs by row: a self-join on the row number."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    r = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3).alias("off"), F.row_number().over(w).alias("rn"))
    to = r.select("o_custkey", F.col("rn").cast("long").alias("at"), F.col("o_orderkey").alias("prev"), F.lit(True).alias("found"))
    asked = r.withColumn("at", F.col("rn") - F.col("off"))
    out = asked.join(to, ["o_custkey", "at"], "left")
    return out.select("o_orderkey", F.when(F.col("found"), F.col("prev")).otherwise(-1).alias("back"))


# --- scalar functions
@register("SELECT o_orderkey, coalesce(s, 'NULL') AS t, CASE WHEN s IS NULL OR s = '' THEN 'none' ELSE s END AS z, CAST(s IS NULL AS INTEGER) AS isn, CASE WHEN o_custkey > 500 THEN 'hi' ELSE 'lo' END AS f, CASE WHEN o_custkey > 1000 THEN 'c' WHEN o_custkey > 500 THEN 'b' END AS sw, CASE o_orderkey % 4 WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS ch, coalesce(s, '?') AS c FROM (SELECT *, NULLIF(o_orderstatus, 'O') AS s FROM orders)")
def fn_null_choice(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.nullif(F.col("o_orderstatus"), F.lit("O")), F.col("o_custkey")
    return table(spark, d, "orders").select(
        "o_orderkey", S.text(s).alias("t"), S.nz(s, "none").alias("z"), S.isnull(s).alias("isn"),
        S.iif(k > 500, F.lit("hi"), F.lit("lo")).alias("f"), S.switch(k > 1000, F.lit("c"), k > 500, F.lit("b")).alias("sw"),
        S.choose(F.col("o_orderkey") % 4, F.lit("one"), F.lit("two")).alias("ch"), S.ifnull(s, F.lit("?")).alias("c"),
    )


@register("SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, left(p_name, 3) AS l, right(p_name, 4) AS r, upper(p_name) AS u, lower(p_brand) AS w, trim('  ' || p_name || chr(9)) AS t, replace(p_name, 'a', '') AS x FROM part")
def fn_text(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    padded = F.concat(F.lit("  "), n, F.lit("\t"))
    return table(spark, d, "part").select(
        "p_partkey", S.length(n).alias("n"), S.left(n, 3).alias("l"), S.right(n, 4).alias("r"), F.upper(n).alias("u"),
        F.lower("p_brand").alias("w"), S.trim(padded).alias("t"), S.replace(n, "a", None).alias("x"),
    )


ORACLES["fn_text"] = ORACLES["fn_text"].replace("trim('  ' || p_name || chr(9))", "trim('  ' || p_name || chr(9), ' ' || chr(9))")


@register("SELECT p_partkey, substring(p_name, greatest(p_size - 10, 1), 4) AS m, substring(p_name, 3) AS rest FROM part")
def fn_mid_clamp(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", S.mid(n, F.col("p_size") - 10, 4).alias("m"), S.mid(n, 3).alias("rest"))


@register("SELECT p_partkey, CAST(instr(lower(p_type), 'e') AS INTEGER) AS at FROM part")
def fn_instr(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.instr(F.col("p_type"), "E").alias("at"))


ORACLES["fn_instr"] = "SELECT p_partkey, CAST(instr(lower(p_type), 'e') AS INTEGER) AS \"at\" FROM part"


@register("SELECT p_partkey, CAST(starts_with(p_brand, 'Brand#1') AS INTEGER) AS a, CAST(ends_with(p_brand, '3') AS INTEGER) AS b, CAST(contains(p_name, 'a') AS INTEGER) AS c FROM part")
def fn_ordinal(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("p_brand")
    return table(spark, d, "part").select(
        "p_partkey", S.ordinal_starts_with(b, "Brand#1").alias("a"), S.ordinal_ends_with(b, "3").alias("b"), S.ordinal_contains(F.col("p_name"), "a").alias("c")
    )


@register("SELECT p_partkey, CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 ELSE 0 END AS c, coalesce(TRY_CAST(regexp_extract(CAST(p_size AS VARCHAR) || ' kg', '^[+-]?([0-9]+\\.?[0-9]*)') AS DOUBLE), 0.0) AS v FROM part")
def fn_strcomp_val(spark: SparkSession, d: str) -> DataFrame:
    v = S.val(F.concat(F.col("p_size").cast("string"), F.lit(" kg")))
    return table(spark, d, "part").select("p_partkey", S.strcomp(F.col("p_name"), F.col("p_type")).alias("c"), v.alias("v"))


@register("SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS n, CAST(second(ts) AS INTEGER) AS s, CAST(dayofweek(ts) + 1 AS INTEGER) AS w FROM events")
def fn_date_parts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ts")
    return table(spark, d, "events").select(
        "event_id", S.year(t).alias("y"), S.month(t).alias("m"), S.day(t).alias("d"), S.hour(t).alias("h"), S.minute(t).alias("n"), S.second(t).alias("s"), S.weekday(t).alias("w")
    )


@register("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS m, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS d, strftime(o_orderdate + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS h FROM orders WHERE o_orderdate = date_trunc('day', o_orderdate)")
def fn_dateadd(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    rows = table(spark, d, "orders").filter(F.date_trunc("day", t) == t)
    return rows.select("o_orderkey", S.dateadd("m", 1, t).alias("m"), S.dateadd("d", 10, t).alias("d"), S.dateadd("h", 5, t).alias("h"))


_EPOCH = "TIMESTAMP '2024-01-10 12:30:00'"


@register(f"SELECT event_id, CAST(year(ts) - 2024 AS INTEGER) AS y, CAST(datediff('month', {_EPOCH}, ts) AS INTEGER) AS m, CAST(datediff('day', {_EPOCH}, ts) AS INTEGER) AS d, CAST(floor(datediff('day', {_EPOCH}, ts) / 7.0) AS INTEGER) AS ww, date_sub('hour', {_EPOCH}, ts) AS h, date_sub('second', {_EPOCH}, ts) AS s FROM events")
def fn_datediff(spark: SparkSession, d: str) -> DataFrame:
    a, t = F.expr(_EPOCH), F.col("ts")
    rows = table(spark, d, "events")
    a = a.cast(dict(rows.dtypes)["ts"])
    return rows.select("event_id", *(S.datediff(u, a, t).alias(n) for n, u in (("y", "yyyy"), ("m", "m"), ("d", "d"), ("ww", "ww"), ("h", "h"), ("s", "s"))))


@register("SELECT o_orderkey, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(dayofyear(o_orderdate) AS INTEGER) AS y, CAST(weekofyear(o_orderdate) AS INTEGER) AS ww, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS w FROM orders")
def fn_datepart(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", *(S.datepart(u, t).alias(u) for u in ("q", "y", "ww", "w")))


@register("SELECT p_partkey, strftime(make_date(2000, 1, 1) + to_months(p_size - 1) + to_days(CAST(p_partkey % 45 - 1 AS INTEGER)), '%Y-%m-%d') AS d, lpad(CAST((p_size * 3600 + 75 * 60) % 86400 // 3600 AS VARCHAR), 2, '0') || ':15:00' AS t FROM part")
def fn_serial(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", S.dateserial(F.lit(2000), size, (F.col("p_partkey") % 45).cast("int")).alias("d"), S.timeserial(size, F.lit(75), F.lit(0)).alias("t")
    )


@register("SELECT p_partkey, monthname(make_date(2000, CAST(p_size % 12 + 1 AS INTEGER), 1)) AS m, left(monthname(make_date(2000, CAST(p_size % 12 + 1 AS INTEGER), 1)), 3) AS s FROM part")
def fn_monthname(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("p_size") % 12 + 1).cast("int")
    return table(spark, d, "part").select("p_partkey", S.monthname(n).alias("m"), S.monthname(n, True).alias("s"))


@register("SELECT p_partkey, CAST(round_even(CAST(p_retailprice AS DECIMAL(18,2)), 1) AS DOUBLE) AS r, floor(-p_retailprice) AS f, trunc(-p_retailprice) AS x, CAST(sign(p_size - 25) AS INTEGER) AS s, abs(p_size - 25) AS a FROM part")
def fn_math_round_even(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("p_retailprice"), F.col("p_size") - 25
    return table(spark, d, "part").select(
        "p_partkey", S.round_(p.cast("decimal(18,2)"), 1).cast("double").alias("r"), S.int_(-p).alias("f"), S.fix(-p).alias("x"), S.sgn(s).alias("s"), S.abs_(s).alias("a")
    )


@register("SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, CAST(round_even(p_size / 2.0, 0) AS INTEGER) AS i, CAST(p_size AS DOUBLE) * 1000 AS d, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS b, CASE WHEN p_size < 13 THEN '2020-' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-01' END AS dt FROM part")
def fn_convert(spark: SparkSession, d: str) -> DataFrame:
    z = F.col("p_size")
    yes = F.when(z % 2 == 0, F.lit(" Yes ")).otherwise("n")
    day = F.concat(F.lit("2020-"), F.lpad(z.cast("string"), 2, "0"), F.lit("-01"))
    return table(spark, d, "part").select(
        "p_partkey", S.cstr(z).alias("s"), S.cint(z / 2).alias("i"), S.cdbl(F.concat(z.cast("string"), F.lit(",000"))).alias("d"), S.cbool(yes).alias("b"), S.cdate(day).alias("dt")
    )


@register("SELECT p_partkey, format('{:,.2f}', p_retailprice) AS f FROM part")
def fn_format(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.format_(F.col("p_retailprice"), "#,##0.00").alias("f"))


@register("SELECT o_orderkey, 1 AS found, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
def fn_xml(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit('<o><c id="'), F.col("o_custkey").cast("string"), F.lit('"/></o>'))
    found, customer = S.xml_parts(x, exists=["/o/c"], values=["/o/c/@id"])
    return table(spark, d, "orders").select("o_orderkey", found.alias("found"), customer.alias("customer"))


@register("SELECT o_orderkey, 9007199254740993 + o_orderkey AS wide, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(o_custkey AS BIGINT) END AS some, CAST(round_even(o_custkey / 2.0, 0) AS INTEGER) AS half FROM orders")
def fn_clng(spark: SparkSession, d: str) -> DataFrame:
    """Beyond 2**53, out of range, not a number, and halves."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    wide = S.clng((F.lit(9007199254740993) + k).cast("string"))
    some = S.clng(F.when(k % 4 == 0, "1e30").when(k % 4 == 2, "x").otherwise(c.cast("string")))
    return table(spark, d, "orders").select("o_orderkey", wide.alias("wide"), some.alias("some"), S.cint((c / 2).cast("string")).alias("half"))


@register("SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN 'y' ELSE 'n' END AS number, CASE WHEN p_size % 2 = 0 THEN 'n' ELSE 'y' END AS word, CASE WHEN p_size % 5 = 0 THEN 1 WHEN p_size % 7 <> 0 THEN 2 END AS picked FROM part")
def fn_truth(spark: SparkSession, d: str) -> DataFrame:
    """IIF and SWITCH of numbers, text and NULL."""
    z = F.col("p_size")
    word = F.when(z % 2 == 0, F.when(z % 4 == 0, F.lit("false")).otherwise(F.lit(" 0 "))).otherwise(F.when(z % 3 == 0, F.lit("x")).otherwise(F.lit("True")))
    blank = F.when(z % 5 == 0, F.lit("1.5")).when(z % 11 == 0, F.lit(None)).otherwise(F.lit("  "))
    return table(spark, d, "part").select(
        "p_partkey", S.iif(z % 3, F.lit("y"), F.lit("n")).alias("number"), S.iif(word, F.lit("y"), F.lit("n")).alias("word"),
        S.switch(blank, F.lit(1), (z % 7).cast("double"), F.lit(2)).alias("picked"),
    )


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END AS y, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(month(o_orderdate) AS INTEGER) END AS m, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN CAST(hour(o_orderdate) AS INTEGER) END AS h FROM orders")
def fn_date_text(spark: SparkSession, d: str) -> DataFrame:
    """Dates from text, from numbers of days, and from what is neither."""
    k, t = F.col("o_orderkey") % 3, F.col("o_orderdate")
    days = (F.datediff(t, F.lit("1899-12-30")) + 0.25).cast("string")
    x = F.when(k == 0, F.lit("nope")).when(k == 1, F.date_format(t, "yyyy-MM-dd HH:mm:ss")).otherwise(days)
    return table(spark, d, "orders").select("o_orderkey", S.year(x).alias("y"), S.month(x).alias("m"), S.hour(x).alias("h"))


@register("SELECT o_orderkey, CAST(floor(-(90071992547409.93::DECIMAL(18,2) + o_orderkey)) AS DECIMAL(18,2)) AS f, CAST(-(90071992547409::DECIMAL(18,2) + o_orderkey) AS DECIMAL(18,2)) AS x FROM orders")
def fn_fix_decimal(spark: SparkSession, d: str) -> DataFrame:
    v = -(F.lit("90071992547409.93").cast("decimal(18,2)") + F.col("o_orderkey").cast("decimal(18,2)")).cast("decimal(18,2)")
    return table(spark, d, "orders").select("o_orderkey", S.int_(v, "decimal(18,2)").alias("f"), S.fix(v, "decimal(18,2)").alias("x"))


@register("SELECT p_partkey, CAST(length(p_name) + 2 AS INTEGER) AS n FROM part")
def fn_len_units(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.length(F.concat("p_name", F.lit("\U0001f600"))).alias("n"))


@register("SELECT true AS same_day, true AS same_time, true AS this_century")
def fn_now(spark: SparkSession, d: str) -> DataFrame:
    """DATE, TIME and NOW are of one moment in a statement."""
    day, clock, now = S.date_today(), S.time_today(), S.now_text()
    return spark.range(1).select((F.left(now, F.lit(10)) == day).alias("same_day"), (F.right(now, F.lit(8)) == clock).alias("same_time"), now.rlike(r"^20\d\d-\d\d-\d\d \d\d:\d\d:\d\d$").alias("this_century"))


# --- data hygiene
_NORM = "lower(trim(text))"


@register(
    f"SELECT coalesce('[''' || replace(min_by({_NORM}, doc_id), '''', '''''') || ''']', '[NULL]') AS key_values, COUNT(*) AS group_size, MIN(doc_id) AS winner_rowid, CAST(MIN(doc_id) AS VARCHAR) AS winner_primary_key, "
    f"array_to_string(list_sort(list(doc_id))[2:], ',') AS duplicate_rowids, array_to_string(list_sort(list(doc_id))[2:], ',') AS duplicate_primary_keys FROM documents GROUP BY {_NORM} HAVING COUNT(*) > 1"
)
def hyg_find_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("norm", F.expr(_NORM))
    return H.find_duplicates(docs.select("doc_id", "norm"), ["norm"], "doc_id")


@register(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_NORM}")
def hyg_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.expr(_NORM).alias("norm"))
    return H.dedup(docs, ["norm"], "doc_id").select("doc_id")


@register("SELECT max(event_id) AS event_id FROM events GROUP BY upper(event_type), user_id")
def hyg_dedup_last(spark: SparkSession, d: str) -> DataFrame:
    return H.dedup(table(spark, d, "events"), [("event_type", "NOCASE"), "user_id"], "event_id", "last").select("event_id")


@register("SELECT 'customer' AS table_name, count(*) FILTER (n > 1) AS duplicate_group_count, CAST(sum(n - 1) AS BIGINT) AS rows_deleted, count(*) AS rows_kept FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)")
def hyg_dedup_summary(spark: SparkSession, d: str) -> DataFrame:
    return H.dedup_summary(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", "customer")


@register("SELECT min(o_orderkey) AS o_orderkey, o_custkey, coalesce(min_by(x, o_orderkey) FILTER (true), NULL) AS status FROM (SELECT 1)")
def hyg_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("status"))
    return H.merge_duplicates(rows, ["o_custkey"], "o_orderkey")


ORACLES["hyg_merge"] = (
    "WITH r AS (SELECT o_orderkey, o_custkey, NULLIF(o_orderstatus, 'O') AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) "
    "SELECT min(o_orderkey) AS o_orderkey, o_custkey, coalesce(max(CASE WHEN rn = 1 THEN status END), CASE WHEN count(DISTINCT status) = 1 THEN min(status) END) AS status FROM r GROUP BY o_custkey"
)


@register("SELECT * FROM (SELECT 'price' AS rule_name, 'orders' AS table_name, 'o_totalprice' AS column_name, o_orderkey AS rowid, CAST(o_orderkey AS VARCHAR) AS primary_key, 'too dear' AS message FROM orders WHERE NOT coalesce(o_totalprice < 45000, false) UNION ALL SELECT 'open', 'orders', 'o_orderstatus', o_orderkey, CAST(o_orderkey AS VARCHAR), 'not open' FROM orders WHERE NOT coalesce(NULLIF(o_orderstatus, 'P') = 'O', false))")
def hyg_validate(spark: SparkSession, d: str) -> DataFrame:
    rules = [("price", "o_totalprice", "o_totalprice < 45000", "too dear"), ("open", "o_orderstatus", "nullif(o_orderstatus, 'P') = 'O'", "not open")]
    return H.validate(table(spark, d, "orders"), rules, "o_orderkey", "orders")


ORACLES["hyg_validate"] = ORACLES["hyg_validate"].replace("AS rowid", 'AS "rowid"')


@register("SELECT NULL::VARCHAR AS constraint_name, 'documents' AS child_table, 'doc_id' AS child_column, doc_id AS child_rowid, CAST(doc_id AS VARCHAR) AS child_value, 'labels' AS parent_table, 'doc_id' AS parent_column FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def hyg_orphans(spark: SparkSession, d: str) -> DataFrame:
    return H.find_orphans(table(spark, d, "documents"), "doc_id", table(spark, d, "labels"), "doc_id", "doc_id", "documents", "labels")


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'SourceOnly' WHEN o_orderkey % 11 = 1 THEN 'TargetOnly' ELSE 'Changed' END AS difference, CASE WHEN o_orderkey % 11 = 2 THEN 'o_orderstatus' ELSE '' END AS changed_columns FROM orders WHERE o_orderkey % 11 < 2 OR (o_orderkey % 11 = 2 AND o_orderstatus <> 'O')")
def data_compare(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    k = F.col("o_orderkey") % 11
    target = o.filter(k != 0).withColumn("o_orderstatus", F.when(k == 2, "O").otherwise(F.col("o_orderstatus")))
    return H.compare(o.filter(k != 1), target, "o_orderkey")


@register()
def checksum_buckets(spark: SparkSession, d: str) -> DataFrame:
    """bucket, rows, digest of all 256 buckets, empty ones too; DuckDB has no xxhash64 like Spark's."""
    sums = H.checksum(table(spark, d, "lineitem"))
    every = spark.range(256).select(F.col("id").alias("bucket"))
    return every.join(sums, "bucket", "left").select("bucket", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("digest", F.lit(0)).alias("digest"))


_CHECKED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
_MD5 = "('0x' || substr(md5(concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in _CHECKED) + ")), 1, 15))::BIGINT"


@register(f"SELECT CAST(h % 256 AS BIGINT) AS bucket, count(*) AS rows, CAST(sum(h) AS DECIMAL(38,0)) AS digest FROM (SELECT {_MD5} AS h FROM lineitem) GROUP BY 1")
def checksum_portable(spark: SparkSession, d: str) -> DataFrame:
    """Digests that another engine can compute too: of md5 in place of xxhash64."""
    return H.checksum(table(spark, d, "lineitem").select(*_CHECKED), portable=True)


ORACLES["checksum_portable"] = ORACLES["checksum_portable"].replace("AS rows,", 'AS "rows",')


@register("SELECT k, CASE WHEN g % 11 = 0 THEN 'SourceOnly' WHEN g % 11 = 1 THEN 'TargetOnly' ELSE 'Changed' END AS difference, CASE WHEN g % 11 = 2 THEN 'v' ELSE '' END AS changed_columns FROM (SELECT nullif(o_orderkey, 11 * 3) AS k, o_orderkey AS g FROM orders) WHERE g % 11 IN (0, 1, 2)")
def data_compare_null_key(spark: SparkSession, d: str) -> DataFrame:
    """A row with a NULL key on one side only, and one on the other side with a key."""
    o = table(spark, d, "orders").select(F.nullif(F.col("o_orderkey"), F.lit(33)).alias("k"), (F.col("o_orderkey") % 11).alias("g"), F.lit("a").alias("v"))
    target = o.filter("g <> 0").withColumn("v", F.when(F.col("g") == 2, "b").otherwise(F.col("v"))).drop("g")
    return H.compare(o.filter("g <> 1").drop("g"), target, "k")


@register("SELECT user_id, list_sort(list(event_id))[1] AS winner_rowid, count(*) AS members FROM events GROUP BY user_id HAVING count(*) > 1")
def hyg_duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id")
    found = H.duplicate_members(rows, ["user_id"], "event_id").join(rows.withColumnRenamed("event_id", "rowid"), "rowid")
    return found.groupBy("user_id", "winner_rowid").agg(F.count("*").alias("members")).select("user_id", "winner_rowid", "members")


@register(
    "WITH r AS (SELECT o_custkey, NULLIF(o_orderstatus, 'O') AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders), "
    "g AS (SELECT count(*) AS n, count(DISTINCT status) AS offers, max(status) FILTER (rn = 1) AS own FROM r GROUP BY o_custkey) "
    "SELECT 'orders' AS table_name, count(*) FILTER (n > 1) AS duplicate_group_count, CAST(sum(n - 1) AS BIGINT) AS rows_deleted, count(*) AS rows_kept, "
    "count(*) FILTER (own IS NULL AND offers = 1) AS rows_updated, count(*) FILTER (own IS NULL AND offers > 1) AS merge_conflict_count, "
    "CASE WHEN count(*) FILTER (own IS NULL AND offers > 1) > 0 THEN 'status: ' || count(*) FILTER (own IS NULL AND offers > 1) END AS merge_conflicts FROM g"
)
def hyg_merge_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("status"))
    return H.merge_summary(rows, ["o_custkey"], "o_orderkey", "orders")


# --- statistics and catalogue
@register("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count, count({c}) AS non_null_count, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM customer" for c in ("c_custkey", "c_nationkey", "c_mktsegment")) + ")")
def stats_columns(spark: SparkSession, d: str) -> DataFrame:
    return H.column_stats(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"))


@register("SELECT CAST(least(floor((l_quantity - 1) / 49 * 8), 7) AS INTEGER) AS bucket, count(*) AS row_count, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def stats_histogram(spark: SparkSession, d: str) -> DataFrame:
    return H.histogram(table(spark, d, "lineitem"), "l_quantity")


@register("SELECT l_returnflag AS value, count(*) AS row_count, count(*) * 1000000 // (SELECT count(*) FROM lineitem) AS frequency_ppm FROM lineitem GROUP BY 1")
def stats_heavy_hitters(spark: SparkSession, d: str) -> DataFrame:
    return H.heavy_hitters(table(spark, d, "lineitem"), "l_returnflag")


@register("SELECT * FROM (SELECT 'c_nationkey' AS prefix, count(DISTINCT c_nationkey) AS distinct_count FROM customer UNION ALL SELECT 'c_nationkey,c_mktsegment', count(DISTINCT (c_nationkey, c_mktsegment)) FROM customer)")
def stats_prefix(spark: SparkSession, d: str) -> DataFrame:
    return H.prefix_counts(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@register("SELECT * FROM (VALUES ('region', 'r_regionkey', 1), ('region', 'r_name', 2), ('nation', 'n_nationkey', 1), ('nation', 'n_name', 2), ('nation', 'n_regionkey', 3)) t(table_name, column_name, ordinal)")
def sys_columns(spark: SparkSession, d: str) -> DataFrame:
    return T.sys_columns(spark, {t: table(spark, d, t) for t in ("region", "nation")}).select("table_name", "column_name", "ordinal")


@register("SELECT c_custkey, c_name FROM customer WHERE upper(c_mktsegment) LIKE 'AUTO%' ORDER BY c_name, c_custkey LIMIT 10 OFFSET 20")
def paged_query(spark: SparkSession, d: str) -> DataFrame:
    return T.page(table(spark, d, "customer"), ["c_name", "c_custkey"], 10, 2, {"c_mktsegment": ("startswith", "auto")}).select("c_custkey", "c_name")


@register()
def explain_plan(spark: SparkSession, d: str) -> DataFrame:
    return T.explain(QUERIES["star_join"](spark, d))


# --- table changes
@register("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NOWHERE'")
def dml_insert(spark: SparkSession, d: str) -> DataFrame:
    return T.insert(table(spark, d, "region"), spark.createDataFrame([(99, "NOWHERE")], "R_REGIONKEY bigint, r_name string"))


@register("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def dml_update(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return T.update(rows, F.col("o_orderstatus") == "F", {"o_totalprice": F.col("o_totalprice") * 2}).drop("o_orderstatus")


@register("SELECT o_orderkey FROM orders WHERE NOT coalesce(NULLIF(o_orderstatus, 'O') = 'F', false)")
def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    return T.delete(table(spark, d, "orders"), F.nullif(F.col("o_orderstatus"), F.lit("O")) == "F").select("o_orderkey")


@register("SELECT * FROM (SELECT 'not_null s' AS \"constraint\", count(*) FILTER (o_orderstatus = 'O') AS row_count FROM orders UNION ALL SELECT 'check dear', count(*) FILTER (o_totalprice >= 40000) FROM orders UNION ALL SELECT 'unique o_custkey', CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1)) WHERE row_count > 0")
def constraint_check(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("s", F.nullif(F.col("o_orderstatus"), F.lit("O")))
    return T.violations(rows, [["o_custkey"]], ["s"], {"dear": "o_totalprice < 40000"})


# --- pipelines
@register("SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, CAST(user_id AS DOUBLE) AS who FROM events")
def pipe_select_rename_cast(spark: SparkSession, d: str) -> DataFrame:
    steps = [P.Step("select", ["event_id", "event_type", "user_id"]), P.Step("rename", {"event_id": "id", "event_type": "kind", "user_id": "who"}), P.Step("cast", {"id": "text", "who": "real"})]
    return P.run(P.Package("events", steps), table(spark, d, "events"))[0]


@register("SELECT event_id FROM events WHERE user_id >= 100")
def pipe_filter(spark: SparkSession, d: str) -> DataFrame:
    return P.run(P.Package("f", [P.Step("filter", "user_id >= 100"), P.Step("select", ["event_id"])]), table(spark, d, "events"))[0]


@register("SELECT n_nationkey, n_name, n_name AS copy, 'fixed' AS tag, 7 AS seven FROM nation")
def pipe_derive(spark: SparkSession, d: str) -> DataFrame:
    steps = [P.Step("select", ["n_nationkey", "n_name"]), P.Step("derive", {"copy": "n_name", "tag": "'fixed'", "seven": "7"})]
    return P.run(P.Package("d", steps), table(spark, d, "nation"))[0]


@register("SELECT min(event_id) AS event_id, user_id FROM events GROUP BY user_id")
def pipe_dedup(spark: SparkSession, d: str) -> DataFrame:
    steps = [P.Step("select", ["event_id", "user_id"]), P.Step("deduplicate", {"keys": ["user_id"], "by": "event_id"})]
    return P.run(P.Package("u", steps), table(spark, d, "events"))[0]


@register("SELECT p_partkey, p_size AS code FROM part WHERE p_size % 5 <> 0")
def pipe_skip_bad(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("p_size") % 5 == 0, F.lit("bad")).otherwise(F.col("p_size").cast("string"))
    source = table(spark, d, "part").select("p_partkey", code.alias("code"))
    return P.run(P.Package("s", [P.Step("cast", {"code": "integer"})], skip_bad_rows=True), source)[0]


@register("SELECT event_id FROM events WHERE event_id > 4000")
def pipe_incremental(spark: SparkSession, d: str) -> DataFrame:
    return incremental.since(table(spark, d, "events"), "event_id", 4000).select("event_id")


# --- collections and full text
@register("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def coll_path_eq(spark: SparkSession, d: str) -> DataFrame:
    return C.find_by_path(table(spark, d, "events"), "$.k", 42, "props").select("event_id")


@register("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) BETWEEN 10 AND 20")
def coll_path_range(spark: SparkSession, d: str) -> DataFrame:
    return C.find_by_range(table(spark, d, "events"), "$.k", 10, 20, doc="props").select("event_id")


@register("SELECT DISTINCT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey = 17")
def coll_array_contains(spark: SparkSession, d: str) -> DataFrame:
    """Documents as structs, so that no line is made into text and parsed again."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"))).alias("lines"))
    docs = lines.select("o_orderkey", F.struct("lines").alias("doc"))
    return C.find_by_path(docs, "$.lines[].part", 17).select("o_orderkey")


@register("SELECT doc_id, 2 AS score FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}'']+'), 'with') AND list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}'']+'), 'from')")
def fts_and_terms(spark: SparkSession, d: str) -> DataFrame:
    return C.search(table(spark, d, "documents"), ["text"], "From WITH from").select("doc_id", "score")


@register("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 17)")
def coll_array_json(spark: SparkSession, d: str) -> DataFrame:
    """The same search over JSON text."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"))).alias("lines"))
    docs = lines.select("o_orderkey", F.to_json(F.struct("lines")).alias("doc"))
    return C.find_by_path(docs, "$.lines[].part", 17).select("o_orderkey")


@register("SELECT doc_id FROM documents WHERE doc_id % 7 = 3")
def fts_apostrophes(spark: SparkSession, d: str) -> DataFrame:
    """Apostrophes are part of a token, and compatibility forms are the same letters."""
    tail = F.when(F.col("doc_id") % 7 == 3, " 'Tis \uff30\uff59 ").otherwise(" tis py ")
    return C.search(table(spark, d, "documents").select("doc_id", F.concat(F.left("text", F.lit(0)), tail).alias("t")), ["t"], "'tis PY").select("doc_id")


@register(ORACLES["fts_and_terms"])
def fts_by_index(spark: SparkSession, d: str) -> DataFrame:
    index = C.index_terms(table(spark, d, "documents"), "doc_id", ["text"])
    return C.search_index(index, "From WITH from").select(F.col("id").alias("doc_id"), "score")


# --- graphs, places, time series, reports, shards
def _stored(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes a table to an engine's folder and reads it back."""
    return Engine(spark)._stored


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders lead from one customer to another."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("src"), F.expr("(o_custkey * 7 + o_orderkey % 2) % 1009").alias("dst")).distinct()


_WALK = (
    "WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS src, (o_custkey * 7 + o_orderkey % 2) % 1009 AS dst FROM orders), "
    "w(node, depth) AS (SELECT 3::BIGINT, 0 UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = w.node WHERE depth < 4) "
)


@register(_WALK + "SELECT node, min(depth) AS depth FROM w GROUP BY node")
def graph_reachable(spark: SparkSession, d: str) -> DataFrame:
    return X.reachable(_edges(spark, d), 3, 4, _stored(spark))


@register(_WALK + "SELECT min(depth) AS hops FROM w WHERE node = (SELECT max(node) FROM w)")
def graph_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    edges, store = _edges(spark, d), _stored(spark)
    goal = X.reachable(edges, 3, 4, store).agg(F.max("node")).first()[0]
    return spark.createDataFrame([(len(X.shortest_path(edges, 3, goal, 4, store)) - 1,)], "hops int")


_PLACES = "SELECT event_id, (event_id * 37 % 1700) / 10.0 - 85 AS lat, (event_id * 91 % 3600) / 10.0 - 180 AS lon FROM events"


@register(f"SELECT event_id FROM ({_PLACES}) p WHERE 2 * 6371 * asin(sqrt(pow(sin((radians(lat) - radians(47.0)) / 2), 2) + cos(radians(lat)) * cos(radians(47.0)) * pow(sin((radians(lon) - radians(8.0)) / 2), 2))) <= 1500")
def spatial_radius(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("event_id", "CAST((event_id * 37 % 1700) / 10.0 - 85 AS DOUBLE) AS lat", "CAST((event_id * 91 % 3600) / 10.0 - 180 AS DOUBLE) AS lon")
    return X.within_radius(e, 47.0, 8.0, 1500.0).select("event_id")


@register(f"SELECT event_id FROM ({_PLACES}) p WHERE lat BETWEEN -10 AND 20 AND (lon >= 170 OR lon <= -160)")
def spatial_box(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("event_id", "CAST((event_id * 37 % 1700) / 10.0 - 85 AS DOUBLE) AS lat", "CAST((event_id * 91 % 3600) / 10.0 - 180 AS DOUBLE) AS lon")
    return X.within_box(e, -10, 170, 20, -160).select("event_id")


@register("SELECT event_type, count(value) AS \"count\", min(value) AS \"min\", max(value) AS \"max\", arg_min(value, ts) AS \"first\", arg_max(value, ts) AS \"last\" FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY event_type")
def ts_summary(spark: SparkSession, d: str) -> DataFrame:
    import datetime

    found = X.summary(table(spark, d, "events"), "ts", "value", datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 20), ["event_type"])
    return found.drop("sum", "avg")


@register(
    "SELECT o_orderstatus, o_orderpriority, CAST(2 - grouping(o_orderstatus) - grouping(o_orderpriority) AS INTEGER) AS level, CAST(sum(o_custkey) AS DOUBLE) AS s, count(o_custkey) AS n, CAST(max(o_custkey) AS DOUBLE) AS m, "
    "NULL::DOUBLE AS t FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"
)
def report_groups(spark: SparkSession, d: str) -> DataFrame:
    return X.report_groups(
        table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], {"s": ("SUM", "o_custkey"), "n": ("COUNT", "o_custkey"), "m": ("MAX", "o_custkey"), "t": ("SUM", "o_orderpriority")}
    )


@register("SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'north' ELSE 'rest' END AS part, count(*) AS n FROM customer GROUP BY 1")
def shard_queries(spark: SparkSession, d: str) -> DataFrame:
    """One shard holds a pinned key; the rows of all others are theirs."""
    segments = table(spark, d, "customer").select("c_mktsegment")
    pins = {s: "south" for s in ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")} | {"BUILDING": "north"}
    found = X.on_all_shards(segments, "c_mktsegment", ["north", "south"], lambda df: df.agg(F.count("*").alias("n")), pins)
    return found.select(F.when(F.col("shard") == "north", "north").otherwise("rest").alias("part"), "n")


@register("SELECT p_partkey AS id, p_name || '!' AS name, 'fixed' AS tag, p_size * 2.0 AS size FROM part WHERE p_size >= 10 AND p_size % 5 <> 0")
def pipe_package(spark: SparkSession, d: str) -> DataFrame:
    """A JSON package with bad rows, a user's function and a table as its destination."""
    engine = Engine(spark)
    code = F.when(F.col("p_size") % 5 == 0, F.lit("bad")).otherwise(F.col("p_size").cast("string"))
    engine.attach("raw", table(spark, d, "part").select("p_partkey", "p_name", code.alias("code")))
    engine.register("Shout", 1, lambda s: s + "!", null_propagating=True)
    engine.execute("CREATE TABLE parts (id BIGINT PRIMARY KEY, name TEXT, tag TEXT DEFAULT 'none', size DOUBLE)")
    package = """{"Name": "parts", "version": "1", "source": {"kind": "Table", "tableName": "raw"}, "destination": {"kind": "table", "tableName": "parts"},
      "options": {"errorMode": "SkipBadRows"}, "transforms": [{"kind": "cast", "castMappings": [{"column": "code", "targetType": "real"}]},
      {"kind": "filter", "filterExpression": "code >= 10"}, {"kind": "rename", "renameMappings": [{"source": "p_partkey", "target": "id"}]},
      {"kind": "derive", "derivedColumns": [{"name": "name", "expression": "Shout(p_name)"}, {"name": "tag", "expression": "'fixed'"}, {"name": "size", "expression": "code"}]},
      {"kind": "select", "selectColumns": ["id", "name", "tag", "size"]}]}"""
    packages.Runner(spark, engine, f"{engine.root}/state").run(package)
    return engine.execute("SELECT id, name, tag, size * 2 AS size FROM parts")


# --- sources and sinks
_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@register(_NATION)
def io_csv(spark: SparkSession, d: str) -> DataFrame:
    """Written, read as text, typed by what its values look like."""
    path = f"{Engine(spark).root}/csv"
    files.write_csv(table(spark, d, "nation"), path)
    back = files.read_csv(spark, path)
    kinds = files.infer_types(back)
    return back.select(*(F.col(c).cast("int" if k == "bigint" else k).alias(c) for c, k in kinds.items()))


@register("SELECT CAST(n_nationkey AS VARCHAR) AS column1, n_name AS column2, CAST(n_regionkey AS VARCHAR) AS column3 FROM nation")
def io_csv_without_header(spark: SparkSession, d: str) -> DataFrame:
    path = f"{Engine(spark).root}/csv"
    table(spark, d, "nation").write.csv(path)
    return files.read_csv(spark, path, header=False)


@register("SELECT n_nationkey AS k, '{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}' AS o FROM nation")
def io_json(spark: SparkSession, d: str) -> DataFrame:
    """An array of objects; what is nested comes back as JSON text."""
    path = f"{Engine(spark).root}/json"
    files.write_json(table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("o")), path)
    return files.read_json(spark, path).select("k", "o")


@register("SELECT n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def io_external_table(spark: SparkSession, d: str) -> DataFrame:
    """A table archive under an external table's name."""
    engine = Engine(spark)
    files.write_archive(table(spark, d, "nation"), f"{engine.root}/archive")
    engine.attach("customer", table(spark, d, "customer"))
    return engine.script(f"CREATE EXTERNAL TABLE far FROM '{engine.root}/archive'; SELECT n_name, COUNT(*) AS n FROM far JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")


@register("SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS price, 'new' AS state FROM orders")
def io_table_sink(spark: SparkSession, d: str) -> DataFrame:
    engine = Engine(spark)
    engine.execute("CREATE TABLE bought (id BIGINT PRIMARY KEY, price DECIMAL(18,2), state TEXT DEFAULT 'new')")
    engine.append("bought", table(spark, d, "orders").select(F.col("o_orderkey").alias("ID"), F.col("o_totalprice").alias("price")))
    return engine.execute("SELECT * FROM bought")


@register("SELECT p_partkey, p_size FROM part WHERE p_size > 40")
def io_sql_pages(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "part").createOrReplaceTempView("part")
    store, pages = _stored(spark), list(files.sql_source(spark, "SELECT p_partkey, p_size FROM part WHERE p_size > 40", ["p_partkey"], 4000))
    return H.union_all([store(p) for p in pages])


@register(
    "SELECT * FROM (VALUES ('flag', 'boolean', 'boolean'), ('whole', 'signed', 'bigint'), ('huge', 'unsigned', 'decimal(20,0)'), ('money', 'decimal', 'decimal(18,2)'), ('tiny', 'decimal', 'decimal(18,6)'), "
    "('code', 'text', 'string'), ('day', 'date', 'date'), ('clock', 'time', 'string'), ('at', 'datetime', 'timestamp_ntz'), ('zoned', 'datetimeoffset', 'timestamp'), ('uuid', 'guid', 'string'), ('none', 'text', 'string')) t(name, kind, type)"
)
def io_csv_inference(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    texts = table(spark, d, "orders").select(
        F.when(k % 2 == 0, "True").otherwise("false").alias("flag"), k.cast("string").alias("whole"), F.lit("18446744073709551615").alias("huge"), F.format_string("%d.%02d", k, (k % 100).cast("int")).alias("money"),
        F.lit("0.000001").alias("tiny"), F.lpad(k.cast("string"), 9, "0").alias("code"), F.date_format(t, "yyyy-MM-dd").alias("day"), F.date_format(t, "HH:mm").alias("clock"), F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("zoned"), F.concat(F.lit("123e4567-e89b-12d3-a456-"), F.lpad(k.cast("string"), 12, "0")).alias("uuid"), F.when(k % 2 == 0, " ").alias("none"),
    )
    rows = [(c, name, kind) for c, (name, kind) in files.inferred(texts).items()]
    return spark.createDataFrame(rows, "name string, kind string, type string")


# --- collections of documents
@register("SELECT event_id AS key, CASE WHEN event_id % 10 = 1 THEN 'new' ELSE event_type END AS doc FROM events WHERE event_id % 10 <> 2")
def coll_changes(spark: SparkSession, d: str) -> DataFrame:
    """Some documents are put in place of others, some are deleted."""
    docs = table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("doc"))
    changed = C.put(docs, docs.filter("key % 10 = 1").withColumn("doc", F.lit("new")))
    return C.delete(changed, docs.filter("key % 10 = 2"))


@register("SELECT event_id AS key FROM events WHERE event_type LIKE 'p%' OR event_id = 7")
def coll_get_find(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("doc"))
    return C.get(docs, 7).select("key").union(C.find(docs, F.col("doc").startswith("p")).select("key")).distinct()


@register("SELECT c_custkey FROM customer WHERE upper(c_mktsegment) = 'BUILDING'")
def coll_path_collation(spark: SparkSession, d: str) -> DataFrame:
    segment = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    docs = table(spark, d, "customer").select("c_custkey", F.to_json(F.struct(F.struct(segment.alias("name")).alias("segment"))).alias("doc"))
    return C.find_by_path(docs, "$.segment.name", "Building", collation="NOCASE").select("c_custkey")


@register("SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS n, CAST(o_orderkey * 100 AS VARCHAR) || '.0 %' AS p, lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(8, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS d FROM orders")
def fn_format_standard(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", S.format_(F.col("o_totalprice"), "N2").alias("n"), F.replace(S.format_(k.cast("double"), "P1"), F.lit(","), F.lit("")).alias("p"), S.format_(k, "D8").alias("d"))


@register("SELECT p_partkey, 1 AS found, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def fn_xml_namespaces(spark: SparkSession, d: str) -> DataFrame:
    x = F.format_string('<a xmlns:x="urn:1" xmlns="urn:2"><x:b size="%d">%s</x:b><b>no</b></a>', F.col("p_size"), F.replace(F.col("p_name"), F.lit("&"), F.lit("&amp;")))
    names = {"q": "urn:1", "d": "urn:2"}
    return table(spark, d, "part").select(
        "p_partkey", S.xml_exists(x, "/d:a/q:b", names).alias("found"), S.xml_value(x, "/d:a/q:b", names).alias("name"), S.xml_value(x, "//q:b/@size", names).alias("size")
    )
