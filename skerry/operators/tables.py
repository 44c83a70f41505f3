"""Copy-on-write table changes, constraints and catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table and rows, which are cast to its types; missing columns are NULL."""
    have = {c.lower(): c for c in rows.columns}
    cols = [(F.col(have[c.lower()]) if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in table.dtypes]
    return table.unionByName(rows.select(*cols))


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    kinds = dict(table.dtypes)
    return table.withColumns({c: F.when(hit, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()})


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.filter(~F.coalesce(where, F.lit(False)))


def violations(table: DataFrame, unique: list[list[str]] | None = None, not_null: list[str] | None = None, checks: dict[str, str] | None = None) -> DataFrame:
    """constraint, row_count of every constraint that rows break. A CHECK that is NULL holds."""
    parts = [F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"not_null {c}") for c in not_null or []]
    parts += [F.sum(F.when(~F.coalesce(F.expr(e), F.lit(True)), 1).otherwise(0)).alias(f"check {n}") for n, e in (checks or {}).items()]
    frames = []
    if parts:
        wide = table.agg(*parts)
        rows = [F.struct(F.lit(c).alias("constraint"), F.col(f"`{c}`").cast("long").alias("row_count")) for c in wide.columns]
        frames.append(wide.select(F.explode(F.array(*rows)).alias("v")).select("v.*"))
    for cols in unique or []:
        again = table.dropna(subset=cols).groupBy(*cols).count().filter("count > 1")
        frames.append(again.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("row_count")).select(F.lit(f"unique {','.join(cols)}").alias("constraint"), "row_count"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.filter("row_count > 0")


def sys_columns(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    rows = [(t, f.name, i + 1, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, data_type string, nullable boolean")


def sys_tables(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    rows = [(t, len(df.columns)) for t, df in tables.items()]
    return spark.createDataFrame(rows, "table_name string, column_count int")


def explain(df: DataFrame) -> DataFrame:
    """The formatted plan, a row for each line."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return df.sparkSession.createDataFrame(list(enumerate(text.splitlines())), "line int, plan string")


def page(df: DataFrame, order: list[str], size: int, number: int, filters: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """A page of a sorted, filtered table; filter modes are contains, exact, startswith and endswith."""
    for c, (mode, value) in (filters or {}).items():
        x, v = F.upper(F.col(c).cast("string")), value.upper()
        df = df.filter({"contains": x.contains(v), "exact": x == v, "startswith": x.startswith(v), "endswith": x.endswith(v)}[mode.lower()])
    return df.orderBy(*order).offset(size * number).limit(size)
