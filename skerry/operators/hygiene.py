"""Data hygiene: duplicates, merging, validation, orphans, comparison, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.semantics import collation_key

Key = str | tuple[str, str]  # a column, or a column and its collation


def _keys(df: DataFrame, on: list[Key]) -> list[Column]:
    pairs = [(k, "BINARY") if isinstance(k, str) else k for k in on]
    kinds = dict(df.dtypes)
    made = [F.col(c) if kinds[c] != "string" else collation_key(F.col(c), how) for c, how in pairs]
    return [x.alias(f"_key{i}") for i, x in enumerate(made)]


def shown(column: Column, kind: str) -> Column:
    """A key's value as text that tells NULL, text and numbers apart."""
    plain = column.cast("string")
    quoted = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("''")), F.lit("'")) if kind.startswith("string") else plain
    return F.coalesce(quoted, F.lit("NULL"))


def _named(on: list[Key]) -> list[str]:
    return [k if isinstance(k, str) else k[0] for k in on]


def find_duplicates(df: DataFrame, on: list[Key], row_id: str, primary_key: str | None = None) -> DataFrame:
    """Groups of more than one row with equal keys (NULLs are equal); the least id wins.

    The contract asks for all ids of a group in one value; duplicate_members()
    gives them as rows, which no hot key can outgrow.
    """
    names, kinds, pk = _named(on), dict(df.dtypes), primary_key or row_id
    keys = _keys(df, on)
    values = F.concat(F.lit("["), F.concat_ws(", ", *(shown(F.col(c), kinds[c]) for c in names)), F.lit("]"))
    rows = df.select(*keys, F.col(row_id).alias("_id"), F.col(pk).cast("string").alias("_pk"), values.alias("_shown"))
    groups = rows.groupBy(*(f"_key{i}" for i in range(len(keys)))).agg(
        F.min_by("_shown", "_id").alias("key_values"), F.count("*").alias("group_size"), F.sort_array(F.collect_list(F.struct("_id", "_pk"))).alias("_ids")
    )
    rest = F.slice("_ids", F.lit(2), F.size("_ids"))
    joined = lambda c: F.array_join(F.transform(rest, lambda x: x[c].cast("string")), ",")
    first = F.element_at("_ids", 1)
    return groups.filter("group_size > 1").select(
        "key_values",
        "group_size",
        first["_id"].alias("winner_rowid"),
        first["_pk"].alias("winner_primary_key"),
        joined("_id").alias("duplicate_rowids"),
        joined("_pk").alias("duplicate_primary_keys"),
    )


def duplicate_members(df: DataFrame, on: list[Key], row_id: str) -> DataFrame:
    """rowid, winner_rowid of every row of a group of more than one."""
    keyed = df.select(F.col(row_id).alias("rowid"), *_keys(df, on))
    names = [c for c in keyed.columns if c.startswith("_key")]
    groups = keyed.groupBy(*names).agg(F.min("rowid").alias("winner_rowid"), F.count("*").alias("_n")).filter("_n > 1")
    same = [keyed[c].eqNullSafe(groups[c]) for c in names]
    return keyed.join(groups, same).select("rowid", "winner_rowid")


def dedup(df: DataFrame, on: list[Key], row_id: str, keep: str = "first") -> DataFrame:
    """The rows with the least (or, for 'last', the greatest) id of their keys.

    Winners are found by an aggregation, which sums up hot keys before the
    shuffle, and joined back by id; no key's rows are gathered or sorted.
    """
    pick = F.min if keep.lower() == "first" else F.max
    winners = df.select(*_keys(df, on), F.col(row_id).alias("_winner"))
    names = [c for c in winners.columns if c.startswith("_key")]
    winners = winners.groupBy(*names).agg(pick("_winner").alias("_winner")).select("_winner")
    return df.join(winners, df[row_id] == F.col("_winner"), "left_semi")


def dedup_summary(df: DataFrame, on: list[Key], row_id: str, table: str) -> DataFrame:
    rows = df.select(*_keys(df, on))
    groups = rows.groupBy(*rows.columns).count()
    return groups.agg(
        F.count(F.when(F.col("count") > 1, 1)).alias("duplicate_group_count"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("rows_deleted"),
        F.count("*").alias("rows_kept"),
    ).select(F.lit(table).alias("table_name"), "*")


def merge_duplicates(df: DataFrame, on: list[Key], row_id: str) -> DataFrame:
    """One row a key: the least id's, its NULLs filled where the others agree on a value."""
    names = [k if isinstance(k, str) else k[0] for k in on]
    others = [c for c in df.columns if c != row_id and c not in names]
    keyed = df.select("*", *_keys(df, on))
    keys = [c for c in keyed.columns if c.startswith("_key")]
    best = [F.min_by(F.struct(c), row_id)[c].alias(f"_w_{c}") for c in [*names, *others]]
    only = [F.when(F.min(c) == F.max(c), F.min(c)).alias(f"_o_{c}") for c in others]
    merged = keyed.groupBy(*keys).agg(F.min(row_id).alias(row_id), *best, *only)
    filled = {c: F.coalesce(F.col(f"_w_{c}"), F.col(f"_o_{c}")) if c in others else F.col(f"_w_{c}") for c in [*names, *others]}
    return merged.select(*(F.col(c) if c == row_id else filled[c].alias(c) for c in df.columns))


def merge_summary(df: DataFrame, on: list[Key], row_id: str, table: str) -> DataFrame:
    """What merge_duplicates() changes: groups, rows deleted, kept and updated, and conflicts.

    A conflict is a column that is NULL in the winner and for which the others
    offer several values; merge_conflicts counts them by column, NULL if none.
    """
    names = _named(on)
    others = [c for c in df.columns if c != row_id and c not in names]
    keyed = df.select("*", *_keys(df, on))
    keys = [c for c in keyed.columns if c.startswith("_key")]
    empty = [F.min_by(F.struct(c), row_id)[c].isNull().alias(f"_e_{c}") for c in others]
    offers = [F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_f_{c}") for c in others]
    groups = keyed.groupBy(*keys).agg(F.count("*").alias("_n"), *empty, *offers)
    agreed = [F.col(f"_e_{c}") & F.col(f"_f_{c}.lo").isNotNull() & (F.col(f"_f_{c}.lo") == F.col(f"_f_{c}.hi")) for c in others]
    clash = [F.coalesce(F.col(f"_e_{c}") & (F.col(f"_f_{c}.lo") != F.col(f"_f_{c}.hi")), F.lit(False)) for c in others]
    filled = reduce(lambda a, b: a | b, (F.coalesce(x, F.lit(False)) for x in agreed), F.lit(False))
    counts = groups.agg(
        F.count(F.when(F.col("_n") > 1, 1)).alias("duplicate_group_count"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("rows_deleted"),
        F.count("*").alias("rows_kept"),
        F.count(F.when(filled, 1)).alias("rows_updated"),
        *(F.count(F.when(x, 1)).alias(f"_c_{c}") for c, x in zip(others, clash, strict=True)),
    )
    total = reduce(lambda a, b: a + b, (F.col(f"_c_{c}") for c in others), F.lit(0).cast("long"))
    listed = F.concat_ws(", ", *(F.when(F.col(f"_c_{c}") > 0, F.concat(F.lit(f"{c}: "), F.col(f"_c_{c}").cast("string"))) for c in others))
    return counts.select(
        F.lit(table).alias("table_name"), "duplicate_group_count", "rows_deleted", "rows_kept", "rows_updated",
        total.alias("merge_conflict_count"), F.nullif(listed, F.lit("")).alias("merge_conflicts"),
    )


def validate(df: DataFrame, rules: list[tuple[str, str | None, str, str]], row_id: str, table: str, primary_key: str | None = None) -> DataFrame:
    """Rows that break (name, column, predicate, message) rules: a predicate not TRUE is a violation."""
    found = [
        F.when(
            ~F.coalesce(F.expr(test), F.lit(False)),
            F.struct(F.lit(name).alias("rule_name"), F.lit(column).cast("string").alias("column_name"), F.lit(message).alias("message")),
        )
        for name, column, test, message in rules
    ]
    broken = F.filter(F.array(*found), lambda x: x.isNotNull())
    rows = df.select(F.col(row_id).alias("rowid"), F.col(primary_key or row_id).cast("string").alias("primary_key"), F.explode(broken).alias("b"))
    return rows.select("b.rule_name", F.lit(table).alias("table_name"), "b.column_name", "rowid", "primary_key", "b.message")


def find_orphans(
    child: DataFrame, column: str, parent: DataFrame, parent_column: str, row_id: str, child_table: str, parent_table: str, constraint: str | None = None
) -> DataFrame:
    """Child rows whose value, unless NULL, no parent has."""
    values = parent.select(F.col(parent_column).alias("_parent"))
    lost = child.filter(F.col(column).isNotNull()).join(values, child[column] == F.col("_parent"), "left_anti")
    return lost.select(
        F.lit(constraint).cast("string").alias("constraint_name"),
        F.lit(child_table).alias("child_table"),
        F.lit(column).alias("child_column"),
        F.col(row_id).alias("child_rowid"),
        F.col(column).cast("string").alias("child_value"),
        F.lit(parent_table).alias("parent_table"),
        F.lit(parent_column).alias("parent_column"),
    )


def compare(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Rows only in one of two tables, or changed, with the names of the changed columns.

    A NULL key equals a NULL key. Keys are unique on either side.
    """
    s, t = source.withColumn("_here", F.lit(True)).alias("s"), target.withColumn("_here", F.lit(True)).alias("t")
    both = s.join(t, F.col(f"s.{key}").eqNullSafe(F.col(f"t.{key}")), "full")
    columns = [c for c in source.columns if c != key]
    changed = F.concat_ws(",", *(F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")), F.lit(c)) for c in columns))
    kind = F.when(F.col("t._here").isNull(), "SourceOnly").when(F.col("s._here").isNull(), "TargetOnly").when(changed != "", "Changed")
    out = both.select(F.coalesce(f"s.{key}", f"t.{key}").alias(key), kind.alias("difference"), F.when(kind == "Changed", changed).otherwise("").alias("changed_columns"))
    return out.filter("difference is not null")


def checksum(df: DataFrame, partitions: int = 256, portable: bool = False) -> DataFrame:
    """Order-free, repeat-preserving digests by hash partition.

    portable: of md5 over the values' text (sixty bits of it; columns whose text
    all engines write alike), else of xxhash64.
    """
    if portable:
        shown = F.concat_ws("|", *(F.col(c).cast("string") for c in df.columns))
        h = F.conv(F.substring(F.md5(shown), 1, 15), 16, 10).cast("long")
    else:
        h = F.xxhash64(*df.columns)
    rows = df.select(h.alias("h"))
    return rows.groupBy(F.pmod("h", F.lit(partitions)).alias("bucket")).agg(
        F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(20,0)")).cast("decimal(38,0)").alias("digest")
    )


def column_stats(df: DataFrame) -> DataFrame:
    """distinct, non-null, least and greatest of every column.

    Each column is reduced to its values before they are counted, from a scan of
    that column alone, so that no row is repeated for each column.
    """
    parts = []
    for c in df.columns:
        values = df.select(F.col(c).alias("v")).groupBy("v").agg(F.count("v").alias("n"))
        parts.append(
            values.agg(
                F.count("v").alias("distinct_count"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("non_null_count"),
                F.min("v").cast("string").alias("min_value"),
                F.max("v").cast("string").alias("max_value"),
            ).select(F.lit(c).alias("column_name"), "*")
        )
    return union_all(parts)


def heavy_hitters(df: DataFrame, column: str, least_ppm: int = 10_000) -> DataFrame:
    """Values of at least a share of the rows, with the share in parts a million."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("row_count"))
    total = df.agg(F.count(column).alias("total"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("frequency_ppm", F.call_function("div", F.col("row_count") * 1_000_000, F.col("total")))
    return out.filter(F.col("frequency_ppm") >= least_ppm).drop("total")


def histogram(df: DataFrame, column: str, buckets: int = 8) -> DataFrame:
    """Equal-width buckets of a numeric column with their row counts."""
    bounds = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    at = F.least(F.floor((F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))
    rows = df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(bounds))
    return rows.groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bucket")).agg(F.count("*").alias("row_count"), F.min(column).alias("low"), F.max(column).alias("high"))


def prefix_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct counts of a column list's prefixes; rows with a NULL in a prefix don't count for it.

    Each prefix is counted from the distinct rows of the next longer one.
    """
    parts, rows = [], df.select(*columns)
    for n in range(len(columns), 0, -1):
        rows = rows.select(*columns[:n]).distinct()
        count = rows.dropna().agg(F.count("*").alias("distinct_count"))
        parts.insert(0, count.select(F.lit(",".join(columns[:n])).alias("prefix"), "distinct_count"))
    return union_all(parts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
