"""Joins that Spark would plan badly or doesn't have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """left WHERE column NOT IN (SELECT other FROM right), by a shuffled anti join.

    Spark's own plan for NOT IN broadcasts the right side whatever its size. Here
    only two numbers are broadcast, its rows and NULLs: a NULL on the right leaves
    nothing, an empty right side everything, and else a NULL on the left goes.
    """
    values = right.select(F.col(other).alias("_other"))
    counts = values.agg(F.count(F.lit(1)).alias("_rows"), F.count("_other").alias("_full"))
    kept = left.join(values.dropna(), left[column] == F.col("_other"), "left_anti").crossJoin(F.broadcast(counts))
    fits = (F.col("_rows") == 0) | ((F.col("_rows") == F.col("_full")) & F.col(column).isNotNull())
    return kept.filter(fits).drop("_rows", "_full")
