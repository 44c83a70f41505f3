"""Incremental loads: what is new since a watermark, and file streams into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def since(df: DataFrame, column: str, last: object | None) -> DataFrame:
    """Rows beyond the last processed value; all of them without one."""
    return df if last is None else df.filter(F.col(column) > F.lit(last))


def load_new_files(spark: SparkSession, source: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    """Append what new Parquet files of `source` hold to `target`, each file once."""
    schema = spark.read.parquet(source).schema
    stream = transform(spark.readStream.schema(schema).parquet(source))
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
