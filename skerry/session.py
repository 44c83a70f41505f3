"""Session settings and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(name: str = "skerry", master: str | None = None, settings: dict[str, str] | None = None) -> SparkSession:
    """A session with the engine's settings and those given."""
    builder = SparkSession.builder.appName(name)
    builder = builder.master(master) if master else builder
    for key, value in (SETTINGS | (settings or {})).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register Parquet tables as temporary views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
