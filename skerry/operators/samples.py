"""Graph, spatial, time-series, report and shard operations over plain tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


# --- graphs: edges are rows (src, dst)
def reachable(edges: DataFrame, start: object, most: int, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node, depth of the nodes within `most` steps of `start`, breadth first.

    Each step is a join of the last found nodes with the edges; `store` writes a
    step's table and reads it back, which keeps the plan short.
    """
    kind = edges.schema["src"].dataType
    seen = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0).alias("depth"))
    last = seen
    for depth in range(1, most + 1):
        near = edges.join(last.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        last = store(near.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not last.limit(1).count():
            break
        seen = store(seen.union(last))
    return seen


def shortest_path(edges: DataFrame, start: object, goal: object, most: int, store: Callable[[DataFrame], DataFrame]) -> list | None:
    """The nodes of a shortest path, ties by the least node before; None if there is none within `most` steps."""
    kind = edges.schema["src"].dataType
    seen = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(None).cast(kind).alias("back"), F.lit(0).alias("depth"))
    last, found = seen, start == goal
    for depth in range(1, most + 1):
        if found:
            break
        near = edges.join(last.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("back"))
        last = store(near.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not last.limit(1).count():
            return None
        seen = store(seen.union(last))
        found = bool(last.filter(F.col("node") == F.lit(goal)).limit(1).count())
    if not found:
        return None
    path = [goal]
    while path[-1] != start:  # one row a step
        path.append(seen.filter(F.col("node") == F.lit(path[-1])).first()["back"])
    return path[::-1]


# --- places: degrees of latitude and longitude
def distance_km(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """The great-circle distance (haversine)."""
    a, b = F.radians(lat), F.lit(math.radians(lat0))
    h = F.pow(F.sin((a - b) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon) - math.radians(lon0)) / 2), F.lit(2))
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def within_box(df: DataFrame, south: float, west: float, north: float, east: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Places in a box; one whose west is greater than its east goes over the date line."""
    across = F.col(lon).between(west, east) if west <= east else (F.col(lon) >= west) | (F.col(lon) <= east)
    return df.filter(F.col(lat).between(south, north) & across)


def within_radius(df: DataFrame, lat0: float, lon0: float, km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Places within a distance, nearest first by distance_km. A box that a scan can push down is tested first."""
    step = math.degrees(km / 6371.0)
    south, north = lat0 - step, lat0 + step
    rows = df.filter(F.col(lat).between(south, north))
    if south > -90 and north < 90:
        reach = math.degrees(math.asin(min(1.0, math.sin(km / 6371.0) / math.cos(math.radians(lat0))))) if km < 6371.0 * math.pi / 2 else 180.0
        if lon0 - reach >= -180 and lon0 + reach <= 180:
            rows = rows.filter(F.col(lon).between(lon0 - reach, lon0 + reach))
    rows = rows.withColumn("distance_km", distance_km(F.col(lat), F.col(lon), lat0, lon0))
    return rows.filter(F.col("distance_km") <= km)


# --- time series
def summary(df: DataFrame, time: str, value: str, begin: object, end: object, by: list[str] | None = None) -> DataFrame:
    """count, min, max, sum, avg, first and last of the values from `begin` to `end`, by metric."""
    rows = df.filter((F.col(time) >= F.lit(begin)) & (F.col(time) <= F.lit(end)))
    return rows.groupBy(*(by or [])).agg(
        F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.avg(value).alias("avg"),
        F.min_by(value, time).alias("first"), F.max_by(value, time).alias("last"),
    )


# --- reports
def report_groups(df: DataFrame, bands: list[str], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each group of every band (the outer ones first in `bands`), and one for the report.

    totals: name to (SUM, COUNT, AVG, MIN or MAX, column); they take the numbers
    among a column's values. SUM of no rows is 0, of rows without a number NULL.
    level counts the bands that a row is grouped by.
    """
    made = []
    for name, (how, column) in totals.items():
        number = F.col(column).cast("string").try_cast("double")
        plain = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
        if how.upper() == "COUNT":
            made.append(F.count(column).alias(name))
        elif how.upper() == "SUM":
            made.append(F.when(F.count(F.lit(1)) == 0, F.lit(0.0)).otherwise(F.sum(number)).alias(name))
        else:
            made.append(plain[how.upper()](number).alias(name))
    level = sum((1 - F.grouping(b) for b in bands), F.lit(0)).cast("int").alias("level")
    return df.rollup(*bands).agg(level, *made)


# --- shards
def shard_of(key: Column, shards: list[str], pins: dict[str, str] | None = None) -> Column:
    """The shard of a key: its pin, else that of its bucket, of which each shard has an equal run."""
    bucket = F.pmod(F.xxhash64(key.cast("string")), F.lit(BUCKETS))
    at = F.array(*map(F.lit, shards))
    found = F.get(at, F.floor(bucket * len(shards) / BUCKETS).cast("int"))
    for pinned, shard in (pins or {}).items():
        found = F.when(key.cast("string") == pinned, F.lit(shard)).otherwise(found)
    return found


def on_all_shards(df: DataFrame, key: str, shards: list[str], query: Callable[[DataFrame], DataFrame], pins: dict[str, str] | None = None) -> DataFrame:
    """A query's rows for each shard by itself, unmerged, with the shard's name."""
    placed = df.withColumn("_shard", shard_of(F.col(key), shards, pins))
    parts = [query(placed.filter(F.col("_shard") == s).drop("_shard")).select(F.lit(s).alias("shard"), "*") for s in shards]
    return reduce(DataFrame.unionByName, parts)
