"""Shared storage, size-checked broadcasts and distributed row numbering."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a side of a join may have to be broadcast (a few MB at most).
BROADCAST_ROWS = 50_000
#: Items that its arrays may hold (16 MB at most).
ARRAY_ITEMS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Only in a local session that names none (tests) is a temporary folder of
    this machine used, and recorded in the session for later calls. On a cluster
    the executors could not read it, so there a missing folder is an error.
    """
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="skerry-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    Cuts the lineage: later jobs, and tasks that are repeated after an executor
    is lost, read these files rather than recompute what made them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables (see materialise) that nothing left to run reads.

    What a caller gets back may still read the rest; those stay until the shared
    folder is emptied with the session's other checkpoints.
    """
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, arrays: tuple[str, ...] = ()) -> DataFrame:
    """`df` marked for broadcast if it has at most `limit` rows, else as it is.

    `arrays` names its array columns, which may hold ARRAY_ITEMS items in all.
    Past the bounds the join shuffles, and adaptive execution splits its skewed
    partitions, so the result is the same either way.
    """
    items = [F.coalesce(F.sum(F.size(F.col(c)).cast("long")), F.lit(0)) for c in arrays]
    found = df.limit(limit + 1).agg(F.count("*"), *items).first()
    return F.broadcast(df) if found[0] <= limit and sum(found[1:]) <= ARRAY_ITEMS else df


def free_name(columns: list[str], wanted: str) -> str:
    """`wanted`, or a variant of it that no column has (case ignored)."""
    taken = {c.lower() for c in columns}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, name: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Add gapless numbers from 0, within each value of `by` if given.

    With `weight`, a column of whole numbers, a row counts as that many: its
    number is the sum of the weights before it.

    `df` must be stored rows (see materialise): each partition numbers its own
    rows as they stream past, and a table of what other partitions hold before
    them is joined on (broadcast only within small()'s bound), so no row is
    sorted and nothing is collected. `by` must have few values; that table has a
    row for each of them and partition.
    """
    by = by or []
    part, start = free_name(df.columns, "part"), free_name(df.columns, "start")
    marked = df.withColumn(part, F.spark_partition_id())
    counts = materialise(marked.groupBy(part, *by).agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("held")))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(counts.select(part, *by, F.coalesce(F.sum("held").over(before), F.lit(0)).cast("long").alias(start)))
    schema = T.StructType([*marked.schema.fields, T.StructField(name, T.LongType())])

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        so_far: dict = {}
        for pdf in batches:
            if pdf.empty:
                continue
            count = pdf[weight] if weight else pd.Series(1, pdf.index)
            keys = pdf.groupby(by, sort=False, dropna=False).ngroup() if by else pd.Series(0, pdf.index)
            names = pdf.loc[~keys.duplicated(), by].itertuples(index=False, name=None) if by else [()]
            own = {k: n for k, n in zip(keys[~keys.duplicated()].tolist(), names, strict=True)}
            within = count.groupby(keys)
            pdf[name] = (within.cumsum() - count + keys.map({k: so_far.get(n, 0) for k, n in own.items()})).astype("int64")
            for k, held in within.sum().items():
                so_far[own[k]] = so_far.get(own[k], 0) + int(held)
            yield pdf

    local = marked.mapInPandas(number, schema)
    keys = [part, *by]
    others = [free_name([*local.columns, start], f"start_{i}") for i in range(len(keys))]
    starts = small(starts.select(*(F.col(k).alias(o) for k, o in zip(keys, others, strict=True)), start))
    same = reduce(lambda a, b: a & b, (local[k].eqNullSafe(starts[o]) for k, o in zip(keys, others, strict=True)))
    return local.join(starts, same).withColumn(name, F.col(name) + F.col(start)).select(*df.columns, name)
