"""CSV, JSON and table archives in and out."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """All values as text; short rows end in NULLs; without a header column1, column2, ..."""
    df = spark.read.csv(path, header=header, inferSchema=False, mode="PERMISSIVE", quote='"', escape='"', multiLine=True)
    return df if header else df.toDF(*(f"column{i + 1}" for i in range(len(df.columns))))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects; nested values are kept as JSON text."""
    df = spark.read.json(path, multiLine=True)
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_json(df: DataFrame, path: str, lines: bool = False) -> None:
    """One array of objects, streamed by one task into one file; NULLs are written.

    lines: an object a line instead, in as many files as there are partitions,
    for results that one task should not write.
    """
    rows = df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    if lines:
        rows.write.mode("overwrite").text(path)
        return

    def array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = "["
        for pdf in batches:
            made = []
            for value in pdf["value"]:
                made.append(before + value)
                before = ","
            yield pd.DataFrame({"value": made})
        yield pd.DataFrame({"value": ["[]" if before == "[" else "]"]})

    rows.coalesce(1).mapInPandas(array, "value string").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, like: DataFrame | None = None) -> None:
    """Append rows to a stored table, each value cast to the table's type; a value that can't be is an error.

    like: the table's columns; those of what is stored at `path` if not given.
    """
    target = like if like is not None else df.sparkSession.read.parquet(path)
    have = {c.lower(): c for c in df.columns}
    unknown = sorted(set(have) - {c.lower() for c in target.columns})
    if unknown:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    columns = [(F.col(f"`{have[c.lower()]}`") if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in target.dtypes]
    df.select(*columns).write.mode("append").parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of another database by JDBC, in `parts` ranges of a whole-number key; its driver must be on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key and parts > 1:
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


_SQLITE = {"INT": "bigint", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary"}


def sqlite_tables(path: str) -> list[str]:
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def read_sqlite(spark: SparkSession, path: str, name: str, parts: int = 8) -> DataFrame:
    """A table of an SQLite file that all executors can open, read in `parts` ranges of its row ids.

    Types follow the declared ones; a value that isn't of its column's type is NULL
    in a number column and text in a text column.
    """
    quoted = '"' + name.replace('"', '""') + '"'
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        columns = db.execute(f"PRAGMA table_info({quoted})").fetchall()
        low, high = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), 0) FROM {quoted}").fetchone()
    if not columns:
        raise ValueError(f"{path} has no table {name}")
    kinds = [next((v for k, v in _SQLITE.items() if k in (c[2] or "").upper()), "string") for c in columns]
    fits = {"bigint": int, "double": (int, float), "binary": bytes}

    def value(x: object, kind: str) -> object:
        if x is None or kind == "string":
            return x if x is None or isinstance(x, str) else str(x)
        return (float(x) if kind == "double" else x) if isinstance(x, fits[kind]) else None

    step = max(1, -(-(high - low + 1) // parts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
            for part in (i for pdf in batches for i in pdf["id"]):
                rows = db.execute(f"SELECT * FROM {quoted} WHERE rowid BETWEEN ? AND ?", (low + int(part) * step, low + (int(part) + 1) * step - 1))
                while found := rows.fetchmany(10_000):
                    yield pd.DataFrame({c[1]: pd.Series([value(r[i], k) for r in found], dtype=object) for i, (c, k) in enumerate(zip(columns, kinds, strict=True))})

    schema = ", ".join(f"`{c[1]}` {k}" for c, k in zip(columns, kinds, strict=True))
    return spark.range(0, parts, 1, parts).mapInPandas(run, schema)


def sql_source(spark: SparkSession, text: str, order: list[str] | None = None, size: int | None = None) -> Iterator[DataFrame]:
    """A query's result, whole or in pages of `size` rows in the order of `order`, which must be unique.

    Each page begins after the last key of the one before, so none is skipped over.
    """
    rows = spark.sql(text)
    if size is None:
        yield rows
        return
    last = None
    while True:
        after = lambda: F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(order, last, strict=True)))
        page = rows if last is None else rows.filter(F.struct(*order) > after())
        page = page.orderBy(*order).limit(size)
        keys = page.select(*order).orderBy(*(F.desc(c) for c in order)).first()
        if keys is None:
            return
        last = tuple(keys)
        yield page


def write_archive(df: DataFrame, path: str) -> None:
    """A table archive: Parquet, and its schema and row count as JSON beside it."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark = df.sparkSession
    rows = spark.read.parquet(f"{path}/data").count()
    manifest = json.dumps({"schema": df.schema.jsonValue(), "rows": rows})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """An archive's rows; an error if their number is not the manifest's."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    df = spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(f"{path}/data")
    if df.count() != manifest["rows"]:
        raise ValueError(f"{path}: row count differs from the manifest")
    return df


_NUMBER = r"[+-]?(0|[1-9]\d*)"
_DAY = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}(:\d{2}(\.\d{1,7})?)?"
#: Names of inferred types, what the text of a value looks like, and the Spark type; first fit wins.
CANDIDATES = (
    ("boolean", r"(?i)(true|false)", "boolean"),
    ("signed", _NUMBER, "bigint"),
    ("unsigned", r"(0|[1-9]\d*)", "decimal(20,0)"),
    ("decimal", _NUMBER + r"\.\d+|" + _NUMBER, None),
    ("guid", r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "string"),
    ("date", _DAY, "date"),
    ("time", _CLOCK, "string"),
    ("datetime", _DAY + "[ T]" + _CLOCK, "timestamp_ntz"),
    ("datetimeoffset", _DAY + "[ T]" + _CLOCK + r"(Z|[+-]\d{2}:\d{2})", "timestamp"),
)


def inferred(df: DataFrame) -> dict[str, tuple[str, str]]:
    """(name, Spark type) of each text column: the first candidate that keeps all of its values.

    Values of another form than a type writes ('007', '1e3', a decimal of more
    than 18 digits) stay text, so a cast never loses anything. Blanks are NULLs;
    a column without values is text. One aggregation over all rows.
    """
    tests = []
    for c in df.columns:
        x = F.when(F.trim(f"`{c}`") != "", F.trim(f"`{c}`"))
        digits = F.regexp_replace(x, r"[^\d.]", "")
        scale = F.length(F.regexp_extract(digits, r"\.(\d*)$", 1))
        tests += [F.max(scale).alias(f"{c}\0scale"), F.max(F.length(F.regexp_extract(digits, r"^(\d*)", 1))).alias(f"{c}\0whole"), F.count(x).alias(f"{c}\0n")]
        for name, form, kind in CANDIDATES:
            fits = x.rlike(f"^({form})\\z")
            if name == "time":
                fits = fits & F.concat(F.lit("2000-01-01 "), x).try_cast("timestamp_ntz").isNotNull()
            elif name == "unsigned":
                fits = fits & (x.try_cast("decimal(38,0)") <= F.lit("18446744073709551615").cast("decimal(38,0)"))
            elif kind not in (None, "string"):
                fits = fits & x.try_cast(kind).isNotNull()
            tests.append(F.coalesce(F.every(F.when(x.isNotNull(), F.coalesce(fits, F.lit(False)))), F.lit(False)).alias(f"{c}\0{name}"))
    found = df.agg(*tests).first().asDict() if tests else {}
    out = {}
    for c in df.columns:
        out[c] = ("text", "string")
        for name, _, kind in CANDIDATES if found[f"{c}\0n"] else ():
            scale = found[f"{c}\0scale"] or 0
            if found[f"{c}\0{name}"] and (name != "decimal" or found[f"{c}\0whole"] + scale <= 18):
                out[c] = (name, kind or f"decimal(18,{scale})")
                break
    return out


def infer_types(df: DataFrame) -> dict[str, str]:
    """The Spark type of each text column (see inferred)."""
    return {c: kind for c, (_, kind) in inferred(df).items()}


def infer_json(spark: SparkSession, path: str) -> dict[str, tuple[str, str]]:
    """(name, Spark type) of each key of a JSON array of objects, over all of its objects.

    Text, boolean, int, uint, decimal; keys with nested or mixed values are json,
    kept as text. One aggregation.
    """
    items = spark.read.json(path, multiLine=True, primitivesAsString=True)
    keys = items.columns
    if not keys:
        return {}
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.variant_get(F.parse_json("value"), "$", "array<variant>")).alias("v"))
    tests = []
    for k in keys:
        x = F.to_json(F.try_variant_get("v", "$['" + k.replace("'", "\\'") + "']", "variant"))
        wide = x.try_cast("decimal(38,0)")
        kind = (
            F.when(x.isNull() | (x == "null"), F.lit(None).cast("string"))
            .when(x.startswith('"'), "text")
            .when(x.isin("true", "false"), "boolean")
            .when(x.startswith("{") | x.startswith("["), "json")
            .when(x.rlike(r"^-?\d+$") & x.try_cast("bigint").isNotNull(), "int")
            .when(x.rlike(r"^\d+$") & (wide <= F.lit("18446744073709551615").cast("decimal(38,0)")), "uint")
            .otherwise("decimal")
        )
        tests.append(F.collect_set(kind).alias(k))
    seen = raw.agg(*tests).first().asDict()
    types = {"text": "string", "boolean": "boolean", "int": "bigint", "uint": "decimal(20,0)", "decimal": "double", "json": "string"}
    out = {}
    for k in keys:
        found = set(seen[k])
        wider = {"int", "uint", "decimal"}
        name = found.pop() if len(found) == 1 else "text" if not found else "json" if not found <= wider else "decimal" if "decimal" in found else "uint"
        out[k] = (name, types[name])
    return out
