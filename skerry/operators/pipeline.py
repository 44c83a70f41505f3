"""Batch pipelines: select, rename, cast, filter, derive, deduplicate, with rejects."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = {"integer": "bigint", "real": "double", "text": "string", "blob": "binary", "decimal": "decimal(18,2)"}
_OPERATORS = tuple("== != >= <= > <".split())


@dataclass
class Step:
    """kind is select, rename, cast, filter, derive or deduplicate; spec is what it takes."""

    kind: str
    spec: object


@dataclass
class Package:
    name: str
    steps: list[Step]
    skip_bad_rows: bool = False
    max_rejects: int | None = None
    errors: list[str] = field(default_factory=list)

    def validate(self) -> list[str]:
        """What is wrong with the package; empty if nothing is."""
        out = [] if self.name.strip() else ["name_required"]
        for i, s in enumerate(self.steps):
            if s.kind not in _STEPS:
                out.append(f"steps[{i}]: unknown_kind")
            elif not s.spec:
                out.append(f"steps[{i}]: spec_required")
        if self.max_rejects is not None and self.max_rejects < 0:
            out.append("max_rejects_negative")
        return out


def _literal(token: str, df: DataFrame) -> tuple[Column, str]:
    token = token.strip()
    names = {c.lower(): c for c in df.columns}
    if token.lower() in names:
        c = names[token.lower()]
        kind = dict(df.dtypes)[c]
        return F.col(c), "text" if kind == "string" else "number"
    if re.fullmatch(r"'.*'|\".*\"", token):
        return F.lit(token[1:-1]), "text"
    if token.lower() == "null":
        return F.lit(None).cast("string"), "null"
    if re.fullmatch(r"[+-]?\d+", token):
        return F.lit(int(token)), "number"
    if re.fullmatch(r"[+-]?\d*\.\d+", token):
        return F.lit(float(token)), "number"
    return F.lit(token), "text"


def select(df: DataFrame, columns: list[str]) -> DataFrame:
    have = {c.lower() for c in df.columns}
    return df.select(*(F.col(c).alias(c) if c.lower() in have else F.lit(None).cast("string").alias(c) for c in columns))


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    for old, new in names.items():
        if old.lower() in {c.lower() for c in df.columns}:
            df = df if old.lower() == new.lower() else df.drop(new)
            df = df.withColumnRenamed(old, new)
    return df


def cast(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast(TYPES.get(k.lower(), k)) for c, k in kinds.items()})


def predicate(df: DataFrame, text: str) -> Column:
    """One `left op right`; == and != tell a number from its text; NULL is the least value."""
    op = next((o for o in _OPERATORS if o in text), None)
    if op is None:
        raise ValueError(f"no operator in {text}")
    a, b = text.split(op, 1)
    (x, kx), (y, ky) = _literal(a, df), _literal(b, df)
    if op in ("==", "!="):
        same = x.eqNullSafe(y) if kx == ky or "null" in (kx, ky) else F.lit(False)
        return same if op == "==" else ~same
    if "text" in (kx, ky):
        x, y = x.cast("string"), y.cast("string")
    order = F.when(x.isNull() & y.isNull(), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).when(x > y, 1).otherwise(0)
    return {">=": order >= 0, "<=": order <= 0, ">": order > 0, "<": order < 0}[op]


def filter_rows(df: DataFrame, text: str) -> DataFrame:
    return df.filter(predicate(df, text))


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    for name, source in columns.items():
        df = df.withColumn(name, _literal(source, df)[0])
    return df


def deduplicate(df: DataFrame, spec: dict) -> DataFrame:
    """The first row of each key in the order of `by`; NULL keys are equal."""
    w = Window.partitionBy(*spec["keys"]).orderBy(spec["by"])
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


_STEPS: dict[str, Callable] = {"select": select, "rename": rename, "cast": cast, "filter": filter_rows, "derive": derive, "deduplicate": deduplicate}


def run(package: Package, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows). A row is rejected where a cast of a value fails.

    Without skip_bad_rows, or beyond max_rejects, rejects are an error.
    """
    faults = package.validate()
    if faults:
        raise ValueError("; ".join(faults))
    df, bad = source, None
    for step in package.steps:
        if step.kind == "cast":
            failed = F.lit(False)
            for c, k in step.spec.items():
                failed = failed | (F.col(c).isNotNull() & F.col(c).try_cast(TYPES.get(k.lower(), k)).isNull())
            lost = df.filter(failed).select(F.to_json(F.struct(*df.columns)).alias("row"), F.lit("cast").alias("step"))
            bad = lost if bad is None else bad.union(lost)
            df = df.filter(~failed)
        df = _STEPS[step.kind](df, step.spec)
    if bad is None:
        bad = source.sparkSession.createDataFrame([], "row string, step string")
    else:
        limit = package.max_rejects if package.skip_bad_rows else 0
        if limit is not None and bad.limit(limit + 1).count() > limit:
            raise ValueError(f"more than {limit} rejected rows")
    return df, bad
