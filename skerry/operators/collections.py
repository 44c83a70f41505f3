"""Collections of JSON documents, and full-text search."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.functions.semantics import collation_key


def _steps(path: str) -> list[str]:
    return path.removeprefix("$.").split(".")


def path_value(doc: Column, path: str) -> Column:
    """The scalar text at a path without arrays."""
    return F.get_json_object(doc, "$." + ".".join(_steps(path)))


def path_equals(doc: Column, path: str, value: str | int | float) -> Column:
    """Whether the value at a path is `value`; [] steps into each element of an array."""
    if "[]" not in path:
        return path_value(doc, path) == F.lit(str(value))
    inner = "$." + ".".join(_steps(path)).replace("[]", "[*]")
    found = F.get_json_object(doc, inner)
    parsed = F.from_json(F.when(found.startswith("["), found).otherwise(F.concat(F.lit("["), found, F.lit("]"))), "array<string>")
    bare = F.array(found)
    return F.coalesce(F.array_contains(parsed, str(value)), F.array_contains(bare, str(value)), F.lit(False))


def typed_equals(doc: Column, kind: T.DataType, steps: list[str], value: object) -> Column:
    """path_equals for a document that is a struct: no text is made or parsed."""
    if not steps:
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.array_contains(doc, F.lit(value)), F.lit(False))
        return F.coalesce(doc == F.lit(value), F.lit(False))
    name, each = steps[0].removesuffix("[]"), steps[0].endswith("[]")
    inner, part = kind[name].dataType, doc[name]
    if each and steps[1:]:
        return F.coalesce(F.exists(part, lambda e: typed_equals(e, inner.elementType, steps[1:], value)), F.lit(False))
    return typed_equals(part, inner, steps[1:], value)


def find_by_path(docs: DataFrame, path: str, value: str | int | float, doc: str = "doc", collation: str = "BINARY") -> DataFrame:
    """Documents, as JSON text or structs, with the value at a path; a collation is for text without arrays."""
    kind = docs.schema[doc].dataType
    if isinstance(kind, T.StructType):
        return docs.filter(typed_equals(F.col(doc), kind, _steps(path), value))
    if collation != "BINARY" and "[]" not in path:
        return docs.filter(collation_key(path_value(F.col(doc), path), collation) == collation_key(F.lit(str(value)), collation))
    return docs.filter(path_equals(F.col(doc), path, value))


def find_by_range(docs: DataFrame, path: str, low: float | None, high: float | None, include_low: bool = True, include_high: bool = True, doc: str = "doc") -> DataFrame:
    """Documents whose number at a path is within bounds; paths into arrays are an error."""
    if "[]" in path:
        raise ValueError("range search needs a path without arrays")
    x = path_value(F.col(doc), path).try_cast("double")
    test = x.isNotNull()
    if low is not None:
        test = test & ((x >= low) if include_low else (x > low))
    if high is not None:
        test = test & ((x <= high) if include_high else (x < high))
    return docs.filter(test)


def put(docs: DataFrame, changes: DataFrame, key: str = "key") -> DataFrame:
    """docs with the rows of `changes` in place of those with their keys."""
    return docs.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete(docs: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return docs.join(keys.select(key), key, "left_anti")


def get(docs: DataFrame, value: object, key: str = "key") -> DataFrame:
    return docs.filter(F.col(key) == F.lit(value))


def count(docs: DataFrame) -> int:
    return docs.count()


def find(docs: DataFrame, test: Column) -> DataFrame:
    return docs.filter(F.coalesce(test, F.lit(False)))


_TOKEN = r"[\p{L}\p{N}']+"


def terms(query: str) -> list[str]:
    """The distinct tokens of a query, by the rule of tokens()."""
    import regex

    return sorted(set(regex.findall(_TOKEN, unicodedata.normalize("NFKC", query).lower())))


def tokens(text: Column) -> Column:
    """The tokens of a text that is in normal form."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_TOKEN})"), F.lit(1))


def _normal(df: DataFrame, column: str) -> DataFrame:
    """df with a text in compatibility normal form (NFKC), without leaving the JVM; ASCII texts are so already.

    By the ICU that Spark brings. It knows characters newer than Python's tables,
    which terms() leaves as they are.
    """
    text = F.col(column)
    made = F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return df.withColumn(column, F.when(F.length(text) != F.octet_length(text), made).otherwise(text))


def search(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows that hold every distinct term of the query; score is the number of terms.

    Only rows that hold the terms somewhere are cut into tokens. For repeated
    searches over one table see index_terms().
    """
    wanted = terms(query)
    if not wanted:
        return df.filter("false").withColumn("score", F.lit(0))
    rows = _normal(df.withColumn("_all", F.concat_ws(" ", *columns)), "_all")
    for term in wanted:
        rows = rows.filter(F.lower("_all").contains(term))
    rows = rows.filter(F.size(F.array_except(F.array(*map(F.lit, wanted)), tokens(F.col("_all")))) == 0)
    return rows.drop("_all").withColumn("score", F.lit(len(wanted)))


def index_terms(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """term, id: an inverted index to store, sorted or bucketed by term."""
    rows = _normal(df.select(F.col(row_id).alias("id"), F.concat_ws(" ", *columns).alias("_all")), "_all")
    return rows.select(F.explode(F.array_distinct(tokens(F.col("_all")))).alias("term"), "id")


def search_index(index: DataFrame, query: str) -> DataFrame:
    """id, score of the rows with all terms of the query, by an index: reads the terms' rows only."""
    wanted = terms(query)
    found = index.filter(F.col("term").isin(wanted)).groupBy("id").agg(F.count("*").cast("int").alias("score"))
    return found.filter(F.col("score") == len(wanted)) if wanted else found.filter("false")
