"""A training-data pipeline over `documents`, in stages that are stored between.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, in their order, with whatever further columns
docs has, of any name that Spark can tell apart. Every stage reads whole texts;
very long ones are one piece of memory in one task. An empty table gives an
empty result with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm._store import free_name, materialise, small
from skerry.llm.decontaminate import SIZE, find_contamination
from skerry.llm.line_dedup import dedup_lines
from skerry.llm.minhash import near_duplicates
from skerry.llm.packing import pack
from skerry.llm.quality import judge

#: Rows of an id and a hash that may be broadcast (some 10 MB).
LISTED = 200_000


def _same(docs: DataFrame, listed: DataFrame, doc_id: str, key: str) -> Column:
    return docs["doc_id"].eqNullSafe(listed[doc_id]) & (F.xxhash64(docs["text"]) == listed[key])


def _listed(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, Column]:
    """The distinct (doc_id, key) of `rows` under free names, and what joins them to docs."""
    key, other = free_name(docs.columns, "listed_key"), free_name(docs.columns, "listed_id")
    listed = materialise(rows.select(F.col("doc_id").alias(other), F.col("key").alias(key)).distinct())
    listed = small(listed, LISTED)
    return listed, _same(docs, listed, other, key)


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id and text hash `rejected` (doc_id, key) lists."""
    listed, same = _listed(docs, rejected)
    return docs.join(listed, same, "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the outlier test reject.

    Null, empty and blank texts have fewer than ten words and go. Null languages
    and sources are groups of their own. Rows are judged by their text, language
    and source: repeated rows share a verdict, and where one id and text stand
    under several sources, a rejection under any of them drops all. Rows without
    an id are judged like others; ties at the cut-off stay.
    """
    judged = judge(docs)
    return _without(docs, judged.filter("not kept").withColumnRenamed("id", "doc_id"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of three-line windows, and documents left without a word.

    n_chars is counted anew. Null, empty and blank texts go. Of equal windows the
    one of the least id (null before all others) and then place stays; rows that
    repeat an id and a text are one document and lose the same lines.
    """
    out = dedup_lines(docs)
    out = out.select(*(F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes))
    return out.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: five-word shingles, similarity 0.8.

    It is the one of least id; rows without an id come last, and ties go by a
    hash of the text. Rows that repeat an id are judged each by their own text;
    of rows that repeat an id (or its absence) and a text one stays, whichever.
    Null, empty and blank texts resemble nothing and stay.
    """
    kind = dict(docs.dtypes)["doc_id"]
    named = F.struct(
        F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast(kind)).alias("id"), F.xxhash64("text").alias("key")
    )
    judged = near_duplicates(docs.select(named.alias("doc_id"), "text")).filter("not kept").select("doc_id.*")
    kept = _without(docs, judged.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "key"))
    again = docs.filter("text is not null").groupBy("doc_id", F.xxhash64("text").alias("key")).count().filter("count > 1")
    again = materialise(again.select("doc_id", "key"))
    if not again.limit(1).count():
        return kept
    kept = materialise(kept)
    listed, same = _listed(kept, again)
    repeats = kept.join(listed, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(kept, again).union(repeats)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold 13 words or more of benchmark passages, or a twentieth of whose words are such.

    A passage is 13 consecutive words of an item, or a shorter item as a whole.
    Shorter items alone count only by their share, as single words may be items;
    no 13-word passage stays. Null and empty texts hold nothing and stay, null
    and empty items are passed over. Rows are judged by their text: repeated rows
    and rows without an id share the verdict of their text.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, find_contamination(docs, benchmark).filter(f"contaminated or n_hit >= {SIZE}"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of the permitted lengths: a row for each piece.

    Null, empty and blank texts get one row without a sequence; very long ones
    are cut into full sequences and a rest. Repeated rows and rows without an id
    are packed each. Ties in length go by id.
    """
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The outlier test and the MinHash stage have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
