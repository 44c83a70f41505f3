"""Line deduplication over overlapping windows of three lines.

Every three consecutive lines are hashed together, windows that occur more than
once anywhere are found by an aggregation, and the lines that later occurrences
cover are merged and removed. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm._store import free_name, materialise, small

WINDOW = 3
_SPACE = " \t\r\f\x0b"


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """id, key, at, w1, w2: a row for each window; at counts non-blank lines."""
    lines = rows.select("id", "key", F.filter(F.transform(_split(F.col("text")), lambda x: F.btrim(x, F.lit(_SPACE))), lambda x: x != "").alias("lines"))
    hashed = lines.filter(F.size("lines") >= window).select(
        "id",
        "key",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("h1"),
        F.transform("lines", lambda x: F.xxhash64(F.lit("second"), x)).alias("h2"),
    )
    near = lambda h, i: [F.get(F.col(h), i + n) for n in range(window)]
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("h1") - window),
        lambda i: F.struct(F.xxhash64(*near("h1", i)).alias("w1"), F.xxhash64(*near("h2", i)).alias("w2")),
    )
    return hashed.select("id", "key", F.posexplode(pairs).alias("at", "w")).select("id", "key", "at", "w.w1", "w.w2")


def _covered(windows: DataFrame, window: int) -> DataFrame:
    """id, key, gone: the non-blank lines that later occurrences cover."""
    place = F.struct("id", "key", "at")
    repeated = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # stored, so that adaptive execution can split a window that many documents share
    repeated = materialise(repeated.filter("not first <=> last").select("w1", "w2", "first"))
    later = windows.join(small(repeated), ["w1", "w2"]).filter(~place.eqNullSafe(F.col("first")))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("key") == F.col("first.key"))
    start = F.when(same, F.greatest(F.col("at"), F.col("first.at") + window)).otherwise(F.col("at"))
    ranges = later.groupBy("id", "key").agg(F.collect_set(F.struct(start.alias("a"), (F.col("at") + window - 1).alias("b"))).alias("r"))
    return ranges.select("id", "key", F.array_distinct(F.flatten(F.transform("r", lambda r: F.sequence(r["a"], r["b"])))).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, counts: bool = False) -> DataFrame:
    """`docs` with the later occurrences of repeated line windows removed.

    A text's lines are what '\\n' divides; they are compared without white space
    at either end, and blank ones are passed over when windows are formed and
    stay where they are. Of equal windows the one with the least id, then the
    least text hash, then the earliest line is the first; every line that a later
    one covers is removed, except for what lies in the first itself where both
    overlap in one text. So each line's content stays at least once. counts adds
    n_lines and n_removed.

    Null texts stay null, with one empty line; texts of fewer than `window`
    non-blank lines are unchanged, and a text may become ''. A null id comes
    before all others. Rows that repeat an id and a text are one document, with
    one result in each row. A very long text is one row, its lines and their
    hashes one array. All other columns are passed on, whatever their names. An
    empty table gives an empty result.
    """
    names = docs.columns
    key, gone = free_name(names, "line_key"), free_name(names, "lines_gone")
    text = F.col(f"`{text_col}`")
    keyed = docs.withColumn(key, F.xxhash64(text))
    windows = _windows(keyed.select(F.col(f"`{id_col}`").alias("id"), F.col(key).alias("key"), text.alias("text")), window)
    other_id, other_key = free_name(names, "line_id"), free_name(names, "line_other_key")
    removals = _covered(windows, window).select(F.col("id").alias(other_id), F.col("key").alias(other_key), F.col("gone").alias(gone))
    same = keyed[id_col].eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_key))
    joined = keyed.join(removals, same, "left")
    lines, full = free_name(names, "lines_all"), free_name(names, "lines_full")
    joined = joined.withColumn(lines, _split(text))
    joined = joined.withColumn(full, F.when(F.col(gone).isNotNull(), F.filter(F.transform(lines, lambda x, i: F.when(F.btrim(x, F.lit(_SPACE)) != "", i)), lambda i: i.isNotNull())))
    away = F.transform(gone, lambda i: F.get(F.col(full), i))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), away)
    made = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    out = [made.alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in names]
    if counts:
        out += [F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*out)


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents),
full_lines AS (
  SELECT doc_id, n, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line,
         row_number() OVER (PARTITION BY doc_id ORDER BY n) AS pos
  FROM lines WHERE trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> ''),
wins AS (
  SELECT doc_id, pos, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS win
  FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT doc_id, pos, first_value(doc_id) OVER w AS first_doc, first_value(pos) OVER w AS first_pos
  FROM wins WHERE win IS NOT NULL WINDOW w AS (PARTITION BY win ORDER BY doc_id, pos)),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(
           CASE WHEN doc_id = first_doc THEN greatest(pos, first_pos + 3) ELSE pos END, pos + 2)) AS pos
  FROM ranked WHERE doc_id <> first_doc OR pos <> first_pos),
kept AS (
  SELECT l.doc_id, l.n, l.line, g.pos IS NOT NULL AS gone
  FROM lines l LEFT JOIN full_lines f ON f.doc_id = l.doc_id AND f.n = l.n
  LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.pos = f.pos)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
FROM kept GROUP BY doc_id
"""

