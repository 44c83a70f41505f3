"""Benchmark decontamination by winnowing.

Five-word grams are hashed and the least hash of every nine consecutive ones is
kept (Schleimer, Wilkerson and Aiken, "Winnowing", 2003). Nine five-grams span
13 words, so any 13 words that a document and a benchmark item share leave them
a common fingerprint: no shared window is missed. Documents that share one are
read again, and the windows whose fingerprint matched are extended to all 13
words and looked up among the benchmark's. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm._store import materialise, small

GRAM, SPAN = 5, 9
SIZE = GRAM + SPAN - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text: runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    text = F.coalesce(text, F.lit(""))
    # lower() would change other letters too; it is the quick way for pure ASCII
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _NO_WORD), "")


def _near(array: str, i: Column, n: int, step: int = 1) -> list[Column]:
    return [F.get(F.col(array), i + k * step) for k in range(n)]


def _hashed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, wh (word hashes), grams (hashes of GRAM words, null for fewer words).

    Nothing may filter on these columns: a filter is pushed below the projections
    with their definitions put in place of their names, and an array that a
    lambda reads would be made anew for each element. explode() of null does it.
    """
    rows = rows.select(*keep, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("wh"))
    at = F.sequence(F.lit(0), F.size("wh") - GRAM)
    grams = F.when(F.size("wh") >= GRAM, F.transform(at, lambda i: F.xxhash64(*_near("wh", i, GRAM))))
    return rows.select(*keep, "wh", grams.alias("grams"))


def _prints(hashed: DataFrame, keep: list[str]) -> DataFrame:
    """keep, print: the distinct fingerprints of every row."""
    at = F.sequence(F.lit(0), F.size("grams") - SPAN)
    least = F.array_distinct(F.transform(at, lambda i: F.least(*_near("grams", i, SPAN))))
    return hashed.select(*keep, F.explode(F.when(F.size("grams") >= SPAN, least)).alias("print"))


def _window(i: Column) -> Column:
    """The hash of the SIZE words from i: of the grams that cover them."""
    return F.xxhash64(*(F.get(F.col("grams"), i + k) for k in (0, GRAM - 1, 2 * (GRAM - 1))))


def _whole(n: int) -> Column:
    return F.xxhash64(F.lit(n), *(F.get(F.col("wh"), F.lit(k)) for k in range(n)))


def _item_windows(items: DataFrame) -> DataFrame:
    """item, n (words), window: every item's windows; short items are one."""
    n = F.size("wh")
    at = F.sequence(F.lit(0), n - SIZE)
    short = F.coalesce(*(F.when(n == k, F.array(_whole(k))) for k in range(1, SIZE)))
    rows = items.select(
        "item", F.least(n, F.lit(SIZE)).alias("n"), F.explode(F.when(n >= SIZE, F.transform(at, _window)).otherwise(short)).alias("window")
    )
    return rows.distinct()


def _long_hits(docs: DataFrame, prints: DataFrame, windows: DataFrame) -> DataFrame:
    """id, key, at, n, window: the occurrences of windows of SIZE words."""
    found = _prints(_hashed(docs, ["id", "key"]), ["id", "key"]).join(small(prints), "print", "left_semi")
    suspects = materialise(found.groupBy("id", "key").agg(F.collect_set("print").alias("prints")))
    other = suspects.select(F.col("id").alias("s_id"), F.col("key").alias("s_key"), "prints")
    same = F.col("id").eqNullSafe(F.col("s_id")) & (F.col("key") == F.col("s_key"))
    again = _hashed(docs.join(small(other, arrays=("prints",)), same), ["id", "key", "prints"])
    at = F.sequence(F.lit(0), F.size("grams") - SPAN)
    extended = F.filter(at, lambda i: F.array_contains(F.col("prints"), F.least(*_near("grams", i, SPAN))))
    pairs = F.transform(extended, lambda i: F.struct(i.alias("at"), _window(i).alias("window")))
    rows = again.select("id", "key", F.explode(pairs).alias("w")).select("id", "key", "w.at", F.lit(SIZE).alias("n"), "w.window")
    return rows.join(small(windows.filter(F.col("n") == SIZE).select("window").distinct()), "window", "left_semi").select("id", "key", "at", "n", "window")


def _short_hits(docs: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """id, key, at, n, window: the occurrences of items of these numbers of words, all below SIZE.

    One pass reads the documents, whatever the number of lengths.
    """
    of_size = lambda n: F.when(
        F.size("wh") >= n,
        F.transform(
            F.sequence(F.lit(0), F.size("wh") - n),
            lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.xxhash64(F.lit(n), *_near("wh", i, n)).alias("window")),
        ),
    )
    every = F.flatten(F.array_compact(F.array(*map(of_size, sizes))))
    rows = _hashed(docs, ["id", "key"]).select("id", "key", F.explode(every).alias("w")).select("id", "key", "w.at", "w.n", "w.window")
    wanted = windows.filter(F.col("n") < SIZE).select("n", "window").distinct()
    return rows.join(small(wanted), ["n", "window"], "left_semi").select("id", "key", "at", "n", "window")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    every: int = 20,
) -> DataFrame:
    """id, key, n_words, n_hit, items, contaminated of every row of `docs`.

    A window is 13 consecutive words of a benchmark item, or a shorter item as a
    whole. n_hit counts the words inside occurrences of windows, items are the
    ids (as text, sorted) of the items with windows that occur. A document is
    contaminated if at least one word in `every` is hit. key is a hash of the
    text, which tells rows of one id apart.

    Null and empty texts have no words and hit nothing, and such items have no
    windows. Items without an id are found but not named. Null ids and repeated
    rows are judged like any others; equal items are each named. A very long text
    is one row, with two hashes for each of its words. Other columns are ignored.
    Either table may be empty.

    Fingerprints of the benchmark are broadcast if their number is within the
    bound of small(); else both sides are joined by a shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    hashed = _hashed(items, ["item"])
    windows = materialise(_item_windows(hashed))
    sizes = [r["n"] for r in windows.select("n").distinct().collect()]
    hits = rows.sparkSession.createDataFrame([], f"id {rows.schema['id'].dataType.simpleString()}, key long, at int, n int, window long")
    if SIZE in sizes:
        prints = materialise(_prints(hashed, []).distinct())
        hits = hits.union(_long_hits(rows, prints, windows))
    if short := sorted(n for n in sizes if n < SIZE):
        hits = hits.union(_short_hits(rows, windows, short))
    hits = materialise(hits)
    places = hits.groupBy("id", "key").agg(F.collect_set(F.struct("at", "n")).alias("p"))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("p", lambda p: F.sequence(p["at"], p["at"] + p["n"] - 1)))))
    covered = places.select("id", "key", n_hit.cast("long").alias("n_hit"))
    named = hits.select("id", "key", "n", "window").distinct().join(small(windows), ["n", "window"]).groupBy("id", "key")
    named = named.agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = ["id", "key"]
    marks = covered.select(F.col("id").alias("h_id"), F.col("key").alias("h_key"), "n_hit")
    names = named.select(F.col("id").alias("i_id"), F.col("key").alias("i_key"), "items")
    on = lambda p: F.col("id").eqNullSafe(F.col(f"{p}_id")) & (F.col("key") == F.col(f"{p}_key"))
    sized = rows.select(*both, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = sized.join(marks, on("h"), "left").join(names, on("i"), "left")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("id").alias(id_col),
        "key",
        "n_words",
        n.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n > 0) & (every * n >= F.col("n_words"))).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 12))) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS i) WHERE len(w) >= n),
hits AS (SELECT s.* FROM spots s SEMI JOIN wins v ON v.n = s.n AND v.win = s.win),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM hits, LATERAL (SELECT unnest(generate_series(i, i + n - 1)) AS p) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits JOIN wins USING (n, win)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
