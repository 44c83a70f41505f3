"""Quality rules: robust multivariate outliers among documents' text statistics.

For every language and source the minimum-covariance-determinant estimate of
transformed statistics is found by concentration steps (Rousseeuw and Van
Driessen, 1999): two from each of three deterministic starts (after Hubert,
Rousseeuw and Verdonck, 2012: medians and absolute deviations alone, and with
the correlations of spatial signs or of hyperbolic tangents), then from the one
of least determinant until no determinant falls any more. Documents beyond a
chi-square cut-off of the Mahalanobis distance are rejected.

A concentration step over all documents is an aggregation: distances under the
present estimates are counted in narrow bins by group, and the nearest part,
with the bin at its edge in proportion, is summed into the next means and
covariances. No group is gathered in one task.

Estimates of few documents are unstable, so each is averaged with that of its
language, and this with that of all documents (a regularisation after Boudt,
Rousseeuw, Vanduffel and Verdonck, 2020). Of n documents the wider estimate's part
is the square of prior / (n + prior): no size changes the rule, and the part soon
vanishes as a group grows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.llm._store import materialise, small
from skerry.llm._text import Words, chunks, mix, span_hash

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
FEATURES = ("word_length", "symbols", "upper", "marks", "dup_lines", "repeats")
#: Least standard deviation of each feature: smaller spreads are no evidence.
FLOOR = (0.05, 0.05, 0.05, 0.05, 0.08, 0.08)
STARTS = 3
#: Documents at which the wider group's estimate makes up a quarter.
PRIOR = 30.0
#: A fall of the logarithm of a determinant that is none, and steps that are always enough.
SETTLED, STEPS = 1e-3, 60
BINS = 32  # to a doubling of the squared distance
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _is(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_SYMBOL, _UPPER = _is("#*$%&|<>"), _is("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _doubled(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more within their text."""
    own = mix(keys ^ mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def text_statistics(data: np.ndarray, offs: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """STATS of each of some texts, given as bytes and offsets."""
    n = len(offs) - 1

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(mask))
        return sums[offs[1:]] - sums[offs[:-1]]

    words = Words(data, offs, lower=False)
    n_words = np.diff(words.bounds)
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[words.starts] += 1
    np.add.at(in_word, words.ends, -1)
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
    first_byte = (data & 0xC0) != 0x80
    # windows of `window` words found twice or more in their text
    text = np.repeat(np.arange(n), n_words)
    size = max(0, len(text) - window + 1)
    acc = np.zeros(size, np.uint64)
    for i in range(window):
        acc = acc * np.uint64(0xD1342543DE82EF95) + words.hashes[i : i + size]
    inside = text[:size] == text[window - 1 :][:size] if size else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    at = at[_doubled(mix(acc[at]), text[at])]
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    covered = np.append(0, np.cumsum(np.cumsum(edge[:-1]) > 0))
    # lines with a word that equal an earlier one of their text
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offs[1:]]))
    line_text = np.searchsorted(offs[1:], ends, "left")
    counts = np.append(0, np.cumsum(np.bincount(words.starts, minlength=len(data) + 1)[: len(data)])) if len(data) else np.zeros(1, int)
    full = (ends > starts) & (counts[np.minimum(ends, len(data))] > counts[np.minimum(starts, len(data))])
    starts, ends, line_text = starts[full], ends[full], line_text[full]
    own = mix(span_hash(data, starts, ends) ^ mix(line_text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    again = np.flatnonzero(own[order][1:] == own[order][:-1]) + 1
    return {
        "n_words": n_words,
        "word_chars": total(in_word & first_byte),
        "n_symbols": total(_SYMBOL[data]),
        "n_dup_lines": np.bincount(line_text[order[again]], minlength=n),
        "n_repeat_words": covered[words.bounds[1:]] - covered[words.bounds[:-1]],
        "n_lines": np.bincount(line_text, minlength=n),
        "n_upper": total(_UPPER[data]),
        "n_marks": total(in_word & ~_LETTER[data]),
    }


def statistics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`keys` and STATS of rows (keys, text)."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offs in chunks(batch.column("text")):
                stats = text_statistics(data, offs)
                kept = [batch.column(k).slice(first, last - first) for k in keys]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(stats[s], pa.int64()) for s in STATS)], [*keys, *STATS])

    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{s} long" for s in STATS)]))


def _features() -> list[Column]:
    """Variance-stabilised rates, each drawn to a common value in short texts."""
    c = F.col
    root = lambda part, whole, more: F.sqrt(c(part) / (c(whole) + F.lit(float(more))))
    made = (
        F.log((c("word_chars") + 100.0) / (c("n_words") + 20.0)),
        root("n_symbols", "word_chars", 100),
        root("n_upper", "word_chars", 100),
        root("n_marks", "word_chars", 100),
        root("n_dup_lines", "n_lines", 10),
        root("n_repeat_words", "n_words", 50),
    )
    return [F.round(x, 6).alias(n) for n, x in zip(FEATURES, made, strict=True)]


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def _squared_distance(center: str = "center", inverse: str = "inverse") -> Column:
    """Mahalanobis distance squared under the estimate in two array columns."""
    d = [F.col(n) - F.col(center)[i] for i, n in enumerate(FEATURES)]
    terms = [d[i] * d[j] * F.col(inverse)[k] * (1.0 if i == j else 2.0) for k, (i, j) in enumerate(_PAIRS)]
    return sum(terms[1:], terms[0])


def consistency(kept: float, p: int) -> float:
    """What makes the covariance of the nearest `kept` of a normal sample unbiased."""
    rng = np.random.default_rng(7)
    d = np.sort(rng.chisquare(p, 200_001))
    cut = d[int(kept * (len(d) - 1))]
    return float(p * kept / (np.mean(np.where(d <= cut, d, 0.0))))


def chi_square(p: int, z: float) -> float:
    """The chi-square quantile at a standard normal's z (Wilson and Hilferty)."""
    return float(p * (1 - 2 / (9 * p) + z * np.sqrt(2 / (9 * p))) ** 3)


KEYS = ("level", "g_lang", "g_source")
_SHAPE = "center array<double>, cov array<double>, inverse array<double>, logdet double, n double"


def _upper(matrix: np.ndarray) -> list[float]:
    return [float(f"{matrix[i, j]:.9g}") for i, j in _PAIRS]


def _full(upper: list[float]) -> np.ndarray:
    out = np.zeros((len(FEATURES), len(FEATURES)))
    for v, (i, j) in zip(upper, _PAIRS, strict=True):
        out[i, j] = out[j, i] = v
    return out


def _shape(center: np.ndarray, cov: np.ndarray, n: float) -> tuple:
    """The columns of _SHAPE."""
    return np.asarray(center).round(9).tolist(), _upper(cov), _upper(np.linalg.inv(cov)), float(np.linalg.slogdet(cov)[1]), float(n)


def _mapped(table: DataFrame, keep: list[str], make: Callable) -> DataFrame:
    """keep and _SHAPE, by make(row), for each row of a small table."""
    kinds = dict(table.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [make(r) for r in pdf.itertuples(index=False)]
            yield pdf[keep].assign(**{c: [m[i] for m in made] for i, c in enumerate(("center", "cov", "inverse", "logdet", "n"))})

    return table.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), _SHAPE]))


def _levels(rows: DataFrame) -> DataFrame:
    """KEYS and FEATURES: each row in all documents, its language, and its language and source."""
    group = lambda n, lang, source: F.struct(F.lit(n).alias("level"), lang.alias("g_lang"), source.alias("g_source"))
    none, lang = F.lit(""), F.col("lang")
    each = F.array(group(0, none, none), group(1, lang, none), group(2, lang, F.col("source")))
    return rows.select(*FEATURES, F.explode(each).alias("g")).select("g.*", *FEATURES)


def _on(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with table's columns for their keys; table is small or joined by a shuffle."""
    return rows.join(small(table), keys)


def _starts(rows: DataFrame) -> DataFrame:
    """KEYS, start, _SHAPE: each group's first estimates."""
    keys, p = list(KEYS), range(len(FEATURES))
    mids = materialise(rows.groupBy(*keys).agg(*(F.percentile_approx(n, 0.5, 1000).alias(f"m{i}") for i, n in enumerate(FEATURES))))
    off = [F.percentile_approx(F.abs(F.col(n) - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i, n in enumerate(FEATURES)]
    spread = _on(rows, mids, keys).groupBy(*keys).agg(*(F.first(f"m{i}").alias(f"m{i}") for i in p), *off)
    width = [F.sqrt(F.pow(F.col(f"d{i}") * 1.4826, F.lit(2)) + FLOOR[i] ** 2).alias(f"d{i}") for i in p]
    spread = materialise(spread.select(*keys, *(f"m{i}" for i in p), *width))
    scaled = _on(rows, spread, keys).select(*keys, *(((F.col(n) - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i, n in enumerate(FEATURES)))
    norm = F.greatest(F.sqrt(sum((F.col(f"z{i}") ** 2 for i in p), F.lit(0.0))), F.lit(1e-9))
    signs = scaled.select(*keys, *((F.col(f"z{i}") / norm).alias(f"u{i}") for i in p), *(F.tanh(f"z{i}").alias(f"y{i}") for i in p))
    products = lambda c: F.array(*(F.avg(F.col(f"{c}{i}") * F.col(f"{c}{j}")) for i, j in _PAIRS))
    cross = signs.groupBy(*keys).agg(products("u").alias("u"), products("y").alias("y"), F.array(*(F.avg(f"y{i}") for i in p)).alias("mean"))
    table = _on(materialise(cross), spread, keys).select("*", F.explode(F.array(*map(F.lit, range(STARTS)))).alias("start"))

    def make(r: tuple) -> tuple:
        shape = np.eye(len(FEATURES))
        if r.start:
            shape = _full(r.u) if r.start == 1 else _full(r.y) - np.outer(r.mean, r.mean)
            scale = np.sqrt(np.maximum(np.diag(shape), 1e-9))
            shape = 0.95 * shape / np.outer(scale, scale) + 0.05 * np.eye(len(FEATURES))
        width = np.array([getattr(r, f"d{i}") for i in p])
        return _shape([getattr(r, f"m{i}") for i in p], shape * np.outer(width, width), 0.0)

    return _mapped(table, [*KEYS, "start"], make)


def _concentrated(rows: DataFrame, now: DataFrame, kept: float) -> DataFrame:
    """KEYS, start, _SHAPE: the estimates of the nearest `kept` part under those of `now`."""
    keys = [*KEYS, "start"]
    tries = now.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "center", "inverse")).alias("tries"))  # STARTS at most
    each = _on(rows, materialise(tries), list(KEYS)).select(*KEYS, *FEATURES, F.explode("tries").alias("t")).select(*KEYS, *FEATURES, "t.*")
    d2 = F.greatest(_squared_distance(), F.lit(1e-9))
    # sums by group and bin, of which there are some hundred a group
    cells = each.groupBy(*keys, F.floor(F.log2(d2) * BINS).cast("int").alias("bin")).agg(
        F.count("*").alias("n"),
        F.array(*(F.sum(n) for n in FEATURES)).alias("s"),
        F.array(*(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in _PAIRS)).alias("p"),
    )
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = materialise(cells).withColumn("before", before).withColumn("all", F.sum("n").over(w)).filter(F.col("before") < kept * F.col("all"))
    part = F.least(F.lit(1.0), (kept * F.col("all") - F.col("before")) / F.col("n"))
    near = near.withColumn("part", part)
    add = lambda c, n: F.array(*(F.sum(F.col("part") * F.col(c)[i]) for i in range(n)))
    sums = near.groupBy(*keys).agg(
        F.sum(F.col("part") * F.col("n")).alias("h"), F.max("all").alias("all"), add("s", len(FEATURES)).alias("s"), add("p", len(_PAIRS)).alias("p")
    )
    factor = consistency(kept, len(FEATURES)) if kept < 1 else 1.0

    def make(r: tuple) -> tuple:
        mean = np.array(r.s) / r.h
        cov = _full(np.array(r.p) / r.h) - np.outer(mean, mean)
        return _shape(mean, cov * factor + np.diag(np.square(FLOOR)), r.all)

    return materialise(_mapped(sums, keys, make))


def _estimate(rows: DataFrame, kept: float) -> DataFrame:
    """KEYS, _SHAPE: the estimate of each group of rows (KEYS, FEATURES)."""
    keys = list(KEYS)
    now = materialise(_starts(rows))
    for _ in range(2):
        now = _concentrated(rows, now, kept)
    columns = ["start", "center", "cov", "inverse", "logdet", "n"]
    best = F.min_by(F.struct(*columns), F.struct("logdet", "start"))
    now = materialise(now.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*"))
    for _ in range(STEPS):
        after = _concentrated(rows, now, kept)
        old = now.select(*keys, F.struct(*columns).alias("old"))
        # bins are narrow but not points: an estimate that got no better is kept
        fallen = F.col("logdet") < F.col("old.logdet") - SETTLED
        both = after.select(*keys, F.struct(*columns).alias("new"), "logdet").join(old, keys)
        now = materialise(both.select(*keys, fallen.alias("fallen"), F.when(fallen, F.col("new")).otherwise(F.col("old")).alias("b")).select(*keys, "fallen", "b.*"))
        if not now.filter("fallen").limit(1).count():
            break
        now = now.drop("fallen")
    return now.select(*keys, "center", "cov", "inverse", "logdet", "n")


def _averaged(estimates: DataFrame, prior: float) -> DataFrame:
    """lang, source, center, inverse: each group's estimate with its language's and that of all."""
    of = lambda level, names: estimates.filter(F.col("level") == level).select(
        *(F.col(g).alias(n) for g, n in names), *(F.col(c).alias(f"{c}{level}") for c in ("center", "cov", "n"))
    )
    own = of(2, [("g_lang", "lang"), ("g_source", "source")])
    table = own.join(small(of(1, [("g_lang", "lang")])), "lang").crossJoin(F.broadcast(of(0, [])))  # the last has one row

    def make(r: tuple) -> tuple:
        center, cov = np.array(r.center0), _full(r.cov0)
        for mean, own, n in ((r.center1, r.cov1, r.n1), (r.center2, r.cov2, r.n2)):
            part = 1 - (prior / (n + prior)) ** 2
            center, cov = part * np.array(mean) + (1 - part) * center, part * _full(own) + (1 - part) * cov
        return _shape(center, cov, r.n2)

    return _mapped(table, ["lang", "source"], make).select("lang", "source", "center", "inverse")


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    kept: float = 0.75,
    z: float = 5.0,
    prior: float = PRIOR,
) -> DataFrame:
    """id, key, lang, source, STATS, base_failed, distance, kept of every row.

    base_failed: fewer than 10 words, or more than a fifth of the words in
    five-word windows that the text repeats. kept is false then, and if the
    squared Mahalanobis distance from the estimate of the row's language and
    source exceeds the chi-square value at z normal deviations. The estimates
    are those of the nearest `kept` part of the rows that pass the base rules,
    averaged with the wider groups'. key is a hash of the
    text, which tells rows of one id apart.

    Null texts have no words and fail. Very long ones are taken whole, each in the
    memory of one task. Null languages and sources are groups of
    their own, and a group may be of one row. Null ids and repeated rows are
    judged like any others; ties at the cut-off are kept. Other columns are
    ignored. An empty table gives an empty result, and without a row that passes
    the base rules no distance is measured.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("\0")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("source"),
        F.xxhash64(text_col).alias("key"),
        F.col(text_col).alias("text"),
    )
    stats = statistics(rows, ["id", "lang", "source", "key"])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = materialise(stats.withColumn("base_failed", failed).select("*", *_features()))
    good = stats.filter("not base_failed")
    columns = ["id", "key", "lang", "source", *STATS, "base_failed"]
    if not good.limit(1).count():
        return stats.select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    of_group = materialise(_averaged(_estimate(_levels(good), kept), prior))
    d2 = F.when(~F.col("base_failed"), _squared_distance())
    judged = stats.join(small(of_group), ["lang", "source"], "left").withColumn("distance", d2)
    verdict = ~F.col("base_failed") & (F.col("distance") <= chi_square(len(FEATURES), z))
    return judged.select(*columns, "distance", F.coalesce(verdict, F.lit(False)).alias("kept"))
