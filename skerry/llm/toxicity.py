"""Toxicity scores: a linear classifier over NB-scaled character n-grams.

After Wang and Manning, "Baselines and Bigrams" (2012): a text's features are
the n-grams of code points (A-Z lower-cased) that it holds, each scaled by its naive
Bayes log-count ratio between toxic and other labelled texts, and a logistic
regression is fitted on the scaled features. N-grams are hashed; those that
tell the classes apart best are kept.

Counting and scoring run on the executors over whole texts. The fit sees at
most `max_labelled` labelled rows, taken in the order of a hash of their id, so
the matrix that reaches the driver is bounded: that many rows by at most
`features` columns, sparse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm._store import materialise
from skerry.llm._text import LOWER, chunks

ORDERS = (4, 5, 6)
BITS = 20
FEATURES = 2048
MAX_LABELLED = 20_000
SMOOTHING = 1.0
CHI = 30.0


def held_out(doc_id) -> F.Column:  # noqa: ANN001
    """Whether crc32 of the id as text leaves 2 modulo 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points (A-Z lower-cased) of a chunk of UTF-8 texts, and their offsets."""
    low = LOWER[data]
    if not (low > 0x7F).any():
        return low.astype(np.uint32), offs
    begins = np.append(0, np.cumsum((low & 0xC0) != 0x80))
    return np.frombuffer(low.tobytes().decode().encode("utf-32-le"), np.uint32), begins[offs]


def grams(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every character n-gram of a chunk of texts, one order at a time."""
    low, offs = points(data, offs)
    text = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    for n in ORDERS:
        size = len(low) - n + 1
        if size <= 0:
            continue
        acc = np.full(size, n, np.uint32)
        for i in range(n):
            acc = acc * np.uint32(0x01000193) + low[i : i + size]
        acc *= np.uint32(0x9E3779B1)
        acc >>= np.uint32(32 - BITS)
        if len(offs) > 2:
            inside = text[:size] == text[n - 1 :]
            yield text[:size][inside], acc[inside]
        else:
            yield text[:size], acc


def features_of(data: np.ndarray, offs: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs without repeats, for the buckets that slot maps above -1."""
    pairs = [np.zeros(0, np.int64)]
    for text, bucket in grams(data, offs):
        where = slot[bucket]
        hit = where >= 0
        pairs.append(text[hit].astype(np.int64) << BITS | where[hit])
    both = np.unique(np.concatenate(pairs))
    return both >> BITS, both & ((1 << BITS) - 1)


class Model:
    """Feature slots, weights (ratio times coefficient) and intercept."""

    def __init__(self, slot: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        self.slot, self.weights, self.intercept = slot, weights, intercept

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        text, feature = features_of(data, offs, self.slot)
        raw = np.bincount(text, self.weights[feature], len(offs) - 1) if len(text) else np.zeros(len(offs) - 1)
        return 1 / (1 + np.exp(-np.clip(raw + self.intercept, -30, 30)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, penalty: float = 1.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression of a sparse matrix, by accelerated gradient steps."""
    n, w, b = len(y), np.zeros(width), 0.0
    square = np.bincount(rows, values**2, n) + 1
    rate = 1 / (0.25 * square.max() * 1.0 + penalty / n)
    rate = max(rate, 1 / (0.25 * np.mean(square) * 8 + penalty / n))
    pw, pb, momentum = w, b, 1.0
    last = np.inf
    for _ in range(steps):
        z = np.bincount(rows, values * pw[cols], n) + pb
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = -np.mean(np.where(y > 0, np.log(p), np.log(1 - p))) + penalty / (2 * n) * (pw @ pw)
        if loss > last:  # overshot: a smaller step, and no momentum
            rate, momentum, pw, pb = rate / 2, 1.0, w, b
            last = np.inf
            continue
        last = loss
        d = (p - y) / n
        nw = pw - rate * (np.bincount(cols, values * d[rows], width) + penalty / n * pw)
        nb = pb - rate * d.sum()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pw, pb = nw + (momentum - 1) / after * (nw - w), nb + (momentum - 1) / after * (nb - b)
        w, b, momentum = nw, nb, after
    return w, b


def train(labelled: DataFrame, features: int = FEATURES) -> Model:
    """A model from rows (text, toxic); toxic is 0 or 1.

    Rows with a null label don't count, null texts are ''. Without rows of both
    labels the model has no features and scores the share of toxic rows.
    """
    spark = labelled.sparkSession
    rows = labelled.filter("toxic is not null").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int64)
        sizes = np.zeros(2, np.int64)
        every = np.arange(1 << BITS, dtype=np.int32)
        for batch in batches:
            toxic = (batch.column("toxic").to_numpy() > 0).astype(np.int64)
            for first, last, data, offs in chunks(batch.column("text")):
                text, feature = features_of(data, offs, every)
                label = toxic[first:last][text]
                for k in (0, 1):
                    sums[k] += np.bincount(feature[label == k], minlength=1 << BITS)
                sizes += np.bincount(toxic[first:last], minlength=2)
        on = np.flatnonzero(sums.sum(axis=0))
        cols = [np.append(on, -1), np.append(sums[0][on], sizes[0]), np.append(sums[1][on], sizes[1])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["bucket", "clean", "toxic"])

    counts = materialise(rows.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    sizes = counts.filter("bucket = -1").first()
    n0, n1 = (int(sizes["clean"] or 0), int(sizes["toxic"] or 0)) if sizes else (0, 0)
    slot = np.full(1 << BITS, -1, np.int32)
    if not n0 or not n1:
        share = (n1 + 0.5) / (n0 + n1 + 1)
        return Model(slot, np.zeros(1), float(np.log(share / (1 - share))))
    a, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    both = a + c
    chi = (n0 + n1) * F.pow(a * n0 - c * n1, F.lit(2)) / (both * (F.lit(float(n0 + n1)) - both + 0.5) * float(n0) * float(n1))
    best = counts.filter("bucket >= 0 and toxic + clean >= 3").withColumn("chi", chi).filter(F.col("chi") >= min(CHI, (n0 + n1) / 10))
    best = best.orderBy(F.desc("chi"), "bucket").limit(features).toPandas()
    slot[best["bucket"].to_numpy()] = np.arange(len(best), dtype=np.int32)
    p, q = best["toxic"].to_numpy() + SMOOTHING, best["clean"].to_numpy() + SMOOTHING
    ratio = np.log((p / p.sum()) / (q / q.sum())) if len(best) else np.zeros(0)
    shared = spark.sparkContext.broadcast(slot)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offs in chunks(batch.column("text")):
                text, feature = features_of(data, offs, shared.value)
                at = np.searchsorted(text, np.arange(last - first + 1))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([lists, batch.column("toxic").slice(first, last - first)], ["features", "toxic"])

    table = rows.mapInArrow(cut, "features array<int>, toxic int").toArrow()
    found = table.column("features").combine_chunks()
    cols = np.concatenate([np.zeros(0, np.int64), found.flatten().to_numpy()]).astype(np.int64)
    lines = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
    y = (table.column("toxic").to_numpy() > 0).astype(float)
    w, b = fit_logistic(lines, cols, ratio[cols], y, max(1, len(best)))
    return Model(slot, w * ratio if len(best) else np.zeros(1), b)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.3,
    features: int = FEATURES,
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """id, held_out, score, predicted of every row of `docs`.

    Learns from the labels of ids that aren't held out (crc32 of the id as text
    modulo 4 is not 2), at most `max_labelled` of them. Only the text decides a
    score, from 0 to 1; predicted is 1 from `threshold`.

    Null and empty texts have no n-grams and score the intercept. Very long texts
    are taken whole, each in the memory of one task. Null labels and
    labels without a document are passed over, and an id with several labels
    counts once for each. Null ids aren't held out; repeated rows are scored
    each; other columns are ignored. Without labels of both kinds every text
    scores the same. An empty table gives an empty result.
    """
    marks = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    marks = marks.filter(~held_out("label_id")).orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    labelled = materialise(rows.join(F.broadcast(marks), F.col("id") == F.col("label_id")).select("text", "toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled, features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(data, offs) for _, _, data, offs in chunks(batch.column("text"))]
            scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], ["id", "score"])

    id_type = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {id_type}, score double")
    return scored.select(
        F.col("id").alias(id_col),
        F.coalesce(held_out("id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
