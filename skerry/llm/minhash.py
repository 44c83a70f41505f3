"""Near-duplicate groups: banded MinHash with sequential Bayesian verification.

Texts with equal shingle sets are first folded into one class. The classes'
signatures are cut into bands, and classes that agree in a band are candidates.
A candidate pair's signatures are compared batch by batch; after each batch the
posterior of the similarity (uniform prior) decides whether it can still reach
the threshold, at a chosen probability of a miss (Satuluri and Parthasarathy,
"Bayesian Locality Sensitive Hashing", 2012). Survivors are verified exactly on
their full shingle sets.

Groups, not pairs, are asked for, so a bucket of m classes is not expanded into
m * m pairs: every class is compared with the bucket's least one, the links
found are closed into components, and only buckets that still hold more than
one component are worked on further, the classes outside the bucket's main
component against all of the bucket, in blocks. No bucket is capped. Pairs whose
set sizes alone exclude the threshold are dropped before any join, and a pair
that shares several bands is compared in the first of them only. Sets are sent to
the block that compares their signatures, once each, and survivors are verified
there by falling matches; pairs that the block has connected already are passed
over. So no list of pairs is ever stored: a block hands on fewer links than it
has rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.llm._store import discard, materialise, small
from skerry.llm._text import Words, chunks, mix, shingles, span_hash
from skerry.llm.components import connected_components, merged

BANDS, ROWS = 42, 6  # a pair of similarity 0.8 shares no band once in 350,000
BATCH = 36  # hashes compared before each decision
BLOCK = 256  # classes on either side of a block
WEIGHT = 1 << 19  # shingles on either side of a block


def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def signature_matrix(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash signatures, a row for each of the non-empty sets.

    Of each least hash 16 mixed bits are kept: hashes that differ agree in them
    once in 65,536, which can add a candidate but never lose one.
    """
    mult, add = _hashes(n)
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    offs = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((n, len(sets)), np.uint16)
    for i in range(n):
        out[i] = (np.minimum.reduceat(low * mult[i] + add[i], offs) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return np.ascontiguousarray(out.T)


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The least of n hashes that must match for P(similarity >= threshold) >= miss.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1),
    and its tail is the probability of at most m successes in n + 1 trials.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n + 1


def surviving(left: np.ndarray, right: np.ndarray, threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs left[i], right[i] of signatures outlast every batch, and their matches."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for first in range(0, left.shape[1], BATCH):
        last = min(first + BATCH, left.shape[1])
        matches = matches + (left[alive, first:last] == right[alive, first:last]).sum(axis=1)
        on = matches >= least_matches(last, threshold, miss)
        alive, matches = alive[on], matches[on]
    return alive, matches


def near_in_size(x: np.ndarray, y: np.ndarray | int, percent: int) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold at all."""
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def _signed(docs: DataFrame, k: int, n: int) -> DataFrame:
    """id, key, n_shingles, class (16 bytes, null without words), sig (null likewise)."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offs in chunks(batch.column("text")):
                words = Words(data, offs)
                sets = shingles(words.hashes, words.bounds, k)
                full = [s for s in sets if len(s)]
                sigs = iter(signature_matrix(full, n)) if full else iter(())
                classes, bins = [], []
                for s in sets:
                    if not len(s):
                        classes.append(None)
                        bins.append(None)
                        continue
                    ends = np.array([len(s)])
                    h1 = span_hash(s, np.array([0]), ends)[0]
                    h2 = mix(s).sum(dtype=np.uint64) ^ mix(mix(s)).sum(dtype=np.uint64)
                    classes.append(h1.tobytes() + h2.tobytes())
                    bins.append(next(sigs).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, last - first),
                        batch.column("key").slice(first, last - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(classes, pa.binary()),
                        pa.array(bins, pa.binary()),
                    ],
                    ["id", "key", "n_shingles", "class", "sig"],
                )

    return docs.mapInArrow(run, f"id {id_type}, key long, n_shingles long, class binary, sig binary")


def _bits(bands: int) -> int:
    return max(1, (bands - 1).bit_length())


def _banded(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """bucket, node: a row for each class and band; a bucket's low bits are its band."""
    low = np.uint64((1 << _bits(bands)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column("sig")).astype(np.uint64)
            band = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands))
            acc = band
            for r in range(rows):
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + sig[:, r : bands * rows : rows])
            acc = acc & ~low | band
            yield pa.RecordBatch.from_arrays(
                [pa.array(acc.view(np.int64).ravel()), pa.array(np.repeat(batch.column("node").to_numpy(), bands))],
                ["bucket", "node"],
            )

    return classes.select("node", "sig").mapInArrow(run, "bucket long, node long")


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(values), np.uint16).reshape(len(values), -1)


def _parts(n: str, weight: str) -> Column:
    """Into how many parts rows of this number and weight are dealt."""
    return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(weight) / WEIGHT), F.lit(1)).cast("int")


def _star(buckets: DataFrame, classes: DataFrame, threshold: float, miss: float, percent: int) -> DataFrame:
    """block, a, b, m: each class and its buckets' least ones, if the test can't exclude them."""
    sizes = classes.select("node", F.col("n_shingles").alias("size"))
    pairs = buckets.filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    pairs = pairs.join(sizes.withColumnsRenamed({"node": "a", "size": "na"}), "a").join(sizes.withColumnsRenamed({"node": "b", "size": "nb"}), "b")
    pairs = materialise(pairs.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep, matches = surviving(_matrix(batch.column("sa")), _matrix(batch.column("sb")), threshold, miss)
                kept = batch.select(["a", "b", "nb"]).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(matches, pa.int32())], ["a", "b", "nb", "m"])

    sa = classes.select(F.col("node").alias("a"), F.col("sig").alias("sa"))
    sb = classes.select(F.col("node").alias("b"), F.col("sig").alias("sb"))
    left = materialise(pairs.join(sa, "a").join(sb, "b").mapInArrow(run, "a long, b long, nb long, m int"))
    parts = left.groupBy("a").agg(F.count("*").alias("n"), F.sum("nb").alias("w")).select("a", _parts("n", "w").alias("parts"))
    dealt = left.join(small(materialise(parts)), "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    return dealt.select(F.xxhash64("a", "part").alias("block"), "a", "b", "m")


def _sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """node, shingles (sorted 64-bit hashes): the full sets of some classes, from their texts."""
    wanted = materialise(nodes.distinct().join(classes.select("node", "id", "key"), "node"))
    texts = docs.join(small(wanted), ["id", "key"]).select("node", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offs in chunks(batch.column("text")):
                words = Words(data, offs)
                sets = [s.tobytes() for s in shingles(words.hashes, words.bounds, k)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(first, last - first), pa.array(sets, pa.binary())], ["node", "shingles"]
                )

    return texts.mapInArrow(cut, "node long, shingles binary").dropDuplicates(["node"])


def alike(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sets of sorted hashes reach the threshold."""
    both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def connecting(pairs: list[tuple], sets: dict[int, bytes], percent: int) -> list[tuple[int, int]]:
    """Links among pairs (matches, a, b, component of a, of b) that connect what all links would."""
    home: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := home.get(c, c)) != c:
            home[c] = c = home.get(up, up)
        return c

    found = []
    for _, a, b, ca, cb in sorted(pairs, key=lambda r: (-r[0], r[1:3])):
        ca, cb = find(ca), find(cb)
        if ca != cb and alike(sets[a], sets[b], percent):
            found.append((a, b))
            home[ca] = cb
    return found


def _verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links a, b among pairs (block, a, b, m): those that connect what all links of a block would.

    A link is a pair whose full shingle sets reach the threshold; each set is
    sent once to a block.
    """
    places = materialise(pairs.select("block", F.col("a").alias("node")).union(pairs.select("block", "b")).distinct())

    def test(placed: pa.Table, asked: pa.Table) -> pa.Table:
        sets = dict(zip(placed.column("node").to_pylist(), placed.column("shingles").to_pylist(), strict=True))
        rows = [(m, a, b, a, b) for a, b, m in zip(*(asked.column(c).to_pylist() for c in ("a", "b", "m")), strict=True)]
        found = connecting(rows, sets, percent)
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    placed = places.join(_sets(places.select("node"), docs, classes, k), "node").groupBy("block").cogroup(pairs.groupBy("block"))
    return placed.applyInArrow(test, "a long, b long")


def _unresolved(buckets: DataFrame, parts: DataFrame, bands: int) -> DataFrame:
    """bucket, band, node, size, component, main, n, w, n_out, w_out: buckets of several components.

    Buckets of two were settled by their one comparison. Of buckets with the
    same members the one of the least band is taken.
    """
    rows = buckets.filter("n > 2").join(parts, "node", "left")
    rows = materialise(rows.select("bucket", "node", "size", F.coalesce("component", "node").alias("component")))
    by = rows.groupBy("bucket", "component").agg(
        F.count("*").alias("m"),
        F.sum("size").alias("w"),
        F.bit_xor(F.xxhash64("node")).alias("h1"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"),
    )
    open_ = by.groupBy("bucket").agg(
        F.max(F.struct("m", "w", "component")).alias("top"),
        F.count("*").alias("parts"),
        F.sum("m").alias("n"),
        F.sum("w").alias("w"),
        F.bit_xor("h1").alias("h1"),
        F.bit_xor("h2").alias("h2"),
    )
    open_ = open_.filter("parts > 1")
    band = F.col("bucket").bitwiseAND((1 << _bits(bands)) - 1).cast("int")
    open_ = open_.groupBy("n", "h1", "h2").agg(F.min(F.struct(band.alias("band"), "bucket", "top", "w")).alias("o"))
    open_ = open_.select(
        "o.bucket", F.col("o.band").alias("band"), F.col("o.top.component").alias("main"), "n", "o.w",
        (F.col("n") - F.col("o.top.m")).alias("n_out"), (F.col("o.w") - F.col("o.top.w")).alias("w_out"),
    )
    return rows.join(small(materialise(open_)), "bucket")


def _blocks(open_: DataFrame, docs: DataFrame, classes: DataFrame, k: int, threshold: float, miss: float, rows_: int, percent: int) -> DataFrame:
    """Links a, b between different components within open buckets, enough to connect what all would.

    Rows outside a bucket's main component meet every row of the bucket, in
    blocks of bounded size. A pair that shares an earlier band is left to that
    band's bucket.
    """
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    few, all_ = _parts("n_out", "w_out"), _parts("n", "w")
    open_ = open_.withColumn("outer", F.col("component") != F.col("main"))
    cols = ("bucket", "band", "node", "component", "size", "outer")
    outer = open_.filter("outer").select(*cols, F.lit(True).alias("out"), place(few).alias("i"), every(all_).alias("j"))
    inner = open_.select(*cols, F.lit(False).alias("out"), every(few).alias("i"), place(all_).alias("j"))
    sets = _sets(open_.select("node"), docs, classes, k)
    rows = outer.union(inner).join(sets.join(classes.select("node", "sig"), "node"), "node")
    # a block is few bytes and much work: its tasks must not be merged by their bytes
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "bucket", "i", "j")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        ys, xs = pdf[pdf["out"]], pdf[~pdf["out"]]
        pairs = []
        if len(ys) and len(xs):
            x_sig, x_node, x_part, x_size = _matrix(xs["sig"]), xs["node"].to_numpy(), xs["component"].to_numpy(), xs["size"].to_numpy()
            x_outer = xs["outer"].to_numpy()
            band = int(pdf["band"].iloc[0])
            for node, part, size, sig in zip(ys["node"].tolist(), ys["component"].tolist(), ys["size"].tolist(), _matrix(ys["sig"]), strict=True):
                other = np.flatnonzero((x_part != part) & near_in_size(x_size, size, percent) & (~x_outer | (x_node > node)))
                if not len(other):
                    continue
                keep, matches = surviving(x_sig[other], np.broadcast_to(sig, (len(other), len(sig))), threshold, miss)
                at = other[keep]
                if band and len(at):
                    first = (x_sig[at, : band * rows_] == sig[: band * rows_]).reshape(len(at), band, rows_).all(axis=2).any(axis=1)
                    at, matches = at[~first], matches[~first]
                pairs += [(m, node, v, part, p) for v, p, m in zip(x_node[at].tolist(), x_part[at].tolist(), matches.tolist(), strict=True)]
        found = connecting(pairs, dict(zip(pdf["node"].tolist(), pdf["shingles"], strict=True)), percent) if pairs else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("bucket", "i", "j").applyInPandas(test, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    miss: float = 1e-6,
    keyed: bool = False,
) -> DataFrame:
    """id, n_shingles, component_id, kept: near-duplicate groups of `docs`.

    Words are runs without white space (x20, x09-x0D), A-Z lower-cased; a text's
    set is its distinct `shingle`-word shingles, or its whole sequence if it has
    fewer words. Texts are linked if the sets' Jaccard similarity is at least
    `percent` / 100. component_id is the least id that links reach; kept is true
    for that row.

    Null and empty texts and texts without words have no shingles and are linked
    with nothing: they are their own component. Rows without an id can't name a
    component: component_id is null and they are kept. Rows that repeat an id
    are judged each by their own text. Equal texts tie by the least id. Very long
    texts are taken whole, each in the memory of one task; their sets weigh more in
    the size of a block. Other columns are ignored. An empty table gives an empty
    result.

    miss: probability that the sequential test drops a pair at the threshold.
    keyed: add key, the text's hash, which tells rows of one id apart.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    signed = materialise(_signed(docs, shingle, bands * rows))
    classes = materialise(
        signed.filter("id is not null and n_shingles > 0")
        .groupBy("class")
        .agg(F.min(F.struct("id", "key")).alias("r"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sig").alias("sig"))
        .select("class", "r.id", "r.key", "n_shingles", "sig", F.monotonically_increasing_id().alias("node"))
    )
    banded = _banded(classes, bands, rows)
    shared = materialise(banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("a")).filter("n > 1"))
    buckets = banded.join(small(shared), "bucket").join(classes.select("node", F.col("n_shingles").alias("size")), "node")
    buckets = materialise(buckets)
    threshold = percent / 100
    star = _star(buckets, classes, threshold, miss, percent)
    links = materialise(_verify(star, docs, classes, shingle, percent))
    parts = connected_components(links)
    open_ = materialise(_unresolved(buckets, parts, bands))
    discard(shared, buckets)
    if open_.limit(1).count():
        more = materialise(_blocks(open_, docs, classes, shingle, threshold, miss, rows, percent))
        if more.limit(1).count():
            parts = merged(parts, more)
    joined = classes.select("class", "node", "id").join(parts, "node", "left")
    named = joined.filter("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    of_class = joined.join(named, "component", "left").select("class", F.coalesce("least", "id").alias("component_id"))
    out = signed.select("id", "key", "n_shingles", "class").join(of_class, "class", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        *(["key"] if keyed else []),
    )
