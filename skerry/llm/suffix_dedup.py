"""Repeated passages by a sparse suffix array.

Only suffixes that begin at a minimiser are kept: the word position with the
least hash of GRAM words among any WINDOW neighbouring ones. Equal passages
select equal positions, so every passage of `least` words holds a kept suffix,
the passage's first minimiser, whose next `least - WINDOW + 1` words, its
prefix, lie inside the passage. A suffix whose prefix's hash occurs once can't
belong to a repeated passage and is left out before any text is moved.

The others are cut with the words around them, range-partitioned and sorted by
their words, and neighbours are compared word by word: those that agree in the
whole prefix form a run. In a run matches are extended to the right and left:
the suffixes are divided by the words on either side, and every window of
`least` words whose first minimiser is the suffix is compared, byte by byte,
with the run's others. Windows that occur twice or more are merged into spans.

The sort key ends in the document and place, so a passage that a third of all
documents share spreads over many tasks. A run that a partition's end cuts hands
on one row for each of its different windows, and an aggregation joins those.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm._store import discard, materialise, small
from skerry.llm._text import IS_SPACE, LOWER, Words, chunks, mix, span_hash, window_min

LEAST, WINDOW, GRAM = 50, 20, 6


def _minimisers(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each word position, its minimiser: the first least gram of `window` ones.

    Positions too near the end have none and are left out.
    """
    n = len(hashes) - gram + 1
    if n < window:
        return np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint64)
    for i in range(gram):
        acc = acc * np.uint64(0xD1342543DE82EF95) + hashes[i : i + n]
    grams = mix(acc)
    least = window_min(grams, window)
    # the first position that holds the least value, for each window
    where = np.full(len(least), -1, np.int64)
    for i in range(window - 1, -1, -1):
        same = grams[i : i + len(least)] == least
        where[same] = i
    return where + np.arange(len(least))


def _selected(words: Words, least: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, minimiser) of every window of `least` words in a chunk of texts."""
    sizes = np.diff(words.bounds)
    found = _minimisers(words.hashes, window, gram)
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(found)]
    start = np.arange(len(found))
    inside = start + least <= words.bounds[text + 1]
    return text[inside], start[inside], found[inside]


def _suffixes(texts: DataFrame, least: int, window: int, gram: int) -> DataFrame:
    """prefix (a hash of it), node, at: the kept suffixes; at is a word position."""
    prefix = least - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offs in chunks(batch.column("text")):
                words = Words(data, offs)
                text, _, at = _selected(words, least, window, gram)
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1]
                text, at = text[new], at[new]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(span_hash(words.hashes, at, at + prefix).view(np.int64)),
                        batch.column("node").slice(first, last - first).take(pa.array(text)),
                        pa.array(at - words.bounds[text], pa.int64()),
                    ],
                    ["prefix", "node", "at"],
                )

    return texts.select("node", "text").mapInArrow(run, "prefix long, node binary, at long")


def _like_neighbours(suffixes: DataFrame) -> DataFrame:
    """node, at of suffixes whose prefix's hash occurs at another place too.

    The hashes are sorted over the cluster. A partition can't see beyond its
    first and last rows, so these count as equal to a neighbour; that adds at
    most two suffixes a partition, which the comparison of words then drops.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_kept = None, True  # the last row so far, still without a right neighbour
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            if not table.num_rows:
                continue
            prefix, at = table.column("prefix").to_numpy(), table.column("at").to_numpy()
            # copies of a text are one node: rows of one place count once
            node = table.column("node").combine_chunks()
            again = (prefix[1:] == prefix[:-1]) & (at[1:] == at[:-1])
            where = np.flatnonzero(again)
            if len(where):
                again[where] = pc.equal(node.take(pa.array(where)), node.take(pa.array(where + 1))).to_numpy(zero_copy_only=False)
                stay = np.append(~again, True)
                table = table.filter(pa.array(stay))
                prefix = prefix[stay]
            n = len(prefix)
            equal = prefix[1:] == prefix[:-1]
            keep = np.zeros(n, bool)
            keep[1:] |= equal
            keep[:-1] |= equal
            keep[0] |= held_kept
            held, held_kept = table.slice(n - 1), bool(keep[n - 1])
            yield from table.select(["node", "at"]).take(pa.array(np.flatnonzero(keep[:-1]))).to_batches()
        if held is not None:
            yield from held.select(["node", "at"]).to_batches()

    by = ["prefix", "node", "at"]
    return suffixes.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(run, "node binary, at long")


def _plain(data: np.ndarray, words: Words) -> tuple[bytes, np.ndarray]:
    """The words in lower case with one space after each, and where each begins."""
    sizes = words.ends - words.starts
    out = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    inside = np.flatnonzero(~IS_SPACE[data])
    out[np.arange(len(inside)) + np.repeat(np.arange(len(sizes)), sizes)] = LOWER[data[inside]]
    return out.tobytes(), np.append(0, np.cumsum(sizes + 1))


def _contexts(texts: DataFrame, least: int, window: int, gram: int) -> DataFrame:
    """right, left, head, id, node, at: the words from each surviving suffix on, and before it.

    They are those of the windows whose first minimiser it is; head is the size
    of the prefix in bytes. texts has id, node, text and the suffixes' ats.
    """
    id_type = texts.schema["id"].dataType.simpleString()
    prefix = least - window + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats = batch.column("ats")
            for first, last, data, offs in chunks(batch.column("text")):
                words = Words(data, offs)
                text, start, found = _selected(words, least, window, gram)
                kept = np.zeros(len(words.hashes) + 1, bool)
                for i in range(first, last):
                    kept[ats[i].values.to_numpy() + words.bounds[i - first]] = True
                new = np.ones(len(found), bool)
                new[1:] = found[1:] != found[:-1]
                lows = np.flatnonzero(new)
                highs = np.append(lows[1:], len(found)) - 1
                on = kept[found[lows]] if len(lows) else np.zeros(0, bool)
                lows, highs = lows[on], highs[on]
                text, at, low, high = text[lows], found[lows], start[lows], start[highs]
                plain, begin = _plain(data, words)
                a, b, c = begin[low].tolist(), begin[at].tolist(), begin[high + least].tolist()
                rows = pa.array(text + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([plain[y:z] for y, z in zip(b, c, strict=True)], pa.binary()),
                        pa.array([plain[x:y] for x, y in zip(a, b, strict=True)], pa.binary()),
                        pa.array(begin[at + prefix] - begin[at], pa.int32()),
                        batch.column("id").take(rows),
                        batch.column("node").take(rows),
                        pa.array(at - words.bounds[text], pa.int64()),
                    ],
                    ["right", "left", "head", "id", "node", "at"],
                )

    return texts.mapInArrow(run, f"right binary, left binary, head int, id {id_type}, node binary, at long")


def _word_ends(part: bytes) -> array:
    """0, and the place after each word's space."""
    return array("q", b"\0" * 8 + (np.flatnonzero(np.frombuffer(part, np.uint8) == 0x20) + 1).tobytes())


def _ranges(lefts: list[int], at: int, least: int) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows that begin so many words left of `at`; lefts fall."""
    out: list[tuple[int, int]] = []
    for n, left in enumerate(lefts):
        if n and lefts[n - 1] == left + 1:
            out[-1] = (out[-1][0], at - left + least)
        else:
            out.append((at - left, at - left + least))
    return out


class _Found:
    """Columns of what a partition's runs yield."""

    def __init__(self) -> None:
        self.id, self.node, self.start, self.end, self.kind, self.hash = [], [], [], [], [], []

    def add(self, place: tuple, start: int, end: int, kind: int, digest: bytes | None = None) -> None:
        self.id.append(place[1])
        self.node.append(place[2])
        self.start.append(start)
        self.end.append(end)
        self.kind.append(kind)
        self.hash.append(digest)

    def __len__(self) -> int:
        return len(self.id)

    def taken(self, id_type: pa.DataType) -> pa.RecordBatch:
        """The rows so far, which are dropped here."""
        columns = [pa.array(self.id, id_type), pa.array(self.node, pa.binary()), pa.array(self.start, pa.int64()), pa.array(self.end, pa.int64())]
        columns += [pa.array(self.kind, pa.int32()), pa.array(self.hash, pa.binary())]
        self.__init__()
        return pa.RecordBatch.from_arrays(columns, ["id", "node", "start", "end", "kind", "hash"])


#: Rows that a partition's runs yield at once, or a little more.
FOUND_ROWS = 10_000
#: Windows of a run that are held at once, or one for each of its suffixes.
HELD_WINDOWS = 10_000

#: Kinds of rows: a repeated range, one that occurs earlier too, and windows of
#: a run's cut end: the partition's earliest occurrence, of several or the only one.
ALL, LATER, OPEN, ALONE = range(4)


def _resolve(run: list[tuple], least: int, cut: bool, out: _Found) -> Iterator[None]:
    """Extend the matches of a run of (left, right, place) with equal prefixes.

    A place is (id is not None, id, node, at). If the run may go on in another
    partition, its windows' earliest places are handed on as open. Equal windows
    have as many words on the left, as their first minimiser is the suffix, so
    a large run's windows are held for a few such numbers at a time. Each step
    may add to `out`, whose rows may be taken between steps.
    """
    if len(run) < 2 and not cut:
        return
    sides: dict[tuple[bytes, bytes], set] = {}
    for left, right, place in run:
        sides.setdefault((left, right), set()).add(place)
    groups = [(left, right, sorted(places)) for (left, right), places in sides.items()]
    if len(groups) == 1 and len(groups[0][2]) < 2 and not cut:
        return
    ends = [(_word_ends(left), _word_ends(right)) for left, right, _ in groups]
    again: list[list[int]] = [[] for _ in groups]
    earliest: list[set[int]] = [set() for _ in groups]
    most = max(len(lefts) for lefts, _ in ends) - 1
    step = max(1, HELD_WINDOWS // len(groups))
    for top in range(most, -1, -step):
        windows: dict[bytes, tuple[int, list[int]]] = {}
        for g, ((left, right, _), (lefts, rights)) in enumerate(zip(groups, ends, strict=True)):
            # words on the left, many to few
            for n in range(min(len(lefts) - 1, top), max(least - len(rights), top - step), -1):
                window = left[lefts[len(lefts) - 1 - n] :] + right[: rights[least - n]]
                windows.setdefault(window, (n, []))[1].append(g)
        for window, (n, members) in windows.items():
            home = min(members, key=lambda g: groups[g][2][0])
            place = groups[home][2][0]
            alone = len(members) == 1 and len(groups[home][2]) == 1
            if not alone:
                for g in members:
                    again[g].append(n)
                earliest[home].add(n)
            if cut:
                out.add(place, place[3] - n, place[3] - n + least, ALONE if alone else OPEN, hashlib.md5(window).digest())
                if len(out) >= FOUND_ROWS:
                    yield
    for (_, _, places), lefts, own in zip(groups, again, earliest, strict=True):
        lefts.sort(reverse=True)
        for i, place in enumerate(places):
            for start, end in _ranges(lefts, place[3], least):
                out.add(place, start, end, ALL)
            for start, end in _ranges(lefts if i else [n for n in lefts if n not in own], place[3], least):
                out.add(place, start, end, LATER)
            if len(out) >= FOUND_ROWS:
                yield


def _matched(contexts: DataFrame, least: int) -> DataFrame:
    """id, node, start, end, kind, hash: what the sorted suffixes' runs yield."""
    id_type = contexts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, held, first, kind, out = None, [], True, None, _Found()
        for batch in batches:
            kind = batch.schema.field("id").type
            for right, left, head, key, node, at in zip(*(batch.column(c).to_pylist() for c in ("right", "left", "head", "id", "node", "at")), strict=True):
                if right[:head] != prefix:
                    if held:
                        for _ in _resolve(held, least, first, out):
                            yield out.taken(kind)
                        first = False
                    prefix, held = right[:head], []
                held.append((left, right, (key is not None, key, node, at)))
        if held:
            for _ in _resolve(held, least, True, out):
                yield out.taken(kind)
        if len(out):
            yield out.taken(kind)

    by = ["right", "node", "at"]
    rows = contexts.repartitionByRange(*by).sortWithinPartitions(*by)
    return rows.mapInArrow(run, f"id {id_type}, node binary, start long, end long, kind int, hash binary")


def _rejoined(found: DataFrame) -> DataFrame:
    """id, node, start, end, kind of the open windows, now that all partitions' are known."""
    place = F.struct("id", "node", "start")
    rows = found.filter(F.col("kind") >= OPEN)
    known = materialise(rows.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("first")))
    rows = rows.join(small(known), "hash")
    kinds = F.array_compact(
        F.array(
            F.when((F.col("n") > 1) & (F.col("kind") == ALONE), F.lit(ALL)),
            F.when(~place.eqNullSafe(F.col("first")), F.lit(LATER)),
        )
    )
    return rows.select("id", "node", "start", "end", F.explode(kinds).alias("kind"))


def merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The ranges that ranges [start, end) cover, joined where they meet."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(starts[1:] > ends[:-1])
    return list(zip(starts[np.append(0, cut + 1)].tolist(), ends[np.append(cut, len(ends) - 1)].tolist(), strict=True))


def _spans(ranges: DataFrame) -> DataFrame:
    """id, node, spans, later: merged ranges of each kind."""
    span = F.struct("start", "end")
    lists = ranges.groupBy("id", "node").agg(*(F.collect_list(F.when(F.col("kind") == k, span)).alias(n) for k, n in ((ALL, "all"), (LATER, "after"))))
    id_type = ranges.schema["id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for name in ("all", "after"):
                spans = [merge(x.values.field("start").to_numpy(), x.values.field("end").to_numpy()) for x in batch.column(name)]
                columns.append(pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), *columns], ["id", "node", "spans", "later"])

    array = "array<struct<start:long,end:long>>"
    return lists.mapInArrow(run, f"id {id_type}, node binary, spans {array}, later {array}")


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST,
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """id, n_words, n_repeated, n_later, spans, later of every row.

    spans are the maximal word ranges [start, end) of a document all of whose
    windows of `least` words occur elsewhere too, in it or in another document;
    n_repeated counts the words in them. later and n_later are the same for
    windows that occur earlier, by id and then position: removing them leaves a
    first copy of every passage. Words are runs without white space (x20,
    x09-x0D), compared with A-Z lower-cased.

    Null, empty and short texts have no spans. Of equal texts the least id (null
    before all others) is the earliest; the others are later throughout, if they
    have `least` words. Rows that repeat an id and a text are alike. Very long
    texts are taken whole, each in the memory of one task. Other columns are
    ignored. An empty table gives an empty result.
    """
    if least < window + gram - 1:
        raise ValueError("least must be at least window + gram - 1")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("node", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    id_type = rows.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [np.diff(Words(data, offs).bounds) for _, _, data, offs in chunks(batch.column("text"))]
            n = pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), n], ["id", "node", "n_words"])

    known = materialise(rows.mapInArrow(count, f"id {id_type}, node binary, n_words long"))
    kinds = materialise(known.groupBy("node").agg(F.count("*").alias("n_copies"), F.min(F.struct("id")).alias("o")))
    several = kinds.filter("n_copies > 1").select("node", F.col("o.id").alias("least_id"), F.lit(True).alias("several"))
    marked = known.join(small(materialise(several)), "node", "left")
    is_copy = F.coalesce("several", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("least_id"))
    suffixes = materialise(_suffixes(rows, least, window, gram))
    survivors = materialise(_like_neighbours(suffixes).groupBy("node").agg(F.collect_set("at").alias("ats")))
    discard(suffixes)
    # of equal texts, which are one node, that of the least id is read
    named = survivors.join(kinds.select("node", F.col("o.id").alias("least_id")), "node").withColumnRenamed("node", "s_node")
    mine = (rows["node"] == F.col("s_node")) & rows["id"].eqNullSafe(F.col("least_id"))
    texts = rows.join(materialise(named), mine).select("id", "node", "text", "ats")
    contexts = materialise(_contexts(texts, least, window, gram))
    found = materialise(_matched(contexts, least))
    discard(survivors, contexts)
    ranges = found.filter(F.col("kind") < OPEN).drop("hash").unionByName(_rejoined(found))
    spans = _spans(ranges).select(F.col("id").alias("s_id"), F.col("node").alias("s_node"), "spans", "later")
    same = F.col("id").eqNullSafe(F.col("s_id")) & (F.col("node") == F.col("s_node"))
    out = marked.withColumn("is_copy", is_copy).join(spans, same, "left")
    none = F.array().cast("array<struct<start:long,end:long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    long = F.col("n_words") >= least
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.when(long & F.col("several"), whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(long & F.col("is_copy"), whole).otherwise(F.coalesce("later", none)).alias("later"),
    )
    return out.select(id_col, "n_words", words("spans").alias("n_repeated"), words("later").alias("n_later"), "spans", "later")
