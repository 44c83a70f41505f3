"""Best-fit packing into sequences of several permitted lengths.

The variable-cost, variable-size bin packing problem, by adapted best-fit
decreasing (Crainic, Perboli, Rei and Tadei, 2011): items by falling length,
each into the open bin that it leaves fullest; where none has room, a bin of
the least-cost size is opened; at the end every bin is downsized to the least
permitted length that still holds its contents. Two readings of "least cost"
(per word, and outright among the sizes that hold the item) are both tried,
and the one whose bins cost less after downsizing is taken.

Documents are dealt by a hash of id, length and stored row number (so that rows
without an id, or repeated ones, spread) into buckets of some two thousand, each packed by
itself in one task: the number of buckets grows with the input, their size does
not, and what the cut costs is a few part-filled bins in several hundred.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm._store import materialise
from skerry.llm._text import Words, chunks

CAPACITIES = (512, 1024, 2048, 4096)
BUCKET = 2048


def best_fit(lengths: list[int], sizes: list[int], costs: list[float]) -> tuple[list[int], list[int], list[int]]:
    """Bin of each item, its offset there, and each bin's size. Items fall in length."""
    best: tuple[float, list[int], list[int], list[int]] | None = None
    by_word = min(range(len(sizes)), key=lambda i: (costs[i] / sizes[i], -sizes[i]))
    for outright in (False, True):
        room: list[tuple[int, int]] = []  # (words left, bin), sorted
        bins, offsets, used, opened = [], [], [], []
        for n in lengths:
            at = bisect_left(room, (n, -1))
            if at < len(room):
                left, b = room.pop(at)
            else:
                fitting = [i for i in range(len(sizes)) if sizes[i] >= n]
                pick = by_word
                if outright or sizes[by_word] < n:
                    key = (lambda i: (costs[i], sizes[i])) if outright else (lambda i: (costs[i] / sizes[i], -sizes[i]))
                    pick = min(fitting, key=key)
                left, b = sizes[pick], len(used)
                used.append(0)
                opened.append(sizes[pick])
            bins.append(b)
            offsets.append(used[b])
            used[b] += n
            if left > n:
                insort(room, (left - n, b))
        cheapest = [min((c, s) for s, c in zip(sizes, costs, strict=True) if s >= u) for u in used]
        total = sum(c for c, _ in cheapest)
        if best is None or total < best[0]:
            best = (total, bins, offsets, [s for _, s in cheapest])
    return best[1:] if best else ([], [], [])


def word_counts(docs: DataFrame) -> DataFrame:
    """id, n_words, row of rows (id, text); row tells repeated rows apart once stored."""
    id_type = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.diff(Words(data, offs).bounds) for _, _, data, offs in chunks(batch.column("text"))]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64())], ["id", "n_words"])

    return docs.mapInArrow(run, f"id {id_type}, n_words long").withColumn("row", F.monotonically_increasing_id())


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacities: tuple[int, ...] = CAPACITIES,
    costs: dict[int, float] | None = None,
    bucket: int = BUCKET,
) -> DataFrame:
    """A row for each piece of a document and the sequence that it is packed into.

    Returns id, piece, start (the document's word at which it begins), length
    (words, and one for the end mark after a document's last), sequence_id,
    capacity (the sequence's length after downsizing), position (of the piece in
    it). A document that exceeds the largest capacity is cut into full pieces,
    sequences of their own, and a rest. costs: of a sequence of each capacity;
    its length if not given.

    Null, empty and blank texts have no words: they get one row whose piece,
    start, sequence, capacity and position are null and whose length is 0. Null
    ids and repeated rows are packed like any others; ties in length go by id.
    Other columns are ignored. An empty table gives an empty result.
    """
    sizes = sorted(set(capacities))
    if not sizes or sizes[0] < 1:
        raise ValueError("capacities must be positive")
    prices = [float((costs or {}).get(s, s)) for s in sizes]
    id_type = docs.schema[id_col].dataType.simpleString()
    counted = materialise(word_counts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))))
    n_buckets = max(1, -(-counted.count() // bucket))
    largest = sizes[-1]

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "n_words", "row"], kind="stable")
        home = int(pdf["bucket"].iloc[0])
        full, rests, rows = 0, [], []
        for i, (key, n) in enumerate(zip(pdf["id"], pdf["n_words"].tolist(), strict=True)):
            if not n:
                rows.append((key, None, None, 0, None, None, None))
                continue
            whole, rest = divmod(n + 1, largest)
            for p in range(whole):
                rows.append((key, p, p * largest, largest, f"{home}-f{full}", largest, 0))
                full += 1
            if rest:
                rests.append((-rest, i, key, whole))
        rests.sort(key=lambda r: r[:2])
        bins, offsets, opened = best_fit([-r[0] for r in rests], sizes, prices)
        for (n, _, key, p), b, at in zip(rests, bins, offsets, strict=True):
            rows.append((key, p, p * largest, -n, f"{home}-b{b}", opened[b], at))
        out = pd.DataFrame(rows, columns=["id", "piece", "start", "length", "sequence_id", "capacity", "position"], dtype=object)
        return out.astype({c: "Int64" for c in ("piece", "start", "length", "capacity", "position")})

    schema = f"id {id_type}, piece long, start long, length long, sequence_id string, capacity long, position long"
    dealt = counted.withColumn("bucket", F.pmod(F.xxhash64("id", "n_words", "row"), F.lit(n_buckets)))
    return dealt.groupBy("bucket").applyInPandas(place, schema).withColumnRenamed("id", id_col)
