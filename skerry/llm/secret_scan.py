"""Secret scanning: key patterns, and a token-efficiency test for random strings.

Text that a byte-pair vocabulary was built on compresses to some four
characters a token; random strings have no long entries in the vocabulary and
fall to two or fewer. Runs of key-like characters with such a low ratio are
reported, after digests of known lengths and identifiers are set aside.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm._text import LOWER, chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
PART = re.compile(r"[^/_=+-]+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_DIGESTS = {32, 40, 48, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NAME = re.compile(r"[A-Za-z]?[a-z]{0,18}|[A-Z]{1,19}|[0-9]{1,8}")
_IS_HEX, _IS_RUN = np.zeros(256, bool), np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_IS_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the pattern kinds, in code points, by start and kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def is_identifier(run: str) -> bool:
    """Whether a run is a digest of known length, a UUID, of few characters, or made of words and short numbers."""
    if len(run) in _DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run) or _UUID.fullmatch(run):
        return True
    if len(set(run)) < 8:
        return True
    # names: every part is a word (one case after its first letter, under 20 letters) or a number of few digits
    return all(map(_NAME.fullmatch, re.split(r"[/_=+-]", run)))


def stretches(run: str) -> list[tuple[int, int]]:
    """Start and end of what lies between a run's words of four letters or more."""
    out: list[tuple[int, int]] = []
    joined = False
    for m in PART.finditer(run):
        word = len(m[0]) >= 4 and _NAME.fullmatch(m[0]) and m[0].isalpha()
        if not word:
            out.append((out.pop()[0] if joined else m.start(), m.end()))
        joined = not word
    return out


class Scanner:
    """Scans texts with one vocabulary."""

    def __init__(self, vocabulary: bytes, ratio: float, least: int) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ratio, self.least = ratio, least

    def random_spans(self, text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Runs, or parts of them, of few characters a token that no pattern span overlaps; `taken` is sorted by start."""

        starts = [s for _, s, _ in taken]
        reach = list(accumulate((e for _, _, e in taken), max))  # the furthest end so far

        def free(a: int, b: int) -> bool:
            n = bisect_left(starts, b)
            return not n or reach[n - 1] <= a

        out = []
        for m in RUN.finditer(text):
            start, end = m.span()
            if end - start < self.least or is_identifier(m[0]):
                continue
            if free(start, end) and self.is_low(m[0]):
                out.append(("random", start, end))
                continue
            # words in front of a key or behind it hide it in the ratio of the whole
            for a, b in stretches(m[0]):
                parts = [(p.start() + a, p.end() + a) for p in PART.finditer(m[0][a:b])]
                for s, e in [(a, b)] if free(start + a, start + b) and self.is_secret(m[0][a:b]) else parts:
                    if free(start + s, start + e) and self.is_secret(m[0][s:e]):
                        out.append(("random", start + s, start + e))
        return out

    def is_low(self, run: str) -> bool:
        return len(run) < self.ratio * len(self.encode(run))

    def is_secret(self, run: str) -> bool:
        return len(run) >= self.least and not is_identifier(run) and self.is_low(run)

    def scan(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Pattern spans, and all spans."""
        base = base_spans(text)
        more = self.random_spans(text, base)
        return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))

    def suspects(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Indices of texts that may hold a span: a cheap pass over raw bytes."""
        low, raw, at = LOWER[data].tobytes(), data.tobytes(), []
        for where, words in ((low, _WORDS), (raw, (b"AKIA",))):
            for word in words:
                i = where.find(word)
                while i >= 0:
                    at.append(i)
                    i = where.find(word, i + 1)
        for kind, least in ((_IS_HEX, 24), (_IS_RUN, self.least)):
            out = np.flatnonzero(~kind[data])
            ends = np.append(out, len(data))
            starts = np.append(-1, out) + 1
            for s, e in zip(starts[ends - starts >= least].tolist(), ends[ends - starts >= least].tolist(), strict=True):
                # a run may go on over the end of a text into the next ones
                first, last = np.searchsorted(offs, [s, e - 1], "right") - 1
                at += [s, *offs[first + 1 : last + 1].tolist()]
        return np.unique(np.searchsorted(offs, np.unique(np.array(at, np.int64)), "right") - 1)


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | bytes = VOCABULARY,
    ratio: float = 2.1,
    least: int = 20,
) -> DataFrame:
    """id, spans (array of kind, start, end in code points, by start) of every row.

    Kinds: assign, access and hex are patterns; random are runs of at least
    `least` key-like characters with fewer than `ratio` characters a token that
    overlap no pattern span, or else such parts of a run between its separators
    or its words. Whole texts are scanned.

    Null and empty texts have no spans. Very long ones are scanned whole, each in
    the memory of one task. Null ids and repeated rows are kept and scanned each;
    other columns are ignored. An empty table gives an empty result.

    vocabulary: a tiktoken rank file or its bytes; it is read once, by the
    driver, and sent to the executors (under 1 MB).
    """
    if isinstance(vocabulary, str):
        with open(vocabulary, "rb") as f:
            vocabulary = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, ratio, least)
        for batch in batches:
            texts, found = batch.column("text"), [[]] * batch.num_rows
            for first, _, data, offs in chunks(texts):
                for i in scanner.suspects(data, offs).tolist():
                    spans = scanner.scan(data[offs[i] : offs[i + 1]].tobytes().decode())[1]
                    found[first + i] = [{"kind": k, "start": s, "end": e} for k, s, e in spans]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, span)], ["id", "spans"])

    schema = f"id {id_type}, spans array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of each pattern kind, the SHA-256 of their spans, and all spans as text."""
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return scanned.select(
        id_col,
        *(count(k) for k in KINDS[:3]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("random"),
    )


__all__ = ["Scanner", "base_spans", "digest", "scan_secrets"]
