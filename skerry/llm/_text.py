"""Vectorised word hashing for text operators that run in Python workers.

A batch of texts is one byte buffer. Words, shingles and windows are found and
hashed with array operations over the whole buffer, so the cost is a few
nanoseconds a byte whatever the number and length of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text worked on at once; one longer text is taken alone.
CHUNK = 1 << 20

#: x20 and x09-x0D divide words; bytes of 0x80 and more belong to words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            up, down = np.full(size, _BASE), np.full(size, _INV)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each values[start:end], the same wherever it stands."""
    up, down = _POWERS.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * down[starts]
    return mix(found + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of some texts: byte spans, hashes, and each text's word range."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> None:
        inside = ~IS_SPACE[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets[:-1]] = True
        edge[n] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.hashes = span_hash(LOWER[data] if lower else data, self.starts, self.ends)
        self.bounds = np.searchsorted(self.starts, offsets)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and offsets of an Arrow string array; null is ''."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[:1]
    return np.frombuffer(data, np.uint8, offs[-1] - offs[0], offs[0]), offs - offs[0]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) for runs of texts of about `size` bytes."""
    if not len(texts):
        return
    data, offs = buffers(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + size, "right")) - 1)
        last = min(last, len(texts))
        yield first, last, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
        first = last


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingle hashes, sorted.

    A text of fewer words has one shingle, its whole sequence; without words, none.
    """
    n = len(hashes)
    acc = np.zeros(max(n - k + 1, 0), np.uint64)
    for i in range(k):
        acc = acc * np.uint64(0xD1342543DE82EF95) + hashes[i : i + len(acc)]
    acc = mix(acc)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            v = np.sort(acc[a : b - k + 1])
            keep = np.empty(len(v), bool)
            keep[0] = True
            np.not_equal(v[1:], v[:-1], out=keep[1:])
            out.append(v[keep])
        elif b > a:
            out.append(span_hash(hashes[a:b], np.array([0]), np.array([b - a])))
        else:
            out.append(hashes[:0])
    return out


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    done, out = 1, values
    while done * 2 <= width:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
