"""Vectorised word spans and word hashes over Arrow batches of texts.

A batch of texts is one byte buffer with offsets; numpy finds the words of
all its texts at once.  Buffers are taken in parts of a few MB, so memory
stays bounded by the part size or by the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PART_BYTES = 1 << 20
_U = np.uint64


def text_parts(texts: pa.Array, part_bytes: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) for runs of whole texts;
    NULL is the empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + part_bytes, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection that spreads 64-bit values (splitmix64 finaliser)."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class SpanHasher:
    """64-bit hashes of many byte spans.

    Spans of at most ``LONG`` bytes: their 8-byte blocks go one after another
    through a bijection that is not linear, which starts from the length, so
    sums of bytes that cancel make no collision.  Longer spans take BLAKE2b.
    ``key`` starts every hash differently; memos take a random one of their
    process, so that nobody can prepare texts whose words collide in them.
    """

    LONG = 64

    def __init__(self, lower: bool = False, key: int = 0):
        self.table = np.arange(256, dtype=np.uint8)
        if lower:
            self.table[65:91] += 32
        self.lower, self.key = lower, key.to_bytes(8, "little")
        self.start = mixed(np.array([key], _U))[0]

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = self.table[data] if self.lower else data
        blocks = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))  # the 8 bytes from every place on
        lengths = ends - starts
        out = mixed(lengths.astype(_U) ^ self.start)
        live = np.flatnonzero((lengths > 0) & (lengths <= self.LONG))
        done = 0
        while len(live):
            left = lengths[live] - done
            keep = _U(64) - _U(8) * np.minimum(left, 8).astype(_U)  # bits beyond the span
            out[live] = mixed(out[live] ^ mixed(blocks[starts[live] + done] << keep))
            live, done = live[left > 8], done + 8
        for i in np.flatnonzero(lengths > self.LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=8, key=self.key).digest(), "little")
        return out


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each text and in all): words are runs of
    anything but ASCII white space, and end where their text ends."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def spread(pool: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of pool[begin : begin + length] over all pairs."""
    lengths = lengths.astype(np.int64)
    before = np.cumsum(lengths) - lengths
    return pool[np.repeat(begins - before, lengths) + np.arange(int(lengths.sum()))]


class SortedMemo:
    """Values of 64-bit keys in sorted arrays: a large level and a small one
    that is merged into it now and then, so that adding a few keys to many is
    cheap.  Memory per key is that of the arrays."""

    def __init__(self, *kinds):
        self.kinds = kinds
        self.clear()

    def clear(self) -> None:
        self.levels = [[np.zeros(0, _U), *(np.zeros(0, k) for k in self.kinds)] for _ in range(2)]

    def __len__(self) -> int:
        return sum(len(level[0]) for level in self.levels)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(whether known, the values of each kind)."""
        known, out = np.zeros(len(keys), bool), [np.zeros(len(keys), k) for k in self.kinds]
        for own, *values in self.levels:
            if len(own):
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                hit = own[at] == keys
                known |= hit
                for o, v in zip(out, values):
                    o[hit] = v[at[hit]]
        return known, out

    def add(self, keys: np.ndarray, *values: np.ndarray) -> None:
        """Adds keys that are not known yet."""
        self.levels[1] = self._merged(self.levels[1], [keys, *values])
        if len(self.levels[1][0]) > max(1 << 15, len(self.levels[0][0]) // 8):
            self.levels = [self._merged(*self.levels), [x[:0] for x in self.levels[1]]]

    @staticmethod
    def _merged(one: list[np.ndarray], two: list[np.ndarray]) -> list[np.ndarray]:
        keys = np.concatenate([one[0], two[0]])
        order = np.argsort(keys, kind="stable")
        return [keys[order], *(np.concatenate([a, b.astype(a.dtype)])[order] for a, b in zip(one[1:], two[1:]))]


class PieceMemo:
    """Ids of text pieces by the pieces' 64-bit hashes.

    Grows to ``most`` pieces and then starts afresh; lives as long as the
    caller keeps it (one task, or one Python worker)."""

    def __init__(self, most: int = 1_000_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.memo, self.used, self.pool = SortedMemo(np.int64, np.int32), 0, np.zeros(1 << 16, np.uint32)

    def ids(self, hashes: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, ids per piece).  ``encode`` gets the
        places of pieces not yet known, one for each, and returns their
        (ids, ids per piece)."""
        keys, place, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.memo) > self.most:
            self.clear()
        known, (begins, lengths) = self.memo.find(keys)
        new = ~known
        if new.any():
            got, sizes = encode(place[new])
            if self.used + len(got) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(got), len(self.pool) // 2), np.uint32)])
            self.pool[self.used : self.used + len(got)] = got
            begins[new], lengths[new] = np.cumsum(sizes) - sizes + self.used, sizes
            self.used += len(got)
            self.memo.add(keys[new], begins[new], lengths[new])
        begins, lengths = begins[back], lengths[back]
        return spread(self.pool, begins, lengths), lengths
