"""Vectorised words and word-window hashes over Arrow text columns (numpy, no per-word Python).

A word's hash is no polynomial of its bytes: it starts from the length and takes in eight
bytes at a time, each time through an avalanche step, which is a bijection, so that no
family of words collides by its structure; a word of more than ``SHORT_BYTES`` bytes is
hashed by XXH3. There are two such streams of 64 bits each. A window's hash combines
those of its words. Where one hash alone would decide for all pairs of a corpus, both are
used, and ``Words.spelled`` gives the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_STEP = _U(0xD6E8FEB86659FD93)
#: Bytes that are worked on at once; bounds the temporaries, also inside a longer text.
CHUNK_BYTES = 1 << 18
#: Words that are hashed at once.
SLICE_WORDS = 1 << 16
#: Words of more bytes are hashed one by one.
SHORT_BYTES = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the public-domain splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def byte_class(separators: bytes | None = None, words: bytes | None = None) -> np.ndarray:
    """256 booleans: is the byte part of a word."""
    table = np.full(256, separators is not None)
    if separators is not None:
        table[list(separators)] = False
    else:
        table[list(words)] = True
    return table


#: Words are runs of anything but space and U+0009 to U+000D.
SPACED = byte_class(separators=b" \t\n\x0b\x0c\r")
#: Words are runs of digits, letters and everything outside ASCII.
ALNUM = byte_class(words=bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))


@lru_cache(maxsize=2)
def _fold(lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[0x41:0x5B] += 32
    return table


@dataclass
class Words:
    """The words of the documents ``first`` to ``first + len(counts) - 1`` of a column."""

    first: int
    counts: np.ndarray  # words of each document
    data: np.ndarray  # the run's bytes
    at: np.ndarray  # where each word starts in them, documents one after the other
    lengths: np.ndarray
    base: np.ndarray  # where each word's document starts in them

    @cached_property
    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        return _hash(self.data, self.at, self.lengths, 0)

    @cached_property
    def checks(self) -> np.ndarray:
        """Another 64 bits."""
        return _hash(self.data, self.at, self.lengths, 1)

    @property
    def starts(self) -> np.ndarray:
        """The byte where each word starts, in its document."""
        return self.at - self.base

    @property
    def ends(self) -> np.ndarray:
        return self.starts + self.lengths

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])

    def spelled(self, own: np.ndarray) -> pa.Array:
        """Some of the words, by their places, as bytes."""
        length = self.lengths[own]
        ends = np.cumsum(length)
        out = self.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[own] - ends + length, length)]
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(out)])

    def document(self) -> np.ndarray:
        """The document, from 0, of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def places(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each window of ``k`` words within one document: first word, document."""
        n = np.maximum(self.counts - k + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.offsets[:-1], n)
        return first, doc

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window of ``k`` words within one document: first word, document, hash of 64 bits."""
        first, doc = self.places(k)
        return first, doc, windows(self.hashes, k)[first] if len(first) else np.empty(0, np.uint64)


def _hash(data: np.ndarray, at: np.ndarray, lengths: np.ndarray, stream: int) -> np.ndarray:
    """64 bits of each word; ``data`` ends with 8 bytes that no word has."""
    out = np.empty(len(at), np.uint64)
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    for a in range(0, len(at), SLICE_WORDS):
        start, length = at[a : a + SLICE_WORDS], lengths[a : a + SLICE_WORDS]
        h = mix((length + 1).astype(np.uint64) * _STEP + _U(stream))
        own, live = slice(None), h
        for k in range(0, SHORT_BYTES, 8):
            if k:
                own = np.flatnonzero(length > k)
                if not len(own):
                    break
                live = h[own]
            block = eights[start[own] + k]
            block &= _MASKS[np.minimum(length[own] - k, 8)]
            h[own] = mix(live ^ block)
        for i in np.flatnonzero(length > SHORT_BYTES).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + length[i]], stream + 1)
        out[a : a + SLICE_WORDS] = h
    return out


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the ``k`` words from each word on; fewer than ``k`` words give none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : j + n]
    out += _U(k)
    return mix(out)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the byte offsets of its values; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def scan(column: pa.Array, is_word: np.ndarray, lower: bool = False, chunk_bytes: int | None = None) -> Iterator[Words]:
    """The words of a string column, a run of whole documents at a time."""
    if not len(column):
        return
    chunk_bytes = chunk_bytes or CHUNK_BYTES
    data, offsets = text_buffers(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1)
        last = min(last, len(column))
        yield _words(data, offsets[first : last + 1], first, is_word, lower, chunk_bytes)
        first = last


def _pieces(data: np.ndarray, begin: int, end: int, is_word: np.ndarray, chunk_bytes: int) -> list[tuple[int, int]]:
    """The bytes from begin to end, cut where no word is cut, at every ``chunk_bytes`` or the first separator beyond."""
    out = []
    while end - begin > 2 * chunk_bytes:
        cut = begin + chunk_bytes
        while cut < end:
            free = np.flatnonzero(~is_word[data[cut : cut + chunk_bytes]])
            if len(free):
                cut += int(free[0])
                break
            cut += chunk_bytes
        cut = min(cut, end)
        out.append((begin, cut))
        begin = cut
    return [*out, (begin, end)]


def _words(data: np.ndarray, offsets: np.ndarray, first: int, is_word: np.ndarray, lower: bool, chunk_bytes: int) -> Words:
    begin, end = int(offsets[0]), int(offsets[-1])
    own = np.zeros(end - begin + 8, np.uint8)
    starts, lengths = [], []
    for a, b in _pieces(data, begin, end, is_word, chunk_bytes):
        raw = data[a:b]
        own[a - begin : b - begin] = _fold(True)[raw] if lower else raw
        inside = is_word[raw]
        edge = np.empty(b - a + 1, bool)  # a word may start at i, or end before i
        edge[0] = edge[-1] = True
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a] = True
        at = np.flatnonzero(edge[:-1] & inside)
        lengths.append(np.flatnonzero(edge[1:] & inside) + 1 - at)
        starts.append(at + (a - begin))
    starts, lengths = (np.concatenate(x) if len(x) > 1 else x[0] for x in (starts, lengths))
    at = offsets - begin
    counts = np.diff(np.searchsorted(starts, at))
    return Words(first, counts, own, starts, lengths, np.repeat(at[:-1], counts))


def distinct_shingles(words: Words, k: int) -> list[np.ndarray]:
    """Of each document: the sorted hashes of its distinct ``k``-word shingles; all its words as one if it has fewer."""
    _, doc, hashes = words.windows(k)
    bounds = np.searchsorted(doc, np.arange(len(words.counts) + 1))
    at = words.offsets
    out = []
    for i, n in enumerate(words.counts):
        if n >= k:
            out.append(np.unique(hashes[bounds[i] : bounds[i + 1]]))
        elif n:
            out.append(windows(words.hashes[at[i] : at[i + 1]], int(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
