"""Substring dedup: a Count-min prefilter, then exact grouping of the windows it leaves.

Documents are dealt into blocks of some MB of text. Each block counts its
windows of 13 words (once per document) in a Count-min sketch whose width follows the
corpus, and sends it sparsely: the cells that it touched, sorted, as gaps of a byte or
two, split into shards of the cell range. Shards merge the sketches and tell each block
which of its own cells reached a count of two. As cells only overestimate, a window
that two documents share always stays; the second pass sends hash, smallest and largest
doc_id of the windows left, grouped exactly by hash shard, and each block learns which of
its windows start in a document with a smaller doc_id than one of its own. One entry per
block and window is the most that is sent, so a passage in a third of all documents is
pre-aggregated before any shuffle, and no task or driver holds more than a shard or a
block. A task works on its blocks one after the other; its memory follows the block, or a
single text that is longer (about 25 bytes a window of it). Sketch and answers take a few
bytes a window while a block touches many cells of a shard (to some TB of text at these
sizes); beyond, rows of single cells, some 30 bytes each.

The sketch works on 64-bit hashes, where a coincidence only means that a window is looked
at again. The exact pass tells windows apart by 104 bits of two hashes.

Defined results: null and empty texts have no words; documents of fewer than 13 words
lose nothing; rows that repeat a doc_id are not smaller than each other; rows with a
null doc_id lose nothing and take nothing from others; doc_id is cast to long, and one
that is no integer counts as null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm import _words

WINDOW = 13
#: Rows (hash functions) of the sketch.
ROWS = 2
#: Bytes of the second hash that tells windows apart.
CHECK_BYTES = 5
_CHECK = np.uint64((1 << 8 * CHECK_BYTES) - 1)
#: Text of a block, in bytes: bounds a Python worker's memory.
BLOCK_BYTES = 8 << 20
#: Blocks that a task works on, one after the other, beyond as many tasks as the session shuffles to.
BLOCKS_A_TASK = 32
#: Cells, touched by blocks, that a shard of the sketch merges, about.
SHARD_ENTRIES = 1 << 20
#: Windows that a shard of the exact pass groups, at most about.
SHARD_WINDOWS = 1 << 19

_U = np.uint64
_NONE = np.iinfo(np.int64).min


def encode(values: np.ndarray) -> bytes:
    """Non-negative integers as variable-length bytes, 7 bits each."""
    values = values.astype(np.uint64)
    if not len(values):
        return b""
    length = np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >> _U(7 * k) > 0
        if not more.any():
            break
        length += more
    ends = np.cumsum(length)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - length
    for k in range(int(length.max()) if len(length) else 0):
        own = length > k
        low = (values[own] >> _U(7 * k)) & _U(127)
        out[starts[own] + k] = low.astype(np.uint8) | ((length[own] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def decode(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    last = raw < 128
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    parts = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, starts)


def encode_ids(values: np.ndarray) -> bytes:
    """Integers of either sign: the sign goes last, so that small ones stay short."""
    return encode(((values << 1) ^ (values >> 63)).view(np.uint64))


def decode_ids(data: bytes) -> np.ndarray:
    raw = decode(data)
    return (raw >> _U(1)).view(np.int64) ^ -(raw & _U(1)).view(np.int64)


def encode_sorted(values: np.ndarray) -> bytes:
    return encode(np.diff(values, prepend=_U(0)))


def decode_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(decode(data), dtype=np.uint64)


def encode_checks(values: np.ndarray) -> bytes:
    """The low CHECK_BYTES bytes of each value."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :CHECK_BYTES]).tobytes()


def decode_checks(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // CHECK_BYTES, 8), np.uint8)
    out[:, :CHECK_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, CHECK_BYTES)
    return out.view(np.uint64).ravel()


class Plan:
    """Widths and shards for a corpus of so many windows and bytes; all powers of two."""

    def __init__(self, windows: int, size: int, window: int, block_bytes: int, shard_entries: int, shard_windows: int) -> None:
        power = lambda x: 1 << max(0, int(x - 1)).bit_length()
        self.window = window
        self.width_bits = max(16, int(2 * windows).bit_length())
        self.blocks = max(1, -(-size // block_bytes))
        self.sketch_bits = min(self.width_bits, power(max(1, -(-windows // shard_entries))).bit_length() - 1)
        self.hash_bits = power(max(1, -(-windows // shard_windows))).bit_length() - 1

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        return _words.mix(hashes ^ _U(0xA5A5A5A5 + row)) >> _U(64 - self.width_bits)


def _runs(texts: pa.Array, ids: np.ndarray, window: int) -> Iterator[tuple[_words.Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Run by run: its words; first word, hash and doc_id of each window of rows with a doc_id."""
    for words in _words.scan(texts, _words.SPACED):
        first, doc, hashes = words.windows(window)
        owner = ids[words.first + doc]
        own = owner != _NONE
        yield (words, first, hashes, owner) if own.all() else (words, first[own], hashes[own], owner[own])


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NONE).to_numpy(zero_copy_only=False).astype(np.int64)


def _whole(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted arrays."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = keys[0][1:] != keys[0][:-1]
    for key in keys[1:]:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _sketch(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        hashes, owners = [], []
        for _, _, own, owner in _runs(_whole(table, "text"), _ids(_whole(table, "doc_id")), plan.window):
            hashes.append(own)
            owners.append(owner)
        hashes, owners = _joined(hashes, np.uint64), _joined(owners, np.int64)
        order = np.argsort(hashes)
        hashes, owners = hashes[order], owners[order]
        first = _starts(hashes)
        twice = np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first) if len(first) else np.empty(0, bool)
        hashes = hashes[first]
        del owners, order
        out = []
        for row in range(ROWS):
            cells = plan.cells(hashes, row)
            order = np.argsort(cells)
            cells, more = cells[order], twice[order]
            first = _starts(cells)
            if not len(first):
                continue
            more = np.logical_or.reduceat(more, first) | (np.diff(np.append(first, len(cells))) > 1)
            cells = cells[first]
            shard = (cells >> _U(plan.width_bits - plan.sketch_bits)).astype(np.int64)
            bounds = np.searchsorted(shard, np.arange((1 << plan.sketch_bits) + 1))
            for s in np.flatnonzero(np.diff(bounds)):
                a, b = bounds[s], bounds[s + 1]
                start = _U(int(s) << (plan.width_bits - plan.sketch_bits))
                gaps = np.diff(cells[a:b], prepend=start)
                out.append((row, int(s), block, encode(gaps * _U(2) + more[a:b])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["row", "shard", "block", "cells"])

    return run


def _merge_sketches(table: pa.Table) -> pa.Table:
    """The cells of a shard that count two or more, for each block that touched them."""
    row, shard = table.column("row")[0], table.column("shard")[0]
    blocks = table.column("block").to_pylist()
    values = [decode(x) for x in table.column("cells").to_pylist()]
    cells = [np.cumsum(v >> _U(1)) for v in values]
    both = np.concatenate(cells)
    distinct, at, counts = np.unique(both, return_inverse=True, return_counts=True)
    hot = counts > 1
    np.logical_or.at(hot, at, np.concatenate(values) & _U(1) > 0)
    out, begin = [], 0
    for own in cells:
        mine = own[hot[at[begin : begin + len(own)]]]
        begin += len(own)
        out.append(encode(np.diff(mine, prepend=_U(0))))
    n = len(blocks)
    return pa.table([pa.array([row.as_py()] * n, pa.int32()), pa.array([shard.as_py()] * n, pa.int64()), pa.array(blocks, pa.int64()), pa.array(out, pa.binary())], names=["row", "shard", "block", "cells"])


_SENT = "part long, block long, hashes binary, checks binary, low binary, more binary"
_SENT_NAMES, _SENT_KINDS = ["part", "block", "hashes", "checks", "low", "more"], (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def _estimated(plan: Plan):
    """The windows of a block whose cells all count two or more: hash, smallest and largest doc_id, by hash shard."""

    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if docs.num_rows and flags.num_rows:
            hot = []
            for row in range(ROWS):
                own = [(s, c) for r, s, c in zip(flags.column("row").to_pylist(), flags.column("shard").to_pylist(), flags.column("cells").to_pylist(), strict=True) if r == row]
                hot.append(_Set(_joined([np.cumsum(decode(c)) + (_U(s << (plan.width_bits - plan.sketch_bits)) if s else _U(0)) for s, c in sorted(own)], np.uint64)))
            found = []
            for words, first, hashes, owner in _runs(_whole(docs, "text"), _ids(_whole(docs, "doc_id")), plan.window):
                keep = np.arange(len(hashes))
                for row in range(ROWS):
                    keep = keep[hot[row].has(plan.cells(hashes[keep], row))]
                if len(keep):
                    found.append((hashes[keep], _words.windows(words.checks, plan.window)[first[keep]] & _CHECK, owner[keep]))
            if found:
                hashes, checks, owner = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((checks, hashes))
                hashes, checks, owner = hashes[order], checks[order], owner[order]
                first = _starts(hashes, checks)
                hashes, checks, low = hashes[first], checks[first], np.minimum.reduceat(owner, first)
                more = np.maximum.reduceat(owner, first) - low
                part = (hashes >> _U(64 - plan.hash_bits)).astype(np.int64) if plan.hash_bits else np.zeros(len(first), np.int64)
                bounds = np.searchsorted(part, np.arange((1 << plan.hash_bits) + 1))
                block = docs.column("block")[0].as_py()
                for p in np.flatnonzero(np.diff(bounds)):
                    a, b = bounds[p], bounds[p + 1]
                    out.append((int(p), block, encode_sorted(hashes[a:b]), encode_checks(checks[a:b]), encode_ids(low[a:b]), encode(more[a:b])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, _SENT_KINDS, strict=True)], names=_SENT_NAMES)

    return run


class _Set:
    """Is a value in a sorted array; most are not, so a bit table goes first."""

    def __init__(self, found: np.ndarray) -> None:
        self.found = found
        self.mask = _U((1 << min(24, max(10, int(len(found)).bit_length() + 3))) - 1)
        self.table = np.zeros(int(self.mask) + 1, bool)
        self.table[(found & self.mask).astype(np.int64)] = True

    def places(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which values are there, and the first place of each."""
        if not len(self.found):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.table[(values & self.mask).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.found, values[maybe]), len(self.found) - 1)
        is_in = self.found[at] == values[maybe]
        return maybe[is_in], at[is_in]

    def has(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), bool)
        out[self.places(values)[0]] = True
        return out


def _group_exactly(table: pa.Table) -> pa.Table:
    """Of a hash shard, to each block: its windows of which a doc_id is larger than the smallest of all, and that doc_id."""
    blocks = table.column("block").to_pylist()
    own = lambda name, read: [read(x) for x in table.column(name).to_pylist()]
    sizes = [len(x) // CHECK_BYTES for x in table.column("checks").to_pylist()]
    hashes, checks = np.concatenate(own("hashes", decode_sorted)), np.concatenate(own("checks", decode_checks))
    low = np.concatenate(own("low", decode_ids))
    high = low + np.concatenate(own("more", decode)).view(np.int64)
    order = np.lexsort((checks, hashes))
    first = _starts(hashes[order], checks[order])
    smallest = np.empty(len(hashes), np.int64)
    smallest[order] = np.repeat(np.minimum.reduceat(low[order], first), np.diff(np.append(first, len(order))))
    gone = smallest < high
    out, begin = [], 0
    for block, n in zip(blocks, sizes, strict=True):
        mine = begin + np.flatnonzero(gone[begin : begin + n])
        begin += n
        if len(mine):
            out.append((block, encode_sorted(hashes[mine]), encode_checks(checks[mine]), encode_ids(smallest[mine])))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "hashes", "checks", "least"])


def _remove(plan: Plan):
    def run(docs: pa.Table, minima: pa.Table) -> pa.Table:
        names, kinds = ["doc_id", "n_words", "n_removed", "kept_text"], (pa.int64(), pa.int64(), pa.int64(), pa.string())
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        texts, ids = _whole(docs, "text"), _ids(_whole(docs, "doc_id"))
        own = lambda name, read, kind: _joined([read(x) for x in minima.column(name).to_pylist()], kind)
        known, check, least = own("hashes", decode_sorted, np.uint64), own("checks", decode_checks, np.uint64), own("least", decode_ids, np.int64)
        order = np.lexsort((check, known))
        known, check, least = _Set(known[order]), check[order], least[order]
        n_words, n_removed, kept = [], [], []
        for words, first, hashes, owner in _runs(texts, ids, plan.window):
            hit, at = known.places(hashes)
            if len(hit):
                own = _words.windows(words.checks, plan.window)[first[hit]] & _CHECK
                while len(late := np.flatnonzero(check[at] < own)):  # the next of equal first halves, if there is one
                    late = late[at[late] + 1 < len(check)]
                    late = late[known.found[at[late] + 1] == hashes[hit[late]]]
                    if not len(late):
                        break
                    at[late] += 1
                hit = hit[(check[at] == own) & (least[at] < owner[hit])]
            edge = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(edge, first[hit], 1)
            np.add.at(edge, first[hit] + plan.window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            offsets = words.offsets
            removed = total[offsets[1:]] - total[offsets[:-1]]
            n_words += words.counts.tolist()
            n_removed += removed.tolist()
            for i, text in enumerate(texts.slice(words.first, len(words.counts)).to_pylist()):
                own_words = (text or "").encode("utf-8", "surrogatepass").split()
                if removed[i]:
                    own_words = [own_words[j] for j in np.flatnonzero(~gone[offsets[i] : offsets[i + 1]])]
                kept.append(b" ".join(own_words))
        kept = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table([docs.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), kept], names=names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_entries: int = SHARD_ENTRIES, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_text (the words left, joined by one space).

    A word goes if a window of ``window`` words over it also starts in a document with a smaller doc_id.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text")
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    # a word takes two bytes at least; six and a half are usual, and the width only needs the order of magnitude
    plan = Plan(max(1, (size or 0) // 6), max(size or 0, n or 0), window, block_bytes, shard_entries, shard_windows)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(plan.blocks)))
    parts = max(-(-plan.blocks // BLOCKS_A_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = dealt.repartition(parts, "block")
    sketches = blocks.groupBy("block").applyInArrow(_sketch(plan), "row int, shard long, block long, cells binary")
    flags = sketches.groupBy("row", "shard").applyInArrow(_merge_sketches, "row int, shard long, block long, cells binary")
    left = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_estimated(plan), _SENT)
    minima = left.groupBy("part").applyInArrow(_group_exactly, "block long, hashes binary, checks binary, least binary")
    return blocks.groupBy("block").cogroup(minima.groupBy("block")).applyInArrow(_remove(plan), "doc_id long, n_words long, n_removed long, kept_text string")


def reference(docs: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """Brute force, for tests: doc_id, n_words, n_removed, kept_text."""
    import re

    own = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    least: dict[tuple, int] = {}
    for i, words in own:
        for k in range(len(words) - window + 1 if i is not None else 0):
            w = tuple(words[k : k + window])
            least[w] = min(least.get(w, i), i)
    out = []
    for i, words in own:
        gone = set()
        for k in range(len(words) - window + 1 if i is not None else 0):
            if least[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out
