"""Benchmark decontamination with an FM-index per training shard.

Each shard (one Arrow batch of documents) is reduced, without loss, to the stretches
that can hold a test phrase: runs of words that all occur in the phrases, at least as
long as the shortest phrase. Over those word sequences an FM-index is built: suffix
array by prefix doubling, Burrows-Wheeler transform, a wavelet tree of bit vectors
with rank directories, and suffix positions sampled by text position. All phrases are
searched backwards together; occurrences are located by walking the LF mapping to a
sampled position; the spans that they cover are merged per document.

Words are compared by their bytes; hashes only sort out words that no phrase has.

The phrases are broadcast in blocks of at most ``block_bytes`` (a documented bound):
a larger benchmark takes several passes, each of which adds to the spans found; between
passes the documents are written, so a task holds one block.
Nothing is shuffled, so hot sources or groups of copies cannot meet in one task, and
a lost executor costs only its own tasks.

Defined results: null or empty texts have no words, no hits; null item texts give no
phrase; repeated documents and items are each judged alone; an empty benchmark hits
nothing; further columns of the documents, whatever their names, pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.llm import _words
from skeinflow.llm._shared import materialise, unused

WINDOW = 13
BLOCK_BYTES = 16 << 20
SAMPLE_RATE = 8


class WaveletTree:
    """Ranks of symbols in a sequence: one bit vector with a rank directory per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.size = len(symbols)
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.zeros: list[int] = []
        self.ranks: list[np.ndarray] = []
        self.levels: list[np.ndarray] = []
        for level in range(self.bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            ones = np.zeros(self.size + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(bit)
            self.ranks.append(ones)
            self.zeros.append(self.size - int(ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _down(self, level: int, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = self.ranks[level][at]
        return np.where(ones, self.zeros[level] + r, at - r)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low = np.zeros_like(at)
        for level in range(self.bits):
            ones = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            low, at = self._down(level, ones, low), self._down(level, ones, at)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before it."""
        symbol, low = np.zeros_like(at), np.zeros_like(at)
        for level in range(self.bits):
            ones = self.levels[level][at]
            symbol = symbol * 2 + ones
            low, at = self._down(level, ones, low), self._down(level, ones, at)
        return symbol, at - low


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be the smallest and occur once."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = new
        width *= 2
        if n < 2 or rank[order[-1]] == n - 1 or width > 2 * n:
            return order


class FMIndex:
    """Self-index of a sequence of symbols 1.. (0 is the end mark, added here)."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample_rate: int = SAMPLE_RATE) -> None:
        text = np.append(symbols.astype(np.int64), 0)
        self.size = len(text)
        suffixes = suffix_array(text)
        self.bwt = WaveletTree(text[suffixes - 1], alphabet)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.sampled = suffixes % sample_rate == 0
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = suffixes[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each phrase (rows of equal length), by backward search."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, j]
            low[live] = self.before[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.bwt.rank(symbol, high[live])
            live = live[low[live] < high[live]]
        found = np.zeros(len(phrases), bool)
        found[live] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffix rows: LF steps to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            symbol, rank = self.bwt.access(rows[walking])
            rows[walking] = self.before[symbol] + rank
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.samples[self.sample_rank[rows]] + steps


class Phrases:
    """A block of test items: their windows as rows of word ids, by length."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int) -> None:
        column = pa.array([t for _, t in items], pa.string())
        self.ids = [i for i, _ in items]
        spelled, hashes, owner, rows = [], [], [], {}
        for words in _words.scan(column, _words.ALNUM, lower=True):
            spelled.append(words.spelled(np.arange(len(words.at))))
            hashes.append(words.hashes)
            owner.append(words.document() + words.first)
        owner = np.concatenate(owner) if owner else np.empty(0, np.int64)
        #: The words of the phrases; a word's id is its place, from 1.
        self.vocabulary = pc.unique(pa.chunked_array(spelled, pa.large_binary()))
        self.hashes = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
        word_id = np.concatenate([pc.index_in(x, self.vocabulary).to_numpy(zero_copy_only=False) for x in spelled]).astype(np.int64) + 1 if spelled else owner
        bounds = np.searchsorted(owner, np.arange(len(items) + 1))
        for i in range(len(items)):
            own = word_id[bounds[i] : bounds[i + 1]]
            k = min(window, len(own))
            if k:
                got = rows.setdefault(k, ([], []))
                got[0].append(np.lib.stride_tricks.sliding_window_view(own, k))
                got[1].append(np.full(len(own) - k + 1, i))
        self.by_length = {k: self._distinct(np.concatenate(p), np.concatenate(o)) for k, (p, o) in rows.items()}
        self.shortest = min(self.by_length, default=0)

    @staticmethod
    def _distinct(phrases: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct phrases, and the items of phrase p as items[bounds[p]:bounds[p + 1]]."""
        distinct, of = np.unique(phrases, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([of.ravel(), items], axis=1), axis=0)
        return distinct, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))

    def lookup(self, words: _words.Words, own: np.ndarray) -> np.ndarray:
        """Ids, from 1, of some words by their bytes; 0 for a word that no phrase has."""
        out = np.zeros(len(own), np.int64)
        hashes = words.hashes[own]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        likely = np.flatnonzero(self.hashes[at] == hashes)
        out[likely] = pc.fill_null(pc.index_in(words.spelled(own[likely]), self.vocabulary), -1).to_numpy(zero_copy_only=False) + 1
        return out

    @cached_property
    def prefilter(self) -> np.ndarray:
        """2^20 booleans by the low bits of a hash: may a phrase have this word."""
        table = np.zeros(1 << 20, bool)
        table[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return table


_built: list[tuple[object, int, Phrases]] = []


def built(items: list[tuple[int | None, str | None]], window: int) -> Phrases:
    """The phrases of a broadcast block, made once a worker; the last two stay."""
    for own, k, phrases in _built:
        if own is items and k == window:
            return phrases
    _built.append((items, window, Phrases(items, window)))
    del _built[:-2]
    return _built[-1][2]


def _stretches(present: np.ndarray, document: np.ndarray, least: int) -> np.ndarray:
    """Marks the words in runs of present words of one document, ``least`` words long or longer."""
    if not len(present):
        return present
    change = np.flatnonzero((present[1:] != present[:-1]) | (document[1:] != document[:-1])) + 1
    edges = np.concatenate([[0], change, [len(present)]])
    length = np.diff(edges)
    return np.repeat((length >= least) & present[edges[:-1]], length)


def search_shard(texts: pa.Array, phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int, int, int]]], list[set[int]]]:
    """Of each text: its words, its hit spans (first word, end word, first byte, end byte), the items found."""
    n_words, spans = [0] * len(texts), [[] for _ in range(len(texts))]
    found: list[set[int]] = [set() for _ in range(len(texts))]
    prefilter = phrases.prefilter if phrases.shortest else None
    kept = []
    for words in _words.scan(texts, _words.ALNUM, lower=True):
        n_words[words.first : words.first + len(words.counts)] = words.counts.tolist()
        if prefilter is None or not len(words.hashes):
            continue
        document = words.document()
        mark = _stretches(prefilter[(words.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)], document, phrases.shortest)
        own = np.flatnonzero(mark)
        ids = np.zeros(len(mark), np.int64)
        ids[own] = phrases.lookup(words, own)
        own = np.flatnonzero(_stretches(ids > 0, document, phrases.shortest))
        if len(own):
            position = own - words.offsets[document[own]]
            kept.append((ids[own], document[own] + words.first, position, words.starts[own], words.ends[own]))
    if not kept:
        return n_words, spans, found
    ids, document, position, start, end = (np.concatenate(x) for x in zip(*kept, strict=True))
    gap = np.flatnonzero((document[1:] != document[:-1]) | (position[1:] != position[:-1] + 1)) + 1
    separator = len(phrases.vocabulary) + 1
    text = np.insert(ids, gap, separator)
    source = np.insert(np.arange(len(ids)), gap, -1)
    index = FMIndex(text, separator + 1)
    for k, (rows, items, bounds) in phrases.by_length.items():
        low, high = index.search(rows)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        count = high[hit] - low[hit]
        phrase = np.repeat(hit, count)
        row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[hit], count)
        first = source[index.locate(row)]
        pairs = np.unique(np.stack([document[first], phrase], axis=1), axis=0)
        for d, p in pairs.tolist():
            found[d].update(items[bounds[p] : bounds[p + 1]].tolist())
        for f in np.unique(first).tolist():
            spans[document[f]].append((int(position[f]), int(position[f]) + k, int(start[f]), int(end[f + k - 1])))
    return n_words, [merge_spans(s) for s in spans], found


def merge_spans(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Overlapping or touching word spans become one."""
    out: list[tuple[int, int, int, int]] = []
    for span in sorted(spans):
        if out and span[0] <= out[-1][1]:
            last = out.pop()
            span = (last[0], max(last[1], span[1]), last[2], max(last[3], span[3]))
        out.append(tuple(span))
    return out


_SPAN = pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "end_word", "first_byte", "end_byte")]))
_SPAN_TYPE = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first_word", "end_word", "first_byte", "end_byte")]))


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, in blocks of ``block_bytes`` (more only where one item is larger)."""
    block, size = [], 0
    for row in benchmark.where(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += 4 * len(row[1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, items (item_ids, sorted as strings), spans (word and byte bounds) and contaminated.

    A document is contaminated if it has a hit word and at least one in twenty of its words is hit.
    """
    words, hit, items, spans, flag = unused(docs, "n_words", "n_hit", "items", "spans", "contaminated")
    schema = T.StructType([*docs.schema.fields, T.StructField(words, T.LongType()), T.StructField(spans, _SPAN_TYPE), T.StructField(items, T.ArrayType(T.StringType()))])
    context = docs.sparkSession.sparkContext
    n_own = len(docs.columns)
    text_at = docs.columns.index("text")

    def pass_over(shared, more: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = built(shared.value, window)
            for batch in batches:
                n_words, own, found = search_shard(batch.column(text_at), phrases)
                names = [sorted({str(phrases.ids[i]) for i in f if phrases.ids[i] is not None}) for f in found]
                if more:
                    before = batch.column(n_own + 1).to_pylist()
                    own = [merge_spans([*s, *(tuple(x.values()) for x in b)]) for s, b in zip(own, before, strict=True)]
                    names = [sorted({*f, *b}) for f, b in zip(names, batch.column(n_own + 2).to_pylist(), strict=True)]
                own = [[dict(zip(("first_word", "end_word", "first_byte", "end_byte"), s, strict=True)) for s in x] for x in own]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:n_own], pa.array(n_words, pa.int64()), pa.array(own, _SPAN), pa.array(names, pa.list_(pa.string()))],
                    names=schema.names,
                )

        return run

    out = docs
    for i, block in enumerate(_blocks(benchmark, block_bytes)):
        out = (materialise(out) if i else out).mapInArrow(pass_over(context.broadcast(block), i > 0), schema)
    if out is docs:
        out = docs.mapInArrow(pass_over(context.broadcast([]), False), schema)
    n_hit = F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda a, s: a + s["end_word"] - s["first_word"])
    out = out.withColumn(hit, n_hit)
    return out.withColumn(flag, (F.col(hit) > 0) & (20 * F.col(hit) >= F.col(words)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    found = find_contamination(docs, benchmark, **options)
    return found.where(~F.col(found.columns[-1])).select(*(f"`{c}`" for c in docs.columns))


def items_digest(items: F.Column) -> F.Column:
    """Lowercase hex SHA-256 of the item_ids, comma-joined."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def reference(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """Brute force, for tests: doc_id, n_words, n_hit, items_sha256, contaminated."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    phrases: dict[tuple, set] = {}
    for item, text in items:
        own = split(text)
        k = min(window, len(own))
        for i in range(len(own) - k + 1 if k else 0):
            phrases.setdefault(tuple(own[i : i + k]), set()).add(str(item))
    lengths = {len(p) for p in phrases}
    out = []
    for doc, text in docs:
        own, hit, found = split(text), set(), set()
        for k in lengths:
            for i in range(len(own) - k + 1):
                if got := phrases.get(tuple(own[i : i + k])):
                    hit.update(range(i, i + k))
                    found |= got
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own)))
    return out
