"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

Equal shingle sets form a class, found by one map-side combined aggregation, so a
group of exact copies is one node from there on. SuperMinHash gives each class a
signature: every shingle deals out the ranks 0 to m-1 over the m slots by a random
permutation, and a slot keeps the smallest rank plus fraction that it was dealt. Rank
levels are taken one at a time, and a document stops at the first level that can no
longer lower a slot (early stopping). Signatures are banded. In each bucket only stars
are tried: a class against the smallest class of a bucket, verified on full shingle
sets. Union-find first contracts links within partitions, then star contraction joins
the forests. What stars can't settle are buckets whose members still lie in different
components. Families of classes that such buckets connect are cut into small blocks; a
task takes two blocks, compares the signatures of classes of different components, and
verifies the likely ones until union-find has joined them, so all pairs of a bucket are
decided, no pair leaves a task but a verified link, and a large family is
many tasks.

What can be missed: with 32 bands of 4 slots a pair at the threshold of 0.75 shares no
bucket with probability (1 - 0.75^4)^32, about 5e-6, and falls below the share ``LIKELY``
with about 1e-7; a pair of higher similarity less often. Links are confirmed on full sets of
64-bit hashes of shingles, where two different shingles of two compared sets of n coincide
with probability n^2 / 2^64; classes are told apart by 128 bits and their size.

Defined results: null and empty texts have no shingles and link with nothing; texts of
fewer than five words are one shingle; rows that repeat a doc_id are each judged by
their own text, and a link of any of them is a link of that doc_id's node; rows with a null doc_id are never linked, have a null component and are kept; other columns
pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.llm import _words
from skeinflow.llm._shared import materialise

SHINGLE = 5
#: Links have a Jaccard similarity of at least NUMERATOR / 100.
NUMERATOR = 75
SLOTS = 128
BAND = 4
#: Classes of a block, two of which a task compares.
BLOCK = 128
#: Share of equal slots from which two classes are verified: at a similarity of 0.75 the
#: share is lower with a probability of about 1e-7.
LIKELY = 0.55

_U = np.uint64


def superminhash(shingles: np.ndarray, document: np.ndarray, n_documents: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (n_documents x slots); documents without shingles have infinite slots. slots: a power of two."""
    out = np.full(n_documents * slots, np.inf)

    def drawn(own: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        x = _words.mix(own + _U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return (level + (x & _U(0xFFFFFFFF)) % _U(slots - level)).astype(np.int64), (x >> _U(32)).astype(np.float64) * 2.0**-32

    own, doc = shingles, document
    k0, fraction = drawn(own, 0)
    np.minimum.at(out, doc * slots + k0, fraction)
    for level in range(1, slots):
        open_ = (out.reshape(-1, slots).max(axis=1) > level)[doc]
        if not open_.all():
            own, doc = own[open_], doc[open_]
        if not len(own):
            break
        if level == 1:
            k0 = drawn(own, 0)[0]
            k, fraction = drawn(own, 1)
            slot = np.where(k == k0, 0, k)
        else:
            if level == 2:
                permutation = np.broadcast_to(np.arange(slots, dtype=np.uint16), (len(own), slots)).copy()
                for before in range(2):
                    _swap(permutation, before, drawn(own, before)[0])
            elif not open_.all():
                permutation = permutation[open_]
            k, fraction = drawn(own, level)
            slot = _swap(permutation, level, k)
        np.minimum.at(out, doc * slots + slot, level + fraction)
    return out.reshape(-1, slots)


def _swap(permutation: np.ndarray, level: int, k: np.ndarray) -> np.ndarray:
    """One Fisher-Yates step of each row; the ranks' slots."""
    rows = np.arange(len(permutation))
    dealt = permutation[rows, k]
    permutation[rows, k] = permutation[:, level]
    permutation[:, level] = dealt
    return dealt.astype(np.int64)


def band_keys(signatures: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), -1, band)
    out = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64), bits.shape[:2]).copy()
    for j in range(band):
        out = _words.mix(out * _U(0xD6E8FEB86659FD93) + bits[:, :, j])
    return out


_SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for words in _words.scan(batch.column(1), _words.SPACED, lower=True):
            sets = _words.distinct_shingles(words, SHINGLE)
            sizes = np.array([len(s) for s in sets])
            flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            document = np.repeat(np.arange(len(sets)), sizes)
            keys = band_keys(superminhash(flat, document, len(sets)))
            both = []
            for salt in (1, 2):
                folded = np.zeros(len(sets), np.uint64)
                np.add.at(folded, document, _words.mix(flat ^ _U(salt)))
                both.append(_words.mix(folded + sizes.astype(np.uint64)).view(np.int64))
            counts = np.where(sizes > 0, keys.shape[1], 0)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[sizes > 0].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(words.first, len(sets)), pa.array(sizes), pa.array(both[0]), pa.array(both[1]), bands], names=_SIGNED.names)


_TESTED = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("linked", T.BooleanType())])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = []
        for column in (2, 3):
            sides.append([s for w in _words.scan(batch.column(column), _words.SPACED, lower=True) for s in _words.distinct_shingles(w, SHINGLE)])
        linked = [_similar(x, y) for x, y in zip(*sides, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=_TESTED.names)


def _settle(table: pa.Table) -> pa.Table:
    """The links that join components, among the classes of two blocks (columns node, label, text, first, second)."""
    nodes, labels = table.column("node").to_pylist(), table.column("label").to_pylist()
    side = table.column("side").to_numpy()
    texts = table.column("text").combine_chunks()
    texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else texts.chunk(0).cast(pa.large_string())
    sets = [s for w in _words.scan(texts, _words.SPACED, lower=True) for s in _words.distinct_shingles(w, SHINGLE)]
    signatures = superminhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets)).view(np.uint64).astype(np.uint32)
    known = np.unique(labels, return_inverse=True)[1]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    likely = []
    for i in left:
        own = right[known[right] != known[i]]
        if right is left:
            own = own[own > i]
        equal = (signatures[own] == signatures[i]).mean(axis=1)
        keep = equal >= LIKELY
        likely += zip((-equal[keep]).tolist(), [int(i)] * int(keep.sum()), own[keep].tolist(), strict=True)
    parent = list(range(len(known)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for _, i, j in sorted(likely):
        a, b = root(known[i]), root(known[j])
        if a != b and _similar(sets[i], sets[j]):
            parent[max(a, b)] = min(a, b)
            links.append((max(nodes[i], nodes[j]), min(nodes[i], nodes[j])))
    return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64()), pa.array([True] * len(links), pa.bool_())], names=_TESTED.names)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < NUMERATOR * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= NUMERATOR * (len(x) + len(y) - both)


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning star forest of each batch's edges: every node to its smallest."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up] if up in parent else up
                x = up
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = [x for x in parent if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b); component: the smallest node reachable.

    Union-find within partitions, then alternating large and small stars until stable.
    Groups are aggregated to their minimum and joined back, so a hub never has to fit one task.
    """
    edges = edges.select("a", "b").mapInArrow(_union_find, "a long, b long")
    edges = materialise(edges.distinct())
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        new = small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        new = materialise(new.where("a <> b").distinct())
        seen = [x.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first() for x in (edges, new)]
        edges = new
        if seen[0] == seen[1]:
            break
    node = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return node.union(edges.select("b", "b").distinct())


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """members (key, node) with the component that the links give."""
    return members.join(components(links), "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))


def _open(members: DataFrame) -> DataFrame:
    """The buckets that hold more than one component."""
    keys = members.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
    return members.join(keys, "key", "left_semi")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    texts = docs.select("doc_id", "text")
    signed = materialise(texts.mapInArrow(_sign, _SIGNED))
    able = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(able.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("node")))
    nodes = able.join(classes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    buckets = nodes.select(F.explode("bands").alias("key"), F.col("doc_id").alias("node"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre <> last")
    members = materialise(buckets.join(shared.select("key", "centre"), "key").distinct())
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    sources = materialise(texts.join(wanted, "doc_id", "left_semi"))

    def test(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) on full shingle sets."""
        left = sources.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        right = sources.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return materialise(joined.mapInArrow(_verify, _TESTED))

    def settle(still: DataFrame) -> DataFrame:
        """All links between the components that meet in open buckets."""
        centres = still.groupBy("key").agg(F.min("node").alias("b"))
        edges = still.join(centres, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
        family = components(edges).withColumnRenamed("component", "family")
        sized = family.join(family.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "family")
        sized = sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        open_ = still.select("node", "label").distinct().join(sized, "node").join(sources.withColumnRenamed("doc_id", "node"), "node")
        own = F.col("block")
        dealt = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("node", "label", "text", "family", F.least(own, "other").alias("first"), F.greatest(own, "other").alias("second"), (own > F.col("other")).cast("int").alias("side"))
        return dealt.groupBy("family", "first", "second").applyInArrow(_settle, _TESTED)

    first = members.where("node <> centre").groupBy("node").agg(F.min("centre").alias("b")).select(F.col("node").alias("a"), "b")
    tested = test(first)
    still = materialise(_open(_labelled(members.select("key", "node"), tested.where("linked"))))
    if not still.isEmpty():
        at = still.groupBy("key").agg(F.min(F.struct("node", "label")).alias("c"))
        pairs = still.join(at, "key").where("label <> c.label").select(F.greatest("node", "c.node").alias("a"), F.least("node", "c.node").alias("b"))
        tested = tested.union(test(pairs.distinct().join(tested, ["a", "b"], "left_anti")))
        still = materialise(_open(_labelled(still.select("key", "node"), tested.where("linked"))))
    if not still.isEmpty():
        tested = tested.union(materialise(settle(still)))
    found = components(tested.where("linked"))
    by_class = classes.join(found, "node", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    alone = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = able.join(by_class, ["set_a", "set_b", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    return alone.union(linked).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents of which their component keeps one; rows that repeat it (doc_id) stay together."""
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
