"""Quality rules: plain text statistics, and a likelihood ratio of hashed n-grams.

The base counts symbols, repeated lines and repeated words. The method compares two
multinomials over hashed words and word pairs: one of trusted text (documents that
``labels`` marks as good), one of the whole corpus. The mean log ratio of a document's
n-grams says whether it reads like trusted text; below a fixed threshold it is rejected.

Corpus counts cover every document and every good label, and are combined on the map
side. Words and pairs have buckets of their own, whose numbers are powers of the corpus'
size, as by Heaps' law the distinct words are; pairs have fewer than there are distinct ones,
so that a task's counts stay smaller than its text. The counts are a written table. One
pass makes base and score: it reads the ratios from one array of floats while there are no more than ``DENSE_BUCKETS`` (4 bytes each, on the driver
and in every executor); beyond, frequent buckets (of which there are at most
``_shared.BROADCAST_ROWS``) are broadcast, n-grams of the others are joined by a shuffle,
and sums by hash of the text return to the documents by a broadcast while they number
at most ``_shared.BROADCAST_ROWS``, and by a shuffle beyond.

Defined results: null and empty texts have no words and fail the base (fewer than ten
words); without trusted documents the method rejects none; repeated rows are judged
alike and count as often as they occur; further columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm._shared import BLANKS, BROADCAST_ROWS, let, materialise, small, unused, words_of

#: Buckets of words and of pairs: factor and power of the n-grams of the corpus, rounded to a power of two of at least STRETCH.
WORD_BUCKETS = (4, 0.65)
PAIR_BUCKETS = (8, 0.5)
#: Buckets up to which the ratios are one array (4 bytes each) in the scoring pass.
DENSE_BUCKETS = 1 << 26
#: Good labels up to which their ids are broadcast.
TRUSTED_ROWS = 8_000_000
#: The array of ratios consists of stretches of so many buckets.
STRETCH_BITS = 12
STRETCH = 1 << STRETCH_BITS
#: Mean log likelihood ratio below which a document is rejected.
THRESHOLD = -0.3
#: Characters that count as symbols; fixed values.
SYMBOLS = "#*$%&|<>"
WINDOW = 5


class Buckets:
    """So many buckets of words, then so many of pairs of words; powers of two of at least STRETCH."""

    def __init__(self, words: int, pairs: int) -> None:
        self.words, self.pairs, self.size = words, pairs, words + pairs
        self.kind = "int" if self.size <= 1 << 31 else "bigint"

    def word(self, x: F.Column) -> F.Column:
        """The bucket of a word, from its hash."""
        return x.bitwiseAND(F.lit(self.words - 1)).cast(self.kind)

    def pair(self, x: F.Column) -> F.Column:
        """The bucket of a pair, from its hash."""
        return (x.bitwiseAND(F.lit(self.pairs - 1)) + F.lit(self.words)).cast(self.kind)


def word_hashes(words: F.Column) -> F.Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def pair_hashes(hashes: F.Column) -> F.Column:
    """Of each two neighbours in an array of the words' hashes."""
    n = F.size(hashes)
    return F.when(n > 1, F.zip_with(F.slice(hashes, F.lit(1), n - 1), F.slice(hashes, F.lit(2), n - 1), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))


def _repeated_words(hashes: F.Column) -> F.Column:
    """Words in windows that occur twice or more, from a hash of each window; n log n in the windows of a text."""

    def covered(placed):
        at = lambda k: F.get(placed, k)["h"]
        twice = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), lambda k: F.coalesce(at(k) == at(k - 1), F.lit(False)) | F.coalesce(at(k) == at(k + 1), F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda k: F.get(placed, k)["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
            lambda a, s: F.struct((a["n"] + s + WINDOW - F.greatest(a["end"], s)).cast("bigint").alias("n"), (s + WINDOW).alias("end")),
            lambda a: a["n"],
        )

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(placed, covered)).otherwise(F.lit(0).cast("bigint"))


def statistics(text: F.Column, score=None) -> F.Column:
    """The base counts of a text in one struct, its words being split and hashed once; with ``score`` of the hashes, if given."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")

    def of(w):
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(word_hashes(w), lambda h: let(pair_hashes(h), lambda p: of_hashes(h, p))).alias("of_hashes"),
        )

    def of_hashes(h, p):
        n = F.size(h)
        # five words from two pairs and a word
        starts = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.get(p, i), F.get(p, i + 2), F.get(h, i + 4)))
        repeated = let(F.when(n >= WINDOW, starts).otherwise(F.array().cast("array<bigint>")), _repeated_words)
        return F.struct(repeated.alias("n_repeat_words"), (score(h, p) if score else F.lit(None).cast("double")).alias("score"))

    return let(words_of(text), of)


def bucket_count(docs: DataFrame) -> Buckets:
    """From the bytes of the corpus, of which an n-gram has about three: a word of six makes one word and one pair."""
    grams = (docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0) / 3
    power = lambda factor, to: max(STRETCH, 1 << round(math.log2(max(1, factor * grams**to))))
    return Buckets(power(*WORD_BUCKETS), power(*PAIR_BUCKETS))


def _grams(docs: DataFrame, buckets: Buckets, kept: F.Column, name: str) -> DataFrame:
    """``kept`` as ``name`` and the bucket of each n-gram of each document.

    Words come out as strings, each with the next one, and are hashed after that, in compiled code.
    """
    words = docs.select(kept.alias(name), words_of("text").alias("w"))
    # the last word has no next one; a null next to it
    pairs = words.select(name, F.inline(F.arrays_zip(F.col("w").alias("x"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("y"))))
    hashed = pairs.select(name, F.xxhash64("x").alias("x"), F.when(F.col("y").isNotNull(), F.xxhash64("y")).alias("y"))
    both = F.array(buckets.word(F.col("x")), F.when(F.col("y").isNotNull(), buckets.pair(F.xxhash64("x", "y"))))
    return hashed.select(name, F.explode(both).alias("bucket")).where("bucket is not null")


def bucket_counts(docs: DataFrame, labels: DataFrame, buckets: Buckets) -> DataFrame:
    """(bucket, n, good): n-grams of the corpus and of all its trusted documents, written."""
    good = materialise(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct())
    marked = docs.select("doc_id", "text").join(small(good, most=TRUSTED_ROWS), F.col("doc_id") == F.col("good_id"), "left")
    grams = _grams(marked, buckets, F.col("good_id").isNotNull().cast("long"), "good")
    return materialise(grams.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("good").alias("good")))


def _ratio(n: F.Column, good: F.Column, totals: tuple[int, int], buckets: Buckets) -> F.Column:
    """The log ratio of a bucket's share of trusted text to its share of the corpus, add-one smoothed; 0 without trusted text."""
    if not totals[1]:
        return F.lit(0.0)
    return F.log((good + 1) / F.lit(float(totals[1] + buckets.size))) - F.log((n + 1) / F.lit(float(totals[0] + buckets.size)))


def _totals(counts: DataFrame) -> tuple[int, int]:
    n, good = counts.agg(F.sum("n"), F.sum("good")).first()
    return n or 0, good or 0


def _dense(counts: DataFrame, totals: tuple[int, int], buckets: Buckets) -> DataFrame:
    """One row, written: the ratios of all buckets as an array of stretches of floats."""
    nothing = _ratio(F.lit(0), F.lit(0), totals, buckets).cast("float")
    entry = F.struct((F.col("bucket") % STRETCH).cast("int").alias("at"), _ratio(F.col("n"), F.col("good"), totals, buckets).cast("float").alias("ratio"))
    parts = counts.groupBy(F.shiftright("bucket", STRETCH_BITS).cast("bigint").alias("stretch")).agg(F.sort_array(F.collect_list(entry)).alias("own"))

    def filled(own):
        gap = lambda x, i: x["at"] - F.coalesce(F.get(own, i - 1)["at"], F.lit(-1)) - 1
        found = F.flatten(F.transform(own, lambda x, i: F.concat(F.array_repeat(nothing, gap(x, i)), F.array(x["ratio"]))))
        return let(found, lambda f: F.concat(f, F.array_repeat(nothing, F.lit(STRETCH) - F.size(f))))

    parts = parts.select("stretch", let(F.col("own"), filled).alias("part"))
    every = counts.sparkSession.range(buckets.size >> STRETCH_BITS).select(F.col("id").alias("stretch")).join(parts, "stretch", "left")
    placed = F.struct("stretch", F.coalesce("part", F.array_repeat(nothing, STRETCH)).alias("part"))
    return materialise(every.agg(F.sort_array(F.collect_list(placed)).alias("all")).select(F.col("all.part").alias("ratios")))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: Buckets) -> list[float]:
    """The log ratio of each bucket, on the driver; for few buckets."""
    counts = bucket_counts(docs, labels, buckets)
    return [x for part in _dense(counts, _totals(counts), buckets).first()[0] for x in part]


def _mean_ratio(ratios: F.Column, buckets: Buckets):
    """From the hashes of a text's words to the mean ratio of its n-grams, which are made and looked up one by one; null without words.

    ``ratios`` is referred to once, so that its array, a subquery's value, is not copied into rows.
    """

    def total(h, p, own):
        ratio = lambda b: F.get(F.get(own, F.shiftright(b, STRETCH_BITS)), b.bitwiseAND(F.lit(STRETCH - 1))).cast("double")
        words = F.aggregate(h, F.lit(0.0), lambda a, x: a + ratio(buckets.word(x)))
        return F.aggregate(p, words, lambda a, x: a + ratio(buckets.pair(x)))

    return lambda h, p: F.when(F.size(h) > 0, let(ratios, lambda own: total(h, p, own)) / (2 * F.size(h) - 1))


def _joined_scores(docs: DataFrame, counts: DataFrame, totals: tuple[int, int], buckets: Buckets) -> DataFrame:
    """(text_hash, score) of texts that have words, written; for more buckets than one array holds."""
    grams = _grams(docs, buckets, F.xxhash64("text"), "text_hash")
    # no more than BROADCAST_ROWS buckets have such a share of all n-grams
    often = F.col("n") * BROADCAST_ROWS >= totals[0]
    ratios = counts.select("bucket", _ratio(F.col("n"), F.col("good"), totals, buckets).alias("ratio"), often.alias("often"))
    frequent = F.broadcast(ratios.where("often").drop("often"))
    rare = grams.join(frequent, "bucket", "left_anti").join(ratios.where("not often").drop("often"), "bucket")
    found = grams.join(frequent, "bucket").select("text_hash", "ratio").union(rare.select("text_hash", "ratio"))
    return materialise(found.groupBy("text_hash").agg(F.avg("ratio").alias("score")))


def judge(docs: DataFrame, labels: DataFrame, buckets: Buckets | None = None, threshold: float = THRESHOLD, dense: int = DENSE_BUCKETS) -> DataFrame:
    """``docs`` and a struct quality: the base counts, base_failed, score (mean log ratio) and kept."""
    quality, hashed, joined, ratios = unused(docs, "quality", "text_hash", "score", "ratios")
    text = F.coalesce("text", F.lit(""))
    buckets = buckets or bucket_count(docs)
    counts = bucket_counts(docs, labels, buckets)
    totals = _totals(counts)
    q = lambda c: F.col(f"`{quality}`.{c}")
    if buckets.size <= dense:
        # the array is read once and travels with the tasks
        out = docs.withColumn(ratios, _dense(counts, totals, buckets).scalar())
        out = out.withColumn(quality, statistics(text, _mean_ratio(F.col(ratios), buckets)))
        score = q("of_hashes.score")
    else:
        found = _joined_scores(docs, counts, totals, buckets).toDF(hashed, joined)
        out = docs.withColumn(quality, statistics(text)).join(small(found), F.xxhash64(docs["text"]) == F.col(hashed), "left")
        score = F.col(joined)
    own = F.coalesce(score, F.lit(0.0))
    repeats = q("of_hashes.n_repeat_words")
    failed = (q("n_words") < 10) | (100 * repeats > 20 * q("n_words"))
    told = [*(q(c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")), repeats.alias("n_repeat_words"), own.alias("score")]
    return out.select(*(f"`{c}`" for c in docs.columns), F.struct(*told, failed.alias("base_failed"), (~failed & (own >= threshold)).alias("kept")).alias(quality))


def drop_low_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns."""
    found = judge(docs, labels, **options)
    # a filter would be pushed below the judgement and make it anew for each part of its condition; a generator is not
    kept = F.filter(F.array(F.col(f"`{found.columns[-1]}`.kept")), lambda k: k)
    (mark,) = unused(docs, "mark")
    return found.select(*(f"`{c}`" for c in docs.columns), F.explode(kept).alias(mark)).select(*(f"`{c}`" for c in docs.columns))


def reference(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """Brute force of the base, for tests: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    found = Counter(tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1))
    covered = {j for i in range(len(words) - WINDOW + 1) if found[tuple(words[i : i + WINDOW])] > 1 for j in range(i, i + WINDOW)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered), failed


def score_reference(docs: list[tuple[int | None, str | None]], good: set[int], buckets: Buckets) -> list[float]:
    """Brute force of the scores, for tests; word and pair hashes are XXH64 with seed 42, a pair's second word seeded by the first."""
    import xxhash

    def grams(text: str | None) -> list[int]:
        words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        of = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
        return [x % buckets.words for x in words] + [buckets.words + of(y, of(x, 42)) % buckets.pairs for x, y in zip(words, words[1:], strict=False)]

    own = [grams(t) for _, t in docs]
    n = Counter(g for x in own for g in x)
    trusted = Counter(g for (i, _), x in zip(docs, own, strict=True) if i in good for g in x)
    totals = sum(n.values()), sum(trusted.values())
    ratio = lambda g: math.log((trusted[g] + 1) / (totals[1] + buckets.size)) - math.log((n[g] + 1) / (totals[0] + buckets.size))
    return [sum(map(ratio, x)) / len(x) if x and totals[1] else 0.0 for x in own]
