"""Line dedup: equal lines, and lines within one word's edit, give way to the earliest.

The edit distance counts words (insertions, deletions, substitutions of one): lines of
eight or more words are duplicates at a distance of at most 1, shorter ones only if
equal, and lines without a word are left alone. Words are what lies between the
contracts' separators. Equal lines meet in one aggregation on their hash. The others meet by deletion neighbourhoods: every line
emits the hash of itself and of every variant with one word deleted; equal variants
mean a distance of at most 2, and exact comparison of the words verifies. A variant's
hash is made of the sums of its word trigrams' hashes, changed in a few terms for each
deleted word, so a line of n words takes time in proportion to n; as sums, terms that
occur twice do not cancel. Within a variant only the earliest line is a partner, never
all pairs. A line is known by two 64-bit hashes.

Lossless prefilter: one edit leaves the first or the last half of a line as it is, so
only lines that share a half with another line emit variants.

Only hashes and positions are shuffled. Hashes of halves and variants that meet another
line's, texts of candidate lines and the removals are joined by a broadcast while rows and
positions number at most ``_shared.BROADCAST_ROWS``, and by a shuffle beyond.

Defined results: the order is doc_id, then a hash of the text, then the line's position;
judged on the input. Null or empty texts lose nothing. Rows with equal doc_id and text
are one document. Rows of null doc_id lose nothing and take nothing from others. Lines
are compared without blanks (space, tab, CR) at their ends. Further columns pass through.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm._shared import SEPARATORS, let, materialise, small, unused

#: Lines of so many words or more may differ by one.
EDIT_WORDS = 8


def _norm(line: F.Column) -> F.Column:
    return F.trim(line, F.lit(" \t\r"))


def _spaced(norm: F.Column) -> F.Column:
    """The words of a line with one space between them."""
    return F.when(norm.rlike(r"[\x09-\x0D]|  "), F.trim(F.regexp_replace(norm, f"[{SEPARATORS}]+", " "))).otherwise(norm)


def _words(spaced: F.Column) -> F.Column:
    return F.split(spaced, " ")


def _worded(lines: DataFrame) -> DataFrame:
    """``lines`` with words, n_words: split at single spaces where a line has no other separators, and no two together, as almost all.

    As columns, not in a lambda, so that all of it is compiled.
    """
    plain = lines.withColumn("plain", _words(F.col("norm")))
    odd = F.array_contains("plain", F.lit("")) | F.col("norm").rlike(r"[\x09-\x0D]")
    return plain.withColumn("words", F.when(odd, _words(_spaced(F.col("norm")))).otherwise(F.col("plain"))).drop("plain").withColumn("n_words", F.size("words"))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, line, norm) of every line that has a word; line: the first of its two hashes."""
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    own = own.select("doc_id", "text_hash", "pos", _norm(F.col("raw")).alias("norm")).where(F.trim("norm", F.lit(" \t\x0b\x0c\r")) != "")
    return own.withColumn("line", F.xxhash64("norm", F.octet_length("norm")))


def _check() -> F.Column:
    """The other hash of a line."""
    return F.xxhash64(F.octet_length("norm"), "norm").alias("check")


def half_keys(w: F.Column, n: F.Column) -> F.Column:
    """Of n words: hashes of the first and of the last m, m being the halves of n and n - 1."""
    first = lambda m: F.xxhash64(F.lit(1), F.slice(w, F.lit(1), m))
    last = lambda m: F.xxhash64(F.lit(2), F.slice(w, n - m + 1, m))
    half, less = F.shiftright(n, 1), F.shiftright(n - 1, 1)
    return F.when(half == less, F.array(first(half), last(half))).otherwise(F.array(first(half), last(half), first(less), last(less)))


def neighbourhood(lines: DataFrame) -> DataFrame:
    """lines (line, check, spaced) to (line, check, key, deleted): deleted is the deleted word's index, -1 for the line itself."""
    hashes = F.transform(_words(F.col("spaced")), lambda w: F.xxhash64(w))
    padded = lines.select("line", "check", F.concat(F.array(F.lit(-1).cast("long"), F.lit(-1).cast("long")), hashes, F.array(F.lit(-2).cast("long"), F.lit(-2).cast("long"))).alias("p"))
    at = lambda i: F.col("p")[i]
    grams = padded.withColumn("g", F.transform(F.sequence(F.lit(0), F.size("p") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))))
    low, high = (lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda x: F.shiftrightunsigned(x, 32))
    total = lambda half: F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + half(x))
    whole = grams.withColumns({"l": total(low), "h": total(high)})
    g = lambda i: F.col("g")[i]
    n = F.size("p") - 4

    def without(i):
        ends = F.array(F.xxhash64(at(i), at(i + 1), at(i + 3)), F.xxhash64(at(i + 1), at(i + 3), at(i + 4)))
        less = lambda c, half: lambda e: F.col(c) - half(g(i)) - half(g(i + 1)) - half(g(i + 2)) + half(e[0]) + half(e[1])
        key = let(ends, lambda e: F.xxhash64(less("l", low)(e), less("h", high)(e), n - 1))
        return F.struct(key.alias("key"), i.alias("deleted"))

    itself = F.array(F.struct(F.xxhash64("l", "h", n).alias("key"), F.lit(-1).alias("deleted")))
    return whole.select("line", "check", F.inline(F.concat(itself, F.transform(F.sequence(F.lit(0), n - 1), without))))


def within_one(a: F.Column, b: F.Column) -> F.Column:
    """Is the edit distance of two arrays of words at most 1; exact."""
    n, m = F.size(a), F.size(b)
    least = F.least(n, m)
    same = F.zip_with(F.slice(a, F.lit(1), least), F.slice(b, F.lit(1), least), lambda x, y: x == y)
    first = F.array_position(same, False)
    p = F.when(first == 0, least).otherwise(first - 1).cast("int")  # equal words at the front
    rest = lambda x, skip: F.slice(x, p + skip + 1, F.size(x))
    return F.when(n == m, rest(a, 1) == rest(b, 1)).when(n == m + 1, rest(a, 1) == rest(b, 0)).when(m == n + 1, rest(a, 0) == rest(b, 1)).otherwise(False)


def repeated_lines(docs: DataFrame, edit_words: int = EDIT_WORDS) -> DataFrame:
    """(doc_id, text_hash, removed): the positions of each document's lines that go, ascending."""
    lines = _lines(docs)
    place = F.struct("doc_id", "text_hash", "pos").alias("place")
    keys = F.when(F.col("n_words") >= edit_words, half_keys(F.col("words"), F.col("n_words"))).alias("keys")
    both = ["line", "check"]
    occurrences = materialise(_worded(lines).select(place, "line", _check(), keys))
    distinct = materialise(occurrences.groupBy(*both).agg(F.min("place").alias("first"), F.count("*").alias("n")))
    # a half that two different lines share; one hash is enough where lines are only sorted out
    halves = occurrences.where("keys is not null").select("line", F.explode("keys").alias("key"))
    shared = materialise(halves.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).where("a <> b").select("key"))
    able = materialise(halves.join(small(shared), "key", "left_semi").select("line").distinct())
    texts = lines.select("line", "norm").join(small(able), "line", "left_semi").select("line", _check(), _spaced(F.col("norm")).alias("spaced"))
    texts = materialise(texts.dropDuplicates(both))
    firsts = distinct.join(able, "line", "left_semi").select(*both, "first")
    variants = materialise(neighbourhood(texts).join(firsts, both))
    # most variants meet nothing: those are sorted out before places are compared
    itself, cut = variants.where("deleted = -1"), variants.where("deleted >= 0")
    twice = materialise(cut.groupBy("key", "deleted").agg(F.count("*").alias("n")).where("n > 1").select("key", "deleted"))
    replaced = materialise(cut.join(small(twice), ["key", "deleted"], "left_semi"))
    met = materialise(cut.join(small(itself.select("key")), "key", "left_semi"))
    least = lambda df, *by: df.groupBy(*by).agg(F.min(F.struct("first", *both)).alias("other"))
    substituted = replaced.join(least(replaced, "key", "deleted"), ["key", "deleted"])
    longer = met.join(least(itself.join(met.select("key"), "key", "left_semi"), "key"), "key")
    shorter = itself.join(least(met, "key"), "key")
    others = (F.col("other.line").alias("other_line"), F.col("other.check").alias("other_check"))
    pairs = [x.where("other.first < first").select(*both, *others) for x in (substituted, longer, shorter)]
    pairs = pairs[0].union(pairs[1]).union(pairs[2]).distinct()
    ours, theirs = texts.withColumnRenamed("spaced", "a"), texts.select(F.col("line").alias("other_line"), F.col("check").alias("other_check"), F.col("spaced").alias("b"))
    near = pairs.join(ours, both).join(theirs, ["other_line", "other_check"]).where(within_one(_words(F.col("a")), _words(F.col("b")))).select(*both).distinct()
    near = materialise(near).withColumn("near", F.lit(True))
    judged = distinct.join(near, both, "left").where("n > 1 or near").select(*both, "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = occurrences.select(*both, "place").join(judged, both).where("near or place > first")
    return gone.groupBy("place.doc_id", "place.text_hash").agg(F.sort_array(F.collect_set("place.pos")).alias("removed"))


def dedup_lines(docs: DataFrame, edit_words: int = EDIT_WORDS) -> DataFrame:
    """``docs`` with the lines left as text, and n_lines, n_removed (of the input's lines)."""
    n_lines, n_removed, gone_id, gone_hash, removed = unused(docs, "n_lines", "n_removed", "gone_id", "gone_hash", "removed")
    gone = materialise(repeated_lines(docs, edit_words).toDF(gone_id, gone_hash, removed))
    joined = docs.join(small(gone, F.size(removed)), (docs["doc_id"] == F.col(gone_id)) & (F.xxhash64(docs["text"]) == F.col(gone_hash)), "left")
    lines = F.split(docs["text"], "\n", -1)
    n = F.octet_length(docs["text"]) - F.octet_length(F.replace(docs["text"], F.lit("\n"), F.lit(""))) + 1

    def left(x):
        bounds = F.concat(F.array(F.lit(-1)), F.col(removed), F.array(F.size(x)))
        return let(bounds, lambda b: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda i: F.slice(x, F.get(b, i) + 2, F.get(b, i + 1) - F.get(b, i) - 1))), "\n"))

    kept = F.when(F.col(removed).isNull(), docs["text"]).otherwise(let(lines, left))
    own = [kept.alias("text") if c == "text" else docs[c] for c in docs.columns]
    return joined.select(*own, F.coalesce(n, F.lit(0)).cast("long").alias(n_lines), F.coalesce(F.size(F.col(removed)), F.lit(0)).cast("long").alias(n_removed))


def reference(docs: list[tuple[int | None, str | None]], edit_words: int = EDIT_WORDS) -> dict[int, list[int]]:
    """Brute force, for tests with distinct doc_ids: the removed positions of each document."""

    def near(a: list[str], b: list[str]) -> bool:
        if abs(len(a) - len(b)) > 1:
            return False
        p = 0
        while p < min(len(a), len(b)) and a[p] == b[p]:
            p += 1
        return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]

    def words_in(norm: str) -> list[str]:
        return re.findall(r"[^\x20\x09-\x0D]+", norm)

    first: dict[str, tuple] = {}
    places = []
    for doc, text in sorted((d for d in docs if d[0] is not None and d[1] is not None), key=lambda d: d[0]):
        for pos, line in enumerate(text.split("\n")):
            norm = line.strip(" \t\r")
            if words_in(norm):
                first.setdefault(norm, (doc, pos))
                places.append((doc, pos, norm))
    order = sorted(first, key=first.get)
    by_size: dict[int, list[str]] = {}
    gone_lines = set()
    for norm in order:
        words = words_in(norm)
        if len(words) >= edit_words:
            if any(near(words, o) for k in (-1, 0, 1) for o in by_size.get(len(words) + k, [])):
                gone_lines.add(norm)
            by_size.setdefault(len(words), []).append(words)
    out: dict[int, list[int]] = {}
    for doc, pos, norm in places:
        if norm in gone_lines or first[norm] != (doc, pos):
            out.setdefault(doc, []).append(pos)
    return out
