"""Secret scans: known shapes of credentials, and strings too random to be words.

The base finds assignments, access keys and hex strings by pattern. The method adds
spans of high entropy: over each candidate string a window slides whose counts of the
class's characters are the state of a fold; the one that leaves is counted out, the one
that enters is counted in, and the sum of n log n (in integers) follows from these two
counts alone. A candidate's class (hex, letters of one case with digits, mixed) has its
own threshold. An allow-list suppresses whole candidates (UUIDs, digests of
subresources, paths of word-like pieces) and found spans (placeholders), never base
spans. All of it is column expressions: one pass, no shuffle, no Python.

Positions come from the pieces between matches: ``split`` and ``regexp_extract_all`` walk
the same leftmost matches, so running lengths of pieces and matches give code points.
Running sums go by stretches, so the time is in proportion to text, matches and candidates.

Defined results: null texts are empty, with no spans; a candidate of any length is scanned
whole; repeated rows are judged alike; further columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinflow.llm._shared import let, unused

#: The base kinds, in the order in which equal starts are listed; fixed values.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Width of the sliding window, and the bits a character that a window needs, by class.
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "one_case": 3.5, "mixed": 3.75}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Candidates that these match are no secrets: UUIDs, subresource digests.
ALLOWED = (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"^sha(256|384|512)-")
#: Nor are paths: two slashes or more, between them pieces like words (letters, then some digits).
PATH_PIECE = r"^(([A-Za-z][a-z]*([A-Z][a-z]*){0,5}[0-9]{0,4}|[0-9]{1,4})([_-]|$)){0,4}$"
PATH_PIECE_LENGTH = 18
#: Nor are spans that hold one of these.
PLACEHOLDER = r"(?i)(example|placeholder|changeme|dummy|your[_-]?(key|token)|x{6,}|0{8,}|1234567)"

#: Terms n log2 n are integers in units of 2^-32 bits; running sums go by stretches of so many values.
UNIT = 1 << 32
STRETCH = 256

_SPAN = "array<struct<start:bigint,kind:int,end:bigint,text:string>>"


def terms(window: int) -> list[int]:
    return [round(c * math.log2(c) * UNIT) if c else 0 for c in range(window + 1)]


def limit(window: int, bits: float) -> int:
    """The largest sum of terms of a window whose entropy has so many bits a character."""
    return math.floor(window * (math.log2(window) - bits) * UNIT)


def _before(values: F.Column) -> F.Column:
    """Of an array of numbers: the sum of those before each; by stretches, since a fold that appends copies its array."""

    def running(x):
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda a, v: F.struct((a["at"] + v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(x, start, step, lambda a: a["out"])

    def by_stretches(x):
        count = F.floor((F.size(x) + STRETCH - 1) / STRETCH).cast("int")
        parts = F.transform(F.sequence(F.lit(1), count), lambda k: F.slice(x, (k - 1) * STRETCH + 1, F.lit(STRETCH)))
        return let(parts, joined)

    def joined(parts):
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda a, v: a + v))
        return F.flatten(F.zip_with(parts, running(sums), lambda p, at: F.transform(running(p), lambda v: v + at)))

    return let(values, lambda x: F.when(F.size(x) > STRETCH, by_stretches(x)).otherwise(running(x)))


def _located(text: F.Column, matches: F.Column, pattern: str, kind: int) -> F.Column:
    """The matches with their positions; the pieces between them are only made where there is a match."""

    def spans(both):
        lengths = F.zip_with(F.slice(both["pieces"], F.lit(1), F.size(both["found"])), both["found"], lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))
        ends = F.zip_with(_before(lengths), lengths, lambda b, n: b + n)
        return F.zip_with(both["found"], ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("text")))

    located = let(F.struct(F.split(text, pattern, -1).alias("pieces"), matches.alias("found")), spans)
    return F.when(F.size(matches) > 0, located.cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def _highest_entropy(text: F.Column, window: int) -> F.Column:
    """(first, last): the starts of the first and last window whose entropy reaches the text's threshold; null without.

    ``text`` has characters of SYMBOLS only. Their counts in the window are packed into a few longs.
    """
    bits = window.bit_length()
    per = 62 // bits
    table = F.lit(np.array([max(0, SYMBOLS.find(chr(c))) for c in range(128)], np.int32))
    value = F.lit(np.array([*terms(window), 0], np.int64))
    most = F.when(text.rlike("^[0-9a-fA-F]+$"), limit(window, THRESHOLDS["hex"])).when(text.rlike("[a-z]") & text.rlike("[A-Z]"), limit(window, THRESHOLDS["mixed"])).otherwise(limit(window, THRESHOLDS["one_case"]))
    nothing = F.lit(None).cast("int")

    def slide(bound):
        symbol = lambda i: F.get(table, F.ascii(F.substring(bound["bytes"], i, F.lit(1)).cast("string")))
        word = lambda c: F.floor(c / per).cast("int")
        # shifts are multiplications by a power of two from a table, as shift widths must be literals
        unit = F.lit(np.array([1 << bits * k for k in range(per)], np.int64))
        weight = lambda c: F.get(unit, F.pmod(c, F.lit(per)))
        count = lambda counts, c: F.call_function("div", F.get(counts, word(c)), weight(c)) % (1 << bits)

        def step(a, i):
            moved = F.struct(symbol(i).alias("in"), F.when(i > window, symbol(i - window)).alias("out"))
            return let(moved, lambda m: let(counted(a, m), lambda n: entered(a, i, m, n)))

        def counted(a, m):
            out = F.coalesce(count(a["counts"], m["out"]), F.lit(0)).cast("int")
            in_ = (count(a["counts"], m["in"]) - F.when(m["in"] == m["out"], 1).otherwise(0)).cast("int")
            return F.struct(out.alias("out"), in_.alias("in"))

        def entered(a, i, m, n):
            total = a["total"] + F.when(n["out"] > 0, F.get(value, n["out"] - 1) - F.get(value, n["out"])).otherwise(0) + F.get(value, n["in"] + 1) - F.get(value, n["in"])
            change = lambda x, k: x + F.when(word(m["in"]) == k, weight(m["in"])).otherwise(0) - F.when(word(m["out"]) == k, weight(m["out"])).otherwise(0)
            return let(
                F.struct(total.alias("total"), ((i >= window) & (total <= bound["most"])).alias("hot")),
                lambda t: F.struct(
                    t["total"].alias("total"), F.transform(a["counts"], change).alias("counts"),
                    F.when(t["hot"] & a["first"].isNull(), i - window).otherwise(a["first"]).alias("first"), F.when(t["hot"], i - window).otherwise(a["last"]).alias("last"),
                ),
            )

        none = F.array_repeat(F.lit(0).cast("bigint"), -(-len(SYMBOLS) // per))
        start = F.struct(F.lit(0).cast("bigint").alias("total"), none.alias("counts"), nothing.alias("first"), nothing.alias("last"))
        return F.aggregate(F.sequence(F.lit(1), F.length(text)), start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    return let(F.struct(most.cast("bigint").alias("most"), text.cast("binary").alias("bytes")), slide)


def _is_path(c: F.Column) -> F.Column:
    pieces = F.split(c, "/", -1)
    return (F.size(pieces) > 2) & F.forall(pieces, lambda p: (F.length(p) <= PATH_PIECE_LENGTH) & p.rlike(PATH_PIECE))


def scan_secrets(docs: DataFrame, window: int = WINDOW, allowed: tuple[str, ...] = ALLOWED, placeholder: str = PLACEHOLDER) -> DataFrame:
    """``docs`` with secrets: array of (start, kind, end, text), kind an index of KINDS, by start, then kind; code points."""
    (out,) = unused(docs, "secrets")
    names = unused(docs, "m_text", "m_assign", "m_value", "m_access", "m_hex", "m_candidate", "m_hot")
    text, assign, value, access, hex_, candidate, hot = names
    found = docs.withColumn(text, F.coalesce("text", F.lit("")))
    found = found.withColumns(
        {
            assign: F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0)),
            access: F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0)),
            hex_: F.regexp_extract_all(text, F.lit(HEX), F.lit(0)),
            candidate: F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)),
        }
    )
    found = found.withColumn(value, F.when(F.size(assign) > 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))))
    likely = lambda c: c.rlike("[0-9]") & c.rlike("[A-Za-z]") & ~_any(c, allowed) & ~_is_path(c)
    found = found.withColumn(hot, F.when(F.exists(candidate, likely), _located(F.col(text), F.col(candidate), CANDIDATE, 3)).otherwise(F.array().cast(_SPAN)))
    # a column inside a lambda might be computed anew for each element
    valued = F.zip_with(_located(F.col(text), F.col(assign), ASSIGN, 0), F.coalesce(F.col(value), F.array().cast("array<string>")), lambda s, v: F.when(F.length(v) >= 6, s))
    all_assign = F.filter(valued, lambda s: s.isNotNull())
    windows = F.transform(F.filter(hot, lambda s: likely(s["text"])), lambda s: F.struct(s.alias("s"), _highest_entropy(s["text"], window).alias("w")))
    random = F.transform(
        F.filter(windows, lambda x: x["w"]["first"].isNotNull()),
        lambda x: F.struct(
            (x["s"]["start"] + x["w"]["first"]).alias("start"), F.lit(3).alias("kind"), (x["s"]["start"] + x["w"]["last"] + window).alias("end"),
            F.substring(x["s"]["text"], x["w"]["first"] + 1, x["w"]["last"] - x["w"]["first"] + window).alias("text"),
        ),
    )
    random = F.filter(random.cast(_SPAN), lambda s: ~s["text"].rlike(placeholder))
    spans = F.concat(all_assign, _located(F.col(text), F.col(access), ACCESS, 1), _located(F.col(text), F.col(hex_), HEX, 2), random)
    return found.withColumn(out, F.array_sort(spans)).drop(*names)


def _any(c: F.Column, patterns: tuple[str, ...]) -> F.Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def span_list(spans: F.Column) -> F.Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")
