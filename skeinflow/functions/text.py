"""Text functions, all built from Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinflow.functions.base import col, contains_any, let

#: Words that a query does not search for.
STOPWORDS = (
    "de", "la", "el", "los", "las", "del", "en", "y", "o", "un", "una", "the", "of", "and", "or", "a", "an", "is", "que", "se", "su", "con", "por",
    "para", "al", "lo", "como", "sin", "sobre", "entre", "hacia", "hasta", "desde", "durante", "mediante",
)
#: The shorter list of the preflight keywords.
PREFLIGHT_STOPWORDS = (
    "de", "la", "el", "los", "las", "del", "en", "y", "o", "un", "una", "the", "of", "and", "or", "a", "an", "is", "que", "se", "su", "con", "por",
    "para", "al", "lo",
)
#: Words of chunks that are page furniture.
NOISE_KEYWORDS = (
    "cookie", "cookies", "analytics", "session", "ai_user", "ai_session", "google analytics", "microsoft clarity", "azure", "tracking", "gdpr",
    "consent", "banner", "popup", "subscribe", "newsletter", "advertisement", "sponsored", "marketing", "promotional", "footer", "sidebar",
    "navigation", "login", "signup", "register", "cart", "checkout", "wishlist", "privacidad", "términos", "condiciones", "uso de cookies",
)
#: Phrases that ask for a tool.
TOOL_PHRASES = (
    "utiliza la herramienta", "usa la herramienta", "use the tool", "search_and_crawl", "ejecuta la herramienta", "llama a la herramienta", "run the tool",
    "call the tool", "utiliza la tool", "usa la tool", "utiliza la función", "usa la función", "ejecuta la función",
)
#: Markers of a protocol that must survive compression.
PROTOCOL_MARKERS = ("▶ CONTINÚA:", "▶ CONTINÚA EN LA SIGUIENTE PARTE", "🗜️ PARTE", "## Código — Parte", "## Código - Parte", "[🗜️ PARTE", "[CÓDIGO COMPRIMIDO")
#: Fixed value.
TRUNCATED = "\n\n[Content truncated due to length...]"
#: Names of credentials that are masked.
CREDENTIALS = ("authorization", "api_key", "api_token", "token", "bearer", "key")

CHUNK_TOKENS = 256
_SENTENCE = r"(?U)(?<=[.!?¿¡…])\s+"


def estimate_tokens(text: Column | str) -> Column:
    """Tokens of a text: a quarter of its characters, rounded down."""
    return F.floor(F.length(col(text)) / 4).cast("int")


def truncate_tokens(text: Column | str, tokens: int) -> Column:
    """At most so many tokens, with a mark where something was cut."""
    text = col(text)
    return F.when(estimate_tokens(text) > tokens, F.concat(F.substring(text, 1, 4 * tokens), F.lit(TRUNCATED))).otherwise(text)


def truncate_bytes(text: Column | str, size: int, mark: str = TRUNCATED) -> Column:
    """At most so many UTF-8 bytes, a cut character replaced, with a mark where something was cut."""
    raw = F.encode(col(text), "UTF-8")
    cut = F.make_valid_utf8(F.substring(raw, 1, size).cast("string"))
    return F.when(F.octet_length(raw) > size, F.concat(cut, F.lit(mark))).otherwise(col(text))


def sentences(text: Column | str) -> Column:
    return F.split(col(text), _SENTENCE, -1)


def chunks(text: Column | str, tokens: int = CHUNK_TOKENS) -> Column:
    """Sentences packed greedily into chunks of at most ``tokens``; a longer sentence is a chunk of its own."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"))

    def pack(a, sentence):
        return let(
            estimate_tokens(sentence),
            lambda n: F.when(
                (F.size(a["open"]) > 0) & (a["size"] + n > tokens),
                F.struct(F.concat(a["out"], F.array(F.array_join(a["open"], " "))).alias("out"), F.array(sentence).alias("open"), n.alias("size")),
            ).otherwise(F.struct(a["out"].alias("out"), F.concat(a["open"], F.array(sentence)).alias("open"), (a["size"] + n).alias("size"))),
        )

    return F.aggregate(sentences(text), empty, pack, lambda a: F.when(F.size(a["open"]) > 0, F.concat(a["out"], F.array(F.array_join(a["open"], " ")))).otherwise(a["out"]))


def query_words(query: Column | str) -> Column:
    """The distinct words of a query that are longer than two characters and no stopwords."""
    found = F.regexp_extract_all(F.lower(col(query)), F.lit(r"(?U)(\w+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS)))


def is_noise(chunk: Column | str, words: Column) -> Column:
    """Page furniture that has none of the query's words; never so without query words."""
    of = lambda lower, own: contains_any(lower, NOISE_KEYWORDS) & ~F.exists(own, lambda w: F.contains(lower, w))
    return let(words, lambda own: (F.size(own) > 0) & let(F.lower(col(chunk)), lambda lower: of(lower, own)))


def keyword_score(text: Column | str, query: Column | str) -> Column:
    """How many of the query's words, repeats counted, are in the text."""
    words = F.filter(F.split(F.lower(col(query)), r"(?U)\s+"), lambda w: w != "")
    return let(F.lower(col(text)), lambda lower: F.size(F.filter(words, lambda w: F.contains(lower, w))))


def preflight_keywords(query: Column | str) -> Column:
    words = F.transform(F.split(col(query), r"(?U)\s+"), lambda w: F.lower(F.regexp_replace(w, r"(?U)[^\w]", "")))
    return F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*PREFLIGHT_STOPWORDS))


def anchor_keywords(query: Column | str) -> Column:
    """The two longest preflight keywords; of equal length, the first in the alphabet."""
    ranked = F.array_sort(F.transform(F.array_distinct(preflight_keywords(query)), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.slice(F.transform(ranked, lambda x: x["w"]), 1, 2)


def strip_think(text: Column | str) -> Column:
    """Without think blocks; if nothing is left, the text as it was."""
    text = col(text)
    return let(F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", ""), F.lit(" \t\n\r\f\x0b")), lambda s: F.when(s == "", text).otherwise(s))


def has_marker(text: Column | str) -> Column:
    return let(F.replace(F.replace(col(text), F.lit("▶️"), F.lit("▶")), F.lit("►"), F.lit("▶")), lambda t: contains_any(t, PROTOCOL_MARKERS))


def is_traceback(text: Column | str) -> Column:
    """Error output that must stay as it is."""

    def of(lower):
        named = contains_any(lower, ["traceback (most recent call last)", "traceback:"])
        return named | (lower.contains("exception") & lower.contains('file "')) | lower.rlike(r'file ".+", line \d+')

    return let(F.lower(col(text)), of)


def defined_names(code: Column | str) -> Column:
    """Classes, then functions, that start in the first column."""
    code = col(code)
    classes = F.regexp_extract_all(code, F.lit(r"(?m)^class\s+([A-Za-z_]\w*)"), F.lit(1))
    functions = F.regexp_extract_all(code, F.lit(r"(?m)^(?:async )?def\s+([A-Za-z_]\w*)"), F.lit(1))
    return F.concat(classes, functions)


_FENCE = r"(?s)```(\w*)\s*\n(.*?)(?:```|\z)"


def segments(text: Column | str) -> Column:
    """Text and code in order: array of (kind, text, lang); a fence that is not closed runs to the end."""
    text = col(text)
    kind = lambda k, t, g: F.struct(F.lit(k).alias("kind"), t.alias("text"), g.alias("lang"))

    def join(x):
        pairs = F.transform(
            F.sequence(F.lit(0), F.size(x["plain"]) - 1),
            lambda i: F.array(kind("text", F.get(x["plain"], i), F.lit("")), kind("code", F.get(x["body"], i), F.get(x["lang"], i))),
        )
        return F.filter(F.flatten(pairs), lambda s: F.when(s["kind"] == "text", s["text"] != "").otherwise(s["text"].isNotNull()))

    extract = lambda i: F.regexp_extract_all(text, F.lit(_FENCE), F.lit(i))
    return let(F.struct(F.split(text, _FENCE, -1).alias("plain"), extract(1).alias("lang"), extract(2).alias("body")), join)


#: The sentence of a stub, around its size and its names.
STUB = ("[CÓDIGO COMPRIMIDO — ", " tokens — símbolos: ", ". Recuperar con /expand <nombre> o via LOD.]")


def code_stub(code: Column, lang: Column) -> Column:
    """A fence whose body only tells its size and first eight names."""
    names = let(defined_names(code), lambda n: F.when(F.size(n) > 0, F.array_join(F.slice(n, 1, 8), ", ")).otherwise("none"))
    told = F.concat(F.lit(STUB[0]), estimate_tokens(code).cast("string"), F.lit(STUB[1]), names, F.lit(STUB[2]))
    return F.concat(F.lit("```"), lang, F.lit("\n"), told, F.lit("\n```"))


def repetition_tail(text: Column | str, lines_back: int = 20) -> Column:
    """How the last lines repeat: struct(lines, exact, shared, median, tokens, verdict); verdict '' where they do not.

    Verdicts: verbatim, template (reachable), template_short, partial.
    """
    tail = F.substring(col(text), -6000, 6000)
    rows = F.filter(F.transform(F.split(tail, "\n", -1), lambda r: F.regexp_replace(r, r"(?U)\s+$", "")), lambda r: r != "")
    last = let(rows, lambda r: F.slice(r, F.greatest(F.size(r) - max(4, lines_back) + 1, F.lit(1)), F.lit(max(4, lines_back))))

    def common(a, b):
        # a longer prefix can only be equal if all shorter ones are: find its length bit by bit
        width = F.least(F.length(a), F.length(b))
        longer = lambda n, bit: F.when((n + bit <= width) & (F.left(a, n + bit) == F.left(b, n + bit)), n + bit).otherwise(n)
        return F.aggregate(F.array(*(F.lit(1 << k) for k in range(12, -1, -1))), F.lit(0), longer)

    def told(r):
        prefixes = F.transform(F.sequence(F.lit(0), F.size(r) - 2), lambda i: common(F.get(r, i), F.get(r, i + 1)))
        shared = F.array_sort(F.filter(prefixes, lambda p: p >= 12))
        return let(F.struct((F.size(r) - F.size(F.array_distinct(r))).alias("exact"), shared.alias("shared"), F.size(r).alias("n")), verdict)

    def verdict(x):
        count = F.size(x["shared"])
        median = F.coalesce(F.get(x["shared"], F.floor(count / 2).cast("int")), F.lit(0))
        tokens = F.floor(median / F.lit(3.7)).cast("int")
        named = (
            F.when((x["exact"] == 0) & (count == 0), "")
            .when(x["exact"] >= F.greatest(F.lit(2), F.floor(x["n"] / 3)), "verbatim")
            .when((count >= F.greatest(F.lit(2), F.floor((x["n"] - 1) / 2))) & (tokens >= 4), "template")
            .when(count >= F.greatest(F.lit(2), F.floor((x["n"] - 1) / 2)), "template_short")
            .otherwise("partial")
        )
        return F.struct(x["n"].alias("lines"), x["exact"].alias("exact"), count.alias("shared"), median.alias("median"), tokens.alias("tokens"), named.alias("verdict"))

    none = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("exact"), F.lit(0).alias("shared"), F.lit(0).alias("median"), F.lit(0).alias("tokens"), F.lit("").alias("verdict"))
    return let(last, lambda r: F.when(F.size(r) >= 4, told(r)).otherwise(none))


def compress_prose(text: Column, rate: float | Column) -> Column:
    """A stand-in for a learned compressor: the longest words, ``rate`` of all, in their order.

    Deterministic, and without a model; of equally long words the earlier stay.
    """
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")

    def pick(w):
        ranked = F.array_sort(F.transform(w, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"))))
        kept = F.slice(ranked, F.lit(1), F.greatest(F.ceil(F.size(w) * rate).cast("int"), F.lit(0)))
        places = F.array_sort(F.transform(kept, lambda k: k["i"]))
        return F.array_join(F.transform(places, lambda i: F.get(w, i)), " ")

    return let(words, pick)


def short_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(F.lower(col(text)), 256), 1, 16)


def first_line(text: Column | str) -> Column:
    """A model's one-line answer: first line, without quotes and blanks around it."""
    line = F.split_part(F.trim(col(text), F.lit(" \t\n\r")), F.lit("\n"), F.lit(1))
    return F.trim(F.trim(line, F.lit('"')), F.lit(" \t\r"))


def shared_words(a: Column | str, b: Column | str) -> Column:
    """How many different words two texts share."""
    words = lambda x: F.filter(F.split(F.lower(col(x)), r"(?U)\s+"), lambda w: w != "")
    return F.size(F.array_intersect(words(a), words(b)))


def is_tool_request(text: Column | str) -> Column:
    return let(F.lower(col(text)), lambda lower: contains_any(lower, TOOL_PHRASES))


def language_of(filename: Column | str) -> Column:
    """The extension, if it has at most 20 characters."""
    ext = F.lower(F.regexp_extract(col(filename), r"\.([^.]*)$", 1))
    return F.when(F.length(ext) <= 20, ext).otherwise("")


def redact(json: Column | str) -> Column:
    """JSON text whose credentials are masked."""
    # a string ends at a quote before which stand pairs of backslashes only; without alternatives in a loop, which Java's regular expressions run by recursion
    scalar = r'(?:"(?s:.*?)(?<!\\)(?:\\\\)*"|[^",\[\]{}\s]+)'
    return F.regexp_replace(col(json), r'(?i)("(?:' + "|".join(CREDENTIALS) + r')"\s*:\s*)' + scalar, r'$1"***REDACTED***"')
