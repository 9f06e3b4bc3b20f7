"""PII: keyed surrogates of the same type, format, script and gender.

Entities are found in whole texts by patterns. A surrogate is a keyed permutation of the
entity's variable characters (a Feistel network over mixed radices): digits stay digits,
letters letters of the same case, octets octets, punctuation stays, a card number keeps
its checksum's validity and an address its private or public range. So one entity gets
one surrogate wherever and however it is written, and two entities of a format get two.
Names after a form of address are replaced word by word: given names by made-up ones of
the same gender and script, family names alike for all, in the same letter case, also
where a document repeats the name without the form of address.

A second check covers what permutation cannot: all distinct entities with their
surrogates are compared, and where a surrogate is a real entity of the corpus, or two
names share one, the entity is permuted anew under another tweak. After ``ROUNDS`` rounds
a format (such as seven-digit phone numbers in a large corpus) that still has such
entities is saturated: its entities all go back to the first permutation, under which they
stay distinct, but a surrogate may be a real entity, or by chance the entity itself. Names
gain a syllable each round until none is left. The
few exceptions are broadcast while they number at most ``broadcast_rows``; above, the
exceptions are joined to the documents that need them. Texts are otherwise not shuffled.

The permutation can be undone by whoever has the key, so a key is required.

Defined results: null texts stay null, empty ones empty; repeated rows get equal
replacements; a text without entities is unchanged; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.llm._shared import materialise, unused

KINDS = ("email", "ip", "iban", "card", "ssn", "phone", "given", "family")
BROADCAST_ROWS = 20_000
#: Rounds after which formats with taken surrogates are left as they are.
ROUNDS = 8
KEY_BYTES = 16
_NAMES = ("given", "family")

_PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
  | (?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))
  | (?P<iban>(?<!\w)[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w))
  | (?P<phone>(?<![\w.+])(?:\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d{2,4}(?:[\x20.-]?\d{2,4}){1,4}|\(\d{2,4}\)[\x20.-]?\d{3,4}[\x20.-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4}|\d{3}-\d{4}(?!-))(?![\d]))
  | (?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
  | (?P<card>(?<![\w.-])(?:\d{13,19}|\d{4}(?:[\x20-]\d{4}){3}(?:[\x20-]\d{1,3})?)(?!\w))
    """,
    re.VERBOSE | re.ASCII,
)

#: Forms of address and the gender that they tell; fixed values.
_TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Don": "m", "Signor": "m", "Sr": "m", "M": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mademoiselle": "f", "Señora": "f", "Señorita": "f", "Doña": "f", "Signora": "f", "Sra": "f", "Srta": "f", "Mme": "f", "Mlle": "f",
    "Dr": "n", "Prof": "n", "г-н": "m", "господин": "m", "г-жа": "f", "госпожа": "f", "κύριος": "m", "κυρία": "f",
}
_UPPER = "A-ZÀ-ÖØ-ÞĀ-ſΆ-ΫЀ-Я"
_LOWER = "a-zß-öø-ÿĀ-ſά-ώа-џ"
_NAME = re.compile(rf"[MSHFDPгκ][\w-]{{0,12}}\.?\x20(?P<name>[{_UPPER}][{_LOWER}'’-]+(?:\x20[{_UPPER}][{_LOWER}'’-]+){{0,2}})")
_DIGIT_OR_AT = re.compile(r"[0-9@]")

#: Parts of made-up names by script; fixed values.
_PARTS = {
    "latin": ("ba be bi bo da de di do fa fe ga go ha he ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te ti va ve za".split(), ("n", "s", "r", "l"), ("a", "ia")),
    "cyrillic": ("ба бе ва ве га го да де ди за зо ка ко ла ле ли ло ма ме ми на не ни но па пе ра ре ри ро са се та те ти то".split(), ("н", "р", "л", "м"), ("а", "ия")),
    "greek": ("βα βε γα γο δα δε δι ζα θα κα κο λα λε λι λο μα με μι να νε νι πα πε ρα ρο σα σε τα τε".split(), ("ς", "ρ"), ("α", "η")),
}


def _prf(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key, digest_size=32).digest(), "big")


def permute(values: list[int], radices: list[int], key: bytes, tweak: str, rounds: int = 4) -> list[int]:
    """A keyed bijection of the mixed-radix numbers of these radices."""
    half = (len(values) + 1) // 2
    pack = lambda v, r: [n := 0, [n := n * b + x for x, b in zip(v, r, strict=True)], n][-1]
    sizes = [1, 1]
    for i, r in enumerate(radices):
        sizes[i >= half] *= r
    a, b = pack(values[:half], radices[:half]), pack(values[half:], radices[half:])
    for i in range(rounds):
        a = (a + _prf(key, tweak, "a", i, b)) % sizes[0]
        b = (b + _prf(key, tweak, "b", i, a)) % sizes[1]
    out = []
    for n, part in ((b, radices[half:]), (a, radices[:half])):
        for r in reversed(part):
            n, x = divmod(n, r)
            out.append(x)
    return out[::-1]


def _spell(text: str, key: bytes, tweak: str) -> str:
    """Letters and digits permuted, case and everything else kept."""
    slots = [(i, 10 if c.isdigit() else 26) for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    if not slots:
        return text
    shape = "".join("9" if c.isdigit() else "a" if c.isascii() and c.isalpha() else c for c in text)
    value = [int(c) if c.isdigit() else ord(c.lower()) - 97 for c in (text[i] for i, _ in slots)]
    out = list(text)
    for (i, radix), v in zip(slots, permute(value, [r for _, r in slots], key, f"{tweak}:{shape}"), strict=True):
        out[i] = str(v) if radix == 10 else chr(97 + v)
    return "".join(out)


def _label(text: str, key: bytes, tweak: str) -> str:
    """A part of a domain; ``example`` stays, and no other becomes it."""
    if text != _RESERVED:
        text = _spell(text, key, tweak)
        while text == _RESERVED:  # cycle walking keeps it a bijection
            text = _spell(text, key, tweak)
    return text


_RESERVED = "example"


def luhn(digits: str) -> int:
    """The check digit of a card number without its last digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def _private(octets: list[int]) -> bool:
    return octets[0] in (0, 10, 127) or octets[0] >= 224 or octets[:2] in ([192, 168], [169, 254]) or octets[0] == 172 and 16 <= octets[1] < 32


def canonical(kind: str, text: str) -> str:
    """What all ways of writing an entity share."""
    if kind in ("phone", "card", "ssn"):
        return ("+" if text.startswith("+") else "") + re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind in ("given", "family"):
        return text.casefold()
    return text.lower()


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of a canonical entity; for given names, ``entity`` is gender:name."""
    tweak = f"{kind}:{attempt}"
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        *labels, top = domain.split(".")
        return f"{_spell(local, key, tweak)}@{'.'.join([*(_label(x, key, tweak) for x in labels), top])}"
    if kind == "ip":
        octets = [int(x) for x in entity.split(".")]
        new = permute(octets, [256] * 4, key, tweak)
        while _private(new) != _private(octets):  # cycle walking keeps it a bijection
            new = permute(new, [256] * 4, key, tweak)
        return ".".join(map(str, new))
    if kind == "card":
        body = "".join(map(str, permute([int(c) for c in entity[:-1]], [10] * (len(entity) - 1), key, tweak)))
        return body + str((luhn(body) + int(entity[-1]) - luhn(entity[:-1])) % 10)
    if kind == "iban":
        body = _spell(entity[4:], key, tweak + entity[:2]).upper()
        digits = lambda x: 98 - int("".join(str(int(c, 36)) for c in f"{x}{entity[:2]}00")) % 97
        # valid digits stay valid, and others as far from the valid ones
        return entity[:2] + f"{(int(entity[2:4]) + digits(body) - digits(entity[4:])) % 100:02d}" + body
    if kind in ("phone", "ssn"):
        lead = re.match(r"\+\d?", entity)[0] if entity.startswith("+") else ""
        digits = entity[len(lead) :]
        return lead + "".join(map(str, permute([int(c) for c in digits], [10] * len(digits), key, tweak + lead)))
    gender, _, name = entity.partition(":") if kind == "given" else ("", "", entity)
    first = name[:1]
    script = "cyrillic" if "Ѐ" <= first <= "ӿ" else "greek" if "Ͱ" <= first <= "Ͽ" else "latin"
    parts, male, female = _PARTS[script]
    n = _prf(key, tweak, entity)
    size = 2 + (len(name) > 5) + attempt
    out = ""
    for _ in range(size):
        n, i = divmod(n, len(parts))
        out += parts[i]
    ending = {"m": male, "f": female}.get(gender)
    return out + (ending[n % len(ending)] if ending else "")


def format_of(kind: str, entity: str) -> str:
    """What a surrogate shares with its entity: among the entities of one format an attempt's surrogates are distinct."""
    shape = lambda x: re.sub("[0-9]", "9", re.sub("[a-z]", "a", x))
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        *labels, top = domain.split(".")
        return f"{shape(local)}@{'.'.join([*(x if x == _RESERVED else shape(x) for x in labels), top])}"
    if kind == "ip":
        return "private" if _private([int(x) for x in entity.split(".")]) else "public"
    if kind == "iban":
        return entity[:2] + shape(entity[4:].lower())
    if kind in _NAMES:
        return ""
    return (entity[:2] if entity.startswith("+") else "") + str(len(entity))


def _written(kind: str, text: str, new: str) -> str:
    """A surrogate in the format of the text that it replaces."""
    if kind in ("phone", "card", "ssn", "iban"):
        keep = str.isalnum if kind == "iban" else str.isdigit
        rest = iter(new.lstrip("+"))
        return "".join(next(rest) if keep(c) else c for c in text)
    if kind in ("given", "family"):
        if text.isupper() and len(text) > 1:
            return new.upper()
        return new[:1].upper() + new[1:] if text[:1].isupper() else new
    if kind == "email" and text != text.lower():
        return "".join(n.upper() if c.isupper() else n for c, n in zip(text, new, strict=False))
    return new


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical entity), by start, not overlapping; code points."""
    found = []
    if _DIGIT_OR_AT.search(text):
        for m in _PATTERN.finditer(text):
            kind = m.lastgroup
            digits = sum(c.isdigit() for c in m[0])
            if kind != "phone" or 7 <= digits <= 15:
                found.append((m.start(), m.end(), kind, canonical(kind, m[0])))
    known: dict[str, tuple[str, str]] = {}
    for m in _NAME.finditer(text):
        title = m[0][: m.start("name") - m.start()]
        gender = _TITLES.get(title.rstrip(" .")) if title != "M " else None
        if gender is None or text[m.start() - 1 : m.start()].isalnum():
            continue
        words = m["name"].split(" ")
        for word in words[:-1]:
            known.setdefault(word, ("given", f"{gender}:{canonical('given', word)}"))
        known[words[-1]] = ("family", canonical("family", words[-1]))
    if known:
        taken = [(a, b) for a, b, *_ in found]
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?!\w)", text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                found.append((m.start(), m.end(), *known[m[0]]))
    return sorted(found)


def replace_entities(text: str, key: bytes, attempts: Callable[[str, str], int]) -> tuple[str, list[tuple[int, int, str, str]]]:
    found = find_entities(text)
    if not found:
        return text, found
    out, last = [], 0
    for start, end, kind, entity in found:
        out += [text[last:start], _written(kind, text[start:end], surrogate(kind, entity, key, attempts(kind, entity)))]
        last = end
    return "".join([*out, text[last:]]), found


_ENTITY = "kind string, entity string, format string, surrogate string, attempt int"


def _entities(own: list[tuple[str, str]], key: bytes, attempts: list[int]) -> pa.RecordBatch:
    columns = ([k for k, _ in own], [e for _, e in own], [format_of(k, e) for k, e in own], [surrogate(k, e, key, a) for (k, e), a in zip(own, attempts, strict=True)])
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(attempts, pa.int32())], names=["kind", "entity", "format", "surrogate", "attempt"])


def _surrogates_of(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sorted({(k, e) for t in batch.column(0).to_pylist() if t for _, _, k, e in find_entities(t)})
            yield _entities(own, key, [0] * len(own))

    return run


def _again(key: bytes, first: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(zip(batch.column("kind").to_pylist(), batch.column("entity").to_pylist(), strict=True))
            yield _entities(own, key, [0 if first else a + 1 for a in batch.column("attempt").to_pylist()])

    return run


def exceptions(docs: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """(kind, entity, attempt) of the entities that do not get their first surrogate."""
    current = materialise(docs.select("text").mapInArrow(_surrogates_of(key), _ENTITY).dropDuplicates(["kind", "entity"]))
    bare = F.when(F.col("kind") == "given", F.substring_index("entity", ":", -1)).otherwise(F.col("entity"))
    real = current.select("kind", bare.alias("surrogate"), F.lit(True).alias("real")).distinct()
    left, done = current, 0
    while True:
        # the oldest surrogate stays: fewest attempts, then the smallest entity
        owner = current.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("owner"))
        bad = left.join(owner, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        bad = materialise(bad.where("real or owner.entity <> entity").select(*current.columns))
        if bad.isEmpty():
            return current.where("attempt > 0").select("kind", "entity", "attempt")
        done += 1
        if done == rounds:
            # saturated formats go back to the first permutation and are left out from here on
            formats = bad.where(~F.col("kind").isin(*_NAMES)).select("kind", "format").distinct()
            back = current.join(formats, ["kind", "format"], "left_semi").select(*current.columns).mapInArrow(_again(key, True), _ENTITY)
            current = materialise(current.join(formats, ["kind", "format"], "left_anti").select(*current.columns).union(back))
            bad = bad.where(F.col("kind").isin(*_NAMES))
        current = materialise(current.join(bad.select("kind", "entity"), ["kind", "entity"], "left_anti").unionByName(bad.mapInArrow(_again(key), _ENTITY)))
        left = current.where(F.col("kind").isin(*_NAMES)) if done >= rounds else current


def derived(key: bytes) -> bytes:
    """The key of the permutations, of any secret that is long enough."""
    if not isinstance(key, bytes) or len(key) < KEY_BYTES:
        raise ValueError(f"a secret key of at least {KEY_BYTES} bytes is needed")
    return hashlib.blake2b(key, digest_size=32).digest()


def replace_pii(docs: DataFrame, key: bytes, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with surrogates in text, and entities: array of (start, end, kind) in code points of the input.

    ``key``: at least ``KEY_BYTES`` secret bytes; other keys raise ValueError.
    """
    key = derived(key)
    spark = docs.sparkSession
    (name,) = unused(docs, "entities")
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    at, n_own = docs.columns.index("text"), len(docs.columns)
    odd = materialise(exceptions(docs, key))
    few = odd.count() <= broadcast_rows
    shared = spark.sparkContext.broadcast({(r[0], r[1]): r[2] for r in odd.collect()} if few else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(n_own).to_pylist() if not few else [None] * batch.num_rows
            texts, entities = [], []
            for text, mine in zip(batch.column(at).to_pylist(), own, strict=True):
                table = {(x["kind"], x["entity"]): x["attempt"] for x in mine} if mine else shared.value
                new, found = replace_entities(text, key, lambda k, e, t=table: t.get((k, e), 0)) if text else (text, [])
                texts.append(new)
                entities.append([{"start": a, "end": b, "kind": k} for a, b, k, _ in found])
            columns = [*batch.columns[:n_own], pa.array(entities, arrow)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    if few:
        return docs.mapInArrow(run, schema)
    # too many exceptions to broadcast: each text brings its own
    text_key, extra = unused(docs, "text_key", "exceptions")
    keyed = docs.withColumn(text_key, F.sha2(F.col("text").cast("binary"), 256))

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted({(k, e, key_) for t, key_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for _, _, k, e in find_entities(t)})
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["kind", "entity", "key"])

    pairs = keyed.select("text", text_key).mapInArrow(mentions, "kind string, entity string, key string").distinct()
    own = pairs.join(odd, ["kind", "entity"]).groupBy("key").agg(F.collect_list(F.struct("kind", "entity", "attempt")).alias(extra))
    joined = keyed.join(own.withColumnRenamed("key", text_key), text_key, "left").select(*(F.col(f"`{c}`") for c in docs.columns), extra)
    return joined.mapInArrow(run, schema)
