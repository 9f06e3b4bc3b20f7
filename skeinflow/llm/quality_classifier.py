"""A compression classifier: which dictionary of labelled text shortens a document more.

Two zstandard dictionaries are trained, one from good and one from bad labelled
texts. A document is compressed with each, whole, in windows of ``WINDOW_BYTES`` so that
in a long text its own repetitions do not outweigh the dictionaries; the difference of
the two total sizes over the length of the text is the only input of the score. A
logistic curve over it, fitted on labelled rows that no dictionary has seen, turns it
into a probability. (Over the compressed size in place of the length it tells less: junk
is often repetitive, and both sizes are then small.)

Only the fit leaves the executors: at most ``max_rows`` labelled rows a class of at most
``max_chars`` characters each, picked from the labels in the order of a hash of doc_id;
longer texts are left out of the sample, never cut. Scoring reads every document whole, in one pass
without a shuffle.

Defined results: null and empty texts have a difference of 0; without labels of both
kinds every score is the prior 0.5; labels of null doc_id, null quality or of missing
documents are ignored; a doc_id of any type will do; other columns are never inputs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDS = 5
#: Bounds of the sample that is fitted on: rows of each class, characters of each text.
MAX_ROWS = 3000
MAX_CHARS = 20_000
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
WINDOW_BYTES = 512


def held_out(doc_id: F.Column) -> F.Column:
    """Rows whose crc32(doc_id as text) modulo 5 is 0; null is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    good: bytes
    bad: bytes
    #: Of the logistic curve: intercept and slope, over the difference less ``centre``, in units of ``scale``.
    weights: list[float]
    centre: float
    scale: float

    def probability(self, difference: np.ndarray) -> np.ndarray:
        x = np.clip((difference - self.centre) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * x, -30, 30)))


class Measure:
    """The normalised compressed-size difference of a text: positive where the good dictionary shortens it more."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
        self.good, self.bad = make(good), make(bad)

    def __call__(self, text: bytes) -> float:
        text = memoryview(text)
        windows = [text[a : a + WINDOW_BYTES] for a in range(0, len(text), WINDOW_BYTES)]
        return sum(len(self.bad.compress(w)) - len(self.good.compress(w)) for w in windows) / max(1, len(text))


def _dictionary(texts: list[bytes]) -> bytes:
    """Trained, or where there is too little text for training, the text itself."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, texts)) // 8)), texts, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; ``share`` weighs the rows."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + ridge * w
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model | None:
    """From labelled rows that are not held out; None without both classes."""
    labels = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = (F.xxhash64("doc_id", F.lit(8)), "doc_id")
    # two limits of max_rows: what is broadcast and what is collected are bounded, and documents aren't shuffled
    picked = [labels.where(F.col("quality") == q).orderBy(*order).limit(max_rows) for q in (0, 1)]
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= max_chars)
    found = texts.join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text")).collect()
    rows = sorted(found, key=lambda r: (zlib.crc32(f"8:{r['doc_id']}".encode()), str(r["doc_id"])))
    rows = [(r["quality"], r["text"].encode()) for r in rows]
    kinds = [[t for q, t in rows if q == k and t] for k in (0, 1)]
    if min(map(len, kinds)) < 4:
        return None
    # even rows of each class build dictionaries, odd ones the calibration
    bad, good = (_dictionary(t[::2]) for t in kinds)
    measure = Measure(good, bad)
    x = np.array([measure(t) for k in (0, 1) for t in kinds[k][1::2]])
    y = np.concatenate([np.full(len(kinds[k][1::2]), float(k)) for k in (0, 1)])
    centre, scale = float(x.mean()), max(float(x.std()), 1e-6)
    # weigh the classes by their shares among all labels, so that scores are calibrated
    total = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    share = np.where(y == 1, total[1] / (y == 1).sum(), total[0] / (y == 0).sum())
    curve = np.column_stack([np.ones(len(x)), np.clip((x - centre) / scale, -6, 6)])
    return Model(good, bad, _logistic(curve, y, share * len(y) / share.sum()).tolist(), centre, scale)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        measure = Measure(model.good, model.bad) if model else None
        for batch in batches:
            if model and batch.num_rows:
                p = model.probability(np.array([measure(t.as_buffer()) if t.is_valid else 0.0 for t in batch.column(2)]))
            else:
                p = np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(p, 9))], names=["doc_id", "held_out", "score"])

    told = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = told.mapInArrow(run, T.StructType([told.schema["doc_id"], told.schema["held_out"], T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
