"""Quality scores from a support vector machine on naive Bayes features (NBSVM).

Features are n-grams, present or absent: every run of three bytes of the text, and every
pair of neighbouring words, the words reduced to their shape (runs of capitals, small
letters, digits and other signs, capped in length) so that a pair says how a text is
written and not what about, and which words of four in a row repeat the one before. An indicator is scaled by its class log-count ratio
r = ln((p/|p|) / (q/|q|)), where p and q are the smoothed document counts among good and
bad samples; dual coordinate descent then fits a linear model to the scaled vectors with
hinge loss, classes weighing alike in sum.

The score is a logistic curve of the margin, placed so that margin zero scores THRESHOLD:
what the machine calls good scores THRESHOLD or more.

Defined results: null and empty texts have no features and score from the intercept alone.
Repeated rows score alike, each in its own row. Without labels of both classes nothing can
be told and every text scores as the majority class of the sample (good if there is none).
Columns of the input other than doc_id and text are neither read nor carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relsift.llm import _text as T
from relsift.llm._labels import labelled_sample

BITS = 18
#: At most about this many labelled rows are learnt from.
FIT_ROWS = 8_000
THRESHOLD = 0.7
SMOOTHING = 1.0
#: A text's scaled vector is divided by its length, so that C means the same for all lengths.
COST = 1.0
STEEPNESS = 4.0

_SHAPE = np.zeros(256, np.uint64)
for _b in range(256):
    _SHAPE[_b] = 1 if 65 <= _b <= 90 else 2 if 97 <= _b <= 122 or _b >= 128 else 3 if 48 <= _b <= 57 else 4 if _b in b".,;:" else 5 + _b


@dataclass(frozen=True)
class Linear:
    """One weight for each slot (ratio times coefficient), the ratios for the norm, and the intercept."""

    weights: np.ndarray
    ratios: np.ndarray
    intercept: float


class Slots:
    """Distinct feature slots of one text, without a sort: the last writer of each slot stands for it."""

    def __init__(self):
        self.last = np.zeros(1 << BITS, np.int64)

    def of(self, text: bytes) -> np.ndarray:
        parts = []
        b = np.frombuffer(text, np.uint8)
        if len(b) >= 3:
            code = b.astype(np.uint32)
            code = (code[:-2] << np.uint32(16)) | (code[1:-1] << np.uint32(8)) | code[2:]
            parts.append((code * np.uint32(2654435761)) >> np.uint32(32 - BITS))
        words = T.Words([text], T.BLANKS)
        if len(words):
            size = np.minimum(words.ends - words.starts, 7).astype(np.uint64)
            shape = (_SHAPE[words.bytes[words.starts]] << np.uint64(17)) | (_SHAPE[words.bytes[words.ends - 1]] << np.uint64(8)) | (_SHAPE[words.bytes[(words.starts + words.ends) // 2]] << np.uint64(26)) | size
            with np.errstate(over="ignore"):
                pair = T.mix(shape[:-1] * np.uint64(0xD6E8FEB86659FD93) + shape[1:] + np.uint64(1))
            parts.append((pair >> np.uint64(64 - BITS)).astype(np.uint32))
            (h,) = words.hashes()
            same = (h[1:] == h[:-1]).astype(np.uint64)
            if len(same) > 2 and same.any():
                runs = same[:-2] * np.uint64(4) + same[1:-1] * np.uint64(2) + same[2:]
                parts.append((T.mix(runs[runs > 0] + np.uint64(1 << 40)) >> np.uint64(64 - BITS)).astype(np.uint32))
        if not parts:
            return np.empty(0, np.int64)
        slots = np.concatenate(parts).astype(np.int64)
        at = np.arange(len(slots))
        self.last[slots] = at
        return slots[self.last[slots] == at]


def descend(vectors: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1-loss linear SVM; the intercept is a feature that is always 1.

    y: +1 or -1. Each step minimises the dual exactly in one multiplier, kept within [0, cost].
    """
    w, b = np.zeros(1 << BITS), 0.0
    multiplier = np.zeros(len(y))
    norm = np.array([float(v @ v) + 1.0 for _, v in vectors])
    order = np.random.default_rng(1)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            at, v = vectors[i]
            gradient = y[i] * (float(w[at] @ v) + b) - 1.0
            new = min(max(multiplier[i] - gradient / norm[i], 0.0), cost[i])
            step = new - multiplier[i]
            if step:
                multiplier[i] = new
                w[at] += step * y[i] * v
                b += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def train(examples: list[tuple[np.ndarray, int]]) -> Linear:
    """Class log-count ratios, then descent on the scaled indicators."""
    y = np.array([1 if label else -1 for _, label in examples])
    if not len(y) or abs(int(y.sum())) == len(y):
        zero = np.zeros(1 << BITS)
        return Linear(zero, zero, float(-1 if len(y) and y[0] < 0 else 1))
    counts = {k: np.full(1 << BITS, SMOOTHING) for k in (1, -1)}
    for (at, _), k in zip(examples, y):
        counts[k][at] += 1
    ratios = np.log((counts[1] / counts[1].sum()) / (counts[-1] / counts[-1].sum()))
    vectors = []
    for at, _ in examples:
        v = ratios[at]
        vectors.append((at, v / max(float(np.sqrt(v @ v)), 1e-9)))
    share = {k: len(y) / (2.0 * max(1, int((y == k).sum()))) for k in (1, -1)}
    w, b = descend(vectors, y, np.array([COST * share[k] for k in y]))
    return Linear(w * ratios, ratios, b)


def fit(sample: DataFrame) -> Linear:
    """Fit on rows (doc_id, text, y). Features are made where the rows lie; one task learns from the bounded sample."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for batch in batches:
            packed = [slots.of(t).astype("<i4").tobytes() for t in T.as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(packed, pa.binary())], ["doc_id", "y", "slots"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], r[2]))
        m = train([(np.frombuffer(s, "<i4"), y) for _, y, s in rows])
        yield pa.RecordBatch.from_arrays([pa.array([x.astype("<f8").tobytes()]) for x in (m.weights, m.ratios)] + [pa.array([m.intercept])], ["weights", "ratios", "intercept"])

    made = sample.mapInArrow(extract, "doc_id long, y int, slots binary")
    got = made.repartition(1).mapInArrow(learn, "weights binary, ratios binary, intercept double").first()
    if got is None:
        return train([])
    return Linear(np.frombuffer(got.weights, "<f8"), np.frombuffer(got.ratios, "<f8"), got.intercept)


def scorer(model: Linear):
    """Score one UTF-8 text."""
    slots = Slots()
    squares = model.ratios**2
    shift = np.log(THRESHOLD / (1 - THRESHOLD))

    def score(text: bytes) -> float:
        at = slots.of(text)
        margin = model.intercept
        if len(at):
            margin += float(model.weights[at].sum()) / max(float(np.sqrt(squares[at].sum())), 1e-9)
        return float(1.0 / (1.0 + np.exp(-np.clip(STEEPNESS * margin + shift, -35, 35))))

    return score


def quality(documents: DataFrame, labels: DataFrame, use: Column, bound: int = FIT_ROWS) -> DataFrame:
    """Fit on the labelled documents that `use` admits and score all documents: (doc_id, score)."""
    model = fit(labelled_sample(documents, labels, "quality", use, bound))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights and ratios, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([score(t) for t in T.as_bytes(batch.column("text"))], pa.float64())], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
