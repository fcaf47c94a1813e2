"""Toxicity scores from FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features of a text (each counts once, present or absent), over its words in lower case:
the word, its first four and first five bytes (stems of inflected words), each pair of
neighbours, and each pair with one word between (skip-gram). All are hashed to 2**BITS
slots. The optimiser keeps a rate for each coordinate and an L1 penalty, so most slots
end at exactly zero; the model is the short list of the others, whose size is bounded by
the number of slots and in practice by the sample.

Defined results: null and empty texts score the model's intercept. Repeated rows score
alike, each in its own row. Where the sample lacks a class, or there is none, the model is
empty and every text scores a hair under 0.5: nothing is rejected. `scored` reads doc_id and
text alone; `rejecting` passes all columns on.
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

BITS = 20
STEMS = (4, 5)
#: At most about this many labelled rows are learnt from.
FIT_ROWS = 12_000
#: What a model without labels says.
NO_MODEL = -1e-3


@dataclass(frozen=True)
class Sparse:
    """Non-zero weights by slot, and the intercept."""

    slots: np.ndarray
    weights: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.slots] = self.weights
        return out


def occurrences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text number) of every feature occurrence, repeats included."""
    words = T.Words([t.lower() for t in texts], T.NON_WORD)
    owner = words.owner().astype(np.int32)
    h, *stems = words.hashes(*STEMS)
    kinds = [(h, owner)]
    size = words.ends - words.starts
    for cut, stem in zip(STEMS, stems):
        longer = size > cut
        kinds.append((stem[longer] + T.U64(cut), owner[longer]))
    with np.errstate(over="ignore"):
        for gap in (1, 2):
            if len(h) > gap:
                near = owner[gap:] == owner[:-gap]
                pair = T.mix(h[:-gap] * T.U64(0xD6E8FEB86659FD93) + h[gap:] + T.U64(gap))
                kinds.append((pair[near], owner[gap:][near]))
    slot = np.concatenate([k >> T.U64(64 - BITS) for k, _ in kinds]).astype(np.int32)
    return slot, np.concatenate([o for _, o in kinds])


def distinct(slot: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each slot once a text: (slots, bounds), text i has slots[bounds[i]:bounds[i+1]]."""
    both = np.unique((owner.astype(np.int64) << BITS) | slot)
    return (both & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(both >> BITS, np.arange(n + 1))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*occurrences(texts), len(texts))


def ftrl(examples: list[tuple[np.ndarray, int]], alpha=0.5, beta=1.0, l1=4.0, l2=1.0, epochs=4) -> Sparse:
    """Follow the regularised leader, per coordinate.

    Each coordinate keeps z (gradients, corrected for its moving rate) and n (squared
    gradients); its weight is zero while |z| <= l1. The intercept, updated alike, has no penalty.
    """
    if len({y for _, y in examples}) < 2:
        return Sparse(np.empty(0, np.int64), np.empty(0), NO_MODEL)
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    order = np.random.default_rng(1)

    def weights(at) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            at, y = examples[i]
            w = weights(at)
            b = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            more = n[at]
            z[at] += g - (np.sqrt(more + g * g) - np.sqrt(more)) / alpha * w
            n[at] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * b
            bias_n += g * g
    w = weights(slice(None))
    slots = np.flatnonzero(w)
    return Sparse(slots, w[slots], float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha)))


def fit(sample: DataFrame) -> Sparse:
    """Fit on rows (doc_id, text, y). Features are made where the rows lie; one task learns from the bounded sample."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = T.as_bytes(batch.column("text"))
            for lo, hi in T.slices(texts):
                slots, bounds = features(texts[lo:hi])
                packed = [slots[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("y")[lo:hi], pa.array(packed, pa.binary())], ["doc_id", "y", "slots"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], r[2]))
        m = ftrl([(np.frombuffer(s, np.int32), y) for _, y, s in rows])
        yield pa.RecordBatch.from_arrays([pa.array([m.slots.astype("<i4").tobytes()]), pa.array([m.weights.astype("<f8").tobytes()]), pa.array([m.intercept])], ["slots", "weights", "intercept"])

    made = sample.mapInArrow(extract, "doc_id long, y int, slots binary")
    got = made.repartition(1).mapInArrow(learn, "slots binary, weights binary, intercept double").first()
    if got is None:
        return ftrl([])
    return Sparse(np.frombuffer(got.slots, "<i4"), np.frombuffer(got.weights, "<f8"), got.intercept)


def scorer(model: Sparse):
    """Score a list of UTF-8 texts."""
    dense = model.dense()
    active = dense != 0

    def score(texts: list[bytes]) -> np.ndarray:
        slot, owner = occurrences(texts)
        on = active[slot]  # most slots weigh nothing, so few are left to sort
        slots, bounds = distinct(slot[on], owner[on], len(texts))
        # summed text by text, so a score doesn't depend on its neighbours by a last digit
        total = np.bincount(np.repeat(np.arange(len(texts)), np.diff(bounds)), dense[slots], len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(total + model.intercept, -35, 35)))

    return score


def scored(documents: DataFrame, model: Sparse) -> DataFrame:
    """(doc_id, score) of every row, from its whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the number of slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for batch in batches:
            texts = T.as_bytes(batch.column("text"))
            for lo, hi in T.slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array(score(texts[lo:hi]))], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(documents: DataFrame, labels: DataFrame, use: Column, bound: int = FIT_ROWS) -> DataFrame:
    """Fit on the labelled documents that `use` admits and score all documents: (doc_id, score)."""
    return scored(documents, fit(labelled_sample(documents, labels, "toxic", use, bound)))


def rejecting(documents: DataFrame, labels: DataFrame, use: Column, threshold: float = 0.5, bound: int = FIT_ROWS) -> DataFrame:
    """The documents scored below threshold, with all their columns; no shuffle, the score is made beside the row."""
    model = documents.sparkSession.sparkContext.broadcast(fit(labelled_sample(documents, labels, "toxic", use, bound)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model.value)
        for batch in batches:
            texts = T.as_bytes(batch.column("text"))
            low = [score(texts[lo:hi]) < threshold for lo, hi in T.slices(texts)]
            if low:
                yield batch.filter(pa.array(np.concatenate(low)))

    return documents.mapInArrow(run, documents.schema)
