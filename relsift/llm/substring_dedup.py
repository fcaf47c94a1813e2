"""Repeated passages of SPAN words and more, found by seed and extend.

Seeds: every run of SEED words is hashed; the least hash among the runs within a window of
SPAN words is the window's anchor (winnowing with windows of SPAN - SEED + 1 runs). A window's
anchor depends on its words alone, so a passage of SPAN words has the same anchor wherever
it stands. Documents meet on anchors: those of one document alone are done with.

Extend: a shared anchor is extended to the left and to the right over all the windows that it is the
anchor of, which follow each other. Occurrences whose extensions are the same words are one class,
and all but its least document's are repeats as a whole. Where an anchor has several classes,
their extensions differ somewhere: the least document's occurrence of each is then extended by every
number of words to the left, and to the right by what SPAN words lack, and these extensions meet
one by one. Since equal windows have equal anchors, no other windows can be alike. Overlapping and
touching repeats of a document run together into maximal repeats, which are what is removed. No pair
of documents is ever formed: a passage held by very many costs each one row for each anchor.

Hashes of words and seeds only say where to look. What is taken for equal has equal 128-bit BLAKE2b
digests of the words themselves, joined by single blanks.

Between the passes travel Bloom filters of a bounded size, of shared anchors and of classes
to be extended step by step. They may let others through, which then meet nothing; they lose none.

Defined results: null and empty texts have no words. Windows are judged on the input. Rows
sharing a doc_id are one document: they don't repeat each other. A null doc_id sorts after
all others and all null ids are one document. Other columns pass through `substring_dedup`, save that
n_words and n_removed of the input give way to the counts made here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from relsift.llm import _bloom as bloom
from relsift.llm import _text as T
from relsift.llm._session import column, dropped, written

SPAN, SEED = 50, 25
NULL_ID = (1 << 63) - 1
SEED_BASE = 0x9E6C63D0876A9A47


def anchors(h: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The anchor of each window of span words: the least hash of the seeds in it."""
    low = T.windows(h, min(SEED, span), SEED_BASE)
    need, have = max(span - SEED, 0) + 1, 1
    if len(low) < need:
        return np.empty(0, T.U64)
    while have * 2 <= need:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(low) - (need - have)], low[need - have :]) if need > have else low


def whole_windows(words: T.Words, span: int) -> np.ndarray:
    """Numbers of the words at which a window starts that ends in the same text."""
    owner = words.owner()
    return np.flatnonzero(owner[: len(owner) - span + 1] == owner[span - 1 :]) if len(owner) >= span else np.empty(0, np.int64)


def _texts(documents: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))


def shared_anchors(texts: DataFrame, span: int) -> DataFrame:
    """(anchor): those of two documents and more."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, docs = b.column("doc_id").to_numpy(zero_copy_only=False), T.as_bytes(b.column("text"))
            for lo, hi in T.slices(docs):
                words = T.Words(docs[lo:hi], T.BLANKS)
                at = whole_windows(words, span)
                if not len(at):
                    continue
                low = anchors(words.hashes()[0], span)[at]
                of = words.owner()[at]
                new = np.concatenate([[True], (low[1:] != low[:-1]) | (of[1:] != of[:-1])])
                yield pa.RecordBatch.from_arrays([pa.array(low[new].view(np.int64)), pa.array(ids[lo:hi][of[new]])], ["anchor", "doc_id"])

    met = texts.mapInArrow(seeds, "anchor long, doc_id long").groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z"))
    return met.where("a < z").select("anchor")


class Occurrences:
    """The occurrences, in one slice of a batch, of the anchors that `known` admits.

    Each is a maximal run of n windows with one anchor, from word number `start` on, in text `of`
    of the slice; e holds the digest of the words of the whole run.
    """

    def __init__(self, docs: list[bytes], known, span: int):
        self.span = span
        self.words = words = T.Words(T.canonical(docs), T.BLANKS)
        at = whole_windows(words, span)
        low = anchors(words.hashes()[0], span)[at] if len(at) else np.empty(0, T.U64)
        owner = words.owner()[at]
        opens = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])])) if len(at) else np.empty(0, np.int64)
        some = known(low[opens])
        self.n = np.diff(np.append(opens, len(at)))[some]
        opens = opens[some]
        self.of, self.start, self.anchor = owner[opens], at[opens], low[opens]
        self.e = self.digests(self.start, self.n + span - 1)

    def digests(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Digests of runs of words, from number start on, size words each."""
        return T.digests(self.words.data, self.words.starts[start], self.words.ends[start + size - 1])

    def within(self, start: np.ndarray, of: np.ndarray) -> pa.Array:
        """Numbers of words counted from the start of their own text."""
        return pa.array((start - self.words.first[of]).astype(np.int32))


def _slices(batches: Iterator[pa.RecordBatch]):
    """(ids, rows, texts) of each slice of the batches."""
    for b in batches:
        ids, rows = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
        docs = T.as_bytes(b.column("text"))
        for lo, hi in T.slices(docs):
            yield ids[lo:hi], rows[lo:hi], docs[lo:hi]


def extensions(texts: DataFrame, filter_, span: int) -> DataFrame:
    """Occurrences of the anchors that the filter lets through, each with the digest of its extension."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, docs in _slices(batches):
            o = Occurrences(docs, lambda a: bloom.contains(filter_.value, a), span)
            yield pa.RecordBatch.from_arrays([pa.array(ids[o.of]), pa.array(rows[o.of]), o.within(o.start, o.of), pa.array(o.n.astype(np.int32)), pa.array(o.anchor.view(np.int64)), pa.array(o.e[:, 0]), pa.array(o.e[:, 1])], ["doc_id", "row", "start", "n", "anchor", "e1", "e2"])

    return texts.mapInArrow(extend, "doc_id long, row long, start int, n int, anchor long, e1 long, e2 long")


def class_key(anchor: np.ndarray, e1: np.ndarray, e2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        anchor, e1, e2, doc = (np.asarray(x).view(T.U64) for x in (anchor, e1, e2, doc))
        return T.mix(anchor * T.U64(3) + e1 * T.U64(5) + e2 * T.U64(7) + T.mix(doc))


def stepwise(texts: DataFrame, anchors_, classes_, span: int) -> DataFrame:
    """(doc_id, row, start, w1, w2): for the occurrences that the filter of classes lets through, the digests of all
    extensions of the anchor to the left and right that are span words long."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, docs in _slices(batches):
            o = Occurrences(docs, lambda a: bloom.contains(anchors_.value, a), span)
            some = bloom.contains(classes_.value, class_key(o.anchor, np.ascontiguousarray(o.e[:, 0]), np.ascontiguousarray(o.e[:, 1]), ids[o.of]))
            of, start, n = o.of[some], o.start[some], o.n[some]
            if not len(of):
                continue
            of = np.repeat(of, n)
            at = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            for lo in range(0, len(at), 1 << 16):
                a, f = at[lo : lo + (1 << 16)], of[lo : lo + (1 << 16)]
                w = o.digests(a, np.full(len(a), span))
                yield pa.RecordBatch.from_arrays([pa.array(ids[f]), pa.array(rows[f]), o.within(a, f), pa.array(w[:, 0]), pa.array(w[:, 1])], ["doc_id", "row", "start", "w1", "w2"])

    return texts.mapInArrow(split, "doc_id long, row long, start int, w1 long, w2 long")


def filter_of(keys: DataFrame, as_hash):
    """Broadcast Bloom filter of the rows' hashes; as_hash makes them from a batch."""
    bits = bloom.bits_for(keys.count())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bloom.Seen(bits)
        for b in batches:
            seen.enter(as_hash(b))
        yield from seen.segments()

    return keys.sparkSession.sparkContext.broadcast(bloom.merged(keys.mapInArrow(build, bloom.SCHEMA), bits, "once"))


def _column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).to_numpy(zero_copy_only=False).view(np.uint64)


def repeated_runs(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, row, start, n): runs of n windows that a smaller document holds too; row is the text's hash."""
    texts = _texts(documents)
    seeds = written(shared_anchors(texts, span), "anchors")
    known = filter_of(seeds, lambda b: _column(b, "anchor"))
    found = written(extensions(texts, known, span), "extensions")
    dropped(seeds)
    key = ["anchor", "e1", "e2"]
    alike = written(found.groupBy(*key).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")), "alike")
    whole = found.join(alike.where("a < z").select(*key, "a").hint("merge"), key).where("doc_id > a").select("doc_id", "row", "start", "n")
    # tables are written before joins, so that both sides are plain exchanges, of which Spark can split a hot key
    several = written(alike.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "several")
    picked = written(alike.join(several.hint("merge"), "anchor").select(*key, "a"), "picked")
    classes_ = filter_of(picked, lambda b: class_key(*(_column(b, c) for c in (*key, "a"))))
    windows = written(stepwise(texts, known, classes_, span), "stepwise")
    dropped(several, picked)
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("w1", "w2", "a")
    first = written(first, "first")
    single = windows.join(first.hint("merge"), ["w1", "w2"]).where("doc_id > a").select("doc_id", "row", "start", F.lit(1).alias("n"))
    return whole.unionByName(single)


def covered(runs: list[dict], n_words: int, span: int = SPAN) -> np.ndarray:
    """Flags of the words that the runs of windows cover."""
    edge = np.zeros(n_words + 1, np.int64)
    start = np.array([r["start"] for r in runs])
    np.add.at(edge, start, 1)
    np.add.at(edge, start + np.array([r["n"] for r in runs]) + span - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def merged_repeats(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, row, repeats): the maximal repeats of each text that has any, as structs of start and end, end exclusive."""
    # a set: the rows that share an id and a text have the same runs, each of which counts once
    runs = repeated_runs(documents, span).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for one in b.column("runs").to_pylist():
                flags = covered(one, max(r["start"] + r["n"] for r in one) + span - 1, span)
                edges = np.flatnonzero(np.diff(flags, prepend=False, append=False)).tolist()
                out.append([{"start": a, "end": z} for a, z in zip(edges[::2], edges[1::2])])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(out, kind)], ["doc_id", "row", "repeats"])

    return runs.mapInArrow(join, "doc_id long, row long, repeats array<struct<start: int, end: int>>")


def maximal_repeats(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, row, start, end): maximal runs of repeated words, end exclusive; row is the text's hash."""
    return merged_repeats(documents, span).select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "row", F.inline("repeats"))


def substring_dedup(documents: DataFrame, span: int = SPAN) -> DataFrame:
    """The documents with text (kept words, joined by one blank), n_words before and n_removed, beside all other columns."""
    found = merged_repeats(documents, span)
    others = [c for c in documents.columns if c not in ("text", "n_words", "n_removed")]
    text = F.col("text").cast("string")
    packed = documents.select(F.struct(*map(column, others)).alias("rest"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("row"))
    joined = packed.join(found.hint("shuffle_hash"), ["doc_id", "row"], "left").select("rest", "text", "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_words, n_removed = [], [], []
            for text, repeats in zip(T.as_bytes(b.column("text")), b.column("repeats").to_pylist()):
                words = text.split()
                kept, at = [], 0
                for r in repeats or ():
                    kept += words[at : r["start"]]
                    at = r["end"]
                kept += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept))
            yield pa.RecordBatch.from_arrays([b.column("rest"), T.strings(texts), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["rest", "text", "n_words", "n_removed"])

    kind = StructType([joined.schema["rest"]]).add("text", "string").add("n_words", "long").add("n_removed", "long")
    out = joined.mapInArrow(cut, kind)
    ordered = [F.col("text") if c == "text" else column(c, "rest") for c in documents.columns if c in ("text", *others)]
    return out.select(*ordered, "n_words", "n_removed")
