"""Exact line deduplication, guided by two Bloom filters.

A line's key is the line without \\x20, \\x09-\\x0D at both ends and with A-Z in lower case.
Keys of at least MIN_CHARS code points that at least two documents hold lose all their lines
but those of the smallest doc_id holding them.

Two filters, once-seen and twice-seen, are built where the rows lie. A task enters each of
its documents' distinct keys: a key already in `once` enters `twice`. Filters merge without
losing a repeat: once = a.once | b.once, twice = a.twice | b.twice | (a.once & b.once). So
a key of two documents is always in `twice`, and the rest mostly is not. Only suspected keys
shuffle, as SHA-256 digests reduced to (digest, least id, greatest id) before they move; the
exact counts decide. The filters' size follows the number of lines up to a bound; with
more lines more unique keys are suspected and shuffled, and results stay the same.

Defined results: null or empty text is one empty line. Rows sharing a doc_id are one
document: a key in several of them alone is no repeat, and all of them keep it; each gets the keys
of its own text alone. A null doc_id sorts after every other id, and all null ids count as one document.
Other columns, whatever their names, pass through `line_dedup` untouched, save that n_lines and n_dropped
of the input give way to the counts made here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from relsift.llm import _bloom as bloom
from relsift.llm import _text as T
from relsift.llm._session import column, written

MIN_CHARS = 10
STRIPPED = b" \t\n\x0b\x0c\r"
NULL_ID = (1 << 63) - 1


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """(lines, keys); a key too short to count is empty."""
    lines = text.split(b"\n")
    keys = [x.strip(STRIPPED).lower() for x in lines]
    return lines, [k if len(k) >= MIN_CHARS and T.code_points(k) >= MIN_CHARS else b"" for k in keys]


def distinct_hashes(text: bytes) -> np.ndarray:
    keys = {k for k in line_keys(text)[1] if k}
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def twice_seen(documents: DataFrame, bits: int) -> np.ndarray:
    """The packed twice-seen filter of the documents' line keys."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = bloom.Seen(bits)
        for b in batches:
            texts = T.as_bytes(b.column("text"))
            for lo, hi in T.slices(texts):
                seen.enter(np.concatenate([distinct_hashes(t) for t in texts[lo:hi]]))
        yield from seen.segments()

    return bloom.merged(documents.select("text").mapInArrow(build, bloom.SCHEMA), bits, "twice")


def _keyed(documents: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text, row, more): row is the text's hash, so that rows that share an id meet their own lines alone."""
    text = F.col("text").cast("string")
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"), *more)


def repeats(documents: DataFrame, bits: int | None = None) -> DataFrame:
    """(doc_id, row, drops): for each text that loses lines, the digests of the keys it loses."""
    spark = documents.sparkSession
    docs = _keyed(documents)
    if bits is None:
        n = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0]
        bits = bloom.bits_for(int(n or 0))
    shared = spark.sparkContext.broadcast(twice_seen(docs, bits))  # at most bloom.MAX_BITS / 8 bytes

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for b in batches:
            ids, rows, digests = [], [], []
            for i, row, text in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), T.as_bytes(b.column("text"))):
                keys = list({k for k in line_keys(text)[1] if k})
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
                for k in np.flatnonzero(bloom.contains(twice, hashes)) if keys else ():
                    ids.append(i)
                    rows.append(row)
                    digests.append(hashlib.sha256(keys[k]).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "row", "digest"])

    held = docs.mapInArrow(probe, "doc_id long, row long, digest binary")
    first = held.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").select("digest", "first_id")
    first = written(first, "confirmed")  # both sides of the join are then plain exchanges, of which Spark can split a hot key
    return held.join(first.hint("merge"), "digest").where("doc_id > first_id").groupBy("doc_id", "row").agg(F.collect_set("digest").alias("drops"))


def line_dedup(documents: DataFrame, bits: int | None = None, counts: bool = True) -> DataFrame:
    """The documents with text (repeated lines gone), n_lines before, and n_dropped, beside all other columns; without
    counts, the documents' own columns alone, whatever their names."""
    made = ("n_lines", "n_dropped") if counts else ()
    others = [c for c in documents.columns if c not in ("text", *made)]
    packed = _keyed(documents, F.struct(*map(column, others)).alias("rest"))
    joined = packed.join(repeats(documents, bits).hint("shuffle_hash"), ["doc_id", "row"], "left").select("rest", "text", "drops")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines_before, dropped = [], [], []
            for text, drop in zip(T.as_bytes(b.column("text")), b.column("drops").to_pylist()):
                if not drop:
                    texts.append(text)
                    lines_before.append(text.count(b"\n") + 1)
                    dropped.append(0)
                    continue
                drop = set(drop)
                lines, keys = line_keys(text)
                kept = [x for x, k in zip(lines, keys) if not (k and hashlib.sha256(k).digest() in drop)]
                texts.append(b"\n".join(kept))
                lines_before.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([b.column("rest"), T.strings(texts), pa.array(lines_before, pa.int64()), pa.array(dropped, pa.int64())], ["rest", "text", "n_lines", "n_dropped"])

    out = joined.mapInArrow(cut, StructType([joined.schema["rest"]]).add("text", "string").add("n_lines", "long").add("n_dropped", "long"))
    ordered = [F.col("text") if c == "text" else column(c, "rest") for c in documents.columns if c in ("text", *others)]
    return out.select(*ordered, *made)
