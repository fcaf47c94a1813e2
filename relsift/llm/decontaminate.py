"""Benchmark decontamination with a distributed positional inverted index.

Words are runs of ASCII digits, ASCII letters (A-Z lower-cased) and non-ASCII characters.
An item's windows are its runs of WINDOW words; an item of fewer words, but not none, is one
window. The steps:

1. Document counts of the benchmark's terms over all documents, reduced in each task first.
2. For each window, its RAREST terms by those counts; a window with a term that no document
   has cannot occur and is left out. A window that several items have is one, and its items are attached last.
3. The index: postings (term, doc_id, row, positions) of the chosen terms in all documents, row being the
   text's hash, stored as a table. Tasks learn which terms are wanted from a bit map of a fixed size
   (2 MB), which may let a term too many through and never one too few.
4. Each window's lists, shifted by its terms' offsets, are intersected from the rarest term
   on: what is left are (window, doc_id, start).
5. An exact check of the few candidates on the documents' words, by 128-bit digests. Items are joined to windows that passed it, and
   never travel with candidates.

Documents meet their candidates by doc_id, so a passage that very many documents hold costs
each of them a short list. Nothing is paired document by document.

Defined results: null and empty texts have no words and no hits; items without words or with
a null id have no windows; equal item_ids are one item. Rows sharing a doc_id, or without one, are judged
each on its own text, by which they meet their candidates too. An empty benchmark hits nothing. Other columns
pass through `decontaminated`, save that a column leak of the input gives way to the one made here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from relsift.llm import _bloom as bloom
from relsift.llm import _text as T
from relsift.llm._session import column, written

WINDOW = 10
RAREST = 2
NULL_ID = -(1 << 63)


def term_hash(words: T.Words) -> np.ndarray:
    return words.hashes()[0]


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, n, digest, terms): the windows of every item, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column("item_id").to_pylist(), T.as_bytes(b.column("text"))):
                words = T.Words([text.lower()], T.NON_WORD)
                if item is None or not len(words):
                    continue
                h = term_hash(words).view(np.int64)
                n = min(window, len(h))
                for at in range(len(h) - n + 1):
                    rows.append((item, n, digest(words, at, n), h[at : at + n].tolist()))
            for lo in range(0, len(rows), 4096):
                item, n, d, terms = zip(*rows[lo : lo + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(n, pa.int32()), pa.array(d), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "n", "digest", "terms"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id string, n int, digest binary, terms array<long>").dropDuplicates(["item_id", "digest"])


def digest(words: T.Words, at: int, n: int) -> bytes:
    """Digest of n words from the given one on, whatever stands between them."""
    return xxhash.xxh3_128_digest(b" ".join([words.data[a:z] for a, z in zip(words.starts[at : at + n], words.ends[at : at + n])]))


def _texts(documents: DataFrame, *more: Column) -> DataFrame:
    text = F.col("text").cast("string")
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"), *more)


def document_counts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): in how many rows of documents each of the terms stands."""
    shared = documents.sparkSession.sparkContext.broadcast(bloom.bit_map(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = T.as_bytes(b.column("text"))
            seen, counts = [], []
            for lo, hi in T.slices(texts):
                words = T.Words([t.lower() for t in texts[lo:hi]], T.NON_WORD)
                h, owner = term_hash(words), words.owner()
                on = bloom.asked(shared.value, h)
                names, number = np.unique(h[on], return_inverse=True)
                pairs = np.unique(number.astype(np.int64) << 32 | owner[on])
                seen.append(names)
                counts.append(np.bincount(pairs >> 32, minlength=len(names)))
            if seen:
                names, number = np.unique(np.concatenate(seen), return_inverse=True)
                total = np.bincount(number, weights=np.concatenate(counts), minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(total)], ["term", "df"])

    return _texts(documents).select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def positional_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, doc_id, row, positions) of the terms (and of few others) in all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(bloom.bit_map(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
            texts = T.as_bytes(b.column("text"))
            for lo, hi in T.slices(texts):
                words = T.Words([t.lower() for t in texts[lo:hi]], T.NON_WORD)
                h, owner = term_hash(words), words.owner()
                at = np.flatnonzero(bloom.asked(shared.value, h))
                if not len(at):
                    continue
                at = at[np.lexsort((h[at], owner[at]))]
                opens = np.flatnonzero(np.concatenate([[True], (h[at][1:] != h[at][:-1]) | (owner[at][1:] != owner[at][:-1])]))
                positions = T.ragged((at - words.first[owner[at]]).astype(np.int32), np.append(opens, len(at)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(h[at][opens].view(np.int64)), *(pa.array(x[lo:hi][owner[at][opens]]) for x in (ids, rows)), positions], ["term", "doc_id", "row", "positions"])

    return _texts(documents).mapInArrow(run, "term long, doc_id long, row long, positions array<int>")


def rarest_terms(windows: DataFrame, counts: DataFrame, most: int = RAREST, absent: int = 0) -> DataFrame:
    """(digest, n, term, offset, rank, of, found): each window's terms from the rarest on, of those that occur.
    All must occur, or all but `absent` in windows of more than two words; found says how many do."""
    once = windows.groupBy("digest").agg(F.first("n").alias("n"), F.first("terms").alias("terms"))
    spread = once.select("digest", "n", F.posexplode("terms").alias("offset", "term"))
    known = spread.join(counts, "term")
    w = Window.partitionBy("digest")
    ranked = known.withColumn("found", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("df", "offset")))
    kept = ranked.where(f"found >= n - if(n > 2, {absent}, 0) and rank <= {most}")
    return kept.select("digest", "n", "term", "offset", "rank", F.least("found", F.lit(most)).cast("int").alias("of"), F.col("found").cast("int").alias("found"))


def starts(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """(digest, n, doc_id, row, start): offset-adjusted lists of a window's chosen terms, intersected."""
    shifted = index.join(chosen, "term").select("digest", "n", "of", "doc_id", "row", "rank", F.explode("positions").alias("position"), "offset").select("digest", "n", "of", "doc_id", "row", "rank", (F.col("position") - F.col("offset")).alias("start")).where("start >= 0")
    met = shifted.groupBy("digest", "n", "of", "doc_id", "row", "start").agg(F.bit_or(F.expr("shiftleft(1, rank - 1)")).alias("met"))
    return met.where(F.bit_count("met") == F.col("of")).select("digest", "n", "doc_id", "row", "start")


def owners(windows: DataFrame) -> DataFrame:
    """(digest, item_id), each once."""
    return windows.select("digest", "item_id").distinct()


def candidates(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, row, found): each text's list (n, digest, start) of windows that the index places in it, at most its words' number."""
    counts = document_counts(documents, windows.select(F.explode("terms").alias("term")))
    chosen = written(rarest_terms(windows, counts), "chosen")
    index = written(positional_index(documents, chosen.select("term")), "index")
    return starts(index, chosen).groupBy("doc_id", "row").agg(F.collect_list(F.struct("n", "digest", "start")).alias("found"))


def proximity(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, terms: int = 4, slop: int = 3) -> DataFrame:
    """Near matches (doc_id, item_id, digest, start, n_terms): n_terms of a window's `terms` rarest words that occur
    stand within slop of their places, all but one at least; all, if one of the window's words occurs nowhere.

    Places are counted from the rarest word, and where it does not stand from the second, so either may be
    the one that is missing. Of windows with one or two chosen words the rarest must stand. Rows sharing a
    doc_id are matched each on its own text; rows with equal id and text give one match.
    """
    windows = written(item_windows(benchmark, window), "windows")
    counts = document_counts(documents, windows.select(F.explode("terms").alias("term")))
    chosen = written(rarest_terms(windows, counts, terms, absent=1), "chosen")
    index = written(positional_index(documents, chosen.select("term")), "index")
    may_miss = F.when(F.col("found") == F.col("n"), 1).otherwise(0)
    placed = index.join(chosen, "term").select("digest", F.greatest(F.col("of") - may_miss, F.lit(1)).alias("least"), "of", "doc_id", "row", "rank", "offset", F.explode("positions").alias("position"))
    placed = placed.select("digest", "least", "of", "doc_id", "row", "rank", (F.col("position") - F.col("offset")).alias("at"))
    anchors = placed.where("rank = 1 or (rank = 2 and of > 2 and least < of)").select("digest", "least", "doc_id", "row", F.col("rank").alias("by"), F.col("at").alias("start")).distinct()
    near = anchors.join(placed.drop("least", "of"), ["digest", "doc_id", "row"]).where(F.abs(F.col("at") - F.col("start")) <= slop)
    met = near.groupBy("doc_id", "row", "digest", "start", "by", "least").agg(F.bit_count(F.bit_or(F.expr("shiftleft(1, rank - 1)"))).cast("long").alias("n_terms"), F.min("rank").alias("first"))
    met = met.where("n_terms >= least and first = by").join(owners(windows), "digest")
    return met.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "item_id", "digest", "start", "n_terms")


HITS = "struct<n_words: long, n_hit: long, windows: array<binary>>"


def verified(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """(whole, hits): all columns of documents, and as HITS says the words, those hit, and the windows that occur, each once.

    Texts meet their candidates once. Of a slice of texts the candidates are flat arrays; items play no part here.
    """
    packed = _texts(documents, F.struct(*map(column, documents.columns)).alias("whole")).drop("text")
    joined = packed.join(candidates(documents, windows).hint("shuffle_hash"), ["doc_id", "row"], "left").select("whole", F.col("whole.text").cast("string").alias("text"), "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = T.as_bytes(b.column("text"))
            for lo, hi in T.slices(texts):
                words = T.Words([t.lower() for t in texts[lo:hi]], T.NON_WORD)
                found = b.column("found").slice(lo, hi - lo)
                flat, sizes = found.flatten(), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                n, start = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "start"))
                digests, owner = flat.field("digest"), np.repeat(np.arange(hi - lo), sizes)
                at = words.first[owner] + start
                inside = at + n <= words.first[owner + 1]
                true = np.array([bool(ok) and digest(words, i, k) == digests[j].as_py() for j, (ok, i, k) in enumerate(zip(inside.tolist(), at.tolist(), n.tolist()))], bool)
                # words from the first to the last of a window, by differences
                marks = np.zeros(len(words) + 1, np.int64)
                np.add.at(marks, at[true], 1)
                np.add.at(marks, (at + n)[true], -1)
                hit = np.concatenate([[0], np.cumsum(np.cumsum(marks[:-1]) > 0)])
                kept = digests.filter(pa.array(true))
                # a window that stands in a text twice is told once
                number = kept.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(kept) else np.empty(0, np.int64)
                _, once = np.unique(owner[true] * (len(kept) + 1) + number, return_index=True)
                bounds = np.searchsorted(owner[true][once], np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), kept.take(pa.array(once)).cast(pa.binary()))
                hits = pa.StructArray.from_arrays([pa.array(np.diff(words.first).astype(np.int64)), pa.array(np.diff(hit[words.first]).astype(np.int64)), lists], ["n_words", "n_hit", "windows"])
                yield pa.RecordBatch.from_arrays([b.column("whole").slice(lo, hi - lo), hits], ["whole", "hits"])

    return joined.mapInArrow(run, StructType([joined.schema["whole"]]).add("hits", DataType.fromDDL(HITS)))


def leaks(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, n_items, items_sha256) of each document: items are sorted, and joined to what occurs at the very end."""
    windows = written(item_windows(benchmark, window), "windows")
    hits = verified(documents.select("doc_id", "text"), windows)
    found = written(hits.select("whole.doc_id", "hits.*").withColumn("id", F.monotonically_increasing_id()), "hits")
    named = found.select("id", F.explode("windows").alias("digest")).join(owners(windows), "digest").groupBy("id").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.join(named, "id", "left").select("doc_id", "n_words", "n_hit", items.alias("items"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, leak: str = "leak") -> DataFrame:
    """The documents with all their columns, and a struct named as `leak` says: n_words, n_hit, and windows, digests of those that occur."""
    out = verified(documents.select(*[column(c) for c in documents.columns if c != leak]), written(item_windows(benchmark, window), "windows"))
    return out.select(*[column(c, "whole") for c in documents.columns if c != leak], F.col("hits").alias(leak))
