"""Collocations of each language by contiguous pattern growth.

Texts, A-Z in lower case, are cut at punctuation and line ends into pieces, and pieces at blanks and tabs into words. A
phrase of 2 to LONGEST words is a candidate if it occurs LEAST times or more within pieces. The steps:

1. Words are counted by language, exactly: frequent words are the first prefixes, and all words together are n.
2. Pairs of neighbouring frequent words are counted by a 64-bit hash. Which pairs are frequent is told to tasks by a bit
   map of a fixed size (8 MB): it may let a pair too many through and never one too few.
3. Phrases of three words or more, whose pairs are all frequent, are counted in a sketch of a fixed number of slots (16 MB a
   task). What shares a slot adds up, so a map (2 MB) of slots with LEAST or more may let a phrase too many through and never
   one too few.
4. Projection: each occurrence of a frequent prefix of two words points at what follows it, up to LONGEST words and as far as
   pairs are frequent and longer phrases may be: what is read no further takes no part in any candidate. Tasks cannot follow
   pointers into other tasks' texts, so a pointer is the words it reads; equal ones become one row with a weight, in each
   task and then in all. So rows follow the frequent phrases and not the ways in which frequent pairs are strung together.
5. Growth: the projections are sorted, so that those of a prefix stand together, and dealt by range: a task grows its
   prefixes to the right, depth first, a longer prefix being a narrower interval of rows. A prefix with very many
   projections lies in several ranges, whose sums are added; nothing is held but a batch.
6. Counts of parts meet the candidates cut after each word; a candidate inside a longer one that occurs as often goes. It is
   enough to look one word further: counts never grow with length, so if a longer phrase occurs as often, all between do.

Counts and products are exact: decimals of 38 digits. Defined results: null text is empty; a null lang is `und`; rows count
as they are, also with equal or null doc_ids. Bytes that aren't UTF-8 are kept as they are. Equal scores go by a, then by phrase in byte order. Other columns of
documents don't matter. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relsift.llm import _bloom as bloom
from relsift.llm import _text as T
from relsift.llm._session import written
from relsift.operators.batches import slices

LEAST = 100
LONGEST = 5
TOP = 2000
#: Bits of the maps of frequent words and pairs: 8 MB each.
MAP_BITS = 26
#: Slots of the sketch of longer phrases are 2 to this power; a row of it holds _PART of them.
SKETCH_BITS = 24
_PART = 1 << 12
ENDS = T.separators(lambda b: b not in b".,;:!?\n\x0b\x0c\r")
_BETWEEN = ENDS | T.separators(lambda b: b not in b"\x20\x09")
_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: A batch of distinct words is sent on at about so many; pairs, which are plain numbers, at more.
_HELD = 1 << 17
#: Texts of an Arrow batch are taken up so many bytes at a time.
_TAKEN = 8 << 20


class Pieces:
    """Words of texts of one language, and which of them follow the word before in the same piece."""

    def __init__(self, texts: list[bytes], salt: int):
        self.words = T.Words([t.lower() for t in texts], _BETWEEN)
        self.h = T.mix(self.words.hashes()[0] ^ np.uint64(salt))
        breaks = np.concatenate([[0], np.cumsum(ENDS[self.words.bytes])])
        # the first word of a text comes after the line end that is set between texts
        self.joined = np.diff(breaks[self.words.starts], prepend=-1) == 0

    def __len__(self) -> int:
        return len(self.words)

    def pairs(self) -> np.ndarray:
        """Hash of each word and the next; what doesn't continue is not to be used."""
        with np.errstate(over="ignore"):
            return T.mix(self.h[:-1] * _PAIR + self.h[1:])

    def phrases(self, words: np.ndarray, pairs: np.ndarray, longest: int, longer: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of 2, 3, ... `longest` words: flags of the words that begin a phrase without infrequent parts, and the phrases' hashes.

        Parts are looked up in the maps of frequent words, pairs and, where it is given, longer phrases.
        """
        often, h = bloom.asked(words, self.h), self.pairs()
        fine = self.joined[1:] & often[1:] & often[:-1] & bloom.asked(pairs, h)
        yield fine, h
        for n in range(3, longest + 1):
            with np.errstate(over="ignore"):
                h = T.mix(h[:-1] * _PAIR + self.h[n - 1 :])
            fine = fine[:-1] & fine[1:]
            if longer is not None:
                fine &= bloom.asked(longer, h)
            yield fine, h

    def same_bytes(self, other: np.ndarray) -> np.ndarray:
        """Of each word, if its bytes are those of the word that other names."""
        size = self.words.ends - self.words.starts
        same = size == size[other]
        same[other == np.arange(len(other))] = True
        on = np.flatnonzero(same & (other != np.arange(len(other))))
        for k in range(32):  # a byte of all words at once, then what few words are longer
            on = on[size[on] > k]
            equal = self.words.bytes[self.words.starts[on] + k] == self.words.bytes[self.words.starts[other[on]] + k]
            same[on[~equal]] = False
            on = on[equal]
        data, starts, ends = self.words.data, self.words.starts, self.words.ends
        for i in on[size[on] > 32].tolist():
            same[i] = data[starts[i] : ends[i]] == data[starts[other[i]] : ends[other[i]]]
        return same

    def texts_of(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Words first..last of each, joined by blanks."""
        data, starts, ends = self.words.data, self.words.starts, self.words.ends
        return [data[a:z] if n == 0 else b" ".join([data[a:z] for a, z in zip(starts[i : i + n + 1].tolist(), ends[i : i + n + 1].tolist())]) for i, n, a, z in zip(first.tolist(), (last - first).tolist(), starts[first].tolist(), ends[last].tolist())]


def _salt(lang: str) -> int:
    return int.from_bytes(lang.encode().ljust(8, b"\0")[:8], "little") * 0x9E3779B97F4A7C15 + len(lang) & (1 << 64) - 1


def _languages(batch: pa.RecordBatch) -> Iterator[tuple[str, Pieces]]:
    for b in slices([batch], "text", most=_TAKEN):
        texts, langs = T.as_bytes(b.column("text")), b.column("lang").to_pylist()
        for lang in dict.fromkeys(langs):
            own = [t for t, x in zip(texts, langs) if x == lang]
            for lo, hi in T.slices(own):
                pieces = Pieces(own[lo:hi], _salt(lang))
                if len(pieces):
                    yield lang, pieces


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def word_counts(documents: DataFrame) -> DataFrame:
    """(lang, phrase, term, f) of all words; term is the word's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], list[int]] = {}

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in held]), T.strings([k[1] for k in held]), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], ["lang", "phrase", "term", "f"])
            held.clear()
            return out

        for b in batches:
            for lang, p in _languages(b):
                # told apart by their bytes below; the hash only brings equal words together
                names, first, number, times = np.unique(p.h, return_index=True, return_inverse=True, return_counts=True)
                words = p.texts_of(first, first)
                other = np.flatnonzero(p.same_bytes(first[number]) == 0)
                for h, w, n in zip(names.view(np.int64).tolist(), words, (times - np.bincount(number[other], minlength=len(names))).tolist()):
                    held.setdefault((lang, w), [h, 0])[1] += n
                for i in other.tolist():
                    held.setdefault((lang, p.texts_of(np.array([i]), np.array([i]))[0]), [int(p.h[i : i + 1].view(np.int64)[0]), 0])[1] += 1
                if len(held) > _HELD:
                    yield flushed()
        if held:
            yield flushed()

    return _rows(documents).mapInArrow(run, "lang string, phrase string, term long, f long").groupBy("lang", "phrase", "term").agg(F.sum("f").alias("f"))


def frequent_pairs(documents: DataFrame, words: np.ndarray, least: int) -> DataFrame:
    """(term) of neighbours that occur `least` times or more, by hash; words is the map of frequent words."""
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            names, f = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(names)
            names, f = names[order], f[order]
            first = np.flatnonzero(np.diff(names, prepend=~names[:1]))
            return names[first], np.add.reduceat(f, first)

        for b in batches:
            for _, p in _languages(b):
                often = bloom.asked(shared.value, p.h)
                held.append(np.unique(p.pairs()[p.joined[1:] & often[1:] & often[:-1]], return_counts=True))
                size += len(held[-1][0])
                if size > 16 * _HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 8 * _HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["term", "f"])
                        held, size = [], 0
        if held:
            names, f = merged()
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(f)], ["term", "f"])

    return _rows(documents).mapInArrow(run, "term long, f long").groupBy("term").agg(F.sum("f").alias("f")).where(F.col("f") >= least).select("term")


def longer_map(documents: DataFrame, words: np.ndarray, pairs: np.ndarray, least: int, longest: int) -> np.ndarray:
    """Map of the hashes of phrases of 3 to `longest` words whose slot counts `least` or more; none that frequent is missing.

    A task's counts stop at `least`: sums reach it all the same.
    """
    shared = documents.sparkSession.sparkContext.broadcast((words, pairs))
    bits, kind = SKETCH_BITS, np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often_words, often_pairs = shared.value
        slots = np.zeros(1 << bits, kind)
        for b in batches:
            for _, p in _languages(b):
                for fine, h in list(p.phrases(often_words, often_pairs, longest))[1:]:
                    at, times = np.unique((h[fine] & np.uint64(len(slots) - 1)).astype(np.int64), return_counts=True)
                    slots[at] = np.minimum(slots[at] + times, least)
        for part, counts in enumerate(slots.reshape(-1, _PART)):
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([zlib.compress(counts.tobytes(), 1)])], ["part", "counts"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by part; one part is held at a time
        rows = ((k, np.frombuffer(zlib.decompress(c), kind).astype(np.int64)) for b in batches for k, c in zip(*(x.to_pylist() for x in b.columns)))
        for part, own in groupby(rows, itemgetter(0)):
            flags = np.packbits(sum(c for _, c in own) >= least, bitorder="little")
            if flags.any():
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([flags.tobytes()])], ["part", "flags"])

    parts = _rows(documents).mapInArrow(run, "part long, counts binary").repartition("part").sortWithinPartitions("part")
    packed = np.zeros((1 << bits) >> 3, np.uint8)
    for row in parts.mapInArrow(merged, "part long, flags binary").collect():
        packed[row.part * _PART >> 3 : (row.part + 1) * _PART >> 3] = np.frombuffer(row.flags, np.uint8)
    return packed


def projections(documents: DataFrame, words: np.ndarray, pairs: np.ndarray, longer: np.ndarray, longest: int) -> DataFrame:
    """(lang, words, weight): what follows the occurrences of frequent prefixes, equal ones as one row."""
    shared = documents.sparkSession.sparkContext.broadcast((words, pairs, longer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], int] = {}

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in held]), T.strings([k[1] for k in held]), pa.array(list(held.values()), pa.int64())], ["lang", "words", "weight"])
            held.clear()
            return out

        often_words, often_pairs, often_longer = shared.value
        for b in batches:
            for lang, p in _languages(b):
                n = np.zeros(len(p), np.int64)
                for fine, _ in p.phrases(often_words, often_pairs, longest, often_longer):
                    n[: len(fine)] += fine
                first = np.flatnonzero(n)
                for w in p.texts_of(first, first + n[first]):
                    key = lang, w
                    held[key] = held.get(key, 0) + 1
                if len(held) > 2 * _HELD:
                    yield flushed()
        if held:
            yield flushed()

    return _rows(documents).mapInArrow(run, "lang string, words string, weight long").groupBy("lang", "words").agg(F.sum("weight").alias("weight"))


def grown(projected: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, size, f) of all prefixes of two words or more that stand `least` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            langs, weight = b.column("lang").dictionary_encode(), b.column("weight").to_numpy()
            data = T.as_bytes(b.column("words"))
            out = intervals(langs.indices.to_numpy(), data, weight, least)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array([o[0] for o in out], pa.int64())), T.strings([o[1] for o in out]), pa.array([o[1].count(b" ") + 1 for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int64())], ["lang", "phrase", "size", "f"])

    ordered = projected.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words")
    return ordered.mapInArrow(run, "lang string, phrase string, size int, f long").groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def intervals(lang: np.ndarray, words: list[bytes], weight: np.ndarray, least: int) -> list[tuple[int, bytes, int]]:
    """(lang, prefix, weight) of sorted rows: prefixes grow by a word as long as their interval weighs enough.

    An interval at either end may go on in other batches, and words that hold bytes below the blank may stand
    between a prefix's own: there, light intervals are kept too, as sums to be added.
    """
    split = [w.split(b" ") for w in words]
    total = np.concatenate([[0], np.cumsum(weight)]).tolist()
    low = np.frombuffer(b"".join(words), np.uint8).min(initial=0x20) < 0x20
    lang = lang.tolist()
    out: list[tuple[int, bytes, int]] = []
    # (from, to, words the prefix has)
    stack = [(0, len(words), 0)]
    while stack:
        lo, hi, n = stack.pop()
        if n > 1:
            sure = not low and lo > 0 and hi < len(words)
            if sure and total[hi] - total[lo] < least:
                continue  # and so are all longer ones
            out.append((lang[lo], b" ".join(split[lo][:n]), total[hi] - total[lo]))
        if n and hi - lo == 1:  # one row: all its longer prefixes weigh the same
            stack += [(lo, hi, n + 1)] if len(split[lo]) > n else []
            continue
        i = lo
        while i < hi:
            if len(split[i]) <= n:
                i += 1
                continue
            key, j = (lang[i], split[i][n]), i + 1
            while j < hi and len(split[j]) > n and split[j][n] == key[1] and lang[j] == key[0]:
                j += 1
            stack.append((i, j, n + 1))
            i = j
    return out


def phrases(documents: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f) of all phrases of 1 to `longest` words with f >= least, (lang, n))."""
    words = written(word_counts(documents), "words")
    often = words.where(F.col("f") >= least)
    known = bloom.bit_map(often.select("term"), MAP_BITS)
    pairs = bloom.bit_map(written(frequent_pairs(documents, known, least), "pairs"), MAP_BITS)
    longer = longer_map(documents, known, pairs, least, longest)
    projected = written(projections(documents, known, pairs, longer, longest), "projections")
    found = written(often.select("lang", "phrase", F.lit(1).alias("size"), "f").unionByName(grown(projected, least)), "phrases")
    return found, words.groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` candidates, or all."""
    found, totals = phrases(documents, least, longest)
    first = lambda n: F.call_function("substring_index", F.col("phrase"), F.lit(" "), n)  # noqa: E731  words, by bytes
    size = F.col("size")
    several = found.where(size > 1)
    # what one word more makes of a candidate: its longer ones' counts, reduced in each task
    longer = several.where(size > 2).select("lang", "f", F.explode(F.array(first(size - 1), first(1 - size))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    open_ = written(several.join(longer, ["lang", "phrase"], "left").where("most is null or most < f").select("lang", "phrase", F.col("f").alias("a"), "size"), "candidates")
    cuts = open_.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"), "size").select("lang", "phrase", "a", "k", first(F.col("k")).alias("first"), first(F.col("k") - size).alias("rest"))
    counts = found.select("lang", F.col("phrase").alias("part"), "f")
    lefts = written(cuts.join(counts.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"]).drop("first"), "lefts")
    both = lefts.join(counts.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"]).drop("rest")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    # of all languages there are few rows: Spark broadcasts them while they are small
    scored = both.join(totals, "lang").withColumn("score", F.expr("cast(1000 * cast(a as decimal(20,0)) * cast(n as decimal(20,0)) as decimal(38,0)) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long"))
    return (ranked if top is None else ranked.where(F.col("rank") <= top)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
