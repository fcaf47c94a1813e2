"""Which tokens of two tokenizers stand for the same text, counted over a corpus by a dictionary of groups.

Both tokenizers cut the bytes of one space and the text. Offsets at which a token of A and one of B both end cut the tokens
into groups; every A token of a group is linked with every B token of it. A pair of ids counts the documents that hold
it linked. The steps:

1. Tasks tokenise documents block by block (BLOCK bytes of text, or one longer text). Texts are cut into chunks before a
   blank that follows no white space, where neither tokenizer has a token across; a chunk's groups are found once and kept in a cache of
   bounded size. A block becomes one row of a written table: its documents as (number of a group, frequency), the block's
   distinct groups, and its distinct pairs with the number of the block's documents that hold each.
2. Documents of each pair are summed, and each A id's greatest sum found.
3. The corpus' distinct groups are the dictionary: each group's links are expanded once, met with the pairs' counts and summed.
4. The sums go back by group, once a block and group, and each block's documents multiply them by their frequencies.

No pair is expanded document by document, and what moves is a block's groups, not the documents'. A group with very many tokens
costs the product of its distinct ids, once.

Defined results: each row is a document, also where doc_ids repeat or are null. Null and empty texts, texts that aren't UTF-8,
and texts that a tokenizer doesn't give back byte by byte have no tokens: zeros, and no groups. An empty table gives an empty one. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relsift.llm import _text as T
from relsift.llm._session import written

BLOCK = 4 << 20
#: A cache of more chunks, or characters, than this takes up only what a block holds twice; at three times as many it begins anew.
MOST_CHUNKS, MOST_CHARS = 250_000, 1 << 23
#: Where a text may be cut: the character before is no white space of any kind.
_CUT = re.compile(r"(?<=\S)(?= )")
_ODD = re.compile(r"\s ")


def byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def sizes_of(tokens: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(tokens, default=0) + 1, np.int64)
    out[list(tokens)] = [len(t) for t in tokens.values()]
    return out


class ByteLevel:
    """Tokenizer A, from the text of a tokenizers JSON file."""

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.encode_special_tokens = True  # their strings are plain text
        signs = byte_of_sign()
        self.bytes = {i: bytes(map(signs.__getitem__, token)) for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if all(c in signs for c in token)}
        how = json.loads(source)
        self.sizes = sizes_of(self.bytes)
        before = how.get("pre_tokenizer") or {}
        #: blanks begin pieces of the usual pattern, whatever stands before them but white space
        self.cuts = how.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Tokenizer B, from the bytes of a sentencepiece model that adds a blank itself."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=model)
        names = [self.processor.id_to_piece(i) for i in range(self.processor.vocab_size())]
        value = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
        self.bytes = dict(enumerate(map(value, names)))
        self.sizes = sizes_of(self.bytes)
        self.cuts = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


def cut(text: str) -> list[str]:
    """A text that begins with a blank, as chunks that each begin with one; no chunk but the first is a lone blank."""
    if _ODD.search(text):
        parts = _CUT.split(text)
    else:
        parts = [f" {p}" for p in text[1:].split(" ")]
    if parts[-1] == " " and len(parts) > 1:
        parts[-2:] = [parts[-2] + " "]
    return parts


def shared_ends(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A tokens, B tokens) up to each offset at which tokens of both end; sizes are the tokens' bytes, none 0, with equal sums."""
    a, b = np.cumsum(a_sizes), np.cumsum(b_sizes)
    both = np.intersect1d(a, b, assume_unique=True)
    return np.searchsorted(a, both) + 1, np.searchsorted(b, both) + 1


def name_of(a: list[int], b: list[int]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def pairs_of(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs as A id << 32 | B id, how often each is linked) of a group, each pair once."""
    (x, n), (y, m) = (np.unique(np.array(ids, np.int64), return_counts=True) for ids in (a, b))
    return (x[:, None] << 32 | y[None, :]).ravel(), (n[:, None] * m[None, :]).ravel()


class Aligner:
    """Chunks and groups by number, each found once."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.cuts = a.cuts and b.cuts
        self.clear()

    def clear(self) -> None:
        self.chunks: dict[str, int] = {}
        self.chars = 0
        self.names: list[str] = []  # of a chunk's groups, joined
        self.sums = np.empty((0, 5), np.int64)  # of a chunk: A tokens, B tokens, groups, links, 1 if bytes differ
        self.opens = np.zeros(1, np.int64)  # chunk i's groups are numbers[opens[i]:opens[i + 1]]
        self.numbers = np.empty(0, np.int64)
        self.groups: dict[str, int] = {}
        self.pairs: list[np.ndarray] = []

    def learn(self, chunks: list[str]) -> None:
        ids = self.a.encode(chunks), self.b.encode([c[1:] for c in chunks])
        whole = [c.encode() for c in chunks]
        sides = [(tool.bytes, held) for tool, held in zip((self.a, self.b), ids)]
        bad = np.zeros(len(chunks), bool)
        if any([sum(len(known.get(i, b"")) for i in x) for x in held] != list(map(len, whole)) or b"".join(known.get(i, b"") for x in held for i in x) != b"".join(whole) for known, held in sides):
            bad = np.array([any(b"".join(known.get(i, b"") for i in held[k]) != w for known, held in sides) for k, w in enumerate(whole)])
            ids = tuple([[] if off else x for x, off in zip(held, bad)] for held in ids)
        n_a, n_b = (np.array([len(x) for x in held], np.int64) for held in ids)
        a, b = (np.fromiter((i for x in held for i in x), np.int64, int(n.sum())) for held, n in zip(ids, (n_a, n_b)))
        to_a, to_b = shared_ends(self.a.sizes[a], self.b.sizes[b])
        wide, high = (np.diff(to, prepend=0) for to in (to_a, to_b))
        numbers = self._numbers(a, b, to_a - wide, to_b - high, wide, high)
        ends = np.searchsorted(to_a, np.cumsum(n_a), "right")  # groups up to each chunk's end
        links = np.concatenate([[0], np.cumsum(wide * high)])[ends]
        by_number = list(self.groups)
        each = [by_number[g] for g in numbers.tolist()]
        first = np.concatenate([[0], ends])
        for k, chunk in enumerate(chunks):
            self.chunks[chunk] = len(self.names)
            self.names.append(";".join(each[first[k] : first[k + 1]]))
        self.chars += sum(map(len, chunks))
        self.sums = np.concatenate([self.sums, np.stack([n_a, n_b, np.diff(first), np.diff(links, prepend=0), bad], 1)])
        self.opens = np.concatenate([self.opens, self.opens[-1] + ends])
        self.numbers = np.concatenate([self.numbers, numbers])

    def _numbers(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, wide: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each group; groups of a shape are told apart together, and each distinct one is named once."""
        out = np.empty(len(wide), np.int64)
        shape = wide << 32 | high
        order = np.argsort(shape, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(shape[order])) + 1):
            if not len(rows):
                continue
            w, h = int(wide[rows[0]]), int(high[rows[0]])
            table = np.concatenate([a[at_a[rows][:, None] + np.arange(w)], b[at_b[rows][:, None] + np.arange(h)]], 1).astype(np.int32)
            _, pick, back = np.unique(table.view(f"V{4 * (w + h)}").ravel() if w + h > 2 else table.view(np.int64).ravel(), return_index=True, return_inverse=True)
            known = np.empty(len(pick), np.int64)
            for k, row in enumerate(table[pick].tolist()):
                known[k] = number = self.groups.setdefault(name_of(row[:w], row[w:]), len(self.groups))
                if number == len(self.pairs):
                    self.pairs.append(pairs_of(row[:w], row[w:])[0])
            out[rows] = known[back]
        return out

    def block(self, texts: list[bytes]) -> dict:
        """One row of BLOCKS, without its number and doc_ids."""
        if len(self.names) > 3 * MOST_CHUNKS or self.chars > 3 * MOST_CHARS:
            self.clear()
        cuts = []
        for t in texts:
            try:
                s = t.decode()
            except UnicodeDecodeError:
                s = ""
            cuts.append(([f" {s}"] if not self.cuts else cut(f" {s}")) if s else [])
        new = dict.fromkeys(c for cs in cuts for c in cs if c not in self.chunks)
        before = len(self.names)
        if new:
            self.learn(list(new))
        held = [[self.chunks[c] for c in cs] for cs in cuts]
        n = np.array([len(h) for h in held])
        flat = np.fromiter((c for h in held for c in h), np.int64, int(n.sum()))
        bounds = np.concatenate([[0], np.cumsum(n)])
        total = np.zeros((len(flat) + 1, 5), np.int64)
        np.cumsum(self.sums[flat], axis=0, out=total[1:])
        sums = total[bounds[1:]] - total[bounds[:-1]]
        fine = (sums[:, 4] == 0) & (n > 0)
        sums[~fine] = 0
        sha = [hashlib.sha256(";".join([self.names[c] for c in h]).encode()).hexdigest() if ok else "" for h, ok in zip(held, fine)]
        if before and (len(self.chunks) > MOST_CHUNKS or self.chars > MOST_CHARS):
            for chunk, k in zip(new, np.bincount(flat[flat >= before] - before, minlength=len(new)).tolist()):
                if k < 2:
                    self.names[self.chunks.pop(chunk)] = ""
        # (document, chunk) with frequencies, then (document, group)
        owner = np.repeat(np.arange(len(texts)), n)
        on = fine[owner]
        keys, times = np.unique(owner[on] << 32 | flat[on], return_counts=True)
        chunk = keys & 0xFFFFFFFF
        at, line = spread(self.opens[chunk], self.opens[chunk + 1] - self.opens[chunk])
        whole, inverse = np.unique((keys >> 32)[line] << 32 | self.numbers[at], return_inverse=True)
        frequency = np.bincount(inverse, weights=times[line], minlength=len(whole)).astype(np.int64)
        known, local = np.unique(whole & 0xFFFFFFFF, return_inverse=True)
        # documents of each pair
        linked = [self.pairs[g] for g in known]
        size = np.array([len(p) for p in linked], np.int64)
        opens = np.concatenate([[0], np.cumsum(size)])[:-1]
        codes, code = np.unique(np.concatenate([np.empty(0, np.int64), *linked]), return_inverse=True)
        at, line = spread(opens[local], size[local])
        once = np.unique((whole >> 32)[line] << 32 | code[at])
        by_number = list(self.groups)
        return {
            "sums": sums[:, :4],
            "sha": sha,
            "opens": np.searchsorted(whole >> 32, np.arange(len(texts) + 1)).astype(np.int32),
            "numbers": local.astype(np.int32),
            "times": frequency,
            "groups": [by_number[g] for g in known],
            "pairs": codes,
            "docs": np.bincount(once & 0xFFFFFFFF, minlength=len(codes)).astype(np.int64),
        }


def spread(opens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, line) of all positions opens[i] .. opens[i] + sizes[i] - 1, line being i."""
    line = np.repeat(np.arange(len(sizes)), sizes)
    before = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return np.arange(len(line)) - before[line] + opens[line], line


#: A row is a block of documents: opens[i]:opens[i+1] are document i's places in (numbers, times), numbers count within groups.
BLOCKS = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, opens array<int>, numbers array<int>, times array<long>, groups array<string>, pairs array<long>, docs array<long>"
_KINDS = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def default_paths() -> tuple[str, str]:
    """The two tokenizers' files as the package public_tokenizers has them."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def shared_models(spark: SparkSession, a: str, b: str) -> tuple[Broadcast, Broadcast]:
    """The files' contents (some 3 MB together), so that tasks need no file."""
    return spark.sparkContext.broadcast(Path(a).read_text(encoding="utf-8")), spark.sparkContext.broadcast(Path(b).read_bytes())


_OPEN: dict[tuple, Aligner] = {}


def aligner(a: str, b: bytes) -> Aligner:
    """One of each pair of models in a worker process, for its next tasks too."""
    key = hash(a), hash(b)
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Aligner(ByteLevel(a), Pieces(b))
    return _OPEN[key]


def encoded(documents: DataFrame, a: str, b: str, block: int = BLOCK) -> DataFrame:
    """The documents tokenised and grouped: rows as BLOCKS says."""
    model_a, model_b = shared_models(documents.sparkSession, a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(model_a.value, model_b.value)
        number = 0
        for batch in batches:
            ids, texts, task = batch.column("doc_id"), T.as_bytes(batch.column("text")), batch.column("task")[0].as_py() if batch.num_rows else 0
            for lo, hi in T.slices(texts, block):
                made = tool.block(texts[lo:hi])
                row = [task << 33 | number, ids.slice(lo, hi - lo), *made.pop("sums").T, *made.values()]
                made.clear()
                yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind.value_type) if not isinstance(x, pa.Array) else x) for x, kind in zip(row[1:], _KINDS[1:]))], names=_NAMES)
                number += 1
        tool.clear()  # the worker process waits beside later stages' tasks: only the tokenizers stay

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().cast("long").alias("task"))
    return rows.mapInArrow(run, BLOCKS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, docs, best): the documents that hold each pair of ids linked, and if no pair of its A id has more."""
    counts = written(blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("docs")).withColumn("a", F.shiftright("pair", 32)), "pairs")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def dictionary(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, n_best, count_sum) of each distinct group of the corpus: its links are expanded here and nowhere else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple[str, np.ndarray, np.ndarray]] = []
            size = 0
            for name in b.column("name").to_pylist():
                one, other = (list(map(int, x.split(","))) for x in name.split("|"))
                held.append((name, *pairs_of(one, other)))
                size += len(held[-1][1])
                if size >= 1 << 16:
                    yield links(held)
                    held, size = [], 0
            if held:
                yield links(held)

    def links(held: list) -> pa.RecordBatch:
        names = pa.array([h[0] for h in held]).take(pa.array(np.repeat(np.arange(len(held)), [len(h[1]) for h in held])))
        return pa.RecordBatch.from_arrays([names, *(pa.array(np.concatenate([h[k] for h in held])) for k in (1, 2))], ["name", "pair", "times"])

    names = blocks.select(F.explode("groups").alias("name")).distinct()
    met = names.mapInArrow(run, "name string, pair long, times long").join(counts, "pair")
    return met.groupBy("name").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            of = lambda c: b.column(c)[i].values
            opens = of("opens").to_numpy()
            sums = []
            place, times = of("numbers").to_numpy(), of("times").to_numpy()
            given = b.column("given")[i].values
            order = None if given is None else given.field("k").to_numpy()
            for c in ("n_best", "count_sum"):
                value = np.zeros(0 if order is None else len(order), np.int64)
                if order is not None:
                    value[order] = given.field(c).to_numpy()
                total = np.concatenate([[0], np.cumsum(value[place] * times)])
                sums.append(pa.array(total[opens[1:]] - total[opens[:-1]]))
            yield pa.RecordBatch.from_arrays([*(of(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *sums, of("sha")], [c.split()[0] for c in ALIGNED.split(", ")])


def aligned(documents: DataFrame, a: str | None = None, b: str | None = None, block: int = BLOCK) -> DataFrame:
    """Each document as ALIGNED says. a, b: files of the tokenizers, those of default_paths if None."""
    known = default_paths() if a is None or b is None else (a, b)
    blocks = written(encoded(documents, a or known[0], b or known[1], block), "blocks")
    sums = dictionary(blocks, pair_counts(blocks))
    names = blocks.select("block", F.posexplode("groups").alias("k", "name"))
    # a block's groups are bounded by its size
    given = names.join(sums, "name").groupBy("block").agg(F.collect_list(F.struct("k", "n_best", "count_sum")).alias("given"))
    return blocks.drop("groups", "pairs", "docs").join(given, "block", "left").mapInArrow(_summed, ALIGNED)


def links(documents: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(a, b, docs, best): every pair of ids that some document holds linked."""
    known = default_paths() if a is None or b is None else (a, b)
    counts = pair_counts(written(encoded(documents, a or known[0], b or known[1]), "blocks"))
    return counts.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "docs", "best")
