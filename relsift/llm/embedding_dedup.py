"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

A hash function rotates a vector pseudo-randomly (three rounds of random signs and a Walsh-Hadamard
transform) and names the axis, with its sign, that the result is nearest to. A table joins
`functions` of them. A vector is at home in its own bucket of each table and also probes the
buckets in which one function takes its second nearest axis. Vectors at home in a bucket are
compared, by cosine in double precision, with all that are at home there or probe it.

Only vectors with equal labels meet. Equal vectors are one class before the search and count
with their number. Buckets are counted by name first, so that vectors travel to those alone where a pair
can be: a Bloom filter of a bounded size tells which, lets some others through and loses none. A bucket
of more than CELL vectors is cut into blocks, rows by the one side and columns by the other, and every block is
compared: a task never holds more than a block. A cell returns counts and a spanning forest of
its links, never its pairs; a pair found in several cells is counted in the first of
them alone, which both vectors' buckets tell.

Recall is that of the hashing (measured in the tests against all pairs, by dimensions, tables and functions);
precision is exact. The buckets of a table are (2 x dimensions)**functions for each label: where a label has
very many more vectors, a third function makes buckets smaller, and takes more tables for the same recall.

Defined results: a vector that is null, empty, zero or has null or non-finite components, or
whose label or vec_id is null, links with nothing and is its own component. Rows that repeat a
vec_id are one vector in the components. Columns other than vec_id, embedding and label are
neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relsift.llm import _bloom as bloom
from relsift.llm import _text as T
from relsift.llm._blocks import blocks
from relsift.llm._graph import components, forest
from relsift.llm._session import dropped, written

COSINE = 0.93
TABLES, FUNCTIONS, ROUNDS = 8, 2, 3
CELL = 1024
AT_ONCE = 1 << 20
#: Vectors hashed at a time: their rotations stay in a processor's cache.
HASHED = 256


@dataclass(frozen=True)
class Hashing:
    """How many tables there are, of how many functions each. Codes depend on a vector alone, not on its neighbours."""

    tables: int = TABLES
    functions: int = FUNCTIONS

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home, probes) of each row of x: home[i, t] is its bucket of table t, probes[i, t] all it looks into, home first."""
        n, d = x.shape
        width = 1 << max(1, (d - 1).bit_length())
        bits = T._odd_stream(1009 * width, self.tables * self.functions * ROUNDS * width) >> np.uint64(63)
        signs = np.where(bits, np.float32(1), np.float32(-1)).reshape(self.tables * self.functions, ROUNDS, width, 1)
        probes = np.empty((n, self.tables, 1 + self.functions), np.int64)
        for lo in range(0, n, HASHED):
            some = x[lo : lo + HASHED]
            padded = np.zeros((1, width, len(some)), np.float32)
            padded[0, :d] = some.T
            y = padded
            for r in range(ROUNDS):
                y = hadamard(y * signs[:, r])
            axis = []
            size = np.abs(y)
            for _ in range(2):
                at = size.argmax(axis=1)[:, None]
                axis.append((2 * at + (np.take_along_axis(y, at, 1) < 0))[:, 0].reshape(self.tables, self.functions, len(some)))
                np.put_along_axis(size, at, -1, 1)
            best, second = axis
            for k in range(1 + self.functions):
                bucket = np.broadcast_to(np.arange(self.tables)[:, None], (self.tables, len(some)))
                for f in range(self.functions):
                    bucket = bucket * (2 * width) + (second if k == f + 1 else best)[:, f]
                probes[lo : lo + HASHED, :, k] = bucket.T
        return probes[:, :, 0], probes


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform along the middle axis, whose length is a power of two."""
    k, d, n = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(k, d // (2 * h), 2, h, n)
        out = np.empty_like(pairs)
        np.add(pairs[:, :, 0], pairs[:, :, 1], out=out[:, :, 0])
        np.subtract(pairs[:, :, 0], pairs[:, :, 1], out=out[:, :, 1])
        x = out.reshape(k, d, n)
        h *= 2
    return x


def codes(x: np.ndarray, hashing: Hashing = Hashing()) -> tuple[np.ndarray, np.ndarray]:
    return hashing.codes(x)


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors, of dim doubles or floats each, as rows of doubles."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    kind = "<f4" if len(flat) == 4 * dim * len(column) else "<f8"
    return flat.view(kind).astype(np.float64).reshape(len(column), dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def marked(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, dim, vector, h1, h2): the vector's bytes, and the name of the class of equal vectors, a digest
    of label and vector; null where a vector links with nothing."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(kind).alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("embedding")
            values = column.values.to_numpy(zero_copy_only=False)  # null components come as NaN
            bounds = column.offsets.to_numpy()
            raw = values.tobytes()
            width = values.dtype.itemsize
            rows = []
            fine = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            some = np.concatenate([[0], np.cumsum(values != 0)])
            for k, (i, label, known, lo, hi) in enumerate(zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist(), column.is_valid().to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist())):
                if i is None or label is None or not known or fine[hi] > fine[lo] or some[hi] == some[lo]:
                    rows.append((None,) * 4)
                    continue
                vector = raw[lo * width : hi * width]
                name = hashlib.blake2b(vector + b"/" + str(width).encode() + label.encode(), digest_size=16).digest()
                rows.append((hi - lo, vector, *(int.from_bytes(x, "little", signed=True) for x in (name[:8], name[8:]))))
            dim, vector, h1, h2 = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(dim, pa.int32()), pa.array(vector, pa.binary()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["vec_id", "label", "dim", "vector", "h1", "h2"])

    return e.mapInArrow(run, "vec_id long, label string, dim int, vector binary, h1 long, h2 long")


def classes(vectors: DataFrame) -> DataFrame:
    """(h1, h2, node, n, label, dim, vector) of each class of equal vectors; node is its least vec_id."""
    return vectors.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))


def coded(found: DataFrame, hashing: Hashing) -> DataFrame:
    """The classes with their probes: the buckets that each looks into, table by table, its home of each table first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = hashing.tables * (1 + hashing.functions)
        for b in batches:
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                some = b.filter(pa.array(dims == dim)) if (dims != dim).any() else b
                for lo in range(0, len(some), 4096):
                    part = some.slice(lo, 4096)
                    _, probes = hashing.codes(unit(as_matrix(part.column("vector"), int(dim))))
                    lists = T.ragged(probes.ravel(), np.arange(0, (len(part) + 1) * each, each), pa.int64())
                    yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "probes"])

    return found.select("label", "dim", "node", "n", "vector").mapInArrow(run, "label string, dim int, node long, n long, vector binary, probes array<long>")


def _key(cell: str):
    return F.xxhash64("label", "dim", cell)


def useful(vectors: DataFrame, hashing: Hashing) -> DataFrame:
    """(key, label, dim, cell, size): buckets where at least one vector is at home and another looks in."""
    each = vectors.select("label", "dim", F.posexplode("probes").alias("nth", "cell"))
    counted = each.groupBy("label", "dim", "cell").agg(F.count("*").alias("size"), F.max(F.col("nth") % (1 + hashing.functions) == 0).alias("home"))
    return counted.where("size > 1 and home").select(_key("cell").alias("key"), "label", "dim", "cell", "size")


def probing(vectors: DataFrame, cells, hashing: Hashing) -> DataFrame:
    """(label, dim, cell, home, node, n, vector): each class at the buckets it looks into, those left out that the filter of useful cells doesn't know."""
    keyed = vectors.select("label", "dim", "node", "n", "vector", "probes", F.transform("probes", lambda c: F.xxhash64("label", "dim", c)).alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = hashing.tables * (1 + hashing.functions)
        for b in batches:
            for lo in range(0, len(b), 1024):
                part = b.slice(lo, 1024)
                keys, cell = (part.column(c).flatten().to_numpy().reshape(len(part), each) for c in ("keys", "probes"))
                row, nth = np.nonzero(bloom.contains(cells.value, keys.ravel().view(np.uint64)).reshape(keys.shape))
                at = pa.array(row)
                taken = {c: part.column(c).take(at) for c in ("label", "dim", "node", "n", "vector")}
                yield pa.RecordBatch.from_arrays([taken["label"], taken["dim"], pa.array(cell[row, nth]), pa.array(nth % (1 + hashing.functions) == 0), taken["node"], taken["n"], taken["vector"]], ["label", "dim", "cell", "home", "node", "n", "vector"])

    return keyed.mapInArrow(run, "label string, dim int, cell long, home boolean, node long, n long, vector binary")


class Bundle:
    """Rows of many buckets: finds their links, and says which are counted here.

    bucket: number of the bucket or block of each row, equal ones side by side; cell: the bucket's name; mine and
    other: whether a row stands on the one side or the other, or on both.
    """

    def __init__(self, hashing, bucket, cell, mine, other, at_home, node, n, x):
        self.hashing = hashing
        self.bucket, self.cell, self.mine, self.other, self.at_home, self.node, self.n, self.x = bucket, cell, mine, other, at_home, node, n, x
        self.counts = np.zeros(len(node), np.int64)
        self.a, self.b = np.empty(0, np.int64), np.empty(0, np.int64)
        self.coded = np.full(len(node), -1)
        self.home = self.probes = None

    def pairs(self, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked rows (i of mine, j), bucket by bucket, about AT_ONCE at a time."""
        edges = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1))
        held, size = [], 0
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if hi - lo < 2:
                continue
            mine, other = (lo + np.flatnonzero(side[lo:hi]) for side in (self.mine, self.other))
            step = max(1, AT_ONCE // max(1, len(other)))
            others = self.x[other] if len(other) < hi - lo else self.x[lo:hi]
            for at in range(0, len(mine), step):
                some = mine[at : at + step]
                i, j = np.nonzero(self.x[some] @ others.T >= cosine)
                held.append((some[i], other[j]))
                size += len(i)
                if size > AT_ONCE:
                    yield tuple(map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*held)))

    def named(self, rows: np.ndarray) -> None:
        """Hashes the rows that aren't yet; few rows have links at all."""
        new = np.unique(rows)
        new = new[self.coded[new] < 0]
        if len(new):
            home, probes = self.hashing.codes(self.x[new])
            have = 0 if self.home is None else len(self.home)
            self.coded[new] = have + np.arange(len(new))
            self.home = home if self.home is None else np.concatenate([self.home, home])
            self.probes = probes if self.probes is None else np.concatenate([self.probes, probes])

    def link(self, cosine: float) -> None:
        for i, j in self.pairs(cosine):
            # rows at home on both sides meet twice here: in one order of their ids is enough
            ok = (self.node[i] != self.node[j]) & (~self.at_home[j] | (self.node[i] < self.node[j]))
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            self.named(np.concatenate([i, j]))
            # cells where the pair meets: either one's home that the other looks into; the least counts it
            far = np.int64(1 << 62)
            met = [np.where((self.home[self.coded[p]][:, :, None] == self.probes[self.coded[q]]).any(axis=2), self.home[self.coded[p]], far).min(axis=1) for p, q in ((i, j), (j, i))]
            first = np.minimum(*met) == self.cell[i]
            i, j = i[first], j[first]
            np.add.at(self.counts, i, self.n[j])
            np.add.at(self.counts, j, self.n[i])
            if len(i):
                self.a, self.b = forest(np.concatenate([self.a, self.node[i]]), np.concatenate([self.b, self.node[j]]))

    def result(self) -> pa.RecordBatch:
        some = self.counts > 0
        none = pa.nulls(len(self.a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([self.node[some], self.a])), pa.concat_arrays([pa.array(self.counts[some]), none]), pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(self.b)])], ["node", "n_links", "root"])


def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """(bucket numbers, rows) of whole buckets: rows come sorted by bucket, and the last one of a batch waits for the next."""
    held: list[pa.RecordBatch] = []

    def keys(t) -> np.ndarray:
        label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        dim, cell, cut = (t.column(c).to_numpy() for c in ("dim", "cell", "cut"))
        change = (np.diff(label) != 0) | (np.diff(dim) != 0) | (np.diff(cell) != 0) | (np.diff(cut) != 0)
        return np.concatenate([[0], np.cumsum(change)])

    for batch in batches:
        if not len(batch):
            continue
        if held:
            # the waiting bucket's first row tells whether it goes on through all of this batch
            joint = pa.Table.from_batches([held[0].slice(0, 1), batch])
            if keys(joint)[-1] == 0:
                held.append(batch)
                continue
        table = pa.Table.from_batches([*held, batch])
        number = keys(table)
        whole = int(np.searchsorted(number, number[-1]))
        held = table.slice(whole).combine_chunks().to_batches()
        if whole:
            yield number[:whole], table.slice(0, whole)
    if held:
        table = pa.Table.from_batches(held)
        yield keys(table), table


def links(found: DataFrame, cosine: float = COSINE, hashing: Hashing = Hashing()) -> DataFrame:
    """(node, n_links, root): counts have n_links, links of the forest have a root and no count."""
    vectors = written(coded(found, hashing), "coded")
    cells = written(useful(vectors, hashing), "useful")
    bits = bloom.bits_for(cells.count())
    known = vectors.sparkSession.sparkContext.broadcast(bloom.built(cells.select("key"), "key", bits))  # at most bloom.MAX_BITS / 8 bytes
    # rows / CELL of them at most
    large = cells.where(F.col("size") > CELL).select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("cell").alias("c"), F.ceil(F.col("size") / CELL).cast("int").alias("cuts"))
    large = written(large, "large")
    dropped(cells)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in bundled(batches):
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                t = table.take(pa.array(rows)) if len(rows) < len(table) else table
                columns = (t.column(c).to_numpy() for c in ("cell", "mine", "other", "home", "node", "n"))
                bundle = Bundle(hashing, number[rows], *columns, unit(as_matrix(t.column("vector").combine_chunks(), int(dim))))
                bundle.link(cosine)
                yield bundle.result()

    spread = probing(vectors, known, hashing).join(large, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c")), "left")
    placed = blocks(spread, F.coalesce("cuts", F.lit(1)), F.col("node"), F.col("home"), "label", "dim", "cell", "home", "node", "n", "vector")
    sorted_ = placed.repartition("label", "dim", "cell", "cut").sortWithinPartitions("label", "dim", "cell", "cut")
    return sorted_.mapInArrow(compare, "node long, n_links long, root long")


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, tables: int = TABLES, functions: int = FUNCTIONS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    vectors = written(marked(embeddings), "vectors")
    ids = vectors.select("vec_id", "h1", "h2")
    found = written(classes(vectors), "classes")
    linked = written(links(found, cosine, Hashing(tables, functions)), "links")
    roots = components(linked.where("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = linked.where("n_links is not null").groupBy("node").agg(F.sum("n_links").alias("others"))
    known = found.select("h1", "h2", "node", "n").join(counts, "node", "left").join(roots, "node", "left")
    known = known.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    known = written(known, "known")  # both sides of the join are then plain exchanges, of which Spark can split a hot class
    out = ids.join(known.hint("merge"), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
