"""SimHash fingerprints and their near-duplicates, found by anchor-point covering.

Fingerprint: A-Z lower-cased, words are runs of non-blanks, shingles are four words joined by
single blanks (fewer words: the whole sequence), h is a shingle's XXH64 with seed 42. Bit i
of the fingerprint is set if bit i is set in over half the h, repeats counted. No words: 0.

Search: the 64 bits are cut into three blocks of 22, 21 and 21 bits, so that two fingerprints
at DISTANCE (4) or fewer differing bits differ by at most THRESHOLD (1) bit in some block. The
anchors of a block are the 4,096 words of the binary Golay code, which is perfect: every
block value lies within RADIUS (3) of exactly one anchor, its home. A fingerprint is
replicated to every anchor of each block that can be the home of a value within THRESHOLD
of its own, that is to anchors within RADIUS + THRESHOLD: about five of each block. At each
anchor, the fingerprints at home there are compared with all that were replicated to it.

Equal fingerprints are one before the search, so groups of copies cost one row. Anchors are
12,288 in all, hence their sizes are a small table: an anchor whose pairs exceed WORK is
cut into blocks by both sides, and no comparison is dropped. A block
returns a spanning forest of its links and never all pairs.

Defined results: null and empty texts have fingerprint 0 and are linked like any other;
repeated rows keep their own rows; the component of a row is the least non-null doc_id
reachable. An empty table gives an empty table. Columns other than doc_id and text are
neither read nor returned by `near_duplicates`; `deduplicated` returns all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relsift.llm import _text as T
from relsift.llm._blocks import blocks
from relsift.llm._graph import components, forest
from relsift.llm._session import written

SHINGLE, SEED, DISTANCE = 4, 42, 4
BLOCKS = ((0, 22), (22, 21), (43, 21))
RADIUS, THRESHOLD = 3, 1
#: Pairs in one block, as planned from the anchors' sizes. Bands leave about one in 1,400 of them to compare; where very
#: many fingerprints share a band, all of them are still a task of minutes.
WORK = 1 << 34
#: Up to so many pairs, a cell compares all with all.
ALL_WITH_ALL = 1 << 26
#: Comparisons made at a time, which bounds memory.
AT_ONCE = 1 << 21
#: Fixed value: generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011


def fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    bounds = list(zip(starts, ends[SHINGLE - 1 :])) or [(0, len(joined))]
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for lo in range(0, len(bounds), 1 << 14):
        some = b"".join([digest(joined[a:b], SEED) for a, b in bounds[lo : lo + (1 << 14)]])
        bits = np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1)
        total += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(total * 2 > len(bounds)).tobytes(), "big")


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t) for t in T.as_bytes(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


_HOME: list[np.ndarray] = []


def home_table() -> np.ndarray:
    """For each of the 2**23 values, the number of its nearest code word."""
    if not _HOME:
        codes = np.zeros(4096, np.int64)
        for bit in range(12):
            codes ^= np.where((np.arange(4096) >> bit) & 1, GOLAY << bit, 0)
        flips = [0, *(1 << i for i in range(23))]
        errors = np.unique([a | b | c for a in flips for b in flips for c in flips])
        table = np.empty(1 << 23, np.int16)
        for e in errors:
            table[codes ^ e] = np.arange(4096)
        _HOME.append(table)
    return _HOME[0]


def replicas(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, at home) of every replica; a cell is a block and an anchor of it."""
    home = home_table()
    rows, cells, at_home = [], [], []
    for k, (shift, width) in enumerate(BLOCKS):
        value = ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        flips = np.array([0, *(1 << i for i in range(width))])
        near = home[value[:, None] ^ flips[None, :]].astype(np.int64)
        key = np.unique((np.arange(len(fps))[:, None] << 12 | near).ravel())
        row, anchor = key >> 12, key & 4095
        rows.append(row)
        cells.append(anchor + 4096 * k)
        at_home.append(anchor == near[row, 0])
    return np.concatenate(rows), np.concatenate(cells).astype(np.int32), np.concatenate(at_home)


def replicated(distinct: DataFrame) -> DataFrame:
    """(cell, fp, home) for the rows (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fps), 4096):
                some = fps[lo : lo + 4096]
                row, cell, at_home = replicas(some)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(some[row].view(np.int64)), pa.array(at_home)], ["cell", "fp", "home"])

    return distinct.select("fp").mapInArrow(run, "cell int, fp long, home boolean")


def close_pairs(mine: np.ndarray, all_here: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a from mine, b from all_here) of unlike fingerprints at DISTANCE or fewer differing bits, some more than once.

    Few are compared all with all. Many are first sorted by each of DISTANCE + 1 bands of bits:
    of two that differ in DISTANCE bits at most, one band at least is equal.
    """

    def near(a, b):
        ok = (np.bitwise_count(a ^ b) <= DISTANCE) & (a != b)
        return a[ok], b[ok]

    if len(mine) * len(all_here) <= ALL_WITH_ALL:
        step = max(1, AT_ONCE // max(1, len(all_here)))
        for lo in range(0, len(mine), step):
            i, j = np.nonzero(np.bitwise_count(mine[lo : lo + step, None] ^ all_here[None, :]) <= DISTANCE)
            yield near(mine[lo : lo + step][i], all_here[j])
        return
    cuts = np.linspace(0, 64, DISTANCE + 2).astype(int)
    for low, high in zip(cuts, cuts[1:]):
        band = lambda x: (x >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)  # noqa: B023, E731
        rows = all_here[np.argsort(band(all_here), kind="stable")]
        keys = band(rows)
        first, last = np.searchsorted(keys, band(mine), "left"), np.searchsorted(keys, band(mine), "right")
        ahead = np.cumsum(last - first)
        lo = 0
        while lo < len(mine):
            done = ahead[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ahead, done + AT_ONCE, "right")))
            n = (last - first)[lo:hi]
            i = np.repeat(np.arange(lo, hi), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[lo:hi], n)
            yield near(mine[i], rows[j])
            lo = hi


def cell_links(mine: np.ndarray, all_here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between `mine` and `all_here`."""
    a, b = np.empty(0, np.uint64), np.empty(0, np.uint64)
    for x, y in close_pairs(mine, all_here):
        if len(x):
            a, b = forest(np.concatenate([a, x]), np.concatenate([b, y]))
    return a, b


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect the fingerprints (fp) at DISTANCE or fewer differing bits."""
    spread = written(replicated(distinct), "replicas")
    sizes = spread.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("n_home"))
    cuts = sizes.select("cell", F.ceil(F.sqrt(F.col("n") * F.col("n_home") / WORK)).cast("int").alias("cuts")).where("cuts > 0")
    # 12,288 rows at most, by construction
    placed = blocks(spread.join(F.broadcast(cuts), "cell"), F.col("cuts"), F.col("fp"), F.col("home"), "cell", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell and cut; one block's fingerprints are held at a time."""
        held: list[tuple[np.ndarray, ...]] = []
        key = None

        def close():
            fps, mine, other = (np.concatenate(x) for x in zip(*held))
            a, b = cell_links(fps[mine].view(np.uint64), fps[other].view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            cell, cut, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "cut", "fp"))
            mine, other = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mine", "other"))
            keys = cell.astype(np.int64) << 32 | cut
            edges = np.flatnonzero(np.diff(keys)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(keys)]):
                if lo == hi:
                    continue
                if key is not None and keys[lo] != key:
                    yield close()
                    held = []
                key = keys[lo]
                held.append((fps[lo:hi], mine[lo:hi], other[lo:hi]))
        if held:
            yield close()

    return placed.repartition("cell", "cut").sortWithinPartitions("cell", "cut").mapInArrow(compare, "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the least doc_id reachable over links of fingerprints."""
    marked = written(fingerprints(documents), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that both sides of the joins are plain exchanges, of which Spark can split a hot root or fingerprint
    group = written(joined.groupBy("root").agg(F.min("least").alias("component_id")), "group")
    named = written(joined.join(group.hint("merge"), "root").select("fp", "component_id"), "named")
    return marked.join(named.hint("merge"), "fp")


def deduplicated(documents: DataFrame) -> DataFrame:
    """One document of each component stays, that of the least doc_id, with all its columns.

    Rows sharing that doc_id all stay, as they are one document. Where some component has
    no id at all, all rows with a null id stay; else none does.
    """
    # a kept row's id is its own component: ids, not texts, are what the search has shuffled
    keep = near_duplicates(documents).where("doc_id <=> component_id").select(F.col("doc_id").alias("__keep")).distinct()
    return documents.join(keep.hint("shuffle_hash"), documents["doc_id"].cast("long").eqNullSafe(keep["__keep"]), "left_semi")
