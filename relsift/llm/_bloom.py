"""Bloom filters in segments: built where rows lie, merged segment by segment, of a fixed size."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASHES = 4
#: A key's bits all lie in one segment of so many bits.
SEGMENT = 1 << 17
#: Bits of a filter: least, and most (32 MB, which is what a broadcast may weigh).
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
BITS_A_KEY = 10
#: Bits of a plain bit map are 2 to this power.
MAP_BITS = 24


def bits_for(n: int) -> int:
    """A power of two of about BITS_A_KEY bits a key, within bounds; beyond them a filter lets more keys through and still loses none."""
    return 1 << math.ceil(math.log2(max(MIN_BITS, min(MAX_BITS, n * BITS_A_KEY))))


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, bit within it by hash function) of 64-bit hashes."""
    segment = (hashes >> np.uint64(40)) % np.uint64(bits // SEGMENT)
    a, b = hashes & np.uint64(0xFFFFF), (hashes >> np.uint64(20)) & np.uint64(0xFFFFF) | np.uint64(1)
    return segment.astype(np.int64), np.stack([((a + np.uint64(i) * b) % np.uint64(SEGMENT)).astype(np.int64) for i in range(HASHES)])


class Seen:
    """Two filters of a fixed size, once-seen and twice-seen, filled batch by batch: memory never follows the rows."""

    def __init__(self, bits: int):
        self.once, self.twice = (np.zeros((bits // SEGMENT, SEGMENT // 8), np.uint8) for _ in range(2))

    def enter(self, hashes: np.ndarray) -> None:
        """Enters hashes, repeats included: what `once` may hold already goes into `twice`."""
        hashes, times = np.unique(hashes, return_counts=True)
        again = (times > 1) | contains(self.once, hashes)
        self._set(self.twice, hashes[again])
        self._set(self.once, hashes)

    def _set(self, whole: np.ndarray, hashes: np.ndarray) -> None:
        segment, bit = places(hashes, whole.shape[0] * SEGMENT)
        np.bitwise_or.at(whole.reshape(-1), (segment * (SEGMENT // 8) + (bit >> 3)).ravel(), (np.uint8(128) >> (bit & 7).astype(np.uint8)).ravel())

    def segments(self) -> Iterator[pa.RecordBatch]:
        """(segment, once, twice), empty segments left out."""
        rows = []
        for k in np.flatnonzero(self.once.any(axis=1)):
            rows.append((int(k), *(zlib.compress(x[k].tobytes(), 1) for x in (self.once, self.twice))))
            if len(rows) == 64:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows) -> pa.RecordBatch:
    segment, once, twice = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(segment, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["segment", "once", "twice"])


SCHEMA = "segment long, once binary, twice binary"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by segment; one segment is held at a time."""
    now = once = twice = None
    for b in batches:
        for segment, o, t in zip(*(c.to_pylist() for c in b.columns)):
            o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
            if segment == now:
                once, twice = once | o, twice | t | (once & o)
                continue
            if now is not None:
                yield _batch([(now, zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1))])
            now, once, twice = segment, o, t
    if now is not None:
        yield _batch([(now, zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1))])


def merged(parts: DataFrame, bits: int, which: str) -> np.ndarray:
    """The filter `once` or `twice` on the driver, bits / 8 bytes in all, whatever the input."""
    whole = np.zeros((bits // SEGMENT, SEGMENT // 8), np.uint8)
    done = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, SCHEMA).select("segment", which)
    for row in done.collect():
        whole[row[0]] = np.frombuffer(zlib.decompress(row[1]), np.uint8)
    return whole


def built(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """The filter of a column of 64-bit hashes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(bits)
        for b in batches:
            seen.enter(b.column(column).to_numpy(zero_copy_only=False).view(np.uint64))
        yield from seen.segments()

    return merged(keys.mapInArrow(build, SCHEMA), bits, "once")


def contains(whole: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Flags of the hashes that may have been entered."""
    segment, bit = places(hashes, whole.shape[0] * SEGMENT)
    return np.all((whole[segment, bit >> 3] >> (7 - (bit & 7))) & 1, axis=0)


def bit_map(terms: DataFrame, bits: int = MAP_BITS) -> np.ndarray:
    """2**bits flags, packed, set for the low bits of the column term; made by tasks in parts of 4 KB, 2 MB in all at 24 bits."""
    slot = F.col("term").bitwiseAND((1 << bits) - 1) + 1  # Spark numbers positions from 1 on
    parts = terms.select(F.bitmap_bucket_number(slot).alias("part"), F.bitmap_bit_position(slot).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("flags"))
    packed = np.zeros((1 << bits) >> 3, np.uint8)
    for row in parts.collect():
        packed[(row.part - 1) * len(row.flags) : row.part * len(row.flags)] = np.frombuffer(row.flags, np.uint8)
    return packed


def asked(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the 64-bit h may be in the map."""
    slot = (h & np.uint64(len(packed) * 8 - 1)).astype(np.int64)
    return (packed[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
