"""Vectorised text primitives shared by the Arrow-backed operators.

Everything here works on UTF-8 bytes, one bounded slice of an Arrow batch at a
time, so memory follows the slice (or the longest single text) and never the
partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

U64 = np.uint64


def _odd_stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit words (splitmix64), the same on every machine."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = _odd_stream(7, 256)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, cached and grown on demand."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 4096), base, dtype=U64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[base] = np.cumprod(step, dtype=U64)
    return have[:n]


def separators(keep) -> np.ndarray:
    """A table of 256 flags: True where the byte stands between words."""
    return np.array([not keep(b) for b in range(256)])


#: Words are runs of anything but blanks (\x20, \x09-\x0D).
BLANKS = separators(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words are runs of ASCII digits and letters and of any non-ASCII character.
NON_WORD = separators(lambda b: b >= 0x80 or chr(b).isalnum())


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(values: list[bytes | None]) -> pa.Array:
    """A string column of these bytes as they are. What isn't UTF-8 stays so: it is neither checked nor mended."""
    made = pa.array(values, pa.binary())
    return pa.StringArray.from_buffers(len(made), *made.buffers()[1:], made.buffers()[0], made.null_count)


def code_points(text: bytes) -> int:
    """Characters of UTF-8; of other bytes, those that don't continue one."""
    return len(text) if text.isascii() else int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges holding at most limit bytes each, or one longer text alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


class Words:
    """The words of several texts: byte bounds, and which words each text owns.

    starts, ends: byte bounds of each word in `data`; first[i]:first[i+1] are the
    words of text i.
    """

    def __init__(self, texts: list[bytes], between: np.ndarray):
        self.data = b"\n".join(texts) + b"\n"
        self.bytes = np.frombuffer(self.data, np.uint8)
        edges = np.flatnonzero(np.diff(between[self.bytes], prepend=True))
        self.starts, self.ends = edges[0::2], edges[1::2]
        opens = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=opens[1:])
        self.first = np.searchsorted(self.starts, opens)

    def __len__(self) -> int:
        return len(self.starts)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, *cuts: int) -> list[np.ndarray]:
        """A 64-bit hash of each word, then one of its first c bytes for each c of cuts.

        A polynomial modulo 2**64, which unlike words can share: a hint to what may be equal, and no proof.
        """
        out = [np.empty(len(self), U64) for _ in range(1 + len(cuts))]
        lo = 0
        while lo < len(self):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + SLICE_BYTES)))
            at = self.starts[lo]
            seen = self.bytes[at : self.ends[hi - 1]]
            a, z = self.starts[lo:hi] - at, self.ends[lo:hi] - at
            with np.errstate(over="ignore"):
                total = np.zeros(len(seen) + 1, U64)
                np.cumsum(_BYTE[seen] * powers(_BASE, len(seen)), out=total[1:])
                before, scale = total[a], powers(_INVERSE, len(seen))[a]
                for k, cut in enumerate((None, *cuts)):
                    out[k][lo:hi] = (total[z if cut is None else np.minimum(z, a + cut)] - before) * scale
            lo = hi
        return [mix(x) for x in out]


def windows(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Hash of h[i:i+n] for each i, order-sensitive (a rolling polynomial modulo 2**64, no proof of equality either)."""
    if len(h) < n:
        return np.empty(0, U64)
    base |= 1
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, U64)
        np.cumsum(h * powers(base, len(h)), out=total[1:])
        out = (total[n:] - total[:-n]) * powers(pow(base, -1, 1 << 64), len(h))[: len(h) - n + 1]
    return mix(out)


def canonical(texts: list[bytes]) -> list[bytes]:
    """The texts' words (runs of non-blanks) joined by single blanks: equal runs of words are then equal bytes."""
    return [b" ".join(t.split()) for t in texts]


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of data[start:end] for each pair of bounds, as rows of two longs."""
    made = [hashlib.blake2b(data[a:z], digest_size=16).digest() for a, z in zip(starts.tolist(), ends.tolist())]
    return np.frombuffer(bytearray(b"".join(made)), "<i8").reshape(-1, 2)


def ragged(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column: row i holds values[bounds[i]:bounds[i+1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
