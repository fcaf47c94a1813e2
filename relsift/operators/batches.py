"""Arrow batches in small slices, so that what Python makes of a batch is bounded by bytes and not by rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A slice's texts hold so many bytes at most, or are one row's.
MOST = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], *texts: str, most: int = MOST) -> Iterator[pa.RecordBatch]:
    """All rows of the batches, in order, in slices by the bytes of the columns `texts`."""
    for b in batches:
        size = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts)
        ends = np.cumsum(size)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + most, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi
