"""Extension, no part of the batch engine: pairs from a stream of releases.

Each package's last version is kept as state; a new release gives the pair (from, to) to compare.
Releases of a package within one micro-batch are taken in order of publication. A release that is
older than the last one known is a late arrival and gives no pair, as its successor is out already.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIRS = "package string, from_version string, to_version string, published_at timestamp"
STATE = "version string, published_at timestamp"


def _next_pairs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["published_at", "version"])
    last = state.get if state.exists else None
    out = []
    for version, at in zip(rows["version"], rows["published_at"]):
        if last is not None and at < last[1]:
            continue
        out.append((key[0], last[0] if last else None, version, at))
        last = (version, at)
    if last is not None:
        state.update(last)
    yield pd.DataFrame(out, columns=["package", "from_version", "to_version", "published_at"])


def pairs(releases: DataFrame) -> DataFrame:
    """releases: a stream of (package, version, published_at). The first release of a package has a null from_version."""
    return releases.groupBy("package").applyInPandasWithState(_next_pairs, PAIRS, STATE, "append", GroupStateTimeout.NoTimeout)
