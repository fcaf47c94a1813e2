"""Signing identities asserted by X.509 certificates: the first URI among the alternative names, else the first e-mail.

A small reader of DER suffices, as only one extension matters. Identities are what the
certificate says; no signature is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: object identifier 2.5.29.17, subject alternative names, in DER.
ALTERNATIVE_NAMES = bytes.fromhex("0603551d11")
MAIL, URI = 0x81, 0x86


def _element(der: bytes, at: int) -> tuple[int, int, int]:
    """(tag, start, end) of the contents of the element at a place."""
    tag, n = der[at], der[at + 1]
    at += 2
    if n & 0x80:
        size = n & 0x7F
        n, at = int.from_bytes(der[at : at + size], "big"), at + size
    if at + n > len(der):
        raise IndexError(at + n)
    return tag, at, at + n


def identity(der: bytes | None) -> str | None:
    """None if there is no certificate that can be read, or it has neither name."""
    at = (der or b"").find(ALTERNATIVE_NAMES)
    if at < 0:
        return None
    try:
        at += len(ALTERNATIVE_NAMES)
        tag, start, end = _element(der, at)
        if tag == 0x01:  # critical: a boolean stands before
            tag, start, end = _element(der, end)
        _, at, end = _element(der, start)  # the sequence within the octet string
        names = []
        while at < end:
            tag, start, at = _element(der, at)
            names.append((tag, der[start:at]))
    except IndexError:
        return None
    for wanted in (URI, MAIL):
        for tag, value in names:
            if tag == wanted:
                return value.decode("ascii", "replace")
    return None


def identities(rows: DataFrame) -> DataFrame:
    """Rows with a binary column der; adds identity in its place."""
    other = [c for c in rows.columns if c != "der"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in other), pa.array([identity(d) for d in b.column("der").to_pylist()], pa.string())], [*other, "identity"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*other).dtypes)
    return rows.select(*other, "der").mapInArrow(run, f"{kinds}, identity string")
