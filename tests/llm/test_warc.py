"""WARC archives: round trips against plain Python, and archives that others wrote or that are broken."""

import hashlib
import random

import pytest
from conftest_llm import prose

from relsift.llm import warc

PAGES = "page_id long, url string, html string, value string, headers string, digest string"


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)


def round_trip(spark, tmp_path, rows, name="a", **how):
    folder = f"file://{tmp_path}/{name}"
    warc.archive(made(spark, rows).repartition(3), folder, **how)
    return folder, warc.pages(spark, folder)


def expected(rows, min_bytes=0):
    groups = {}
    for page, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((page, url))
    out = []
    low = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    for p, held in groups.items():
        held.sort(key=lambda r: (low(r[:1]), (r[1] is not None, r[1] or "")), reverse=True)
        for k, (page, _) in enumerate(held):
            alone = k == 0 or len(p) < min_bytes
            out.append((page, len(p), warc.base32_sha1(p), "response" if alone else "revisit", None if alone else held[0][0]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


LONG = "é<p>\r\n\r\nWARC/1.1\r\n" + prose(4, 40_000)
ROWS = [
    (1, "http://a/1", "<p>same"), (2, "http://a/2", "<p>same"), (9, None, "<p>same"), (9, "http://a/9", "<p>same"), (9, "http://a/9", "<p>same"),
    (3, "http://a/3", None), (4, "http://a/4", ""), (5, "http://a/ ü\r\n", LONG), (6, "u", LONG), (None, "u", LONG), (None, None, None),
    (7, "u", "ü" * 30_000), (8, "u", "0\r\n\r\n"), (10, "u", "\r\n\r\n"), (11, "u", "x\n"), (None, "u", "no id"), (None, "u", "no id"),
]


def test_round_trip(ready, tmp_path):
    folder, out = round_trip(ready, tmp_path, ROWS)
    got = out.collect()
    assert not [r for r in got if r.error]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(ROWS)
    whole = {(r.page_id, bytes(r.payload)) for r in got if r.payload is not None}
    assert (6, LONG.encode()) in whole and (7, ("ü" * 30_000).encode()) in whole and (8, b"0\r\n\r\n") in whole and (10, b"\r\n\r\n") in whole
    kinds = warc.records(ready, folder).groupBy("headers.warc-type").count().collect()
    assert {r[0] for r in kinds} == {"response", "revisit", "continuation"}


@pytest.mark.parametrize("how", [{"segment": 7}, {"min_bytes": 8}, {"segment": 1 << 40, "date": "2020-01-01T00:00:00Z"}])
def test_parameters(ready, tmp_path, how):
    rows = [(p, u, (h or "")[:500]) for p, u, h in ROWS]
    _, out = round_trip(ready, tmp_path, rows, **how)
    assert rows_of(out) == expected(rows, how.get("min_bytes", 0))


def test_empty_table(ready, tmp_path):
    _, out = round_trip(ready, tmp_path, [])
    assert out.count() == 0


def test_framing():
    r = random.Random(5)
    for n in (0, 1, 4095, 4096, 4097, 20_000):
        p = r.randbytes(n)
        assert warc.unchunked(warc.chunked(p)) == p
    assert warc.unchunked(b"3;name=x\r\nabc\r\n0a\r\n0123456789\r\n000\r\nTrailer: y\r\n\r\n") == b"abc0123456789"
    for bad in (b"", b"3\r\nab\r\n0\r\n\r\n", b"3\r\nabc0\r\n\r\n", b"x\r\n\r\n", b"1\r\na\r\n0\r\n", b"0\r\n\r\nmore", b"-1\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_stream_in_pieces():
    """However an archive's bytes are cut, the records are the same."""
    whole = b"".join(r + b"\r\n\r\n" for p in (b"", b"abc\r\n\r\n", bytes(range(256)) * 40) for r in warc.response_records(warc.urn(p), "d", p, 2000, WARC_Page_ID=1))
    want = [(h["warc-type"], b) for _, h, b, e in warc.Stream("f").feed(whole)]
    assert len(want) == 2 + 6
    for size in (1, 3, 100, 999):
        s, got = warc.Stream("f"), []
        for i in range(0, len(whole), size):
            got += [(h["warc-type"], b) for _, h, b, e in s.feed(whole[i : i + size])]
        assert got == want and not list(s.close())
    small = warc.Stream("f", most=500)
    seen = [r for i in range(0, len(whole), 77) for r in small.feed(whole[i : i + 77])] + list(small.close())
    assert [bool(r[3]) for r in seen] == [len(b) > 500 for _, b in want]  # too long ones are passed over
    assert list(s.feed(b"nonsense\r\n\r\n"))[0][3] and not list(s.feed(whole))


def cut(name, *parts, total=None, numbers=None):
    numbers = numbers or range(1, len(parts) + 1)
    size = sum(map(len, parts)) if total is None else total
    for k, (number, part) in enumerate(zip(numbers, parts)):
        about = dict(WARC_Record_ID=name, WARC_Type="response", WARC_Page_ID=name[1:]) if number == 1 else dict(WARC_Record_ID=f"{name}.{number}", WARC_Type="continuation", WARC_Segment_Origin_ID=name)
        yield warc._record(part, **about, WARC_Segment_Number=number, WARC_Segment_Total_Length=size if number == max(numbers) else None)


def test_segments_anywhere(ready, tmp_path):
    """Segments lie in any order over compressed and plain archives; broken ones are one error a record."""
    message = b"HTTP/1.0 200 OK\r\ntransfer-encoding: gzip, Chunked\r\n\r\n" + warc.chunked(b"payload " * 100, 33)
    good = [list(cut(f"p{i}", *(message[j : j + 90 + i] for j in range(0, len(message), 90 + i)))) for i in range(1, 6)]
    bad = [
        list(cut("p11", b"HTTP/1.1 200\r\n\r\n", b"b", b"c"))[:2],  # the last is missing
        list(cut("p12", b"a", b"b", b"c"))[1:],  # the first
        list(cut("p13", b"a", b"b", b"c", total=4)),
        list(cut("p14", b"a", b"b", b"c", b"d", numbers=(1, 2, 2, 4))),
        list(cut("p15", b"HTTP/1.1 200\r\ntransfer-encoding: chunked\r\n\r\n5\r\nab", b"c")),
    ]
    every = [r for g in good + bad for r in g]
    every.append(warc._record(b"plain", WARC_Type="response", WARC_Record_ID="p6", WARC_Page_ID=6, WARC_Payload_Digest="sha1:" + warc.base32_sha1(b"plain")))
    every.append(warc._record(b"plain", WARC_Type="response", WARC_Record_ID="p16", WARC_Page_ID=16, WARC_Payload_Digest="sha1:AAAA"))
    every.append(warc._record(b"", WARC_Type="revisit", WARC_Record_ID="p17", WARC_Page_ID=17, WARC_Refers_To="p99"))
    every.append(warc._record(b"", WARC_Type="warcinfo", WARC_Record_ID="i"))
    random.Random(2).shuffle(every)
    folder = tmp_path / "w"
    folder.mkdir()
    import gzip

    for k in range(4):
        part = b"".join((gzip.compress(x) if k % 2 else x) for x in (r + b"\r\n\r\n" for r in every[k::4]))
        (folder / (f"{k}.warc" + ".gz" * (k % 2))).write_bytes(part)
    (folder / "9.warc").write_bytes(warc._record(b"cut off here", WARC_Type="response", WARC_Record_ID="p20")[:-3])
    before = ready.conf.get("spark.sql.files.maxPartitionBytes")
    ready.conf.set("spark.sql.files.maxPartitionBytes", "700")  # plain archives are read in many splits
    try:
        got = warc.pages(ready, f"file://{folder}").collect()
    finally:
        ready.conf.set("spark.sql.files.maxPartitionBytes", before)
    fine = {r.page_id: bytes(r.payload) for r in got if r.error is None}
    assert fine == {**{i: b"payload " * 100 for i in range(1, 6)}, 6: b"plain"}
    assert sorted(r.error for r in got if r.error) == sorted(
        ["segments are missing or doubled"] * 3 + ["segments don't have the total length", "chunk is cut short", "payload differs from its digest", "refers to no record", "archive ends within a record"]
    )


def test_digest_is_base32():
    assert warc.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and len(hashlib.sha1().digest()) == 20
