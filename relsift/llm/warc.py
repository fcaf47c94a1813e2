"""WARC archives of pages: written by Spark, read back as streams, segmented records reassembled.

Writing. A page's payload is its html in UTF-8. Pages of equal payloads (by SHA-256) are one response record and
revisit records that refer to it; a response's block is an HTTP message in chunked framing, and a block of more than
`segment` bytes is cut into a first record and continuation records. Which payloads repeat is found on hashes alone,
and a bit map of fixed size (2 MB) tells tasks whose pages must meet: all others are written where they lie, and of the
rest each task sends one payload a group on. Archives are gzip files of Spark's text writer, whose line end closes a record.

Reading. A gzip archive is read by one task as it comes, with one record in memory at most; archives that aren't
compressed may be split by Spark, so their lines are sorted by file and place first. Records that have a segment number
are grouped by origin identifier: lengths and numbers are verified on narrow rows, and only the segments of a whole record
are collected, ordered by number and joined. Then chunked framing is decoded and the payload's digest verified. Revisits get
their payload's length from the record they refer to.

Defined results: null and empty html is an empty payload. A null page_id is the least. Of rows with equal payload and
page_id the one with the greatest url, nulls least, is the response; wholly equal rows are one response and revisits.
Payloads under min_bytes are all responses. Of a url, white space and controls are percent-encoded in the archive. Other columns of
pages, whatever their names, aren't archived. What can't be read is a row with its reason in `error`: a broken header ends its archive,
a record whose segments are missing, doubled or of a wrong total length is one row, as is a wrong framing or digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relsift.llm import _bloom as bloom
from relsift.llm._session import written

SEGMENT = 1 << 14
CHUNK = 1 << 12
#: A record, whole or put together, of more bytes than this is an error, so that a task's memory is bounded.
MAX_RECORD = 1 << 30
MAX_HEADER = 1 << 16
_YIELD = 4 << 20
_END = b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(*parts: object) -> str:
    """A record identifier, the same for the same parts."""
    d = hashlib.sha256(repr(parts).encode()).hexdigest()
    return f"<urn:uuid:{d[:8]}-{d[8:12]}-{d[12:16]}-{d[16:20]}-{d[20:32]}>"


def _clean(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _record(block: bytes, **headers: object) -> bytes:
    """A record without its closing line ends. Headers of None are left out; _ stands for -."""
    lines = [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + _END + block


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing, extensions and trailers skipped; ValueError if it is broken or something follows it."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            raise ValueError("chunk size is broken")
        at, n = end + 2, int(size, 16)
        if not n:
            break
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2
    while (end := body.find(b"\r\n", at)) > at:
        at = end + 2  # trailer
    if end < 0 or end + 2 != len(body):
        raise ValueError("framing doesn't end with the block")
    return b"".join(out)


def response_records(name: str, date: str, payload: bytes, segment: int, **about: object) -> Iterator[bytes]:
    """The records of a response: one, or a first segment and its continuations."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    kept = dict(WARC_Type="response", WARC_Record_ID=name, WARC_Date=date, **about, WARC_Payload_Digest=f"sha1:{base32_sha1(payload)}", Content_Type="application/http;msgtype=response")
    if len(block) <= segment:
        yield _record(block, **kept)
        return
    yield _record(block[:segment], **kept, WARC_Segment_Number=1)
    for number, at in enumerate(range(segment, len(block), segment), 2):
        total = len(block) if at + segment >= len(block) else None
        yield _record(block[at : at + segment], WARC_Type="continuation", WARC_Record_ID=urn(name, number), WARC_Date=date, WARC_Segment_Origin_ID=name, WARC_Segment_Number=number, WARC_Segment_Total_Length=total)


def _out(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r)
        if size >= _YIELD:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["value"])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows, a slice at a time."""
    for lo in range(0, batch.num_rows, 256):
        yield from zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns))


def archive(pages: DataFrame, folder: str, min_bytes: int = 0, segment: int = SEGMENT, date: str | None = None) -> None:
    """Writes the records of pages (page_id, url, html) as gzip archives into a new folder."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    digest = F.unhex(F.sha2("payload", 256)).alias("digest")
    # payloads that may be equal to others'; shorter ones never meet
    term = F.when(F.length("payload") >= min_bytes, F.xxhash64("payload"))
    repeated = rows.select(term.alias("term")).where("term is not null").groupBy("term").count().where("count > 1")
    shared = pages.sparkSession.sparkContext.broadcast(bloom.bit_map(repeated))
    met = rows.select("page_id", "url", "payload", digest, term.alias("term"), F.monotonically_increasing_id().alias("place"))

    def suspect(batch: pa.RecordBatch) -> np.ndarray:
        h = batch.column("term")
        return h.is_valid().to_numpy(zero_copy_only=False) & bloom.asked(shared.value, h.fill_null(0).to_numpy().view(np.uint64))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for b in batches:
                for page, url, body, d, h, place in _rows(b.filter(pa.array(~suspect(b)))):
                    yield from response_records(urn(d) if h is not None else urn(d, place), date, body, segment, WARC_Target_URI=_clean(url), WARC_Page_ID=page)

        return _out(records())

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = b.filter(pa.array(suspect(b))).select(["page_id", "url", "digest", "payload"])
            if kept.num_rows:
                yield kept

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _out(r for b in batches for d, page, url, body in _rows(b) for r in response_records(urn(d), date, body, segment, WARC_Target_URI=_clean(url), WARC_Page_ID=page))

    def revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = dict(WARC_Type="revisit", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Date=date, Content_Type="application/http;msgtype=response")
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        return _out(
            _record(head, **about, WARC_Record_ID=urn(d, page, url, number), WARC_Target_URI=_clean(url), WARC_Page_ID=page, WARC_Refers_To=urn(d), WARC_Payload_Digest=f"sha1:{base64.b32encode(bytes(sha1)).decode()}")
            for b in batches
            for d, page, url, number, sha1 in _rows(b)
        )

    groups = met.select("page_id", "url", "digest", "payload", "term").withColumn("place", F.lit(0)).mapInArrow(together, "page_id long, url string, digest binary, payload binary")
    first = groups.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("head"), F.first("payload").alias("payload"))
    # the repeats once more, without payloads: equal rows are counted in each task
    narrow = written(groups.select("page_id", "url", "digest", F.unhex(F.sha1("payload")).alias("sha1")).groupBy("digest", "page_id", "url", "sha1").count(), "repeats")
    heads = narrow.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("head"), F.sum("count").alias("n")).where("n > 1").drop("n")
    left = F.col("count") - (F.struct("page_id", "url") == F.col("head")).cast("long")
    again = narrow.join(heads, "digest").withColumn("left", left).where("left > 0").select("digest", "page_id", "url", F.explode(F.sequence(F.lit(1), "left")).alias("number"), "sha1")
    parts = met.mapInArrow(alone, "value binary"), first.select("digest", "head.page_id", "head.url", "payload").mapInArrow(responses, "value binary"), again.mapInArrow(revisits, "value binary")
    for part in parts:
        # bytes as they are: a record may end within a character
        part.select(F.col("value").cast("string")).write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)


class Stream:
    """Records of an archive's bytes, fed as they come; what is kept is one record's bytes at most."""

    def __init__(self, file: str, most: int = MAX_RECORD):
        self.file, self.most, self.parts, self.have, self.want, self.broken, self.skip = file, most, [], 0, 1, False, 0

    def feed(self, data: bytes) -> Iterator[tuple]:
        if self.broken:
            return
        if self.skip:
            cut = min(self.skip, len(data))
            self.skip -= cut
            data = data[cut:]
        self.parts.append(data)
        self.have += len(data)
        if self.have < self.want:
            return
        data, at = b"".join(self.parts), 0
        while True:
            while data.startswith(b"\r\n", at):
                at += 2
            self.want = 1
            end = data.find(_END, at)
            if end < 0:
                if len(data) - at > MAX_HEADER:
                    yield self._break("header has no end")
                    return
                self.want = len(data) - at + 1
                break
            headers = parsed(data[at:end])
            length = headers.get("content-length", "")
            if not data.startswith(b"WARC/", at) or not re.fullmatch(r"[0-9]{1,18}", length):
                yield self._break("header is broken")
                return
            n, body = int(length), end + len(_END)
            if n > self.most:
                yield self.file, headers, None, f"record of {n} bytes"
                self.skip = max(0, body + n - len(data))
                at = min(len(data), body + n)
                continue
            if len(data) < body + n:
                self.want = body + n - at
                break
            yield self.file, headers, data[body : body + n], None
            at = body + n
        self.parts, self.have = [data[at:]], len(data) - at

    def _break(self, why: str) -> tuple:
        self.broken, self.parts, self.have = True, [], 0
        return self.file, {}, None, why

    def close(self) -> Iterator[tuple]:
        """What the archive ends with, if not a whole record."""
        if self.skip or b"".join(self.parts).strip(b"\r\n"):
            yield self._break("archive ends within a record")


def parsed(head: bytes) -> dict[str, str]:
    """Header fields by lower-cased name; the first of a name counts, folded lines are joined."""
    out: dict[str, str] = {}
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    for line in lines[1:]:
        name, sign, value = line.partition(b":")
        if sign:
            out.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    return out


RECORDS = "file string, headers map<string, string>, block binary, error string"
_RECORDS = pa.schema([("file", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("error", pa.string())])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of lines (file, line), each file's in order and together."""
    held, size, open_ = [], 0, None

    def batch() -> pa.RecordBatch:
        file, headers, block, error = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((file, [list(h.items()) for h in headers], block, error), _RECORDS)], schema=_RECORDS)

    def found() -> Iterator[tuple]:
        nonlocal open_
        for b in batches:
            files = b.column("file").dictionary_encode()
            number = files.indices.to_numpy()
            edges = np.flatnonzero(np.diff(number)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(number)]):
                if hi == lo:
                    continue
                name = files.dictionary[int(number[lo])].as_py()
                if open_ is None or open_.file != name:
                    if open_:
                        yield from open_.close()
                    open_ = Stream(name)
                yield from open_.feed(b"\n".join(b.column("line").slice(lo, hi - lo).to_pylist()) + b"\n")
        if open_:
            yield from open_.close()

    for r in found():
        held.append(r)
        size += 64 + len(r[2] or b"")
        if size >= _YIELD:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(file, headers, block, error): every record of the archives (*.gz, and *.warc uncompressed) in a folder."""
    lines = spark.read.schema("value string").option("lineSep", "\n")
    line = F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line")
    whole = lines.option("pathGlobFilter", "*.gz").text(folder).select(*line)
    place = F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("number")
    parts = lines.option("pathGlobFilter", "*.warc").text(folder).select(*line, *place)
    sorted_ = parts.repartition("file").sortWithinPartitions("file", "split", "number").select("file", "line")
    return whole.mapInArrow(_streamed, RECORDS).unionByName(sorted_.mapInArrow(_streamed, RECORDS))


def _header(name: str) -> Column:
    return F.col("headers")[name]


def reassembled(found: DataFrame, most: int = MAX_RECORD) -> DataFrame:
    """(headers, blocks, error): records with their block's parts in order. found is read more than once: a written table."""
    number, total = (_header(f"warc-segment-{x}").try_cast("long") for x in ("number", "total-length"))
    cut = F.col("error").isNull() & _header("warc-segment-number").isNotNull()
    single = found.where(~cut).select("headers", F.when(F.col("block").isNotNull(), F.array("block")).alias("blocks"), "error")
    segments = found.where(cut).select(F.coalesce(_header("warc-segment-origin-id"), _header("warc-record-id")).alias("origin"), number.alias("number"), total.alias("total"), "headers", "block")
    sums = segments.groupBy("origin").agg(F.count("*").alias("n"), F.min("number").alias("least"), F.max("number").alias("greatest"), F.sum(F.length("block")).alias("length"), F.max("total").alias("total"), F.count("total").alias("totals"))
    why = F.when(~F.equal_null(F.col("least"), F.lit(1)) | ~F.equal_null(F.col("greatest"), F.col("n")) | (F.col("totals") != 1), "segments are missing or doubled").when(F.col("length") != F.col("total"), "segments don't have the total length").when(F.col("length") > most, "record is too long")
    sums = sums.select("origin", why.alias("error"))
    bad = sums.where("error is not null").select(F.create_map(F.lit("warc-record-id"), F.coalesce("origin", F.lit(""))).alias("headers"), F.lit(None).cast("array<binary>").alias("blocks"), "error")
    whole = segments.join(sums.where("error is null").select("origin"), "origin").groupBy("origin").agg(F.min_by("headers", "number").alias("headers"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"))
    numbers = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    whole = whole.select("headers", F.when(numbers, F.col("parts.block")).alias("blocks"), F.when(~numbers, "segments are missing or doubled").alias("error"))
    return single.unionByName(whole).unionByName(bad)


PAGES = "page_id long, url string, record_type string, record_id string, refers_id string, payload_digest string, payload_bytes long, payload binary, error string"
_PAGES = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("url", "record_type", "record_id", "refers_id", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])


def decoded(kind: str | None, block: bytes, digest: str | None) -> tuple[bytes | None, str | None, str | None]:
    """(payload, digest, error) of a block of HTTP; other blocks are payloads themselves."""
    if not block.startswith(b"HTTP/"):
        payload = block
    else:
        head, sign, payload = block.partition(_END)
        if not sign:
            return None, digest, "HTTP header has no end"
        if kind != "revisit" and parsed(head).get("transfer-encoding", "").lower().split(",")[-1].strip() == "chunked":
            try:
                payload = unchunked(payload)
            except ValueError as e:
                return None, digest, str(e)
    if kind == "revisit":
        return None, digest, None
    made = base32_sha1(payload)
    return payload, made, None if digest is None or digest == made else "payload differs from its digest"


def _pages(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for headers, blocks, error in _rows(b):
                h = dict(headers or [])
                kind, digest = h.get("warc-type"), h.get("warc-payload-digest", "")
                digest = digest[5:] if digest.lower().startswith("sha1:") else None
                payload = None
                if error is None:
                    payload, digest, error = decoded(kind, b"".join(blocks), digest)
                page = h.get("warc-page-id", "")
                out.append((int(page) if re.fullmatch(r"-?[0-9]{1,18}", page) else None, h.get("warc-target-uri"), kind, h.get("warc-record-id"), h.get("warc-refers-to"), digest, None if payload is None else len(payload), payload if payloads else None, error))
                size += 256 + len(payload or b"") * payloads
                if size >= _YIELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _PAGES)], schema=_PAGES)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _PAGES)], schema=_PAGES)

    return run


def pages(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, payload, refers_to, error) of each response and revisit, and of what can't be read.

    refers_to is the page_id of the record that a revisit refers to, which holds the payload; the digest is bare base32.
    """
    found = written(records(spark, folder), "records")
    made = written(reassembled(found).mapInArrow(_pages(payloads), PAGES), "pages").where("error is not null or record_type in ('response', 'revisit')")
    kept = "page_id", "url", "record_type", "payload_digest", "payload_bytes", "payload"
    whole = made.where("error is not null or record_type = 'response'").select(*kept, F.lit(None).cast("long").alias("refers_to"), "error")
    heads = made.where("error is null and record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))
    again = made.where("error is null and record_type = 'revisit'").drop("error").join(heads, "refers_id", "left")
    why = F.when(F.col("bytes").isNull(), "refers to no record").when(~F.equal_null("payload_digest", "digest"), "digest differs from the record referred to")
    return whole.unionByName(again.withColumn("payload_bytes", F.col("bytes")).withColumn("error", why).select(*kept, "refers_to", "error"))
