"""Members of package archives as rows, read as streams and never written to disk.

Archives come as (pair_id, side, file_name) with their content or a path, which the task opens and seeks in; each gives
a row per regular file. An archive is read twice: first all of it, to check limits on declared sizes and on the bytes as
they come and to note the names, with nothing kept; then once more, each member given away before the next is read. So
memory is bounded by one member, and by the archive itself only where it comes as a column.

An archive that breaks a limit, is beyond the download limit or can't be read gives a row with an error. That is its only
row, unless it changes or fails between the two readings: then rows went out before, and the error row retracts them, as a
pair with an error is not compared.
"""

from __future__ import annotations

import io
import lzma
import stat
import tarfile
import zipfile
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relsift.settings import Settings

MEMBERS = "pair_id string, side string, path string, content binary, error string"
WHEEL_FACTS = ".dist-info"


class Rejected(Exception):
    """An archive beyond a limit, or one that can't be read."""


def safe_path(path: str) -> bool:
    """Relative, without backslashes or parent parts."""
    return bool(path) and "\\" not in path and not path.startswith("/") and ".." not in path.split("/")


def is_safe(path: Column) -> Column:
    """The same as a column expression."""
    return (path != "") & ~F.contains(path, F.lit("\\")) & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


class _Limits:
    """Counts members and bytes, and rejects what exceeds the settings."""

    def __init__(self, settings: Settings):
        self.settings, self.files, self.total = settings, 0, 0

    def admit(self, name: str, size: int) -> None:
        self.files += 1
        self.total += size
        for what, now, most in (("files", self.files, self.settings.max_archive_files), ("bytes in one file", size, self.settings.max_archive_file_bytes), ("bytes in all", self.total, self.settings.max_extracted_bytes)):
            if now > most:
                raise Rejected(f"{name}: more than {most} {what}")


#: What the standard readers raise on archives that are none, or broken.
UNREADABLE = (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError, ValueError, RuntimeError, zlib.error, lzma.LZMAError)
BLOCK = 1 << 20


def _bounded(stream, size: int, name: str) -> bytes:
    data = stream.read(size + 1)
    if len(data) > size:
        raise Rejected(f"{name}: larger than declared")
    return data


class _Tar:
    """Tar archives of any compression; links, devices and unsafe paths are skipped."""

    @staticmethod
    def names(source: IO[bytes], settings: Settings) -> dict[str, int]:
        """Names with the place of the member that counts, the last of a name; walking over members unpacks all of them."""
        limits, found = _Limits(settings), {}
        with tarfile.open(fileobj=source, mode="r:*") as archive:
            for place, m in enumerate(archive):
                limits.admit(m.name, m.size if m.isreg() else 0)
                if m.isreg() and safe_path(m.name):
                    found[m.name.removeprefix("./")] = place
        return found

    @staticmethod
    def contents(source: IO[bytes], wanted: dict[str, int]) -> Iterator[tuple[str, bytes]]:
        places = {place: name for name, place in wanted.items()}
        with tarfile.open(fileobj=source, mode="r:*") as archive:
            for place, m in enumerate(archive):
                if place in places:
                    yield places[place], _bounded(archive.extractfile(m), m.size, m.name)


class _Zip:
    """Zip archives by their directory; links are told by the mode bits."""

    @staticmethod
    def names(source: IO[bytes], settings: Settings) -> dict[str, int]:
        limits, found = _Limits(settings), {}
        with zipfile.ZipFile(source) as archive:
            entries = archive.infolist()
            for m in entries:
                limits.admit(m.filename, m.file_size)
            for place, m in enumerate(entries):
                if not m.is_dir() and not stat.S_ISLNK(m.external_attr >> 16) and safe_path(m.filename):
                    found[m.filename] = place
            for place in found.values():
                left = entries[place].file_size
                with archive.open(entries[place]) as f:  # to the end, where its checksum is looked at
                    while block := f.read(BLOCK):
                        left -= len(block)
                        if left < 0:
                            raise Rejected(f"{entries[place].filename}: larger than declared")
        return found

    @staticmethod
    def contents(source: IO[bytes], wanted: dict[str, int]) -> Iterator[tuple[str, bytes]]:
        with zipfile.ZipFile(source) as archive:
            entries = archive.infolist()
            for name, place in wanted.items():
                with archive.open(entries[place]) as f:
                    yield name, _bounded(f, entries[place].file_size, name)


def read_members(file_name: str, source: IO[bytes] | bytes, settings: Settings = Settings()) -> tuple[list[str], Iterator[tuple[str, bytes]]]:
    """(all paths, a stream of (path, content)) of an archive that was read through and found right, by the name's suffix; other
    names are tried as tar, then as zip (S15). The source is something that can be read and sought in, or bytes."""
    source = io.BytesIO(source) if isinstance(source, bytes) else source
    name = file_name.lower()
    if name.endswith((".whl", ".zip", ".egg")):
        readers = [_Zip]
    elif name.endswith((".tgz", ".tar.gz", ".tar.bz2", ".tar.xz", ".tar")):
        readers = [_Tar]
    else:
        readers = [_Tar, _Zip]
    for reader in readers:
        source.seek(0)
        try:
            names = reader.names(source, settings)
        except UNREADABLE as e:
            if reader is readers[-1]:
                raise Rejected(f"{file_name}: {e}") from e
            continue
        return list(names), _again(file_name, source, reader, names)
    return [], iter(())


def _again(file_name: str, source: IO[bytes], reader: type, names: dict[str, int]) -> Iterator[tuple[str, bytes]]:
    source.seek(0)
    try:
        yield from reader.contents(source, names)
    except UNREADABLE as e:
        raise Rejected(f"{file_name}: {e}") from e


def root_prefix(paths: list[str], file_name: str) -> str:
    """What stands before the package's own files (S14): package/, or the only folder; for wheels the only one that isn't metadata."""
    tops = Counter(p.split("/", 1)[0] for p in paths if "/" in p)
    if not file_name.lower().endswith(".whl") and "package" in tops:
        return "package/"
    if file_name.lower().endswith(".whl"):
        tops = Counter({t: n for t, n in tops.items() if not t.endswith(WHEEL_FACTS)})
        return f"{next(iter(tops))}/" if len(tops) == 1 else ""
    alone = len(tops) == 1 and all("/" in p for p in paths)
    return f"{next(iter(tops))}/" if alone else ""


#: Schemes of paths that tasks open by themselves, with the names that they have there.
OPENED = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs"}


def opened(path: str) -> pa.NativeFile:
    """A file of one of these schemes, to read and seek in."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    if scheme not in OPENED:
        raise OSError(f"a task can't open {path}")
    system, inside = fs.FileSystem.from_uri(f"{OPENED[scheme]}:{rest}")
    return system.open_input_file(inside)


def _source(path: str | None, content: pa.Scalar) -> IO[bytes]:
    if content.is_valid:
        return pa.BufferReader(content.as_buffer())
    return opened(path) if path else io.BytesIO()


#: A batch of members goes out once it has so many, or so many bytes.
MEMBERS_AT_ONCE, BYTES_AT_ONCE = 256, 4 << 20
_ROWS = pa.schema([("pair_id", pa.string()), ("side", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def _files(file_name: str, source: IO[bytes], settings: Settings) -> Iterator[tuple[str, bytes]]:
    """Paths below the package's root, and contents."""
    names, found = read_members(file_name, source, settings)
    prefix = root_prefix(names, file_name)
    for path, content in found:
        if path.startswith(prefix):
            yield path.removeprefix(prefix), content


def members(archives: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(pair_id, side, path, content, error) of every archive; paths are below the package's root. An archive that comes with an
    error keeps it; one without content is opened at its path, if there is a column of that name, and else is empty."""

    def rows(pair_id: str, side: str, file_name: str, path: str | None, content: pa.Scalar, error: str | None) -> Iterator[tuple]:
        try:
            if error is not None:
                raise Rejected(error)
            try:
                source = _source(path, content)
            except OSError as e:
                raise Rejected(f"{file_name}: {e}") from e
            with source:
                for inside, data in _files(file_name, source, settings):
                    yield pair_id, side, inside, data, None
        except Rejected as e:
            yield pair_id, side, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in ("pair_id", "side", "file_name", "path")), b.column("content"), b.column("error").to_pylist())
            for key in keys:
                held, size = [], 0
                for row in rows(*key):
                    held.append(row)
                    size += len(row[3] or b"")
                    if len(held) == MEMBERS_AT_ONCE or size >= BYTES_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ROWS)], schema=_ROWS)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ROWS)], schema=_ROWS)

    given = lambda c, kind: (F.col(c) if c in archives.columns else F.lit(None)).cast(kind).alias(c)
    return archives.select("pair_id", "side", "file_name", given("path", "string"), given("content", "binary"), given("error", "string")).mapInArrow(run, MEMBERS)


def archive_files(spark: SparkSession, path: str, settings: Settings = Settings()) -> DataFrame:
    """(path, file_name, content, error) of archive files, as Spark lists them; those beyond the download limit have an error.

    Where tasks can open paths by themselves there is no content: then what is joined and shuffled is paths. Elsewhere Spark's reader gives it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name, most = F.element_at(F.split("path", "/"), -1), settings.max_download_bytes
    none = F.lit(None).cast("binary").alias("content")
    one = found.select("path").first()
    by_path = one is not None and one.path.partition(":")[0] in OPENED
    read = found.where(F.col("length") <= most).select("path", name.alias("file_name"), none if by_path else "content", F.lit(None).cast("string").alias("error"))
    over = found.where(F.col("length") > most).select("path", name.alias("file_name"), none, F.concat(name, F.lit(f": more than {most} bytes to download")).alias("error"))
    return read.unionByName(over)
