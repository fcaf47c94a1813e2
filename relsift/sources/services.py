"""Answers of registries and feeds as a data source: spark.read.format("relsift_responses").

Two ways to read, by option:
- requests: a folder of Parquet files of requests (REQUEST). Each file is a partition, whose task sends its requests
  and gives an answer a request.
- replay: a folder of Parquet files of saved answers (ANSWER). Each file is a partition; nothing is sent.

Folders are any that pyarrow opens by address (file, hdfs, s3, gs; s3a is read as s3). Equalities and lists of values of
kind, ecosystem, package and version are pushed down: what they exclude is neither sent nor given. Other options:
rate (calls a second of all partitions together, 0: no bound), at_once (calls under way in a task), opener ("module:name"
of a function url, post -> status, headers, parts; default https), settings (JSON of fields of Settings).

A failure is a row with an error and no body; `status` is the service's, null where none came. Empty and null urls fail so.
Answers in pages (next_page_token) are one row with all pages' lists. Equal requests are each sent; callers make them distinct.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from relsift.session import new_folder, prepare
from relsift.settings import Settings
from relsift.sources import fetch
from relsift.sources.calls import Pace, in_order

NAME = "relsift_responses"
KEYS = ("kind", "ecosystem", "package", "version")
REQUEST = "kind string, ecosystem string, package string, version string, url string, post string"
ANSWER = "kind string, ecosystem string, package string, version string, body string, status int, error string"
#: Kinds of requests.
DOCUMENT, VERSION, ADVISORIES, ATTESTATIONS, SCORECARD = "document", "version", "advisories", "attestations", "scorecard"
#: Rows of a request file that are read at a time.
BATCH = 256


@dataclass
class Part(InputPartition):
    path: str


def opened(folder: str):
    """(file system, path) of a folder's address; a plain path is this machine's."""
    from pyarrow import fs

    scheme, colon, rest = folder.partition(":")
    if not colon:
        return fs.LocalFileSystem(), folder
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri("s3:" + rest if scheme == "s3a" else folder)


def named(path: str | None) -> Callable | None:
    """The function that "module:name" names."""
    if not path:
        return None
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def pages(ask: Callable[[str, str | None], bytes], url: str, post: str | None) -> str:
    """The answer's text; where it names a next page, one object whose lists hold all pages' entries."""
    text = ask(url, post).decode("utf-8", "replace")
    if post is None or "next_page_token" not in text:
        return text
    whole, seen = json.loads(text), set()
    while token := whole.pop("next_page_token", None):
        if token in seen:
            raise fetch.Refused(f"pages repeat: {url}")
        seen.add(token)
        more = json.loads(ask(url, json.dumps(json.loads(post) | {"page_token": token})))
        for name, value in more.items():
            whole[name] = whole[name] + value if isinstance(value, list) and isinstance(whole.get(name), list) else value
    return json.dumps(whole)


def answered(row: dict, get: Callable, hosts: tuple[str, ...], settings: Settings, pace: Pace) -> dict:
    """The answer to a request."""

    def ask(url: str, post: str | None) -> bytes:
        def once():
            pace.wait()
            return fetch.download(url, hosts, lambda u: get(u, post), settings.max_download_bytes)

        return fetch.with_retry(once, fetch.limited, settings)

    out = {k: row[k] for k in KEYS} | {"body": None, "status": None, "error": None}
    try:
        return out | {"body": pages(ask, row["url"] or "", row["post"]), "status": 200}
    except Exception as e:  # noqa: BLE001  one bad lookup must not end the job
        return out | {"status": getattr(e, "status", None), "error": str(e)}


class Reader(DataSourceReader):
    def __init__(self, options):
        self.replay = options.get("replay")
        self.folder = self.replay or options.get("requests")
        if not self.folder:
            raise ValueError("give a folder of requests, or one to replay")
        self.rate, self.at_once, self.opener = float(options.get("rate", 0)), int(options.get("at_once", 4)), options.get("opener")
        self.settings = Settings(**json.loads(options.get("settings", "{}")))
        self.wanted: dict[str, set] = {}
        self.parts = 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in KEYS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[f.attribute[0]] = values & self.wanted.get(f.attribute[0], values)
            else:
                yield f

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        store, path = opened(self.folder)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        out = [Part(i.path) for i in found if i.is_file and i.path.endswith(".parquet") and not i.base_name.startswith(("_", "."))]
        self.parts = max(len(out), 1)
        return out

    def rows(self, part: Part) -> Iterator:
        """Batches of a file's rows that no pushed filter excludes."""
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        names = [c.split()[0] for c in (ANSWER if self.replay else REQUEST).split(", ")]
        store, _ = opened(self.folder)
        with store.open_input_file(part.path) as f:
            for b in pq.ParquetFile(f).iter_batches(BATCH, columns=names):
                for c, values in self.wanted.items():
                    b = b.filter(pc.is_in(b.column(c), pa.array([v for v in values if v is not None], pa.string())))
                if b.num_rows:
                    yield b.select(names)

    def read(self, part: Part) -> Iterator:
        import pyarrow as pa

        if self.replay:
            yield from self.rows(part)
            return
        schema = pa.schema([(c, pa.string()) for c in (*KEYS, "body")] + [("status", pa.int32()), ("error", pa.string())])
        get = named(self.opener) or fetch.https_opener(self.settings)
        hosts, pace = fetch.service_hosts(self.settings), Pace(self.rate / self.parts)
        each = (r for b in self.rows(part) for r in b.to_pylist())
        for r in in_order(lambda r: answered(r, get, hosts, self.settings, pace), each, self.at_once):
            yield pa.RecordBatch.from_pylist([r], schema)


class Responses(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ANSWER

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session, and lets filters reach it."""
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Responses)
    return spark


def asker(settings: Settings = Settings(), replay: str | None = None, parts: int | None = None, **options) -> Callable[[DataFrame], DataFrame]:
    """A function from requests to answers: those saved in the folder `replay`, or the services' own.

    Requests are made distinct and written to the shared folder in so many files, each sent by a task of its own."""

    def ask(requests: DataFrame) -> DataFrame:
        spark = register(requests.sparkSession)
        if replay:
            saved, asked = spark.read.format(NAME).option("replay", replay).load(), requests.select(*KEYS).distinct()
            same = [saved[c].eqNullSafe(asked[c]) for c in KEYS]
            return saved.join(asked, same, "left_semi")
        path = new_folder(spark, "requests")
        requests.select(*[c.split()[0] for c in REQUEST.split(", ")]).distinct().repartition(parts or settings.dependency_concurrency).write.parquet(path)
        return spark.read.format(NAME).options(requests=path, settings=json.dumps(asdict(settings)), **options).load()

    return ask
