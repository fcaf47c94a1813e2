"""Shipping this package to Python workers, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from dataclasses import dataclass
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it lies at the driver's path.

    A cluster gets it with --py-files or an installed wheel; then this changes nothing.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, ROOT) if x)
    return spark


#: Tables written within each open `scratch` of this thread or task; a run's list is its own, whatever others do beside it.
_OPEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("relsift_scratch", default=())


@dataclass
class Stage:
    """A table that was written: wall-clock seconds of it, to three places, and its rows."""

    name: str
    began: float
    seconds: float
    rows: int


#: The log of the open `stages` of this thread or task.
_LOG: ContextVar[list[Stage] | None] = ContextVar("relsift_stages", default=None)


@contextmanager
def stages() -> Iterator[list[Stage]]:
    """A log of what is written within it: a stage a table, its rows counted as they are written."""
    log: list[Stage] = []
    token = _LOG.set(log)
    try:
        yield log
    finally:
        _LOG.reset(token)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a folder of our own only where it is unset and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = Path(tempfile.mkdtemp(prefix="relsift-")).as_uri()
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, kept: bool = False, began: float | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and any lost executor's part is read again.

    An open `scratch` deletes it in the end, unless it is kept. began: when work on it began, for an open log, if before now."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    log = _LOG.get()
    if log is None:
        df.write.parquet(path)
    else:
        seen, began = Observation(), time.monotonic() if began is None else began
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        log.append(Stage(name, began, round(time.monotonic() - began, 3), seen.get.get("rows") or 0))
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    if _OPEN.get() and not kept:
        _OPEN.get()[-1].append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that nothing will read again, to spare the shared folder."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t.scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes all tables that operators write within it. Results are lazy and read them: write results inside."""
    own: list[DataFrame] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        dropped(*own)


def side_by_side(spark: SparkSession, makers: dict[str, Callable[[], DataFrame]]) -> dict[str, DataFrame | Exception]:
    """Tables made and written at the same time, each in a scheduler pool of its name (X05). What fails is its exception and stops no other.

    With spark.scheduler.mode FAIR they share executors; else the later ones get what the first leaves free."""

    def made(name: str, make: Callable[[], DataFrame]) -> DataFrame | Exception:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            began = time.monotonic()
            return written(make(), name, began=began)
        except Exception as e:  # noqa: BLE001
            return e

    if not makers:
        return {}
    with ThreadPoolExecutor(len(makers)) as pool:
        under_way = {n: pool.submit(copy_context().run, inheritable_thread_target(spark)(made), n, m) for n, m in makers.items()}
        return {n: f.result() for n, f in under_way.items()}
