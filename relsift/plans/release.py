"""Whole plans: pairs to reports, lockfiles to scan entries. Many pairs are one job, keyed by pair_id."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relsift.functions.feeds import no_feeds
from relsift.functions.scoring import caveats, scored
from relsift.operators import chunk, history, metadata, scorers, strip, tree
from relsift.schemas import SCHEMA_VERSION, SUMMARY, TIMINGS
from relsift.session import Stage, side_by_side, written
from relsift.settings import Settings
from relsift.sources import archives, fetch

NAMES = ("pair_id", "ecosystem", "package", "from_version", "to_version")


@contextmanager
def timed(into: dict, name: str):
    """Wall-clock seconds of a stage's actions, to three places."""
    began = time.monotonic()
    try:
        yield
    finally:
        into[name] = round(time.monotonic() - began, 3)


def timings(log: list[Stage], total: float) -> Column:
    """A report's timings from the log of the stages that were written for it (X06). The scorer and the feeds overlap, and
    analysis is the span of both; what is neither they, nor files, nor the report is counted as diffing."""
    of = lambda *names: [s for s in log if s.name in names]
    sums = lambda found: sum(s.seconds for s in found)
    both = of("responses", "feeds")
    span = max(s.began + s.seconds for s in both) - min(s.began for s in both) if both else 0.0
    diffing = [s for s in log if s.name not in ("files", "responses", "feeds", "answers", "added", "report")]
    seconds = {"fetch": sums(of("files")), "diff": sums(diffing), "llm": sums(of("responses")), "feeds": sums(of("feeds")), "analysis": span, "total": total}
    return F.struct(*[F.lit(round(v, 3)).alias(f"{k}_seconds") for k, v in seconds.items()]).cast(TIMINGS)


def diffs_of(files: DataFrame, settings: Settings = Settings(), strip_comments: bool = False) -> DataFrame:
    """The files' diffs, as a table that summaries and chunks read."""
    diffs = tree.file_diffs(files, settings)
    return written(strip.stripped(diffs) if strip_comments else diffs, "diffs")


def diff_summaries(pairs: DataFrame, files: DataFrame, settings: Settings = Settings(), strip_comments: bool = False, diffs: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """(pair_id, summary) of pairs whose files are (pair_id, side, path, text, size, sha256)."""
    diffs = diffs_of(files, settings, strip_comments) if diffs is None else diffs
    gone = None
    if strip_comments:
        gone = diffs.groupBy("pair_id").agg(F.sum("comment_lines_stripped").alias("comment_lines_stripped"))
        diffs = diffs.drop("comment_lines_stripped")
    found = pairs.select("pair_id").join(tree.summaries(diffs, texts), "pair_id", "left").join(metadata.metadata_diff(files), "pair_id", "left")
    found = found.join(gone, "pair_id", "left") if gone is not None else found.withColumn("comment_lines_stripped", F.lit(0).cast("long"))
    kinds = dict(found.dtypes)
    empty = {"string": F.lit(""), "boolean": F.lit(False), "bigint": F.lit(0).cast("long")}
    value = lambda c: F.coalesce(F.col(c), empty.get(kinds[c], F.array().cast(kinds[c]))) if c in kinds else None
    given = {"comments_stripped": F.lit(strip_comments)}
    none = lambda t: F.array().cast(t) if t.startswith("array") else empty[t]
    fields = pairs.sparkSession.createDataFrame([], f"s {SUMMARY}").schema["s"].dataType
    parts = []
    for f in fields:
        made = given.get(f.name, value(f.name))
        parts.append((none(f.dataType.simpleString()) if made is None else made).alias(f.name))
    return found.select("pair_id", F.struct(*parts).cast(SUMMARY).alias("summary"))


def _with_bookkeeping(summaries: DataFrame, kept: DataFrame) -> DataFrame:
    names = [c for c in kept.columns if c != "pair_id"]
    s = F.col("summary")
    for c in names:
        s = s.withField(c, F.col(c))
    return summaries.join(kept, "pair_id").select("pair_id", s.alias("summary"))


def _or_failed(responses: DataFrame | Exception, pieces: DataFrame) -> DataFrame:
    """The responses, or one error a chunk where their job failed."""
    if isinstance(responses, Exception):
        return pieces.select("pair_id", "chunk_idx", F.lit(None).cast("string").alias("raw"), F.lit(str(responses)).alias("error"))
    return responses


def reports(pairs: DataFrame, files: DataFrame, feeds: DataFrame | Callable[[DataFrame, DataFrame], DataFrame] | None = None, scorer: Callable[[DataFrame], DataFrame] | None = None, settings: Settings = Settings(), strip_comments: bool = False, split_large: bool = False, model: str = "stub", texts: bool = True) -> DataFrame:
    """One report a pair (lifecycle of a diff). scorer maps chunks to responses; without one the stub rates.

    feeds: (pair_id, feed_results), or a function that looks them up for (pairs, (pair_id, new_dependencies)); without them
    all are no_data. Such a function and a scorer run at the same time; if looking up fails, all feeds are no_data, and if
    the scorer's job fails, all pairs have its error. files may have a column error, as those
    of archives do: a pair with one is not compared. A pair with such an error, or whose scorer failed, has an
    error and no score; the columns are those of a report, and pair_id and error. texts: whether reports hold the diffs
    themselves; chunks for the scorer do in any case.
    """
    faults = None
    if "error" in files.columns:
        faults = files.where("error is not null").groupBy("pair_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(" archive: ", "side", "error"))), "; ").alias("fault"))
        files = files.join(faults, "pair_id", "left_anti").drop("error")
    diffs = diffs_of(files, settings, strip_comments)
    summed = diff_summaries(pairs, files, settings, strip_comments, diffs, texts)
    pieces, kept = chunk.chunks(summed, settings, split_large, diffs)
    summed = _with_bookkeeping(summed, kept)
    makers: dict[str, Callable[[], DataFrame]] = {}
    if scorer:
        makers["responses"] = lambda: scorer(pieces)
    if callable(feeds):
        added = written(summed.select("pair_id", F.col("summary.new_dependencies").alias("new_dependencies")), "added")
        makers["feeds"] = lambda: feeds(pairs, added)
    made = side_by_side(pairs.sparkSession, makers)
    rated = scorers.rated_dimensions(_or_failed(made["responses"], pieces)) if scorer else scorers.stub(pairs)
    if callable(feeds):
        looked_up = made["feeds"]
        feeds = no_feeds(pairs, f"The lookup failed: {looked_up}") if isinstance(looked_up, Exception) else looked_up
    feeds = no_feeds(pairs) if feeds is None else feeds
    digests = tree.digests(files).groupBy("pair_id").agg(F.max(F.when(F.col("side") == "from", F.col("digest"))).alias("from_version_sha256"), F.max(F.when(F.col("side") == "to", F.col("digest"))).alias("to_version_sha256"))
    joined = pairs.select(*NAMES).join(summed, "pair_id").join(rated, "pair_id").join(feeds, "pair_id").join(digests, "pair_id", "left")
    if faults is not None:
        joined = joined.join(faults, "pair_id", "left").withColumn("error", F.coalesce("fault", "error")).drop("fault")
    out = scored(joined)
    failed = F.col("error").isNotNull()
    blank = lambda c: F.when(~failed, F.col(c)).alias(c)
    return out.select(
        "pair_id", F.lit(SCHEMA_VERSION).alias("schema_version"), *NAMES[1:], blank("risk_score"), blank("severity"), blank("llm_base_score"), "dimensions", "feed_results", "score_modifiers",
        caveats(F.col("summary")).alias("caveats"), F.col("summary").alias("diff_summary"), F.lit(model).alias("llm_model"), "llm_summary", F.current_timestamp().alias("timestamp"), "from_version_sha256", "to_version_sha256", "error",
    )


def scan(locked: DataFrame, releases: DataFrame, load: Callable[[DataFrame], DataFrame], ecosystem: str, limit: int = 25, **options) -> DataFrame:
    """Scan entries (package, from_version, to_version, risk_score, severity, error) of pinned dependencies, in order.

    releases: (package, version, published_at). load(pairs) gives the pairs' files. A dependency
    without a predecessor is an error row; the others are one job.
    """
    some = history.sorted_limit(locked.select(F.col("name").alias("package"), "version"), ["package", "version"], limit)
    entries = history.scan_entries(some, releases)
    pairs = entries.where("error is null").select(F.concat_ws("@", "package", "to_version").alias("pair_id"), F.lit(ecosystem).alias("ecosystem"), "package", "from_version", "to_version")
    made = reports(pairs, load(pairs), **options).select("package", "to_version", "risk_score", "severity", F.col("error").alias("failed"))
    return entries.join(made, ["package", "to_version"], "left").select("package", "from_version", "to_version", "risk_score", "severity", F.coalesce("error", "failed").alias("error")).orderBy("package", "to_version")


def files_of_requests(requests: DataFrame, settings: Settings = Settings(), opener=None) -> DataFrame:
    """Files of artifacts that are downloaded and verified (S10, S11, P06, P07): requests are (pair_id, side, ecosystem,
    file_name, url, integrity, shasum, sha256). What can't be had, or isn't what its registry says, is a row with an error."""
    got = fetch.fetched(requests, settings, opener)
    content = F.col("content")
    true = F.when(F.col("ecosystem") == "npm", fetch.npm_verified(content, F.col("integrity"), F.col("shasum"))).otherwise(fetch.pypi_verified(content, F.col("sha256")))
    error = F.coalesce("error", F.when(~true, F.concat("file_name", F.lit(": its digest is not what the registry says"))))
    return files_of_archives(got.select("pair_id", "side", "file_name", F.when(error.isNull(), content).alias("content"), error.alias("error")), settings)


def archives_of(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(pair_id, side, file_name, path, content, error) of both sides of the pairs, from archives (path, file_name, content, error) named as
    registries name them; source archives go before wheels. A side without an archive is a row with an error."""
    sides = pairs.select("pair_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), "package", F.col(f"{s}_version").alias("version")) for s in ("from", "to")])).alias("s")).select("pair_id", "s.*")
    same = lambda c: F.regexp_replace(F.lower(c), "[-_.+]+", "-")
    wheel = F.lower("file_name").endswith(".whl")
    stem = F.regexp_replace("file_name", r"(?i)\.(tgz|tar\.gz|tar\.bz2|tar\.xz|tar|zip|whl)$", "")
    named = found.withColumn("key", same(F.when(wheel, F.regexp_replace(stem, "(-[^-]+){3}$", "")).otherwise(stem)))
    named = history.best(named, ["key"], [wheel, F.col("file_name")])
    joined = sides.withColumn("key", same(F.concat_ws("-", F.element_at(F.split("package", "/"), -1), "version"))).join(named, "key", "left")
    missing = F.when(F.col("file_name").isNull(), F.concat_ws("", F.lit("no archive of "), "package", F.lit("@"), "version"))
    path = F.col("path") if "path" in found.columns else F.lit(None).cast("string").alias("path")
    return joined.select("pair_id", "side", "file_name", path, "content", F.coalesce("error", missing).alias("error"))


def files_of_archives(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Files with their facts from archives (pair_id, side, file_name, content or path, and maybe error), and a row with an error for each that can't be had."""
    return tree.with_facts(archives.members(found, settings))
