"""Command line: diff two releases, scan a lockfile, or show a saved report.

Exit codes: 0, 1 if a score is above the threshold, 2 on errors.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
import time

from relsift.plans import render
from relsift.plans.release import timed
from relsift.session import scratch, stages


def session():
    from pyspark.sql import SparkSession

    from relsift.session import prepare

    return prepare(SparkSession.builder.appName("relsift").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.scheduler.mode", "FAIR").getOrCreate())


def options(args: argparse.Namespace, settings) -> dict:
    """What the flags of feeds and scorers mean for release.reports."""
    from relsift.operators import scorers
    from relsift.plans import lookups
    from relsift.sources.services import named

    out: dict = {"settings": settings, "model": args.model}
    if args.feeds or args.replay:
        out["feeds"] = lookups.feeds_by(asker_of(args, settings), settings, args.record)
    if args.scorer:
        complete = named(args.scorer)
        out["scorer"] = lambda pieces: scorers.live(pieces, complete, settings.dependency_concurrency, settings.chunk_concurrency, settings)
    return out


def asker_of(args: argparse.Namespace, settings):
    from relsift.sources.services import asker

    more = {"opener": args.opener} if args.opener else {}
    return asker(settings, args.replay, rate=args.rate, **more)


def arguments(argv=None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="relsift")
    top.add_argument("--verbose", action="store_true")
    kinds = top.add_subparsers(dest="command", required=True)
    diff = kinds.add_parser("diff", help="compare the archives of two versions")
    for name in ("ecosystem", "package", "from_version", "to_version"):
        diff.add_argument(name)
    for name in ("from_archive", "to_archive"):
        diff.add_argument(name, nargs="?", help="without archives both are downloaded from the registry")
    diff.add_argument("--strip-comments", action="store_true")
    diff.add_argument("--split-large-files", action="store_true")
    scan = kinds.add_parser("scan", help="compare a lockfile's dependencies with their predecessors")
    scan.add_argument("lockfile")
    scan.add_argument("--releases", required=True, help="Parquet of package, version, published_at")
    scan.add_argument("--archives", help="folder of archives, named package-version as registries do; without it dependencies are listed and not scored")
    scan.add_argument("--limit", type=int, default=25, help="0: all")
    report = kinds.add_parser("report", help="show a saved report")
    report.add_argument("file")
    for p in (diff, scan):
        p.add_argument("--feeds", action="store_true", help="ask the feeds of advisories, signing identities, scorecards and registries")
        p.add_argument("--replay", help="folder of saved answers, read instead of asking services")
        p.add_argument("--record", help="folder that answers are added to, for --replay")
        p.add_argument("--rate", type=float, default=0, help="calls a second of all tasks together, 0: no bound")
        p.add_argument("--opener", help="module:name of what opens addresses, instead of https")
        p.add_argument("--scorer", help="module:name of a function from a prompt to a response, instead of the stub")
        p.add_argument("--model", default="stub", help="the scorer's name in reports")
    for p in (diff, scan, report):
        p.add_argument("--format", choices=("text", "json"), default="text")
        p.add_argument("--output")
        p.add_argument("--threshold", type=float)
    return top.parse_args(argv)


def run(args: argparse.Namespace, log: list | None = None) -> int:
    from pyspark.sql import functions as F

    from relsift.operators import history
    from relsift.plans import lookups, release
    from relsift.session import written
    from relsift.settings import Settings
    from relsift.sources import archives, lockfiles, reports, services

    spark, began = session(), time.monotonic()
    if args.command == "diff":
        pair = ("pair", args.ecosystem, args.package, args.from_version, args.to_version)
        pairs = spark.createDataFrame([pair], "pair_id string, ecosystem string, package string, from_version string, to_version string")
        side = lambda path, name: archives.archive_files(spark, path, Settings.from_env()).select(F.lit("pair").alias("pair_id"), F.lit(name).alias("side"), "file_name", "path", "content", "error")
        settings = Settings.from_env()
        if (args.from_archive is None) != (args.to_archive is None):
            raise ValueError("give both archives or none")
        if args.from_archive is None:
            files = release.files_of_requests(lookups.artifact_requests(pairs, asker_of(args, settings), settings), settings, services.named(args.opener))
        else:
            files = release.files_of_archives(side(args.from_archive, "from").unionByName(side(args.to_archive, "to")), settings)
        df = release.reports(pairs, written(files, "files"), strip_comments=args.strip_comments, split_large=args.split_large_files, **options(args, settings))
        df = written(df, "report")
        if (bad := df.select("error").where("error is not null").first()) is not None:
            raise ValueError(bad.error)
        df = df.drop("pair_id", "error").withColumn("timings", release.timings(log or [], time.monotonic() - began))
    elif args.command == "report":
        df = reports.faults(reports.read_reports(spark, args.file))
        bad = df.select("faults").first()
        if bad is None or bad.faults:
            raise ValueError("; ".join(bad.faults) if bad else "no report in the file")
        df = df.drop("faults")
    else:
        files = spark.read.text(args.lockfile, wholetext=True).select(F.input_file_name().alias("file_name"), F.col("value").alias("text"))
        if (bad := lockfiles.malformed(files).first()) is not None:
            raise ValueError(bad.error)
        locked = lockfiles.parse_lockfiles(files).select(F.col("name").alias("package"), "version")
        releases = spark.read.parquet(args.releases)
        if args.archives:
            settings = Settings.from_env()
            found = archives.archive_files(spark, args.archives, settings)
            load = lambda pairs: written(release.files_of_archives(release.archives_of(pairs, found), settings), "files")  # noqa: E731  archives are unpacked once
            (kind,) = [r[0] for r in files.select(lockfiles.ecosystem_of(F.col("file_name"))).collect()]
            rows = [r.asDict() for r in release.scan(locked.withColumnRenamed("package", "name"), releases, load, kind, args.limit, **options(args, settings)).collect()]  # as many as are printed
            render.emit("\n".join(json.dumps(r) for r in rows) if args.format == "json" else render.scan_text(rows), args.output)
            return int(args.threshold is not None and any(r["risk_score"] is not None and r["risk_score"] > args.threshold for r in rows))
        entries = history.scan_entries(history.sorted_limit(locked, ["package", "version"], args.limit), releases).orderBy("package", "to_version")
        render.emit("\n".join(render.json_lines(entries)) if args.format == "json" else "\n".join(render.plain(f"{r.package} {r.from_version or '-'} -> {r.to_version} {r.error or ''}").rstrip() for r in entries.collect()), args.output)
        return 0
    lines = render.json_lines(df)
    render.emit("\n".join(lines) if args.format == "json" else "\n\n".join(render.report_text(json.loads(x)) for x in lines), args.output)
    return int(args.threshold is not None and reports.exceeding(df, args.threshold).limit(1).count() > 0)


def main(argv=None) -> int:
    args = arguments(argv)
    render.log_to_stderr(args.verbose)
    seconds: dict[str, float] = {}
    try:
        with timed(seconds, "total_seconds"), scratch(), stages() as log:
            try:
                return run(args, log)
            finally:
                for s in log:
                    logging.getLogger("relsift").info("stage %s took %s s, %s rows", s.name, s.seconds, s.rows)
    except Exception as e:  # noqa: BLE001  the exit code tells
        render.emit(render.error_text(str(e), args.format == "json"))
        return 2
    finally:
        logging.getLogger("relsift").info("%s took %s s", args.command, seconds.get("total_seconds"))


if __name__ == "__main__":
    sys.exit(main())
