"""Version histories, predecessors, and picks of one row among several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relsift.session import written


def predecessors(releases: DataFrame, by: list[str], order: list[str], version: str) -> DataFrame:
    """Adds previous_version: the one published just before, by time and not by version number; null for the first.

    Rows are sorted by package and time and dealt by range, so that a package with very many releases is several tasks' work;
    each range's last release of a package is carried to the next range that has it.
    """
    ordered = releases.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumns({"__part": F.spark_partition_id(), "__n": F.monotonically_increasing_id()})
    ordered = written(ordered, "releases")
    # one package within one range
    own = Window.partitionBy("__part", *by).orderBy("__n")
    near = ordered.withColumns({"__first": F.row_number().over(own) == 1, "__near": F.lag(version).over(own)})
    lasts = ordered.groupBy("__part", *by).agg(F.max_by(version, "__n").alias("__last"))
    # a row a range and package
    carried = lasts.withColumn("__far", F.lag("__last").over(Window.partitionBy(*by).orderBy("__part"))).where("__far is not null")
    a, b = near.alias("a"), carried.alias("b")
    on = F.col("a.__first") & (F.col("a.__part") == F.col("b.__part"))
    for c in by:
        on &= F.equal_null(F.col(f"a.{c}"), F.col(f"b.{c}"))
    return a.join(b, on, "left").select(*[F.col(f"a.{c}") for c in releases.columns], F.when(F.col("a.__first"), F.col("b.__far")).otherwise(F.col("a.__near")).alias("previous_version"))


def locked_with_predecessor(locked: DataFrame, releases: DataFrame) -> DataFrame:
    """locked (package, version) with previous_version; both unknown and first versions have null."""
    history = predecessors(releases, ["package"], ["published_at", "version"], "version").select("package", "version", "previous_version")
    return locked.join(history, ["package", "version"], "left")


def best(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def published(releases: DataFrame, by: list[str], time: str) -> DataFrame:
    """First upload of each release; releases without a dated file are left out."""
    return releases.where(F.col(time).isNotNull()).groupBy(*by).agg(F.min(time).alias("published_at"))


def artifact_rank(kind: Column) -> Column:
    """Source archives, then wheels, then anything else."""
    return F.when(kind == "sdist", 0).when(kind == "bdist_wheel", 1).otherwise(2)


def last_versions(versions: Column, n: int = 10) -> Column:
    """The last n of the sorted versions, for an error's text."""
    ordered = F.sort_array(versions)
    return F.slice(ordered, F.greatest(F.size(ordered) - n + 1, F.lit(1)), n)


def scan_entries(locked: DataFrame, releases: DataFrame) -> DataFrame:
    """(package, from_version, to_version, error): one row a dependency; an error where there is nothing to compare with."""
    found = locked_with_predecessor(locked, releases).join(releases.select("package", "version").distinct().withColumn("there", F.lit(True)), ["package", "version"], "left")
    # the last versions of packages whose pinned version isn't there, and of no others
    lost = found.where("there is null").select("package").distinct()
    known = releases.join(lost, "package", "left_semi").groupBy("package").agg(F.array_join(last_versions(F.collect_set("version")), ", ").alias("known"))
    found = found.join(known, "package", "left")
    unknown = F.when(F.col("there").isNull() & F.col("known").isNotNull(), F.concat("package", F.lit(" has no version "), "version", F.lit("; its last ones are "), "known"))
    error = F.when(F.col("previous_version").isNull(), F.coalesce(unknown, F.concat(F.lit("no earlier published version of "), F.col("package"), F.lit("@"), F.col("version"))))
    return found.select("package", F.col("previous_version").alias("from_version"), F.col("version").alias("to_version"), error.alias("error"))


def sorted_limit(rows: DataFrame, by: list[str], most: int = 25) -> DataFrame:
    """Distinct rows in order, at most so many; 0 means all."""
    out = rows.distinct().orderBy(*by)
    return out.limit(most) if most else out
