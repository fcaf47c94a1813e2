"""Reports and scan entries as JSON lines: typed reading with checks, and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relsift.functions.scoring import decomposes, severity
from relsift.schemas import REPORT, REPORT_FIELDS

ENTRY = f"package string, from_version string, to_version string, report struct<{', '.join(c.replace(' ', ':', 1) for c in REPORT_FIELDS)}>, error string"


def read_reports(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Saved reports, old ones with fewer fields too: what they lack is null or empty."""
    df = spark.read.schema(REPORT).option("multiLine", multi_line).json(path)
    for c in ("dimensions", "feed_results", "score_modifiers", "caveats"):
        df = df.withColumn(c, F.coalesce(c, F.array().cast(dict(df.dtypes)[c])))
    return df


def faults(df: DataFrame) -> DataFrame:
    """The reports with a column `faults`: texts of what doesn't hold, empty for a valid report.

    Weights add up to 1 within a hundredth unless there are none; severity is the score's bucket; ranges hold.
    """
    weights = F.aggregate("dimensions", F.lit(0.0), lambda a, d: a + d["weight"])
    said = lambda bad, text: F.when(F.coalesce(bad, F.lit(True)), text)
    odd = lambda d: ~(d["score"].between(0, 10)) | ~(d["weight"].between(0, 1)) | ~F.coalesce(d["confidence"].between(0, 1), F.lit(True))
    found = F.array(
        said(F.col("risk_score").isNull() | ~F.col("risk_score").between(0, 100), "risk_score out of range"),
        said((F.size("dimensions") > 0) & (F.abs(weights - 1) > 0.01), "weights do not add up to 1"),
        said(F.col("severity") != severity(F.round(F.col("risk_score").cast("decimal(20,8)"), 1)), "severity is not that of the score"),
        said(F.exists("dimensions", odd), "dimension out of range"),
        said(~F.coalesce(decomposes(df), F.lit(True)), "score does not decompose"),
    )
    return df.withColumn("faults", F.filter(found, lambda x: x.isNotNull()))


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, nulls and order of fields kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    as_json(df).write.mode("errorifexists").text(path)


def exceeding(df: DataFrame, threshold: float, score: str = "risk_score") -> DataFrame:
    """Reports above a threshold, strictly."""
    return df.where(F.col(score) > threshold)


def scan_counts(entries: DataFrame) -> DataFrame:
    """total, scored, flagged, errored (K04, A10): flagged is a severity above LOW."""
    return entries.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("scored"), F.count_if(flagged(F.col("severity"))).alias("flagged"), F.count_if(F.col("error").isNotNull()).alias("errored"))


def flagged(sev: Column) -> Column:
    return F.coalesce(sev != "LOW", F.lit(False))
