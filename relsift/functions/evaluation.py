"""How good verdicts were, from labels and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(judged: DataFrame, flagged: Column, bad: Column) -> DataFrame:
    """One row (tp, fp, fn, tn)."""
    return judged.agg(F.count_if(flagged & bad).alias("tp"), F.count_if(flagged & ~bad).alias("fp"), F.count_if(~flagged & bad).alias("fn"), F.count_if(~flagged & ~bad).alias("tn"))


def detection_gap(events: DataFrame, key: str, at: str, published: Column, advised: Column) -> DataFrame:
    """(key, gap_seconds) from the first publication to the first advisory, of keys that have both."""
    first = lambda which: F.min(F.when(which, F.col(at)))
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    both = events.groupBy(key).agg(first(published).alias("from"), first(advised).alias("to")).where("from is not null and to is not null")
    return both.select(key, (second("to") - second("from")).alias("gap_seconds"))
