"""Mixing sources to target weights, with exact budgets cut by distributed prefix sums.

A document's size is its number of blank-separated words. Sources, by code point and null
last, weigh 1, 2, 3 and so on in turn, and share all sizes in proportion; a target stops at
MOST times its source's size, and what it would have had beyond goes to the others by
weight until none is above (water filling, in closed form).

Each document gets a hash-random key. A source is cut into equal ranges of keys, as many as
its rows call for, so a source of a third of all rows is spread over as many tasks as others.
Range totals are summed ahead for each source (one small row for each range), rows are sorted
within their range, and a document's place in its source is the range's start plus the words
sorted before it. A budget of e whole epochs and a rest takes every document e times, and
once more the documents, words for the last one, that the rest reaches: the cut is exact.

Defined results: null text has size 0 and takes 0. Repeated rows are documents of their own;
equal keys order by doc_id, then size. Keys depend on doc_id, the text and SEED alone, so that reruns agree and rows
that have no id, or share one, are spread like others; only rows equal in both share a key, and a range. Targets are
doubles, budgets their floor. A source of size 0 has target 0; an empty table gives an empty table. Columns other than doc_id, text and source are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relsift.llm._session import written

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix"
#: Rows that a range of keys should hold.
RANGE_ROWS = 4_000
#: Bits of a key that choose its range: their number times the number of ranges stays below 2**63.
KEY_BITS = 32


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, key): key is a hash-random text of hexadecimal digits."""
    return documents.select(
        F.col("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.sha2(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))), 256).substr(1, 32).alias("key"),
    )


def targets(sources: DataFrame) -> DataFrame:
    """(source, n_rows, source_size, target) from (source, n_rows, source_size), one row for each source."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    big = lambda c: c.cast("decimal(38,0)")
    s = sources.withColumn("w", big(weight)).withColumn("cap", big(F.col("source_size") * MOST))
    # filled in the order of cap / weight: before the first source that is not full, all are
    rising = Window.orderBy((F.col("cap").cast("double") / F.col("w").cast("double")), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("all", big(F.sum("source_size").over(every))).withColumn("full", big(F.coalesce(F.sum("cap").over(before), F.lit(0)))).withColumn("left_w", big(F.sum("w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    s = s.withColumn("rest", F.col("all") - F.col("full")).withColumn("open", F.col("rest").cast("double") * F.col("w").cast("double") <= F.col("cap").cast("double") * F.col("left_w").cast("double"))
    # the first open source fixes the level for itself and all after it
    level = s.withColumn("at", F.row_number().over(rising)).withColumn("from", F.min(F.when(F.col("open"), F.col("at"))).over(every))
    pick = lambda c: F.max(F.when(F.col("at") == F.col("from"), F.col(c))).over(every)
    level = level.withColumn("rest_", pick("rest")).withColumn("left_", pick("left_w"))
    share = F.col("w").cast("double") * F.col("rest_").cast("double") / F.col("left_").cast("double")
    return level.select("source", "n_rows", "source_size", F.when(F.col("from").isNull() | (F.col("at") < F.col("from")), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mixed(documents: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document."""
    docs = written(sized(documents), "sized")
    sources = targets(docs.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size")))
    sources = sources.withColumn("ranges", F.greatest(F.ceil(F.col("n_rows") / range_rows), F.lit(1)).cast("long")).withColumnRenamed("source", "of")
    sources = written(sources, "sources")  # Spark then knows its size, and broadcasts it if that is small
    number = F.conv(F.substring("key", 1, KEY_BITS // 4), 16, 10).cast("long")
    ranged = docs.join(sources, F.col("source").eqNullSafe(F.col("of"))).withColumn("range", F.shiftright(number * F.col("ranges"), KEY_BITS)).drop("of", "n_rows", "ranges")
    totals = ranged.groupBy(F.col("source").alias("of"), F.col("range").alias("nth")).agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("of").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    opens = totals.select("of", "nth", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("opens"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(opens, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("nth")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("opens") - F.col("inside")))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
