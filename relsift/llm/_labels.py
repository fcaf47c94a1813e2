"""A bounded, repeatable sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, use: Column, bound: int) -> DataFrame:
    """Rows (doc_id, text, y) of documents with a 0/1 label, about `bound` at most; doc_id is a long.

    use: which doc_ids may be learnt from. A label row is in the sample if its
    id's hash is below bound / count, so reruns agree and the sample is drawn from
    the whole table. Rows whose id or label is null, or whose label is not 0 or 1,
    teach nothing. An id labelled twice counts once, with its larger label; of documents that
    share an id one is learnt from, that of the least hash of its text, so repeated ids don't add to the sample.
    The sample's ids have two short columns and at most about `bound` rows, hence the broadcast.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(use).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("y").alias("y"))
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 40)) < int(bound / n * (1 << 40)))
    text = F.col("text").cast("string")
    joined = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(known), "doc_id")
    # reduced in each task before it moves
    return joined.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))


def held_out(buckets: int, kept: int) -> Column:
    """True where crc32(doc_id as text) mod buckets is `kept`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % buckets == kept
