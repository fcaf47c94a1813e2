"""A training corpus from raw documents: five stages, each by one operator of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet in the
shared folder and reads it back as the next stage's docs, and deletes what the stage and the one before it
left there. All but the last keep the columns of documents, and n_chars follows the text. Rows leave only
by a stage's own decision:

1. toxicity: documents scored 0.5 or more go.
2. line_dedup: repeated lines go, but for their first document; a document may be left empty.
3. simhash: of each component of near-duplicates the document of the least doc_id stays.
4. decontaminate: documents holding a window of a benchmark item go.
5. mix: what each remaining document gives to the mix: doc_id, size, source_size, target, taken.

Defined results, of all stages: an empty table gives an empty one; columns that documents has besides its own
pass through stages 1 to 4 under any name, and are not in the last one's result. Rows that repeat a doc_id, and
rows without one, are judged each on its own text, save where a stage's docstring says more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relsift.llm import decontaminate, line_dedup, mixing, simhash, toxicity
from relsift.llm._labels import held_out
from relsift.llm._session import dropped, prepare, scratch, written


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5, unchanged.

    Null and empty texts score the model's intercept and stay unless that alone is 0.5 or more. Equal texts are
    judged alike. Without labels of both classes nothing goes.
    """
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    # the model learns from the labels of the documents that are here, which are all of them in the first stage
    return toxicity.rejecting(docs, labels, ~held_out(5, 0))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their repeated lines gone; n_chars, where there is one, counts the characters left.

    Null text is one empty line and comes out as empty text. Rows that share a doc_id, and all rows without one, are
    one document: lines that they alone share stay in all of them. Ties: the least doc_id keeps a line, no id is the greatest.
    """
    prepare(spark)
    out = line_dedup.line_dedup(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that of the least doc_id, unchanged.

    Null and empty texts are all alike and so are one component. Rows that share the doc_id that stays all stay; rows without one go, unless some
    component has no id at all.
    """
    prepare(spark)
    return simhash.deduplicated(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, unchanged.

    Null and empty texts hold none and stay. An empty benchmark, items without words and items without an id drop nothing.
    """
    benchmark = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    leak = "leak" + "_" * max(map(len, docs.columns))  # no column of theirs
    found = decontaminate.decontaminated(docs, benchmark, leak=leak)
    return found.where(f"{leak}.n_hit = 0").drop(leak)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    Null and empty texts have size 0 and give nothing. Rows that repeat a doc_id are documents of their own. No source is a source like any other.
    """
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_line_dedup),
    ("simhash", stage_simhash),
    ("decontaminate", stage_decontaminate),
    ("mix", stage_mix),
]

#: The toxicity stage is a fitted model and the simhash stage needs XXH64: neither is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before: list[DataFrame] = []
    for name, stage in STAGES:
        with scratch():
            docs = written(stage(spark, docs, sf_dir), name, kept=True)
        dropped(*before)
        before = [docs]
    return docs
