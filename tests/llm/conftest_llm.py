"""Fixtures in plain functions: invented prose, and documents tables."""

import random


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=False):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for c in ("row", "rest", "key", "n_lines", "n_words", "drops", "found", "score", "component_id", "fp", "size", "leak_", "value"):
            df = df.withColumn(c, F.lit("mine"))
    return df
