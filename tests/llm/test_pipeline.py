"""The pipeline's stages on rows with known fates, and the queries' columns."""

import random
from pathlib import Path

from conftest_llm import documents, prose

import corpus_pipeline
from relsift.llm._session import shared_folder
from relsift.llm.queries import ORACLES, QUERIES


def test_stages(ready, tmp_path):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        w = prose(i, 60).split()
        toxic = i % 4 == 0
        if toxic:
            w[r.randrange(60)] = "grubblex"
        rows.append((i, " ".join(w), f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    item = prose(9000, 15)
    long = prose(9001, 300)
    rows += [(1000, prose(9002, 40) + " " + item, "s1"), (1001, long, "s2"), (1002, long, "s0"), (1003, "a line in two documents\n" + prose(9003, 60), "s0"), (1004, "A line in two documents \n" + prose(9004, 60), None), (1005, None, "s1"), (None, prose(9005, 30), "s1")]
    documents(ready, rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    ready.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    ready.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = ready.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(ready, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = ready.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = {x.doc_id: x for x in docs.collect()}
        assert name == "mix" or docs.columns == columns
    gone = [i for i in range(400) if i not in seen["toxicity"]]
    assert sum(i % 4 == 0 for i in gone) >= 95 and sum(i % 4 != 0 for i in gone) <= 2
    assert {1000, 1001, 1002, 1003, 1004, 1005, None} <= set(seen["toxicity"])
    lines = seen["line_dedup"]
    assert lines[1003].text.startswith("a line") and not lines[1004].text.lower().startswith("a line")
    assert lines[1004].n_chars == len(lines[1004].text) and lines[1002].text == "" and lines[1001].text == long
    assert 1001 in seen["simhash"] and {1002, 1005} & set(seen["simhash"]) == {1002}  # two empty texts are alike
    assert 1000 not in seen["decontaminate"] and len(seen["decontaminate"]) == len(seen["simhash"]) - 1
    assert set(seen["mix"]) == set(seen["decontaminate"])
    folder = Path(shared_folder(ready).removeprefix("file:"))
    there = set(folder.iterdir())
    run = corpus_pipeline.run(ready, str(tmp_path))
    assert run.count() == len(seen["mix"])
    assert [f.name.partition("-")[0] for f in set(folder.iterdir()) - there] == ["mix"]  # all else is deleted
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_empty_tables(ready, tmp_path):
    docs = documents(ready, [(1, "x")]).limit(0).drop("n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ready.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    ready.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(ready, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_stages_on_odd_rows(ready, tmp_path):
    """Nulls in every column, repeated rows and ids, columns of clashing names."""
    from pyspark.sql import functions as F

    rows = [(1, None), (1, None), (2, ""), (3, "the same text here"), (3, "the same text here"), (3, "another text of three"), (None, "no id, and a text"), (None, None)]
    docs = documents(ready, rows).withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string"))
    docs = docs.select("*", *[F.lit(c).alias(c) for c in ("leak", "size", "taken", "__", "fp", "n_dropped", "a b")])
    ready.createDataFrame([(None, None, None), (1, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    ready.createDataFrame([(None, "x"), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        out = stage(ready, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r[c] == c for r in got for c in ("leak", "size", "taken", "__", "fp", "n_dropped", "a b"))
        assert len(got) == (8 if name != "simhash" else 7), name  # empty texts are one component; a component without an id keeps the rows without one
    assert corpus_pipeline.stage_mix(ready, docs, str(tmp_path)).count() == 8


def test_registry():
    import __spark_entry__

    assert len([q for q in QUERIES if q.startswith("op")]) == 13 and "pipeline" in __spark_entry__.queries()
    assert set(ORACLES) < set(QUERIES)
