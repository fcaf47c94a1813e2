"""Packing by jumps against the plain loop, for keys of any size."""

import random

import pytest
from pyspark.sql import functions as F

from relsift.operators import chunk, packing


def plain(sizes, first, room):
    """What each size's chunk is: a chunk that holds something closes when the next one doesn't fit."""
    out, k, used, limit = [], 0, 0, first
    for n in sizes:
        if used and used + n > limit:
            k, used, limit = k + 1, 0, room
        used += n
        out.append(k)
    return out


def table(spark, keys):
    rows = [(k, i, n) for k, sizes in keys.items() for i, n in enumerate(sizes)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k string, i int, n long").repartition(5)


CASES = {
    "one": [5], "zero": [0], "zeros": [0] * 7, None: [3, 4, 5], "large": [999999] * 4, "mixed": [0, 0, 50_000, 0, 0, 3, 0, 99_999, 0],
    **{f"r{s}": [random.Random(s).choice([0, 1, 3, 10, 97, 100, 101, 250]) for _ in range(random.Random(s).randint(1, 900))] for s in range(12)},
    "ones": [1] * 3000, "even": [50] * 500, "null": [None, 60, None, 60],
}


@pytest.mark.parametrize("room, first", [(100, 100), (100, 37), (-5, -5), (0, 40), (7000, 7000)])
@pytest.mark.parametrize("alone", [packing.ALONE, 0])
def test_packed(spark, room, first, alone):
    if alone == 0 and room not in (100, -5):
        pytest.skip("the same way")
    out = packing.packed(table(spark, CASES), "k", ["i"], "n", F.lit(room), F.lit(first), alone)
    got = {}
    for r in out.collect():
        got.setdefault(r.k, {})[r.i] = r.chunk
    for k, sizes in CASES.items():
        assert [got[k][i] for i in range(len(sizes))] == plain([n or 0 for n in sizes], first, room), k


def test_one_pair_of_very_many_blocks(spark):
    """A million rows of one key in well under a minute; the fold that this replaces was quadratic."""
    import time

    began = time.time()
    rows = spark.range(1_000_000).select(F.lit("p").alias("k"), F.col("id").alias("i"), (F.col("id") * 7919 % 3001).alias("n"))
    out = packing.packed(rows, "k", ["i"], "n", F.lit(80_000))
    got = out.groupBy("chunk").agg(F.sum("n").alias("s"), F.max("i").alias("last"), F.count("*").alias("c"))
    facts = got.agg(F.count("*"), F.max("s"), F.max("chunk"), F.sum("c")).first()
    want = plain([i * 7919 % 3001 for i in range(1_000_000)], 80_000, 80_000)
    assert tuple(facts) == (want[-1] + 1, facts[1], want[-1], 1_000_000) and facts[1] <= 80_000
    assert time.time() - began < 60


def test_running_sums(spark):
    out = {(r.k, r.i): r.ahead for r in packing.running_sums(table(spark, {"a": [1, 2, 3], "b": [5] * 50, None: [2, 2]}), "k", ["i"], "n").collect()}
    assert out == {("a", 0): 0, ("a", 1): 1, ("a", 2): 3, (None, 0): 0, (None, 1): 2, **{("b", i): 5 * i for i in range(50)}}


def test_empty(spark):
    assert packing.packed(table(spark, CASES).limit(0), "k", ["i"], "n", F.lit(9)).count() == 0


def test_cap(spark):
    got = chunk.packed_rows(table(spark, {"a": [60] * 5}), "k", "i", "n", 100, most=2).orderBy("i").collect()
    assert [r.chunk for r in got] == [0, 1, -1, -1, -1] and got[0].asDict().keys() == {"k", "i", "n", "chunk"}


@pytest.mark.parametrize("wide", [1024, packing.LEAST_WIDE])
def test_stretches_of_any_width(spark, monkeypatch, wide):
    monkeypatch.setattr(packing, "LEAST_WIDE", wide)
    out = packing.packed(table(spark, CASES), "k", ["i"], "n", F.lit(100), F.lit(37), 0)
    got = {(r.k, r.i): r.chunk for r in out.collect()}
    assert got == {(k, i): c for k, sizes in CASES.items() for i, c in enumerate(plain([n or 0 for n in sizes], 37, 100))}


def test_rows_without_room_share_stretches(spark):
    """Twenty keys whose facts alone fill a chunk: a call of Python for each row made this minutes."""
    import time

    began = time.time()
    rows = spark.range(60_000).select((F.col("id") % 20).cast("string").alias("k"), F.col("id").alias("i"), (F.col("id") * 7919 % 6001 + 1).alias("n"))
    got = packing.packed(rows, "k", ["i"], "n", F.lit(-5000))
    facts = got.groupBy("k").agg(F.max("chunk").alias("m"), F.countDistinct("chunk").alias("d")).agg(F.min("m"), F.max("m"), F.sum("d")).first()
    assert tuple(facts) == (2999, 2999, 60_000)
    assert time.time() - began < 60
