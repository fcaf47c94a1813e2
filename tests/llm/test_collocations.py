"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import DOCS

from relsift.llm import collocations as co


def table(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)], DOCS)
    for c in ("phrase", "f", "term", "words", "weight", "rank"):
        df = df.withColumn(c, F.lit("mine"))
    return df


def plain(rows, least, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\n-\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in often.items():
            if 100 * inside[p] < 100 * a:
                s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed, n, words=12):
    r = random.Random(seed)
    names = ["the", "of", "New", "york", "é", "a\x01", "a", "\x02", "straße", "日本", "x" * 40, "x" * 39 + "y", *(f"w{i}" for i in range(words))]
    fixed = ["New york of the é", "the end of the world is near", "a\x01 a a \x02", "state of the art, of the"]
    text = lambda: " ".join(r.choice(fixed) if r.random() < 0.4 else r.choice(names) + r.choice(["", "", "", ",", ".", "\t", "\n", "\r", ";", "  "]) for _ in range(r.randint(0, 40)))
    return [(r.choice(["en", "en", "de", None]), text()) for _ in range(n)]


ODD = [(None, None), ("en", ""), ("en", " . , \n"), ("xx", "one two"), ("en", "same same same same same same"), ("", "empty lang " * 9), ("und", "new york of the")]


@pytest.mark.parametrize("least", [2, 7, 30])
def test_against_plain(ready, least):
    rows = corpus(1, 300) + ODD
    out = co.collocations(table(ready, rows).repartition(7), least)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == plain(rows, least)


def test_top_and_length(ready):
    rows = corpus(2, 150)
    assert sorted(map(tuple, co.collocations(table(ready, rows), 3, longest=3, top=5).collect())) == plain(rows, 3, 3, 5)
    assert len({r.phrase for r in co.collocations(table(ready, rows), 3, top=None).collect()}) > 5


def test_empty(ready):
    assert co.collocations(table(ready, ODD[:3])).count() == 0
    assert co.collocations(table(ready, ODD).limit(0)).count() == 0


def test_products_beyond_64_bits(ready):
    from unittest import mock

    big = ready.createDataFrame([("en", "a", 1, 5 * 10**12), ("en", "b", 1, 4 * 10**12), ("en", "a b", 2, 3 * 10**12)], "lang string, phrase string, size int, f long")
    total = ready.createDataFrame([("en", 2 * 10**13)], "lang string, n long")
    with mock.patch.object(co, "phrases", lambda *a: (big, total)):
        row = co.collocations(None).first()
    assert row.score == 1000 * 3 * 10**12 * 2 * 10**13 // (5 * 10**12 * 4 * 10**12)


def test_maps_that_let_all_through(ready, monkeypatch):
    """A map too small for its keys costs time and no result."""
    monkeypatch.setattr(co, "MAP_BITS", 15)
    monkeypatch.setattr(co, "_HELD", 20)
    monkeypatch.setattr(co.bloom, "asked", lambda packed, h: np.ones(len(h), bool))
    rows = corpus(3, 200)
    assert sorted(map(tuple, co.collocations(table(ready, rows), 5).collect())) == plain(rows, 5)


@pytest.mark.parametrize(("bits", "least"), [(12, 5), (16, 2), (24, 300)])
def test_sketch_of_any_size(ready, monkeypatch, bits, least):
    """Full slots cost time and no result; counts above a byte are counts too."""
    monkeypatch.setattr(co, "SKETCH_BITS", bits)
    rows = corpus(4, 250) + [("en", "one two three four five " * 80)] * 4
    assert sorted(map(tuple, co.collocations(table(ready, rows).repartition(5), least).collect())) == plain(rows, least)


def test_projections_end_with_the_frequent_phrases(ready, monkeypatch):
    """All pairs of these words are frequent and few longer phrases are: rows follow the phrases, not the ways to string pairs together."""
    r = random.Random(6)
    rows = [("en", " ".join(r.choice("abcdefghij") for _ in range(50))) for _ in range(200)] + [("en", "a b c d e f")] * 30
    tables = {}
    monkeypatch.setattr(co, "written", lambda df, name, written=co.written: tables.setdefault(name, written(df, name)))
    assert sorted(map(tuple, co.collocations(table(ready, rows).repartition(4), 30).collect())) == plain(rows, 30)
    frequent = tables["phrases"].where("size > 1").count()
    assert 100 <= tables["projections"].count() <= frequent + 5


def test_intervals_add_up():
    words = sorted([b"a b", b"a b c", b"a b c d", b"a c", b"b b b b b", b"b b"])
    whole = co.intervals(np.zeros(6, np.int64), words, np.arange(1, 7), 0)
    parts = [x for lo in (0, 2, 4) for x in co.intervals(np.zeros(2, np.int64), words[lo : lo + 2], np.arange(1, 7)[lo : lo + 2], 99)]
    total = lambda rows: {k: sum(n for _, p, n in rows if p == k) for k in {p for _, p, _ in rows}}
    assert total(whole) == total(parts) == {b"a b": 6, b"a b c": 5, b"a b c d": 3, b"a c": 4, b"b b": 11, b"b b b": 6, b"b b b b": 6, b"b b b b b": 6}


def test_words_told_apart_by_bytes():
    """Words of equal hashes, here all of a language, are still counted apart."""
    p = co.Pieces([b"ab ac ab " + b"x" * 40 + b" " + b"x" * 39 + b"y " + b"x" * 40], 1)
    assert p.same_bytes(np.zeros(6, np.int64)).tolist() == [True, False, True, False, False, False]
    assert p.same_bytes(np.full(6, 3)).tolist() == [False, False, False, True, False, True]


def test_odd_bytes(ready):
    df = ready.sql("select cast(id as long) doc_id, cast(x'61ff20622063' as string) text, 'en' lang from range(3)")
    got = co.collocations(df, 2).selectExpr("hex(phrase) p", "a").collect()
    assert [(r.p, r.a) for r in got] == [("61FF20622063", 3)]
