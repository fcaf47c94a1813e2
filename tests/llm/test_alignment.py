"""Cross-tokenizer alignment against a plain version that tokenises whole texts and expands every document's links."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from conftest_llm import documents, prose

from relsift.llm import tokenizer_alignment as ta

COLUMNS = [c.split()[0] for c in ta.ALIGNED.split(", ")]


@pytest.fixture(scope="module")
def tools():
    a, b = ta.default_paths()
    return ta.ByteLevel(Path(a).read_text(encoding="utf-8")), ta.Pieces(Path(b).read_bytes())


def plain(tools, rows):
    one, other = tools
    held = []
    for _, text in rows:
        whole = f" {text}".encode() if text else b""
        a, b = (one.tokenizer.encode(f" {text}", add_special_tokens=False).ids, other.processor.encode(text)) if text else ([], [])
        if b"".join(one.bytes[i] for i in a) != whole or b"".join(other.bytes[i] for i in b) != whole:
            a, b = [], []
        ends = []
        for ids, known in ((a, one.bytes), (b, other.bytes)):
            at, out = 0, []
            for i in ids:
                at += len(known[i])
                out.append(at)
            ends.append(out)
        shared = sorted(set(ends[0]) & set(ends[1]))
        held.append([([i for i, e in zip(a, ends[0]) if lo < e <= hi], [i for i, e in zip(b, ends[1]) if lo < e <= hi]) for lo, hi in zip([0, *shared], shared)])
    links = [[(x, y) for xs, ys in g for x in xs for y in ys] for g in held]
    count = Counter(p for each in links for p in set(each))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), g, each in zip(rows, held, links):
        name = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(each), sum(count[p] == most[p[0]] for p in each), sum(count[p] for p in each), hashlib.sha256(name.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr), count


TEXTS = [
    "Hello world, this is a test of tokenization.", "Hello  world", " leading", "trailing ", "trailing   ", " ", "   ", "\n", "a \n b\t c \r\n d", "tab\t x  y  z", "x　 y 　z",
    "naïve café ÜBER straße 東京 は 日本 🎉🎉 🏳️‍🌈", "<|endoftext|> <s> </s> <unk> <0x41> [INST]", "piece ▁ sign", "▁", "ﬁ ligature ㎏ Å é", "\x00 \x1c x\x1d y \x85 z", "it's we're I'll 's 't  's",
    "1234567890 3.14159 1,000,000", "a" * 5000, "=" * 333 + " " * 77 + "-" * 129, "if (x == 0) {\n        return;\n    }\n", "​ zero ᠎ width ﻿ mark", "ab " * 400, "", None, "é", "퟿ private", "same same same", "same same same",
]


@pytest.mark.parametrize("block", [ta.BLOCK, 40])
def test_against_whole_texts(ready, tools, block):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, "five again"), (None, "no id"), (None, "no id"), (99, prose(3, 400))]
    out = ta.aligned(documents(ready, rows, extra=True).repartition(3), block=block)
    assert out.columns == COLUMNS
    want, count = plain(tools, rows)
    assert sorted(map(tuple, out.collect()), key=repr) == want
    if block == ta.BLOCK:
        got = {(r.a, r.b): r.docs for r in ta.links(documents(ready, rows)).collect()}
        assert got == dict(count)


def test_odd_bytes_and_empty(ready):
    df = ready.sql("select cast(1 as long) doc_id, cast(x'61ff62' as string) text union all select 2, 'fine'")
    assert [tuple(r)[:5] for r in ta.aligned(df).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0), (2, 1, 1, 1, 1)]
    assert ta.aligned(documents(ready, [(1, "x")]).limit(0)).count() == 0
    assert [tuple(r) for r in ta.aligned(documents(ready, [(1, None), (2, "")])).orderBy("doc_id").collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_cache_begins_anew(ready, tools, monkeypatch):
    rows = [(i, prose(i % 7, 200)) for i in range(20)]
    monkeypatch.setattr(ta, "MOST_CHUNKS", 50)
    tool = ta.Aligner(*tools)
    made = [tool.block([t.encode()]) for _, t in rows]
    fresh = [ta.Aligner(*tools).block([t.encode()]) for _, t in rows[:7]]
    for i, m in enumerate(made):
        named = lambda x: sorted((x["groups"][k], n) for k, n in zip(x["numbers"].tolist(), x["times"].tolist()))
        assert m["sha"] == fresh[i % 7]["sha"] and named(m) == named(fresh[i % 7])


def test_cut():
    for t in TEXTS:
        if t:
            assert "".join(ta.cut(" " + t)) == " " + t and all(c[0] == " " and c != " " for c in ta.cut(" " + t)[1:])


def test_groups_of_made_up_tokens():
    to_a, to_b = ta.shared_ends(*(np.array([len(t) for t in x.split()]) for x in ("ab c def", "a bc d ef")))
    assert (to_a.tolist(), to_b.tolist()) == ([2, 3], [2, 4])
    assert ta.pairs_of([7, 7, 8], [9, 9])[1].tolist() == [4, 2]
