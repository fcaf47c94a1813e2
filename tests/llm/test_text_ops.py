"""Line dedup, decontamination, SimHash, substring dedup and mixing against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest_llm import documents, prose
from pyspark.sql import functions as F


from relsift.llm import _bloom as bloom
from relsift.llm import _text as T
from relsift.llm import decontaminate, line_dedup, mixing, simhash, substring_dedup


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


LINES = [
    (1, "a common line here\nunique one of doc 1\nshort\n"),
    (2, " A COMMON line here\t\nunique two of doc 2\nshort"),
    (3, None),
    (4, ""),
    (5, "a common line here\na common line here\nrepeated inside only\nrepeated inside only"),
    (6, "ünïcödé l"),  # nine code points, more bytes
    (7, "ünïcödé l"),
    (8, "ünïcödé li"),
    (9, "ünïcödé li"),
    (9, "ünïcödé li"),
    (None, "a common line here\nnull id line, ten"),
    (None, "null id line, ten"),
    (10, "\n\n\n"),
    (11, prose(1, 30_000) + "\nunique two of doc 2"),
]


def brute_lines(rows):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    big = 1 << 62
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[strip(x)].add(big if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(strip(x)) >= 10 and len(holders[strip(x)]) > 1 and min(holders[strip(x)]) < (big if i is None else i))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup(ready):
    for bits in (None, bloom.SEGMENT):  # even a filter that is far too small loses nothing
        out = line_dedup.line_dedup(documents(ready, LINES, extra=True).repartition(5), bits)
        assert rows_of(out, "doc_id", "text", "n_lines", "n_dropped") == brute_lines(LINES)
        assert out.where("drops <> 'mine' or key <> 'mine' or rest <> 'mine'").count() == 0
    assert line_dedup.line_dedup(documents(ready, LINES).limit(0)).count() == 0


def test_filters_lose_nothing():
    hashes = T._odd_stream(3, 5000)
    seen = bloom.Seen(bloom.MIN_BITS)
    for lo in range(0, 5000, 700):
        seen.enter(hashes[lo : lo + 700])
    seen.enter(hashes[:100])  # of an earlier batch
    seen.enter(np.repeat(hashes[4000:4100], 2))
    whole = {k: np.zeros_like(seen.once) for k in ("once", "twice")}
    for b in seen.segments():
        for k in whole:
            for s, o in zip(b.column("segment").to_pylist(), b.column(k).to_pylist()):
                whole[k][s] |= np.frombuffer(zlib.decompress(o), np.uint8)
    assert bloom.contains(whole["once"], hashes).all()
    assert bloom.contains(whole["once"], T._odd_stream(99991, 5000)).mean() < 0.05
    assert bloom.contains(whole["twice"], hashes[:100]).all() and bloom.contains(whole["twice"], hashes[4000:4100]).all()
    assert bloom.contains(whole["twice"], hashes[100:4000]).mean() < 0.05


def test_word_hashes_depend_on_words_alone():
    text = "some words are long_and-odd, others ünïcode words".encode()
    one = T.Words([text], T.BLANKS)
    two = T.Words([b"pad pad", b"", b"  " + text + b"\n"], T.BLANKS)
    assert one.first.tolist() == [0, 7] and two.first.tolist() == [0, 2, 2, 9]
    assert (one.hashes()[0] == two.hashes()[0][2:]).all()
    assert len(set(one.hashes()[0].tolist())) == 6  # "words" comes twice
    assert (T.windows(one.hashes()[0], 3, 77) == T.windows(two.hashes()[0], 3, 77)[2:]).all()


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_leaks(docs, items):
    grams = defaultdict(set)
    for item, t in items:
        w = words_of(t)
        n = min(10, len(w))
        if item is not None and n:
            for i in range(len(w) - n + 1):
                grams[tuple(w[i : i + n])].add(str(item))
    sizes = {len(g) for g in grams}
    out = []
    for i, t in docs:
        w, hit, names = words_of(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if g := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= g
        names = sorted(names)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_decontamination(ready):
    item = prose(5, 30)
    items = [(1, item), (2, item.upper()), (3, "three odd words"), (4, ""), (5, None), (None, prose(6, 20)), (10, prose(7, 12)), (10, "three odd words")]
    w = item.split()
    docs = [
        (1, prose(8, 50) + " " + " ".join(w[3:17]) + ", " + prose(9, 50)),
        (2, " ".join(w[:9])),
        (3, "x Three; odd-WORDS y three odd words"),
        (4, None),
        (5, ""),
        (6, prose(6, 20)),
        (7, prose(10, 40_000) + " " + item),
        (7, " ".join(w[5:20])),
        (None, "three odd words"),
        (8, "...!"),
        *((100 + i, "pad " * i + item) for i in range(60)),
    ]
    for benchmark in (items, [], [(1, None)]):
        b = ready.createDataFrame(benchmark, "item_id long, text string")
        want = brute_leaks(docs, benchmark)
        assert rows_of(decontaminate.leaks(documents(ready, docs, extra=True).repartition(4), b), "doc_id", "n_words", "n_hit", "n_items", "items_sha256") == want
        out = decontaminate.decontaminated(documents(ready, docs, extra=True).repartition(4), b)
        got = out.selectExpr("doc_id", "leak.n_words", "leak.n_hit", "size(leak.windows) > 0 as some")
        assert rows_of(got, "doc_id", "n_words", "n_hit", "some") == sorted(((*r[:3], r[3] > 0) for r in want), key=repr)
    assert out.where("row <> 'mine' or found <> 'mine'").count() == 0
    assert decontaminate.decontaminated(documents(ready, docs).limit(0), b).count() == 0


def test_proximity_finds_what_phrases_miss(ready):
    item = prose(5, 12)
    w = item.split()
    docs = [(1, " ".join(w[:5] + ["inserted"] + w[5:])), (2, prose(44, 40)), (3, item)]
    near = decontaminate.proximity(documents(ready, docs), ready.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id for r in near.collect()} == {1, 3}


@pytest.mark.parametrize("whole", [True, False])
def test_proximity_finds_windows_without_their_rarest_word(ready, whole):
    """One word of ten replaced, the rarest: once it stands in another document only, once in none."""
    w = prose(5, 40).split()
    w = list(dict.fromkeys(w))[:10]
    docs = [(1, " ".join(["replaced", *w[1:]])), (2, prose(44, 40)), *([(3, " ".join(w))] if whole else [])]
    near = decontaminate.proximity(documents(ready, docs), ready.createDataFrame([(1, " ".join(w))], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.start, r.n_terms) for r in near) == ([(1, 0, 3), (3, 0, 4)] if whole else [(1, 0, 4)])


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    least = lambda g: min((x for x in g if x is not None), default=None)
    return [least(groups[find(i)]) for i in range(len(ids))]


def test_golay_code_is_perfect():
    table = simhash.home_table()
    assert set(Counter(table.tolist()).values()) == {2048}


def test_anchors_cover_all_close_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    other = base.copy()
    for k in range(300):
        for b in rng.choice(64, k % 5, replace=False):
            other[k] ^= np.uint64(1) << np.uint64(b)
    row, cell, home = simhash.replicas(np.concatenate([base, other]))
    at, homes = defaultdict(set), defaultdict(set)
    for r, c, h in zip(row, cell, home):
        at[r].add(c)
        if h:
            homes[r].add(c)
    assert all(homes[k] & at[300 + k] and homes[300 + k] & at[k] for k in range(300))


def test_bands_find_all_close_pairs(monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    x[200:] = x[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)) ^ (np.uint64(7) << rng.integers(0, 60, 200, dtype=np.uint64))
    mine = x[::2]
    true = {(a, b) for a in mine.tolist() for b in x.tolist() if a != b and (a ^ b).bit_count() <= 4}
    for limit, at_once in ((1 << 26, 1 << 21), (0, 1 << 21), (0, 3)):
        monkeypatch.setattr(simhash, "ALL_WITH_ALL", limit)
        monkeypatch.setattr(simhash, "AT_ONCE", at_once)
        found = {p for a, b in simhash.close_pairs(mine, x) for p in zip(a.tolist(), b.tolist())}
        assert found == true and len(true) > 100


def test_simhash(ready, monkeypatch):
    base = prose(20, 400)
    w = base.split()
    docs = [(10 + i, " ".join(w[: 60 + i] + [f"x{i}"] + w[61 + i :])) for i in range(12)]
    docs += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One\tTWO"), (6, prose(21, 80)), (6, prose(22, 80)), (None, base), (40, base), (41, base.upper()), (42, prose(23, 50_000))]
    fps = [fingerprint(t) for _, t in docs]
    root = components([i for i, _ in docs], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    expected = sorted(((i, f, r) for (i, _), f, r in zip(docs, fps, root)), key=repr)
    for work in (simhash.WORK, 20):  # split cells lose no link
        monkeypatch.setattr(simhash, "WORK", work)
        out = simhash.near_duplicates(documents(ready, docs, extra=True).repartition(3))
        assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in out.collect()), key=repr) == expected
    kept = simhash.deduplicated(documents(ready, [d for d in docs if d[0] is not None], extra=True))
    assert {r.doc_id for r in kept.collect()} == {r for _, _, r in expected if r is not None}
    assert kept.columns == documents(ready, docs, extra=True).columns
    assert simhash.near_duplicates(documents(ready, docs).limit(0)).count() == 0


def brute_substrings(rows, span=50):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    big = 1 << 62
    first = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - span + 1):
            g = tuple(w[k : k + span])
            first[g] = min(first.get(g, big + 1), big if i is None else i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for k in range(len(w) - span + 1):
            if first[tuple(w[k : k + span])] < (big if i is None else i):
                gone |= set(range(k, k + span))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(out, key=repr)


def test_substring_dedup(ready):
    p = prose(30, 120)
    w = p.split()
    edited = w[:70] + ["edit"] + w[71:]
    docs = [
        (1, prose(31, 40) + " " + p + "\n" + prose(32, 40)),
        (2, " ".join(w[20:69])),
        (3, " ".join(w[20:70])),
        (4, " ".join(edited) + " " + prose(33, 10)),
        (5, p),
        (5, p),
        (6, " ".join(edited)),
        (7, None),
        (8, ""),
        (9, "la " * 200),
        (10, "la " * 60 + "end"),
        (None, p),
        (None, p),
        (11, prose(34, 30_000) + " " + p),
        (12, " ".join(w[:90]) + " " + prose(35, 60) + " " + " ".join(w[40:])),
        *((100 + i, f"n{i} " + " ".join(w[i : i + 80])) for i in range(30)),
    ]
    out = substring_dedup.substring_dedup(documents(ready, docs, extra=True).repartition(4))
    assert rows_of(out, "doc_id", "text", "n_words", "n_removed") == brute_substrings(docs)
    assert out.where("row <> 'mine' or rest <> 'mine'").count() == 0
    spans = substring_dedup.maximal_repeats(documents(ready, docs))
    assert all(r.end - r.start >= 50 for r in spans.collect())
    assert substring_dedup.substring_dedup(documents(ready, docs).limit(0)).count() == 0


def thue_morse(n):
    """Two texts of 2**n letters that a polynomial hash modulo 2**64 can't tell apart for n of 10 and more."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << n))
    return a, a.translate({97: 98, 98: 97})


def test_substring_dedup_compares_words_and_not_hashes(ready):
    one, two = thue_morse(11)
    assert T.Words([one.encode()], T.BLANKS).hashes()[0] == T.Words([two.encode()], T.BLANKS).hashes()[0]
    around = prose(50, 60).split()
    x, y = (w for w in ("left", "right"))
    long = [" ".join([x, y][bin(i).count("1") % 2 ^ flip] for i in range(1 << 11)) for flip in (0, 1)]
    docs = [
        (1, " ".join(around[:30] + [one] + around[30:])),
        (2, " ".join(around[:30] + [two] + around[30:])),
        (3, " ".join(around[:30] + [one] + around[30:])),
        (4, long[0]),
        (5, long[1]),
        (6, one * 50),
        (7, two * 50 + " " + " ".join(around)),
        (8, "\t".join(around[5:30] + [two] + around[30:58])),
    ]
    out = substring_dedup.substring_dedup(documents(ready, docs).repartition(3))
    assert rows_of(out, "doc_id", "text", "n_words", "n_removed") == brute_substrings(docs)


def many_rows(text, n=5_000):
    """n rows without an id, n of one id, and n of all the same text."""
    return [(None, f"{text} {prose(i, 12)}") for i in range(n)] + [(7, f"{text} {prose(i + n, 12)}") for i in range(n)] + [(None, text)] * n


def test_many_rows_that_share_an_id(ready):
    """Rows meet their own lines, windows and repeats alone: work stays in proportion."""
    text = prose(60, 60)
    rows = [(1, text), *many_rows(text)]
    docs = documents(ready, rows).repartition(8)
    out = decontaminate.decontaminated(docs, ready.createDataFrame([(1, prose(60, 12))], "item_id long, text string"))
    assert out.where("leak.n_hit >= 12").count() == len(rows)
    assert substring_dedup.substring_dedup(docs).where("n_removed >= 60").count() == len(rows) - 1
    lines = documents(ready, [(i, t.replace(" ", "\n", 30)) for i, t in rows]).repartition(8)
    got = line_dedup.line_dedup(lines).groupBy("n_dropped").count().collect()
    assert {r["count"] for r in got} and sum(r["count"] for r in got) == len(rows)


ODD = ("__", "leak", "n_words", "n_removed", "n_lines", "n_dropped", "__keep", "a-b c", "tick`s", "dot.ted", "rest", "whole", "text_", "mine", "row")


def test_columns_of_any_name_pass_through(ready):
    from pyspark.sql import functions as F

    docs = documents(ready, [(1, prose(70, 60)), (2, prose(70, 60)), (None, None)])
    docs = docs.select("*", *[F.lit(c).alias(c) for c in ODD])
    items = ready.createDataFrame([(1, prose(70, 12))], "item_id long, text string")
    for out, made in (
        (line_dedup.line_dedup(docs), {"n_lines", "n_dropped"}),
        (substring_dedup.substring_dedup(docs), {"n_words", "n_removed"}),
        (decontaminate.decontaminated(docs, items), {"leak"}),
        (simhash.deduplicated(docs), set()),
    ):
        assert set(out.columns) == set(docs.columns) | made and len(out.columns) == len(set(out.columns))
        for r in out.collect():
            assert all(r[c] == c for c in ODD if c not in made)


def test_mixing(ready):
    rows = [(i, prose(i, 1 + i % 40), s) for s, n, at in (("a", 200, 0), ("b", 10, 1000), ("c", 40, 2000), (None, 30, 3000)) for i in range(at, at + n)]
    rows += [(1, "again and again", "a"), (None, "no id", "b"), (7000, None, "c"), (7001, "", "z"), (7002, prose(2, 20_000), "b")]
    for range_rows in (mixing.RANGE_ROWS, 7):
        out = mixing.mixed(documents(ready, rows, extra=True).repartition(3), range_rows).collect()
        assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
        size, target, taken = Counter(), {}, Counter()
        for r in out:
            size[r.source] += r["size"]
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert 0 <= r.taken <= 3 * r["size"]
        assert all(r.source_size == size[r.source] for r in out)
        assert {s: int(t) for s, t in target.items()} == {s: taken[s] for s in target}
        assert abs(sum(target.values()) - sum(size.values())) < 1e-6
        again = mixing.mixed(documents(ready, rows).repartition(2), range_rows).collect()
        assert sorted(map(repr, ((r.doc_id, r["size"], r.taken) for r in out))) == sorted(map(repr, ((r.doc_id, r["size"], r.taken) for r in again)))
    weight = dict(zip(["a", "b", "c", "z", None], [1, 2, 3, 1, 2]))
    free = [s for s in size if target[s] < 3 * size[s] - 1e-6]
    level = {round(target[s] / weight[s], 6) for s in free}
    assert len(level) <= 1 and all(3 * size[s] / weight[s] <= min(level) + 1e-6 for s in size if s not in free)
    assert mixing.mixed(documents(ready, rows).limit(0)).count() == 0
    assert mixing.mixed(documents(ready, [(1, None, "a")])).first().taken == 0


def test_mixing_spreads_rows_without_an_id(ready):
    """Thousands of rows without an id: a key each, by their texts."""
    docs = ready.range(5_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source"))
    assert mixing.sized(docs).select("key").distinct().count() == 5_000
    out = mixing.mixed(docs, 50).agg(F.count("*").alias("n"), F.sum("taken").alias("taken")).first()
    assert (out.n, out.taken) == (5_000, 10_000)


def test_components_of_long_chains(ready):
    from relsift.llm._graph import components as find

    edges = [(i, i + 1) for i in range(200)] + [(1000, 900), (1000, 950), (5, 5)]
    got = {r.node: r.root for r in find(ready.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000: 900, 950: 900}
    assert find(ready.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_hubs_without_a_single_task(ready):
    from relsift.llm._graph import components as find

    edges = [(5000, i) for i in range(3000)] + [(i, i + 7000) for i in range(0, 3000, 3)] + [(20_000 + i, 20_001 + i) for i in range(70)]
    for alone in (0, 3500, 1 << 20):
        got = {r.node: r.root for r in find(ready.createDataFrame(edges, "a long, b long"), alone).collect()}
        assert got == {i: 0 for e in edges if e[0] < 20_000 for i in e if i} | {20_001 + i: 20_000 for i in range(70)}


def test_bytes_that_are_no_utf8(ready):
    """They are kept as they are; a byte that begins nothing counts as a character."""
    made = "select cast({} as long) doc_id, cast(unhex('{}') as string) text, 'en' lang, 's' source, 0L n_chars"
    line = b"ten \xff chars\xc3"
    words = b" ".join(b"w%d\xfe" % i for i in range(50))
    rows = [(1, line + b"\nmine"), (2, line + b"\nother"), (3, words), (4, b"x " + words)]
    docs = ready.sql(" union all ".join(made.format(i, t.hex()) for i, t in rows))
    got = {r.doc_id: (bytes(r.t), r.n_dropped) for r in line_dedup.line_dedup(docs).selectExpr("doc_id", "cast(text as binary) t", "n_dropped").collect()}
    assert got == {1: (rows[0][1], 0), 2: (b"other", 1), 3: (words, 0), 4: (b"x " + words, 0)}
    got = {r.doc_id: (bytes(r.t), r.n_removed) for r in substring_dedup.substring_dedup(docs).selectExpr("doc_id", "cast(text as binary) t", "n_removed").collect()}
    assert got[3] == (words, 0) and got[4] == (b"x", 50)
    items = ready.sql("select 1L item_id, cast(unhex('{}') as string) text".format(words.hex()))
    assert {r.doc_id: r.n_hit for r in decontaminate.leaks(docs, items).collect()} == {1: 0, 2: 0, 3: 50, 4: 50}
    assert mixing.mixed(docs).count() == simhash.near_duplicates(docs).count() == 4
