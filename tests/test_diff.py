"""Trees, diffs, comment stripping and chunks."""

import difflib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relsift.operators import chunk, strip, tree
from relsift.plans import catalog, release
from relsift.plans.catalog import scores
from relsift.settings import Settings

PAIR = "pair_id string, ecosystem string, package string, from_version string, to_version string"


def files(spark, rows):
    return tree.with_facts(spark.createDataFrame([("p", s, path, t if isinstance(t, bytes) else t.encode()) for s, path, t in rows], "pair_id string, side string, path string, content binary"))


def pairs(spark):
    return spark.createDataFrame([("p", "npm", "pkg", "1", "2")], PAIR)


def summary(spark, rows, **more):
    return release.diff_summaries(pairs(spark), files(spark, rows), **more).first().summary


def test_compared_trees(spark):
    s = summary(spark, [
        ("from", "index.js", "a\nb\n"), ("to", "index.js", "a\nc\n"),
        ("from", "old.js", "x"), ("to", "lib/new.PY", "l1\nl2\n"),
        ("from", "same.ts", "s\r\n"), ("to", "same.ts", "s\n"),
        ("to", "logo.png", "no"), ("to", "readme.md", "no"), ("to", ".js", "no"),
        *(("to", f"run.{e}", "x") for e in ("sh", "bat", "ps1", "cmd")),
    ])
    assert s.files_added == sorted(["lib/new.PY", "run.sh", "run.bat", "run.ps1", "run.cmd"])
    assert (s.files_removed, s.files_modified) == (["old.js"], ["index.js"])
    assert [d.path for d in s.file_diffs] == ["index.js", *s.files_added]
    assert s.file_diffs[0].unified_diff == "\n".join(difflib.unified_diff(["a\n", "b\n"], ["a\n", "c\n"], "a/index.js", "b/index.js", lineterm=""))
    assert (s.file_diffs[0].lines_added, s.file_diffs[0].lines_removed) == (1, 1)
    new = next(d for d in s.file_diffs if d.path == "lib/new.PY")
    assert (new.unified_diff, new.lines_added) == ("+l1\n+l2", 2)
    assert s.total_diff_lines == 2 + 2 + 4


def test_identical_and_empty_trees(spark):
    s = summary(spark, [("from", "a.js", "x"), ("to", "a.js", "x")])
    assert (s.files_modified, s.file_diffs, s.total_diff_lines) == ([], [], 0)


def test_oversize_files(spark):
    small = Settings(max_diff_file_bytes=10)
    s = summary(spark, [("from", "a.js", "x" * 20), ("to", "a.js", "y" * 20), ("to", "b.js", "z" * 11), ("from", "c.js", "q" * 30), ("to", "c.js", "q" * 30)], settings=small)
    assert s.skipped_files == ["a.js", "b.js"] and s.files_modified == ["a.js"]
    assert s.file_diffs[0].unified_diff == "[diff skipped: file size 20 bytes exceeds max_diff_file_bytes=10]"
    assert s.total_diff_lines == 0


def test_odd_counts_and_lines():
    text, plus, minus = tree._diff_texts("-- x\n", "++ y\nz\n", "f")
    assert (plus, minus) == (1, 0)  # lines that look like headers aren't counted
    assert "\n\n" in text  # line ends are kept and joined by newlines


def test_line_changes_as_multisets(spark):
    df = spark.createDataFrame([(1, "a\nb\nb", "b\nc"), (2, "same", "same")], "key long, from_text string, to_text string")
    assert {tuple(r) for r in tree.multiset_line_changes(df).collect()} == {(1, 1, 2), (2, 0, 0)}


def strip_all(spark, rows):
    """(text left, lines gone) of (path, diff)."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, path string, unified_diff string")
    return [(r.unified_diff, r.comment_lines_stripped) for r in strip.stripped(df).orderBy("k").collect()]


JS = "@@ -1 +1 @@\n+// gone\n+code() // stays\n-  // gone\n /* block\n+ inner\n  end */\n+/* tail */ code\n+/* one */\n+/* open\n@@ -9 @@\n+*/"

STRIPPED = [
    ("a/b.js", JS, "@@ -1 +1 @@\n+code() // stays\n+/* tail */ code\n+/* open\n@@ -9 @@\n+*/", 6),
    ("x.py", '+#! /bin/sh\n+# c\n+"""doc"""\n+x = 1', "+#! /bin/sh\n+x = 1", 2),
    ("x.bat", "+REM a\n+rem\tb\n+::c\n+remote", "+remote", 3),
    ("x.ps1", "+<# a\n+b #>\n+# c\n+d", "+d", 3),
    ("x.PY", "+'''a\n-b'''  \n c", " c", 2),
    ("x.md", "+# title", "+# title", 0),
    ("x.js", "[diff skipped: // x]", "[diff skipped: // x]", 0),
    ("x.js", None, None, 0),
    ("x.js", "", "", 0),
    ("x.js", "+// all", "", 1),
    ("x.js", "+// all\n+//", "", 2),
    ("x.js", "+/*/\n+x */", "", 2),
    ("x.js", "+/* a */ /* b */", "+/* a */ /* b */", 0),
    ("x.js", "+\xa0// wide blank\x85+more\n+x", "+x", 1),
    ("x.js", "// no marker\n+x", "// no marker\n+x", 0),
    # a removed line that looks like a header, and a line without a marker, end the run
    ("x.js", "+/* a\n--- b\n+*/", "+/* a\n--- b\n+*/", 0),
    ("x.js", "+/* a\n\n+*/", "+/* a\n\n+*/", 0),
    ("x.js", "+/* one\n+ two */\n+a", "+a", 2),
    ("x.js", "+/* a\n" * 300_000 + "+x", "+/* a\n" * 300_000 + "+x", 0),  # openers that never close
    ("x.js", "+/* a\n" * 100_000 + "+ */ x", "+/* a\n" * 100_000 + "+ */ x", 0),
    ("x.py", "+\'\'\' a \"\"\" b\n+c \'\'\'\n+x", "+x", 2),
    ("x.js", "+/* a */\n+/* b */ c\n+// d\n+/* e", "+/* b */ c\n+/* e", 2),
    ("x.js", "+/*\n" + "+ a long comment\n" * 50_000 + "+*/\n+x", "+x", 50_002),
]


def test_comments(spark):
    assert strip_all(spark, [r[:2] for r in STRIPPED]) == [r[2:] for r in STRIPPED]


def test_real_diffs_keep_block_comments(spark):
    text, _, _ = tree._diff_texts("a\n", "/* one\n two */\na\n", "x.js")
    assert strip_all(spark, [("x.js", text)])[0][1] == 0  # every other line is empty, so the block isn't contiguous


def test_stripping_only_removes_lines(spark):
    r = random.Random(8)
    bodies = ["\n".join("".join(r.choice("ab#/*\n +-") for _ in range(r.randrange(12))) for _ in range(r.randrange(30))) for _ in range(400)]
    for body, (text, gone) in zip(bodies, strip_all(spark, [("x.js", b) for b in bodies])):
        left = iter(body.split("\n"))
        kept = text.split("\n") if text or not gone else []
        assert gone == len(body.split("\n")) - len(kept) or (gone == 0 and text == body)
        assert all(any(x == y for y in left) for x in kept)


@given(st.text("abc\n", max_size=200), st.integers(1, 40))
def test_segments_lose_nothing(body, limit):
    out = chunk.segments(body, limit)
    assert "".join(out).replace("\n", "") == body.replace("\n", "")
    assert all(len(x) <= limit for x in out)


def test_giant_line_is_cut():
    assert [len(x) for x in chunk.segments("x" * 10_000, 3000)] == [3000, 3000, 3000, 1000] or "".join(chunk.segments("x" * 10_000, 3000)) == "x" * 10_000


def chunked(spark, rows, s, split=False):
    summed = release.diff_summaries(pairs(spark), files(spark, rows), s)
    out, kept = chunk.chunks(summed, s, split)
    return [r.content for r in out.orderBy("chunk_idx").collect()], kept.first()


def test_chunks(spark):
    head, kept = chunked(spark, [("from", "a.md", "x")], Settings())
    assert len(head) == 1 and kept.chunks_sent_to_llm == 1 and head[0].startswith("# What the release changes\n")
    body = "\n".join(f"line {i} of a long file" for i in range(10_000))
    cut, kept = chunked(spark, [("to", "big.js", body), ("to", "small.js", "x")], Settings(max_tokens_per_chunk=1000))
    assert kept.diff_truncated and kept.truncated_files == ["big.js"]
    assert "[cut: 3800 of " in cut[0]
    parts, kept = chunked(spark, [("to", "big.js", body[:30_000])], Settings(max_tokens_per_chunk=1000), split=True)
    assert kept.split_files == ["big.js"] and not kept.truncated_files and kept.chunks_sent_to_llm == len(parts) > 5
    for line in body[:29_000].split("\n")[:-1]:
        assert any(f"+{line}\n" in p for p in parts)
    _, kept = chunked(spark, [("to", "big.js", body)], Settings(max_tokens_per_chunk=1000, max_split_parts_per_file=2), split=True)
    assert kept.truncated_files == ["big.js"]


def test_chunk_cap_names_what_is_dropped(spark):
    rows = [("to", f"f{i:02}.js", "y" * 3000) for i in range(30)]
    out, kept = chunked(spark, rows, Settings(max_tokens_per_chunk=1000, max_chunks_per_analysis=3))
    sent = {f"f{i:02}.js" for i in range(30) if any(f"## f{i:02}.js (added" in c for c in out)}
    assert len(out) == 3 == kept.chunks_sent_to_llm
    assert sent | set(kept.files_not_analyzed) == {r[1] for r in rows} and not sent & set(kept.files_not_analyzed)


def test_release_reports_of_a_hot_source(spark, tmp_path):
    """Every document is on some side, paths are unique on theirs, and documents of one source pair one by one."""
    rows = [(i, "hot" if i % 2 else "cold", f"a{i}\nb\n") for i in range(280)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = scores.release_files(docs).collect()
    assert {bytes(r.content).decode() for r in got} >= {t for _, _, t in rows}
    assert len({(r.pair_id, r.side, r.path) for r in got}) == len(got) == 280 + 40
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in catalog.QUERIES["release_reports"](spark, str(tmp_path)).collect():
        kept = {i for i, s, _ in rows if s == r.package and i % 7}
        old, new = {i for i in kept if i // 20 % 2 == 0}, {i - 20 for i in kept if i // 20 % 2}
        assert (r.n_added, r.n_removed, r.n_modified) == (len(new - old), len(old - new), len(old & new))


def test_block_comments_are_read_row_by_row(spark):
    """Large diffs don't wait for a whole Arrow batch of others."""
    got = strip.stripped(spark.createDataFrame([("f.js", "+/* a\n+ b */\n+c"), ("f.js", None), (None, "+/* a */")], "path string, unified_diff string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert [(r.unified_diff, r.comment_lines_stripped) for r in got.collect()] == [("+c", 2), (None, 0), ("+/* a */", 0)]
