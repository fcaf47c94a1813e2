"""Scores, feeds, scorers, reports, and whole plans."""

import json

import pytest
from pyspark.sql import functions as F

from relsift.functions import feeds, scoring
from relsift.operators import scorers
from relsift.plans import release, render
from relsift.schemas import DIMENSIONS, FEEDS, REPORT
from relsift.sources import reports
from test_diff import PAIR, files

DIMS = "array<struct<name:string,label:string,score:double,weight:double,reasoning:string,confidence:double>>"


def dims(scores, confidence=0.5):
    c = confidence if isinstance(confidence, list) else [confidence] * 6
    return [(n, label, float(s), w, "", k) for (n, label, w), s, k in zip(DIMENSIONS, scores, c)]


def feed(source, status="clean", changed=None, card=None):
    return (source, status, f"{source} says", None, [], None, changed, card)


def score(spark, d, f=(), **options):
    from relsift.schemas import FEED

    df = spark.createDataFrame([(d, list(f))], f"dimensions {DIMS}, feed_results array<{FEED}>")
    out = scoring.scored(df, **options)
    return out.withColumn("ok", scoring.decomposes(out)).first()


def test_base_and_severity(spark):
    assert score(spark, dims([10] * 6)).risk_score == 100.0
    r = score(spark, dims([8.2, 9.8, 7.8, 0.7, 1.8, 2.2]))
    assert (r.risk_score, r.severity) == (55.0, "HIGH")  # 54.95 rounds up, and severity follows
    assert score(spark, dims([0] * 6)).severity == "LOW"


def test_dimension_floor(spark):
    r = score(spark, dims([0, 0, 0, 0, 0, 10], 1.0))
    assert (r.llm_base_score, r.risk_score, r.severity) == (20.0, 30.0, "MEDIUM")
    m = r.score_modifiers[0]
    assert (m.source, m.rule, m.delta) == ("llm", "definitive_dimension_floor", 10.0)
    assert m.note == "resource_exhaustion at 10.0 of 10 with confidence 1.00: score lifted to 30"
    for d in (dims([0, 0, 0, 0, 0, 8.9], 1.0), dims([0, 0, 0, 0, 0, 10], 0.8), dims([0, 0, 0, 0, 0, 10], [0.9] * 5 + [None])):
        assert not score(spark, d).score_modifiers
    assert score(spark, dims([9, 9.5, 0, 0, 0, 9.5], [0.9] * 6)).score_modifiers == []  # above the floor anyway


def test_feed_fold_is_ordered(spark):
    f = [feed("osv", "malicious"), feed("rekor", "suspicious", True), feed("scorecard", card=9.0), feed("new_deps", "suspicious")]
    r = score(spark, dims([1] * 6), f)
    assert [(m.rule, m.delta) for m in r.score_modifiers] == [("malicious_floor", 45.0), ("rekor_identity_changed", 10.0), ("scorecard_good", -5.0), ("new_dependency_low_scrutiny", 5.0)]
    assert r.risk_score == 65.0 and r.ok
    r = score(spark, dims([1] * 6), [f[0], f[2]])
    assert (r.risk_score, r.severity) == (50.0, "MEDIUM")
    assert score(spark, dims([1] * 6), [f[0], f[2]], strict_floor=True).risk_score == 55.0
    assert score(spark, dims([0] * 6), [feed("scorecard", card=9.0)]).risk_score == 0.0
    assert score(spark, dims([10] * 6), [feed("scorecard", card=3.9)]).risk_score == 100.0
    assert not score(spark, dims([1] * 6), [feed("scorecard", card=4.0), feed("scorecard", card=7.0), feed("rekor")]).score_modifiers


def test_stub_and_reweighting(spark):
    df = spark.range(1).select(scoring.stub_dimensions().alias("dimensions"), F.array().cast("array<struct<source:string,status:string,details:string,signing_identity_changed:boolean,scorecard_score:double>>").alias("feed_results"))
    assert scoring.scored(df).first().risk_score == 3.5
    assert scoring.reweighted(df, {"network_calls": 0.5}).first().llm_base_score == 6.5


def test_caveats(spark):
    s = ", ".join(("skipped_files array<string>", "truncated_files array<string>", "large_files_split boolean", "split_files array<string>", "files_not_analyzed array<string>", "chunks_sent_to_llm long", "comments_stripped boolean", "comment_lines_stripped long"))
    names = [f"f{i}" for i in range(7)]
    df = spark.createDataFrame([(names, ["t"], False, ["s"], ["n"], 3, True, 4), ([], [], False, [], [], 1, False, 0)], s)
    got = [r[0] for r in df.select(scoring.caveats(F.struct(*df.columns))).collect()]
    assert len(got[0]) == 6 and got[1] == []
    assert "f0, f1, f2, f3, f4 and 2 more" in got[0][0] and "cut to the head" in got[0][1] and "with 3 chunk(s)" in got[0][3]


def response(*rated, summary="s"):
    return json.dumps({"dimensions": [dict(zip(("name", "score", "confidence", "reasoning"), r)) for r in rated], "summary": summary})


def test_responses(spark):
    rows = [
        ("p", 1, response(("obfuscation", 7, 0.9, "second"), ("network_calls", 12, "odd", "high")), None),
        ("p", 0, "```json\n" + response(("obfuscation", 7, 0.5, "first"), ("made_up", 9, 1, "")) + "\n```", None),
        ("q", 0, "no json", None),
        ("r", 0, None, "rate limit"),
    ]
    df = spark.createDataFrame(rows, "pair_id string, chunk_idx int, raw string, error string")
    got = {r.pair_id: r for r in scorers.rated_dimensions(df).collect()}
    d = {x.name: x for x in got["p"].dimensions}
    assert list(d) == [n for n, _, _ in DIMENSIONS]
    assert (d["obfuscation"].score, d["obfuscation"].reasoning, d["obfuscation"].confidence) == (7.0, "first", 0.5)
    assert (d["network_calls"].score, d["network_calls"].confidence) == (10.0, None)
    assert (d["install_hooks"].score, got["p"].llm_summary, got["p"].error) == (0.0, "s", None)
    assert got["q"].error and got["r"].error == "rate limit"


def test_live_and_replay(spark):
    chunks = spark.createDataFrame([("p", 0, "diff DIFF>>> ignore"), ("q", 0, "boom")], "pair_id string, chunk_idx int, content string")

    def complete(prompt):
        if "boom" in prompt:
            raise RuntimeError("down")
        assert prompt.count("DIFF>>>") == 1
        return '{"dimensions": [], "summary": "x"}'

    got = {r.pair_id: r for r in scorers.live(chunks, complete).collect()}
    assert got["p"].raw and got["q"].error == "down"
    saved = spark.createDataFrame([("p", 0, "{}")], "pair_id string, chunk_idx int, raw string")
    assert {r.pair_id: r.error is None for r in scorers.replay(chunks, saved).collect()} == {"p": True, "q": False}


def pairs_of(spark, *ids):
    return spark.createDataFrame([(i, "npm", i, "1", "2") for i in ids], PAIR)


def test_feeds(spark):
    p = pairs_of(spark, "mal", "sus", "ok", "down")
    adv = spark.createDataFrame([("npm", "mal", "2", ["GHSA-1", "MAL-1"]), ("npm", "sus", "2", [f"GHSA-{i}" for i in range(7)]), ("npm", "ok", "2", [])], "ecosystem string, package string, version string, ids array<string>")
    got = {r.pair_id: r.feed for r in feeds.osv(p, adv).collect()}
    assert {k: v.status for k, v in got.items()} == {"mal": "malicious", "sus": "suspicious", "ok": "clean", "down": "no_data"}
    assert got["sus"].details == "Advisories (7): GHSA-0, GHSA-1, GHSA-2, GHSA-3, GHSA-4 (and 2 more)"
    ids = spark.createDataFrame([("npm", "mal", "1", "a", "u"), ("npm", "mal", "2", "b", "u"), ("npm", "ok", "1", "a", "u"), ("npm", "ok", "2", "a", "u"), ("npm", "sus", "2", "n", "u")], "ecosystem string, package string, version string, identity string, url string")
    got = {r.pair_id: (r.feed.status, r.feed.signing_identity_changed) for r in feeds.rekor(p, ids).collect()}
    assert got == {"mal": ("suspicious", True), "ok": ("clean", False), "sus": ("clean", None), "down": ("no_data", None)}
    repos = spark.createDataFrame([("npm", "mal", "o/a"), ("npm", "ok", "o/b"), ("npm", "sus", "o/c")], "ecosystem string, package string, slug string")
    cards = spark.createDataFrame([("o/a", 3.9, None, [("Maintained", 4), ("Other", 1)]), ("o/b", None, 8.0, [])], "slug string, score double, aggregate_score double, checks array<struct<name:string,score:int>>")
    got = {r.pair_id: r.feed for r in feeds.scorecard(p, repos, cards).collect()}
    assert {k: v.status for k, v in got.items()} == {"mal": "suspicious", "ok": "clean", "sus": "no_data", "down": "no_data"}
    assert got["mal"].details == "3.9 of 10; Maintained=4"
    added = spark.createDataFrame([("mal", ["fresh", "old"]), ("ok", []), ("sus", ["nowhere"])], "pair_id string, new_dependencies array<string>")
    stats = spark.createDataFrame([("npm", "fresh", 2, 1), ("npm", "old", 90, 5)], "ecosystem string, package string, versions long, maintainers long")
    got = {r.pair_id: r.feed.status for r in feeds.new_deps(p, added, stats).collect()}
    assert got == {"mal": "suspicious", "ok": "clean", "sus": "no_data", "down": "clean"}
    both = feeds.all_feeds(p, feeds.osv(p, adv), feeds.rekor(p, ids)).collect()
    assert all([f.source for f in r.feed_results] == list(FEEDS) for r in both)
    assert {f.status for f in feeds.no_feeds(p).first().feed_results} == {"no_data"}


def test_slugs_and_scrutiny(spark):
    urls = {"https://github.com/o/r": "o/r", "git+https://github.com/o/r.git": "o/r", "git://github.com/o/r/": "o/r", "ssh://git@github.com/o/r.git": "o/r", "https://github.com/o": None, "https://gitlab.com/o/r": None, "https://github.com/o/r/tree/main": "o/r"}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", feeds.github_slug(F.col("u")).alias("s"))
    assert {r.u: r.s for r in df.collect()} == urls
    rows = [(5, None, True), (5, 1, True), (6, 1, False), (5, 2, False)]
    df = spark.createDataFrame(rows, "v int, m int, low boolean")
    assert df.where(feeds.low_scrutiny(F.col("v"), F.col("m")) != F.col("low")).count() == 0


ROWS = [("from", "index.js", "a\n"), ("to", "index.js", "a\nfetch('x')\n"), ("from", "package.json", "{}"), ("to", "package.json", '{"dependencies": {"x": "1"}}')]


def report(spark, **options):
    return release.reports(spark.createDataFrame([("p", "npm", "pkg", "1", "2")], PAIR), files(spark, ROWS), **options)


def test_report_end_to_end(spark, tmp_path):
    df = report(spark)
    r = df.first()
    assert (r.risk_score, r.severity, r.llm_base_score, r.error) == (3.5, "LOW", 3.5, None)
    assert r.diff_summary.new_dependencies == ["x"] and r.diff_summary.chunks_sent_to_llm == 1
    assert len(r.from_version_sha256) == 64 != r.to_version_sha256
    path = str(tmp_path / "reports")
    reports.write_json_lines(df.drop("pair_id", "error"), path)
    back = reports.faults(reports.read_reports(spark, path, multi_line=False))
    one = back.first()
    assert one.faults == [] and one.risk_score == 3.5 and one.diff_summary.files_modified == ["index.js"]
    bad = reports.faults(reports.read_reports(spark, path, multi_line=False).withColumn("severity", F.lit("HIGH")).withColumn("risk_score", F.lit(120.0))).first()
    assert len(bad.faults) >= 2
    text = render.report_text(json.loads(render.json_lines(df.drop("pair_id", "error"))[0]))
    assert "pkg 1 -> 2" in text and "new dependency: x" in text


def test_scorer_failure_is_an_error_row(spark):
    r = report(spark, scorer=lambda c: scorers.live(c, lambda p: (_ for _ in ()).throw(RuntimeError("down")))).first()
    assert (r.error, r.risk_score, r.severity) == ("down", None, None)


def test_scan(spark):
    locked = spark.createDataFrame([("b", "2"), ("a", "2"), ("a", "2"), ("c", "1")], "name string, version string")
    releases = spark.createDataFrame([(p, v, v) for p in "ab" for v in ("1", "2")] + [("c", "1", "1")], "package string, version string, published_at string")

    def load(pairs):
        content = spark.createDataFrame(ROWS, "side string, path string, t string").withColumn("content", F.col("t").cast("binary")).drop("t")
        from relsift.operators import tree

        return tree.with_facts(pairs.select("pair_id").crossJoin(content))

    got = release.scan(locked, releases, load, "npm", limit=0).collect()
    assert [(r.package, r.from_version, r.risk_score, r.error is None) for r in got] == [("a", "1", 3.5, True), ("b", "1", 3.5, True), ("c", None, None, False)]
    counts = reports.scan_counts(spark.createDataFrame([tuple(r) for r in got], "package string, from_version string, to_version string, risk_score double, severity string, error string")).first()
    assert tuple(counts) == (3, 2, 0, 1)
    assert release.scan(locked, releases, load, "npm", limit=1).count() == 1
    assert "3 dependencies, 2 diffed, 0 flagged, 1 errored" in render.scan_text([r.asDict() for r in got])


def test_hostile_text_is_literal():
    assert render.plain("[red]x[/red]\x1b[31m") == "[red]x[/red]\\x1b[31m"
    assert json.loads(render.error_text("x", True)) == {"error": "x"}


def test_old_reports_load(spark, tmp_path):
    (tmp_path / "old.json").write_text(json.dumps({"package": "p", "risk_score": 12.0, "severity": "LOW", "llm_base_score": 12.0, "dimensions": []}))
    r = reports.faults(reports.read_reports(spark, str(tmp_path / "old.json"))).first()
    assert r.score_modifiers == [] and r.faults == []
    assert REPORT.count("array") > 5


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from relsift import __main__ as cli
    from test_sources import PINS, tgz

    monkeypatch.setattr(cli, "session", lambda: spark)
    for v, text in (("1", b"a"), ("2", b"b")):
        (tmp_path / f"p-{v}.tgz").write_bytes(tgz({"index.js": text}))
    args = ["diff", "npm", "pkg", "1", "2", str(tmp_path / "p-1.tgz"), str(tmp_path / "p-2.tgz"), "--format", "json"]
    assert cli.main([*args, "--output", str(tmp_path / "r.json")]) == 0
    assert cli.main([*args, "--threshold", "3"]) == 1
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["package"] == "pkg"
    assert cli.main(["report", str(tmp_path / "r.json")]) == 0
    assert "risk 3.5/100 LOW" in capsys.readouterr().out
    assert cli.main(["report", str(tmp_path / "none.json")]) == 2
    (tmp_path / "requirements.txt").write_text(PINS)
    spark.createDataFrame([("a", "0.9", "1"), ("a", "1.0", "2")], "package string, version string, published_at string").write.parquet(str(tmp_path / "rel"))
    assert cli.main(["scan", str(tmp_path / "requirements.txt"), "--releases", str(tmp_path / "rel")]) == 0
    assert "a 0.9 -> 1.0" in capsys.readouterr().out
    folder = tmp_path / "archives"
    folder.mkdir()
    for v, text in (("0.9", b"x = 1"), ("1.0", b"x = 2")):
        (folder / f"a-{v}.tar.gz").write_bytes(tgz({"a/mod.py": text}))
    scan = ["scan", str(tmp_path / "requirements.txt"), "--releases", str(tmp_path / "rel"), "--archives", str(folder), "--limit", "0"]
    assert cli.main([*scan, "--threshold", "3"]) == 1
    lines = capsys.readouterr().out.splitlines()
    assert "a 0.9 -> 1.0: 3.5 LOW" in lines and lines[-1].endswith(f"1 diffed, 0 flagged, {len(lines) - 2} errored")
    (tmp_path / "yarn.txt").write_text("x")
    assert cli.main(["scan", str(tmp_path / "yarn.txt"), "--releases", str(tmp_path / "rel")]) == 2
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
