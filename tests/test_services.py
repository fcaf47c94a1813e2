"""The data source of answers, feeds and downloads against a fake service, replayed answers, and jobs side by side."""

import hashlib
import io
import json
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from relsift import __main__ as cli
from relsift.operators import scorers
from relsift.plans import lookups
from relsift.session import side_by_side, stages, written
from relsift.settings import Settings
from relsift.sources import calls, fetch, services
from tests.fake_service import Service

PAIR = "pair_id string, ecosystem string, package string, from_version string, to_version string"


def tgz(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(f"package/{name}")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def advisories(posted):
    """Two pages for p, none for others."""
    asked = json.loads(posted)
    if asked["package"]["name"] != "p":
        return b"{}"
    if "page_token" not in asked:
        return json.dumps({"vulns": [{"id": f"{asked['package']['ecosystem']}-{asked['version']}"}], "next_page_token": "t"}).encode()
    return json.dumps({"vulns": [{"id": "MAL-1"}]}).encode()


@pytest.fixture
def service():
    old, new = tgz({"index.js": b"a\n", "package.json": b"{}"}), tgz({"index.js": b"b\n", "package.json": b'{"dependencies": {"tiny": "1"}}'})
    answers: dict = {"/npm/p-1.tgz": old, "/npm/p-2.tgz": new, "/osv/query": advisories}
    s = Service(answers, limited=["/npm/p", "/osv/query"])
    dist = lambda v, data: {"dist": {"tarball": f"{s.base}/npm/p-{v}.tgz", "shasum": hashlib.sha1(data).hexdigest()}}
    answers["/npm/p"] = json.dumps({"versions": {"1": dist(1, old), "2": dist(2, new)}, "repository": {"url": "git+https://github.com/o/p.git"}, "maintainers": [1, 2]}).encode()
    answers["/npm/tiny"] = json.dumps({"versions": {"1": {}}, "maintainers": [{}]}).encode()
    answers["/cards/projects/github.com/o/p"] = json.dumps({"score": 3.5, "checks": [{"name": "Maintained", "score": 10}]}).encode()
    answers["/pypi/q/json"] = json.dumps({"info": {"home_page": "https://example.org"}, "releases": {str(i): [] for i in range(9)}}).encode()
    for v, workflow in (("1", "a.yml"), ("2", "b.yml")):
        answers[f"/pypi/q/{v}/json"] = json.dumps({"urls": [{"filename": f"q-{v}.tar.gz", "packagetype": "sdist", "url": "u"}]}).encode()
        answers[f"/integrity/q/{v}/q-{v}.tar.gz/provenance"] = json.dumps({"attestation_bundles": [{"publisher": {"kind": "GitHub", "repository": "o/q", "workflow": workflow}}]}).encode()
    yield s
    s.close()


@pytest.fixture
def settings(service):
    b = service.base
    return Settings(npm_registry=f"{b}/npm", pypi_registry=f"{b}/pypi", osv_api=f"{b}/osv", pypi_integrity=f"{b}/integrity", scorecard_api=f"{b}/cards", extra_hosts=b[8:])


def pairs(spark):
    rows = [("a", "npm", "p", "1", "2"), ("b", "pypi", "q", "1", "2"), ("c", "npm", "lost", "1", "2"), ("d", "npm", None, None, None)]
    return spark.createDataFrame(rows, PAIR)


def added(spark):
    return spark.createDataFrame([("a", ["tiny"]), ("b", []), ("c", None), ("d", [])], "pair_id string, new_dependencies array<string>")


def status(df):
    return {r.pair_id: {f.source: f for f in r.feed_results} for r in df.collect()}


def test_feeds_of_a_service_recorded_and_replayed(spark, service, settings, tmp_path):
    ask = services.asker(settings, opener="tests.fake_service:opener")
    live = status(lookups.feeds_by(ask, settings, str(tmp_path / "saved"))(pairs(spark), added(spark)))
    assert {k: v.status for k, v in live["a"].items()} == {"osv": "malicious", "rekor": "no_data", "scorecard": "suspicious", "new_deps": "suspicious"}
    assert live["a"]["osv"].advisory_ids == ["npm-2", "MAL-1"] and "Maintained=10" in live["a"]["scorecard"].details
    assert {k: v.status for k, v in live["b"].items()} == {"osv": "clean", "rekor": "suspicious", "scorecard": "no_data", "new_deps": "clean"}
    assert live["b"]["rekor"].signing_identity == "github:o/q:b.yml" and live["c"]["scorecard"].status == "no_data" and live["d"]["osv"].status == "no_data"
    assert service.calls["/npm/p"] == 2, "asked again once after the rate limit"
    asked = sum(service.calls.values())
    replayed = services.asker(settings, replay=str(tmp_path / "saved"))
    assert status(lookups.feeds_by(replayed, settings)(pairs(spark), added(spark))) == live and sum(service.calls.values()) == asked


def test_filters_spare_calls_and_rows(spark, service, settings, tmp_path):
    services.register(spark)
    df = lookups.documents(pairs(spark).where("package is not null"), settings).unionByName(lookups.npm_attestations(pairs(spark).select("ecosystem", "package", F.col("to_version").alias("version")), settings))
    df.repartition(3).write.parquet(str(tmp_path / "requests"))
    read = spark.read.format(services.NAME).options(requests=str(tmp_path / "requests"), opener="tests.fake_service:opener", settings=json.dumps(settings.__dict__)).load()
    got = read.where((F.col("kind") == "document") & F.col("package").isin("p", "q")).collect()
    assert {(r.package, r.status) for r in got} == {("p", 200), ("q", 200)} and set(service.calls) == {"/npm/p", "/pypi/q/json"}
    lost = {r.package: r for r in read.where("package = 'lost' and kind = 'document'").collect()}["lost"]
    assert (lost.status, lost.body) == (404, None) and "404" in lost.error
    assert read.where("kind = 'document'").rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="folder of requests"):
        spark.read.format(services.NAME).load().count()


def test_empty_requests(spark, settings, tmp_path):
    services.register(spark)
    none = spark.createDataFrame([], services.REQUEST)
    assert services.asker(settings)(none).count() == 0
    spark.createDataFrame([], services.ANSWER).write.parquet(str(tmp_path / "saved"))
    assert spark.read.format(services.NAME).option("replay", str(tmp_path / "saved")).load().count() == 0
    assert lookups.feeds_by(services.asker(settings), settings)(spark.createDataFrame([], PAIR), added(spark).where("false")).count() == 0


def test_other_hosts_are_not_asked(spark, settings):
    rows = [("document", "npm", str(i), None, u, None) for i, u in enumerate(("https://elsewhere.example.org/", "http://p1.example.org/", "", None))]
    got = services.asker(settings, opener="tests.fake_service:opener")(spark.createDataFrame(rows, services.REQUEST)).collect()
    assert len(got) == 4 and all(r.body is None and r.status is None and r.error for r in got)


def test_diff_command_downloads_asks_and_scores(spark, service, settings, monkeypatch, capsys, tmp_path):
    monkeypatch.setattr(cli, "session", lambda: services.register(spark))
    for name in ("npm_registry", "osv_api", "scorecard_api", "extra_hosts"):
        monkeypatch.setenv(f"RELSIFT_{name.upper()}", getattr(settings, name))
    args = ["diff", "npm", "p", "1", "2", "--format", "json", "--opener", "tests.fake_service:opener", "--scorer", "tests.fake_service:rate", "--model", "m"]
    assert cli.main([*args, "--feeds", "--record", str(tmp_path / "saved")]) == 0
    r = json.loads(capsys.readouterr().out)
    assert [f["status"] for f in r["feed_results"]] == ["malicious", "no_data", "suspicious", "suspicious"]
    assert r["llm_summary"] == "seen" and r["llm_model"] == "m" and r["diff_summary"]["new_dependencies"] == ["tiny"]
    t = r["timings"]
    assert t["llm_seconds"] > 0 and t["fetch_seconds"] > 0 and t["diff_seconds"] > 0 and max(t["llm_seconds"], t["feeds_seconds"]) <= t["analysis_seconds"] + 0.002 <= t["total_seconds"]
    asked = service.calls["/osv/query"]
    assert cli.main([*args, "--replay", str(tmp_path / "saved")]) == 0, "documents are in that folder, archives are downloaded"
    assert json.loads(capsys.readouterr().out)["feed_results"] == r["feed_results"] and service.calls["/osv/query"] == asked


def test_scan_command_asks_and_scores(spark, service, settings, monkeypatch, capsys, tmp_path):
    monkeypatch.setattr(cli, "session", lambda: services.register(spark))
    for name in ("npm_registry", "osv_api", "scorecard_api", "extra_hosts"):
        monkeypatch.setenv(f"RELSIFT_{name.upper()}", getattr(settings, name))
    (tmp_path / "archives").mkdir()
    for v, text in (("1", b"a"), ("2", b"b")):
        (tmp_path / "archives" / f"p-{v}.tgz").write_bytes(tgz({"index.js": text}))
    (tmp_path / "package-lock.json").write_text(json.dumps({"packages": {"node_modules/p": {"version": "2"}}}))
    spark.createDataFrame([("p", "1", "2020-01-01"), ("p", "2", "2021-01-01")], "package string, version string, published_at string").write.parquet(str(tmp_path / "releases"))
    args = ["scan", str(tmp_path / "package-lock.json"), "--releases", str(tmp_path / "releases"), "--archives", str(tmp_path / "archives"), "--format", "json", "--opener", "tests.fake_service:opener"]
    assert cli.main([*args, "--feeds", "--scorer", "tests.fake_service:rate", "--threshold", "55"]) == 1
    row = json.loads(capsys.readouterr().out)
    assert (row["package"], row["from_version"], row["to_version"], row["error"]) == ("p", "1", "2", None) and row["risk_score"] > 55


def test_live_scorer_limits_order_and_failures(spark):
    chunks = spark.createDataFrame([("p", i, f"chunk {i}") for i in range(12)] + [("p", 12, None)], "pair_id string, chunk_idx int, content string")

    def service():
        refused = set()

        async def complete(prompt):
            n = int(prompt.split("chunk ")[1].split("\n")[0]) if "chunk " in prompt else -1
            if n % 4 == 1 and n not in refused:
                refused.add(n)
                raise scorers.RateLimited(wait=0.01)
            if n == 7:
                raise RuntimeError("down")
            time.sleep(0.05 if n % 2 == 0 else 0)  # later ones are ready first
            return f"raw {n}"

        return complete

    got = scorers.live(chunks.coalesce(1), service(), concurrency=1, at_once=4).collect()
    by = {r.chunk_idx: r for r in got}
    assert len(by) == 13 and by[7].error == "down" and all(by[i].raw == f"raw {i}" for i in range(12) if i != 7) and by[12].raw == "raw -1"


def test_calls_in_order_and_at_most_so_many():
    taken, done = [], []

    def items():
        for i in range(10):
            taken.append(i)
            assert len(taken) - len(done) <= 4
            yield i

    for x in calls.in_order(lambda i: (time.sleep(0.02 if i % 3 == 0 else 0), i)[1], items(), 3):
        done.append(x)
    assert done == list(range(10))
    now, slept = [0.0], []
    pace = calls.Pace(2, clock=lambda: now[0], sleep=slept.append)
    for _ in range(3):
        pace.wait()
    assert slept == [0.5, 1.0]


def test_waits_as_long_as_a_service_asks():
    waits = []

    def refuse(wait):
        def call():
            raise fetch.Refused("status 429", 429, wait)

        return call

    with pytest.raises(fetch.Refused):
        fetch.with_retry(refuse(7.0), fetch.limited, Settings(max_retries=2), waits.append)
    with pytest.raises(fetch.Refused):
        fetch.with_retry(refuse(fetch.MAX_WAIT + 1), fetch.limited, Settings(), waits.append)
    assert waits == [7.0, 7.0] and fetch.asked_wait({"retry-after": "5"}) == 5 and fetch.asked_wait({"retry-after": "Fri, 1 Jan"}) is None


def test_side_by_side_and_stages(spark):
    """Both jobs overlap, rows are counted, and one's failure leaves the other's rows."""

    def slow(x):
        time.sleep(1.0)
        return x

    rows = spark.range(3, numPartitions=1)
    make = lambda: rows.select(F.udf(slow, "long")("id").alias("id"))
    with stages() as log:
        made = side_by_side(spark, {"one": make, "two": make, "bad": lambda: rows.select(F.raise_error(F.lit("broken")).alias("x"))})
        written(spark.range(0), "none")
    assert made["one"].count() == made["two"].count() == 3 and "broken" in str(made["bad"])
    by = {s.name: s for s in log}
    assert set(by) == {"one", "two", "none"} and (by["one"].rows, by["two"].rows, by["none"].rows) == (3, 3, 0)
    assert max(by["one"].began, by["two"].began) < min(s.began + s.seconds for s in (by["one"], by["two"]))
    assert side_by_side(spark, {}) == {}


def test_reports_survive_failing_feeds(spark):
    from relsift.plans import release

    files = spark.createDataFrame([("a", "from", "x.js", "1\n"), ("a", "to", "x.js", "2\n")], "pair_id string, side string, path string, text string")
    files = files.withColumn("size", F.length("text").cast("long")).withColumn("sha256", F.sha2("text", 256))

    def broken(pairs, added):
        raise OSError("no network")

    one = pairs(spark).where("pair_id = 'a'")
    r = release.reports(one, files, feeds=broken, scorer=lambda c: scorers.live(c, lambda p: '{"dimensions": [], "summary": "s"}')).first()
    assert [f.status for f in r.feed_results] == ["no_data"] * 4 and "no network" in r.feed_results[0].details and r.llm_summary == "s" and r.error is None
    r = release.reports(one, files, scorer=lambda c: c.select("no such column")).first()
    assert r.risk_score is None and "no such column" in r.error
