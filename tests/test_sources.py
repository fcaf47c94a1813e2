"""Archives, manifests, lockfiles, registries, certificates, URL and digest rules."""

import base64
import hashlib
import io
import json
import random
import tarfile
import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from relsift import __main__ as cli
from relsift.operators import history, metadata, tree
from relsift.plans import catalog, release
from relsift.settings import Settings
from relsift.sources import archives, certificates, fetch, lockfiles, manifests, registry


def tgz(members, prefix="package/"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(prefix + name)
            if data is None:
                info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
                t.addfile(info)
            else:
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def wheel(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
        link = zipfile.ZipInfo("pkg/link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "/etc/passwd")
    return out.getvalue()


def test_members(spark):
    rows = [
        ("a", "from", "p-1.tgz", tgz({"index.js": b"x", "lib/a.js": b"y", "../../evil.js": b"z", "link": None})),
        ("a", "to", "p-1.0-py3-none-any.whl", wheel({"pkg/m.py": b"m", "p-1.0.dist-info/METADATA": b"d"})),
        ("b", "from", "p-1.0.tar.gz", tgz({"setup.py": b"s"}, "p-1.0/")),
        ("b", "to", "unknown", wheel({"pkg/a.py": b"1", "other/b.py": b"2"})),
        ("c", "from", "bad.tgz", b"not an archive"),
        ("c", "to", "none.tgz", None),
    ]
    df = spark.createDataFrame(rows, "pair_id string, side string, file_name string, content binary")
    got = {}
    for r in archives.members(df).collect():
        got.setdefault((r.pair_id, r.side), {})[r.path] = r.error or bytes(r.content)
    assert got["a", "from"] == {"index.js": b"x", "lib/a.js": b"y"}
    assert got["a", "to"] == {"m.py": b"m"}
    assert got["b", "from"] == {"setup.py": b"s"}
    assert set(got["b", "to"]) == {"pkg/a.py", "other/b.py"}
    assert "bad.tgz" in got["c", "from"][None] and None in got["c", "to"]


@pytest.mark.parametrize("limits", [{"max_archive_files": 1}, {"max_archive_file_bytes": 3}, {"max_extracted_bytes": 6}])
def test_limits(limits):
    for name, content in (("x.tgz", tgz({"a.js": b"1234", "b.js": b"5678"})), ("x.whl", wheel({"a.py": b"1234", "b.py": b"5678"}))):
        with pytest.raises(archives.Rejected):
            archives.read_members(name, content, Settings(**limits))


def test_members_come_one_at_a_time():
    """Memory follows one member: an archive of 60 members of 4 MB, which packed is small, by both readers."""
    members = {f"pkg/m{i}.py": bytes([i]) * (4 << 20) for i in range(60)}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, data in members.items():
            z.writestr(name, data)
    for name, content in (("x.tgz", tgz(members, "")), ("x.whl", packed.getvalue())):
        tracemalloc.start()
        paths, found = archives.read_members(name, content)
        seen = {p: (len(c), c[0]) for p, c in found}
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert set(paths) == set(seen) and seen["pkg/m7.py"] == (4 << 20, 7)
        assert peak < 40 << 20


def test_the_last_of_a_name_counts_and_checksums_are_read():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for data in (b"first", b"second one"):
            info = tarfile.TarInfo("./a.js")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    assert [(p, c) for p, c in archives.read_members("x.tar", out.getvalue())[1]] == [("a.js", b"second one")]
    broken = bytearray(wheel({"a.py": b"1234567890"}))
    broken[broken.index(b"1234567890")] = 0
    with pytest.raises(archives.Rejected):
        archives.read_members("x.whl", bytes(broken))


def test_archives_read_at_their_paths(spark, tmp_path):
    for name, content in (("a b%20-1.tgz", tgz({"index.js": b"x"})), ("bad.tgz", b"none"), ("w.whl", wheel({"pkg/m.py": b"m"}))):
        (tmp_path / name).write_bytes(content)
    found = archives.archive_files(spark, str(tmp_path))
    assert {r.content for r in found.collect()} == {None}
    keyed = found.withColumn("pair_id", F.col("file_name")).withColumn("side", F.lit("to"))
    gone = keyed.where("file_name = 'w.whl'").select("pair_id", F.lit("from").alias("side"), "file_name", F.concat("path", F.lit(".gone")).alias("path"), "content", "error")
    got = {(r.pair_id, r.side): (r.path, r.content and bytes(r.content), r.error) for r in archives.members(keyed.unionByName(gone)).collect()}
    assert got["a b%20-1.tgz", "to"] == ("index.js", b"x", None) and got["w.whl", "to"] == ("m.py", b"m", None)
    assert got["bad.tgz", "to"][2].startswith("bad.tgz: ") and got["w.whl", "from"][2].startswith("w.whl: ")


def test_an_archive_that_changes_between_readings_is_retracted():
    names, found = archives.read_members("x.tgz", source := io.BytesIO(tgz({"a.js": b"1", "b.js": b"2"})))
    source.seek(0)
    source.write(bytes(len(source.getvalue())))
    with pytest.raises(archives.Rejected):
        list(found)


def test_safe_paths(spark):
    cases = {"a/b.js": True, "": False, "/a": False, "a/../b": False, "a\\b": False, "..": False, "a..b": True}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", archives.is_safe(F.col("p")).alias("ok"))
    assert {r.p: r.ok for r in df.collect()} == cases == {p: archives.safe_path(p) for p in cases}


PYPROJECT = '[project]\ndependencies = ["Flask>=2", "a b c"]\nauthors = [{name = "A", email = "a@x"}]\n[project.optional-dependencies]\ndev = ["pytest"]\n[build-system]\nrequires = ["setuptools"]\n'
SETUP_CFG = "[options]\ninstall_requires =\n  requests>=1\n  Six\n[options.extras_require]\nx = pyyaml\n"
SETUP_PY = "from setuptools import setup\nsetup(name='x', author='B', install_requires=['numpy>1', name], setup_requires=('cffi',))\nimport os; os.system('never run')"
REQUIREMENTS = "# c\n-r other.txt\nDjango==4 # note\nrequests[security]>=2; python_version>'3'\n\n"


def test_manifest_parsers():
    assert manifests.pyproject_dependencies(PYPROJECT) == {"flask", "pytest", "setuptools"}
    assert manifests.setup_cfg_dependencies(SETUP_CFG) == {"requests", "six", "pyyaml"}
    assert manifests.setup_py_dependencies(SETUP_PY) == {"numpy", "cffi"}
    assert manifests.requirements_dependencies(REQUIREMENTS) == {"django", "requests"}
    for parse in manifests.DEPENDENCIES.values():
        assert parse("((( [broken") == set() or parse is manifests.requirements_dependencies
    assert manifests.pyproject_author(PYPROJECT) == "A <a@x>"
    assert manifests.setup_py_author(SETUP_PY) == "B <>"
    assert manifests.module_author("__author__ = 'C'\n__email__ = 'c@x'") == "C <c@x>"


def metadata_of(spark, old, new):
    rows = [("p", s, path, t.encode()) for s, side in (("from", old), ("to", new)) for path, t in side.items()]
    return metadata.metadata_diff(tree.with_facts(spark.createDataFrame(rows, "pair_id string, side string, path string, content binary"))).first()


def test_metadata(spark):
    old = {"package.json": json.dumps({"dependencies": {"a": "1", "b": "1"}, "scripts": {"test": "x"}, "author": {"name": "n", "email": "e"}})}
    new = {"package.json": json.dumps({"dependencies": {"b": "2"}, "devDependencies": {"c": "1"}, "scripts": {"install": "i", "postinstall": "p"}, "author": {"email": "e", "name": "n"}}), "binding.gyp": "{}"}
    m = metadata_of(spark, old, new)
    assert (m.new_dependencies, m.removed_dependencies, m.new_install_hooks) == (["c"], ["a"], ["postinstall", "install"])
    assert not m.maintainer_changed and m.native_addons_added
    m = metadata_of(spark, {"package.json": '{"author": "a"}'}, {"package.json": '{"author": "b"}'})
    assert m.maintainer_changed
    m = metadata_of(spark, {"package.json": "[1]"}, {"package.json": '{"scripts": {"install": "i"}}'})
    assert not m.maintainer_changed and m.new_install_hooks == []
    m = metadata_of(spark, {"setup.py": SETUP_PY, "ctx.py": "__author__ = 'old'"}, {"setup.py": SETUP_PY, "ctx.py": "__author__ = 'new'", "requirements.txt": REQUIREMENTS})
    assert m.maintainer_changed and m.new_dependencies == ["django", "requests"]
    m = metadata_of(spark, {"index.js": "x"}, {"setup.py": "ext_modules=[]"})
    assert m.native_addons_added and not m.maintainer_changed


LOCK3 = json.dumps({"lockfileVersion": 3, "packages": {"": {"version": "9"}, "node_modules/lodash": {"version": "4.17.21"}, "node_modules/x/node_modules/@babel/core": {"version": "7.1.0"}, "node_modules/ws": {"link": True, "version": "1"}, "packages/local": {"version": "1"}, "node_modules/nov": {}}})
LOCK1 = json.dumps({"dependencies": {"a": {"version": "1.0", "dependencies": {"b": {"version": "2.0", "dependencies": {"c": {"version": "3.0"}}}}}, "d": "odd"}})
YARN1 = '# yarn lockfile v1\n\n"@babel/core@^7.0.0", "@babel/core@^7.1.0":\n  version "7.2.0"\n  dependencies:\n    version "9.9.9"\n\nlodash@^4:\n  version "4.17.21"\ngit-dep@git+ssh://x:\n  version "1.0.0"\n'
BERRY = '__metadata:\n  version: 6\n\n"alias@npm:real@^1.0.0":\n  version: 1.2.3\n  resolution: "real@npm:1.2.3"\n\n"root@workspace:.":\n  version: 0.0.0-use.local\n'
PINS = "a==1.0\nB.b[x]==2.0.1 ; python_version>'3' # c\nc>=1\n-e .\nd==4.2.*\ne===1\n\n# f==1\ng == 1!2.0+x\n"


def test_lockfiles(spark):
    rows = [("x/package-lock.json", LOCK3), ("v1/package-lock.json", LOCK1), ("y/yarn.lock", YARN1), ("z/YARN.lock", BERRY), ("requirements-dev.txt", PINS), ("Gemfile", "x"), ("bad/package-lock.json", "{")]
    df = spark.createDataFrame(rows, "file_name string, text string")
    got = {}
    for r in lockfiles.parse_lockfiles(df).collect():
        got.setdefault(r.file_name, set()).add((r.name, r.version))
    assert got == {
        "x/package-lock.json": {("lodash", "4.17.21"), ("@babel/core", "7.1.0")},
        "v1/package-lock.json": {("a", "1.0"), ("b", "2.0"), ("c", "3.0")},
        "y/yarn.lock": {("@babel/core", "7.2.0"), ("lodash", "4.17.21")},
        "z/YARN.lock": {("real", "1.2.3")},
        "requirements-dev.txt": {("a", "1.0"), ("B.b", "2.0.1"), ("g", "1!2.0+x")},
    }
    assert {r.file_name for r in lockfiles.malformed(df).collect()} == {"Gemfile", "bad/package-lock.json"}


def test_registry(spark):
    npm = {"versions": {"1.0": {"dist": {"tarball": "t", "integrity": "sha512-x"}}, "1.1": {}, "0.9": {}}, "time": {"created": "2020", "1.0": "2020-02", "1.1": "2020-03", "0.9": "2020-04", "gone": "2020-01"}, "maintainers": [{}, {}], "repository": {"url": "git+https://github.com/o/r.git"}}
    pypi = {"releases": {"1": [{"upload_time_iso_8601": "2021-02"}, {"upload_time_iso_8601": "2021-01"}], "2": []}, "info": {"project_urls": {"Homepage": "https://x.org", "Code": "https://github.com/a/b/tree/x"}, "home_page": ""}}
    n = spark.createDataFrame([("n", json.dumps(npm)), ("odd", "{"), ("s", json.dumps({"repository": "github.com/q/w", "versions": {"1": {}}}))], "package string, body string")
    p = spark.createDataFrame([("p", json.dumps(pypi))], "package string, body string")
    h = registry.npm_history(n)
    assert {(r.version, r.published_at) for r in h.collect()} == {("1.0", "2020-02"), ("1.1", "2020-03"), ("0.9", "2020-04")}
    locked = spark.createDataFrame([("n", "0.9"), ("n", "1.0"), ("n", "7")], "package string, version string")
    entries = {r.to_version: (r.from_version, r.error is None) for r in history.scan_entries(locked, h).collect()}
    assert entries == {"0.9": ("1.1", True), "1.0": (None, False), "7": (None, False)}
    assert {(r.version, r.published_at) for r in registry.pypi_history(p).collect()} == {("1", "2021-01")}
    assert {(r.package, r.slug) for r in registry.repositories(n, p).collect()} == {("n", "o/r"), ("s", "q/w"), ("p", "a/b")}
    assert {(r.package, r.versions, r.maintainers) for r in registry.package_stats(n, p).collect()} == {("n", 3, 2), ("s", 1, None), ("p", 2, None)}
    files = {"urls": [{"packagetype": "bdist_wheel", "filename": "w"}, {"packagetype": "sdist", "filename": "s1", "digests": {"sha256": "d"}}, {"packagetype": "sdist", "filename": "s2"}]}
    docs = spark.createDataFrame([("p", "1", json.dumps(files)), ("p", "2", '{"urls": []}')], "package string, version string, body string")
    assert [(r.version, r.filename, r.sha256) for r in registry.pypi_artifacts(docs).collect()] == [("1", "s1", "d")]
    assert spark.range(1).select(registry.npm_url("https://r/", F.lit("@s/p"))).first()[0] == "https://r/%40s%2Fp"
    assert spark.range(1).select(registry.pypi_url("https://r/", F.lit("a b"), F.lit("1.0"))).first()[0] == "https://r/a%20b/1.0/json"
    assert spark.range(1).select(history.last_versions(F.array(*[F.lit(str(i)) for i in range(12)]))).first()[0] == sorted(map(str, range(12)))[-10:]


def der(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x81, len(body)])
    return bytes([tag]) + size + body


def certificate(*names, critical=False):
    ext = der(0x30, certificates.ALTERNATIVE_NAMES + (b"\x01\x01\xff" if critical else b"") + der(0x04, der(0x30, b"".join(der(t, v.encode()) for t, v in names))))
    return der(0x30, der(0x02, b"\x01") + ext)


def test_identities(spark):
    uri = "https://github.com/o/r/.github/workflows/release.yml@refs/heads/main"
    assert certificates.identity(certificate((certificates.MAIL, "m@x"), (certificates.URI, uri))) == uri
    assert certificates.identity(certificate((certificates.MAIL, "m@x"), critical=True)) == "m@x"
    assert certificates.identity(certificate()) is None and certificates.identity(b"junk") is None and certificates.identity(None) is None
    assert certificates.identity(certificate((certificates.URI, uri))[:-20]) is None
    one = lambda kind, cert, n: {"predicateType": kind, "bundle": {"verificationMaterial": {"certificate": {"rawBytes": cert}, "tlogEntries": [{"logIndex": n}]}}}
    b64 = lambda x: base64.b64encode(x).decode()
    body = {"attestations": [one("other", b64(certificate((certificates.URI, "first"))), "1"), one("https://slsa.dev/provenance/v1", b64(b"junk"), "2"), one("https://slsa.dev/provenance/v1", b64(certificate((certificates.URI, uri))), "3")]}
    df = spark.createDataFrame([("n", "1", json.dumps(body)), ("n", "2", "{}")], "package string, version string, body string")
    assert [(r.version, r.identity, r.url) for r in registry.npm_identities(df).collect()] == [("1", uri, "https://search.sigstore.dev/?logIndex=3")]
    py = {"attestation_bundles": [{"publisher": {"kind": "GitHub"}}, {"publisher": {"kind": "GitHub", "repository": "o/r", "workflow": "w.yml", "environment": "e"}, "attestations": [{"verification_material": {"transparency_entries": [{"logIndex": "7"}]}}]}]}
    df = spark.createDataFrame([("p", "1", json.dumps(py))], "package string, version string, body string")
    assert registry.pypi_identities(df).first().identity == "github:o/r:w.yml:e"


URLS = {
    "https://registry.npmjs.org/x": True, "http://registry.npmjs.org/x": False, "https://u:p@registry.npmjs.org/x": False, "https://localhost/x": False,
    "https://a.localhost/x": False, "https://127.0.0.1/x": False, "https://10.1.2.3/": False, "https://169.254.169.254/": False, "https://8.8.8.8/": True, "https://[::1]/": False, "nonsense": False, "https://": False,
}


def test_url_rules(spark):
    def allowed(u, hosts=()):
        try:
            return bool(fetch.check_url(u, hosts))
        except (fetch.Refused, ValueError):
            return False

    assert {u: allowed(u) for u in URLS} == URLS
    df = spark.createDataFrame([(u,) for u in URLS], "u string").select("u", fetch.url_allowed(F.col("u")).alias("ok"))
    assert {r.u: r.ok for r in df.collect()} == URLS
    assert allowed("https://PyPI.org/x", fetch.PYPI_HOSTS) and not allowed("https://8.8.8.8/", fetch.PYPI_HOSTS)
    assert "more.org" in fetch.allowed_hosts("npm", Settings(extra_hosts="more.org, x"))


def test_downloads():
    ok = lambda body, **h: (200, h, [body])
    pages = {"https://pypi.org/a": (302, {"location": "https://files.pythonhosted.org/b"}, []), "https://files.pythonhosted.org/b": ok(b"data"), "https://pypi.org/evil": (302, {"location": "https://127.0.0.1/"}, []), "https://pypi.org/loop": (302, {"location": "/loop"}, []), "https://pypi.org/big": (200, {"content-length": "99"}, [b""]), "https://pypi.org/lies": ok(b"x" * 99)}
    get = lambda u: fetch.download(u, fetch.PYPI_HOSTS, pages.__getitem__, 10)
    assert get("https://pypi.org/a") == b"data"
    for name in ("evil", "loop", "big", "lies"):
        with pytest.raises(fetch.Refused):
            get(f"https://pypi.org/{name}")
    waits, calls = [], iter([OSError("429"), OSError("429"), "fine"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert fetch.with_retry(call, lambda e: True, sleep=waits.append) == "fine" and waits == [1, 2]
    with pytest.raises(ValueError):
        fetch.with_retry(lambda: (_ for _ in ()).throw(ValueError()), lambda e: False)


def test_digests(spark):
    data = b"payload"
    b64 = lambda k: base64.b64encode(hashlib.new(k, data).digest()).decode()
    sha1 = hashlib.sha1(data).hexdigest()
    rows = [(data, f"sha256-{b64('sha256')}", None, True), (data, f"sha1-x sha512-{b64('sha512')}?opt", None, True), (data, "sha512-AAAA", sha1, False), (data, None, sha1, True), (data, "", "00", False), (data, None, None, False)]
    df = spark.createDataFrame(rows, "c binary, i string, s string, ok boolean")
    assert df.where(fetch.npm_verified(F.col("c"), F.col("i"), F.col("s")) != F.col("ok")).count() == 0
    assert df.select(fetch.pypi_verified(F.col("c"), F.lit(hashlib.sha256(data).hexdigest()))).first()[0] and not df.select(fetch.pypi_verified(F.col("c"), F.lit(None).cast("string"))).first()[0]


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("# c\nRELSIFT_MAX_TOKENS_PER_CHUNK='2000'\nRELSIFT_NPM_REGISTRY=https://r/\n")
    s = Settings.from_env({"RELSIFT_MAX_RETRIES": "5"}, str(tmp_path / ".env"))
    assert (s.budget_chars, s.max_retries, s.npm_registry) == (8000, 5, "https://r")
    with pytest.raises(ValueError):
        Settings(max_tokens_per_chunk=10)


def made_documents(spark, folder, texts):
    df = texts.select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.col("text"))
    df.write.parquet(f"{folder}/documents.parquet")
    return catalog.QUERIES["archive_members"](spark, str(folder))


def test_archive_members_of_a_hot_source(spark, tmp_path):
    """More documents a side than an archive may hold: every one comes back, none twice."""
    got = made_documents(spark, tmp_path, spark.range(60_000).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")))
    assert got.select("side", "path").distinct().count() == got.count() == 60_000


def test_archive_members_fail_on_a_limit(spark, tmp_path):
    """A document that no archive may hold isn't left out without a sign."""
    got = made_documents(spark, tmp_path, spark.range(1).select("id", F.repeat(F.lit("x"), Settings().max_archive_file_bytes + 1).alias("text")))
    for act in (got.count, got.collect):
        with pytest.raises(Exception, match="bytes in one file"):
            act()


def test_archive_errors_are_errors_of_their_pair(spark, tmp_path):
    """An archive that is broken, beyond a limit or too long to load gives its pair an error and no score; other pairs keep theirs."""
    good, two = tgz({"a.js": b"1"}), tgz({"a.js": b"1", "b.js": b"2"})
    cut = bytearray(tgz({"a.js": random.Random(1).randbytes(200_000)}))
    cut[len(cut) // 2 :] = bytes(len(cut) - len(cut) // 2)
    sides = {"ok": (good, good), "limit": (good, two), "broken": (good, b"no archive"), "both": (b"no archive", None), "stream": (good, bytes(cut))}
    rows = [(k, side, "x.tgz", c) for k, v in sides.items() for side, c in zip(("from", "to"), v)]
    pairs = spark.createDataFrame([(k, "npm", k, "1", "2") for k in sides], "pair_id string, ecosystem string, package string, from_version string, to_version string")
    files = release.files_of_archives(spark.createDataFrame(rows, "pair_id string, side string, file_name string, content binary"), Settings(max_archive_files=1))
    got = {r.pair_id: r for r in release.reports(pairs, files).collect()}
    assert set(got) == set(sides) and (got["ok"].error, got["ok"].risk_score) == (None, 3.5)
    assert all(got[k].error.startswith("to archive: x.tgz") or k == "limit" for k in ("broken", "stream"))
    assert "more than 1 files" in got["limit"].error and got["both"].error.startswith("from archive") and "; to archive" in got["both"].error
    for k in set(sides) - {"ok"}:
        assert (got[k].risk_score, got[k].severity, got[k].diff_summary.files_removed) == (None, None, [])


def test_archives_too_long_to_load(spark, tmp_path):
    (tmp_path / "x.tgz").write_bytes(tgz({"a.js": b"1"}))
    r = archives.archive_files(spark, str(tmp_path / "x.tgz"), Settings(max_download_bytes=10)).first()
    assert r.content is None and "more than 10 bytes" in r.error


@pytest.mark.parametrize("limit, code", [("", 0), ("RELSIFT_MAX_ARCHIVE_FILES", 2), ("RELSIFT_MAX_DOWNLOAD_BYTES", 2)])
def test_diff_command_fails_on_lost_archives(spark, tmp_path, monkeypatch, capsys, limit, code):
    for name, members in (("old", {"a.js": b"1"}), ("new", {"a.js": b"1", "b.js": b"2"})):
        (tmp_path / f"{name}.tgz").write_bytes(tgz(members))
    monkeypatch.setattr(cli, "session", lambda: spark)
    if limit:
        monkeypatch.setenv(limit, "1")
    assert cli.main(["diff", "npm", "p", "1", "2", str(tmp_path / "old.tgz"), str(tmp_path / "new.tgz"), "--format", "json"]) == code
    assert ("more than 1" in capsys.readouterr().out) == (code == 2)


def test_artifacts_are_downloaded_verified_and_read(spark):
    """Both registries, a digest that differs, a host that isn't allowed, a file that isn't there."""
    import hashlib

    from relsift.plans import release

    good, other = tgz({"index.js": b"a"}), tgz({"index.js": b"b"})
    pages = {"https://registry.npmjs.org/p-1.tgz": good, "https://registry.npmjs.org/p-2.tgz": other, "https://files.pythonhosted.org/q-1.tar.gz": good}

    def opener(url):
        return (200, {}, [pages[url]]) if url in pages else (404, {}, [])

    sha1, sha256 = hashlib.sha1(good).hexdigest(), hashlib.sha256(good).hexdigest()
    rows = [
        ("ok", "from", "npm", "p-1.tgz", "https://registry.npmjs.org/p-1.tgz", None, sha1, None),
        ("other", "to", "npm", "p-2.tgz", "https://registry.npmjs.org/p-2.tgz", None, sha1, None),
        ("none", "to", "npm", "p-3.tgz", "https://registry.npmjs.org/p-3.tgz", None, sha1, None),
        ("host", "to", "npm", "p-1.tgz", "https://elsewhere.example.org/p-1.tgz", None, sha1, None),
        ("py", "to", "pypi", "q-1.tar.gz", "https://files.pythonhosted.org/q-1.tar.gz", None, None, sha256),
        ("bare", "to", "pypi", "q-1.tar.gz", "https://files.pythonhosted.org/q-1.tar.gz", None, None, None),
    ]
    requests = spark.createDataFrame(rows, "pair_id string, side string, ecosystem string, file_name string, url string, integrity string, shasum string, sha256 string")
    got = {r.pair_id: r for r in release.files_of_requests(requests, opener=opener).collect()}
    assert (got["ok"].path, got["ok"].text, got["py"].text) == ("index.js", "a", "a") and got["ok"].error is got["py"].error is None
    assert "digest" in got["other"].error and "digest" in got["bare"].error and "status 404" in got["none"].error and got["host"].error
    assert all(got[k].path is None for k in ("other", "none", "host", "bare"))


def test_archives_of_pairs_by_their_names(spark):
    from relsift.plans import release

    names = ["left-pad-1.0.0.tgz", "Left_Pad-1.1.0.tgz", "core-2.0.0.tgz", "My_Pkg-1.0-py3-none-any.whl", "my.pkg-1.0.tar.gz", "my_pkg-1.1-py3-none-any.whl"]
    found = spark.createDataFrame([(n, n.encode(), None) for n in names], "file_name string, content binary, error string")
    pairs = spark.createDataFrame([("l", "left-pad", "1.0.0", "1.1.0"), ("c", "@scope/core", "1.9.0", "2.0.0"), ("p", "my-pkg", "1.0", "1.1")], "pair_id string, package string, from_version string, to_version string")
    got = {(r.pair_id, r.side): (r.file_name, r.error) for r in release.archives_of(pairs, found).collect()}
    assert got == {
        ("l", "from"): ("left-pad-1.0.0.tgz", None), ("l", "to"): ("Left_Pad-1.1.0.tgz", None),
        ("c", "from"): (None, "no archive of @scope/core@1.9.0"), ("c", "to"): ("core-2.0.0.tgz", None),
        ("p", "from"): ("my.pkg-1.0.tar.gz", None), ("p", "to"): ("my_pkg-1.1-py3-none-any.whl", None),
    }


def test_unknown_versions_are_told_with_the_last_ones(spark):
    from relsift.operators import history

    releases = spark.createDataFrame([("a", f"1.{k}", f"{k:02}") for k in range(12)], "package string, version string, published_at string")
    locked = spark.createDataFrame([("a", "1.5"), ("a", "1.0"), ("a", "9.9"), ("b", "1")], "package string, version string")
    got = {(r.package, r.to_version): (r.from_version, r.error) for r in history.scan_entries(locked, releases).collect()}
    assert got[("a", "1.5")] == ("1.4", None)
    assert got[("a", "1.0")][1] == "no earlier published version of a@1.0" and got[("b", "1")][1] == "no earlier published version of b@1"
    assert got[("a", "9.9")][1] == "a has no version 9.9; its last ones are 1.10, 1.11, 1.2, 1.3, 1.4, 1.5, 1.6, 1.7, 1.8, 1.9"


def test_nested_lockfiles_of_any_number_and_depth(spark):
    """Beyond the row limit of recursive SQL, which is set low here, and deep."""
    deep = '{"version": "1.0"}'
    for i in range(60):
        deep = f'{{"version": "{i}.0", "dependencies": {{"d{i}": {deep}}}}}'
    text = f'{{"lockfileVersion": 1, "dependencies": {{"top": {deep}, "other": {{"version": "2.0"}}}}}}'
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        files = spark.range(200).selectExpr("concat(id, '/package-lock.json') file_name").withColumn("text", F.lit(text))
        out = lockfiles.npm_lock_pins(files)
        assert out.count() == 200 * 62
        assert {(r.name, r.version) for r in out.where("file_name = '7/package-lock.json'").collect()} == {("top", "59.0"), ("other", "2.0"), ("d0", "1.0"), *((f"d{i}", f"{i - 1}.0") for i in range(1, 60))}
        assert not [t for t in spark.catalog.listTables() if t.isTemporary and "lock" in t.name]
        assert lockfiles.npm_lock_pins(files.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_yarn_lock_of_very_many_lines(spark):
    import time

    n = 250_000
    text = "".join(f'"p{i}@^1.0.0":\n  version "1.{i}"\n  resolved "x"\n\n' for i in range(n))
    began = time.time()
    assert lockfiles.yarn_pins(spark.createDataFrame([("yarn.lock", text)], "file_name string, text string")).count() == n
    assert time.time() - began < 60
    odd = "  version 9.9\n__metadata:\n  version: 8\na@1, b@2:\n  version: 1.0\n  version: 1.1\nnoversion@1:\n  x y\nno colon\n  version 3.0\n"
    got = lockfiles.yarn_pins(spark.createDataFrame([("yarn.lock", odd)], "file_name string, text string")).collect()
    assert {(r.name, r.version) for r in got} == {("a", "1.1"), ("b", "1.1")}


def test_predecessors_across_ranges(spark):
    """A package that fills several ranges, ties aside, has the plain window's predecessors."""
    from pyspark.sql import Window

    from relsift.operators import history

    rows = spark.range(5000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 'hot' else concat('p', id % 50) end as k", "id * 7919 % 5003 as t", "concat('v', id) as v")
    parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = history.predecessors(rows, ["k"], ["t"], "v")
        want = rows.withColumn("previous_version", F.lag("v").over(Window.partitionBy("k").orderBy("t")))
        assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0
        assert history.predecessors(rows.limit(0), ["k"], ["t"], "v").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
