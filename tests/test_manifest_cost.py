"""Python's manifests are read by all tasks, and each file is parsed once."""

import ast
import tomllib

from packaging.requirements import InvalidRequirement, Requirement

from relsift.sources import manifests


def test_files_of_one_partition_are_dealt_out(spark):
    files = spark.range(200).coalesce(1).selectExpr("cast(id as string) as pair_id", "'to' as side", "'setup.py' as path", "'setup(install_requires=[\"a' || id || '>1\"])' as text")
    made = manifests.python_manifests(files)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert {(r.pair_id, *r.deps) for r in made.collect()} == {(str(i), f"a{i}") for i in range(200)}


def test_a_file_is_parsed_once(monkeypatch):
    seen = []
    for module, name in ((ast, "parse"), (tomllib, "loads")):
        monkeypatch.setattr(module, name, lambda text, f=getattr(module, name): seen.append(text) or f(text))
    code = "__author__ = 'x'\nsetup(author='me', install_requires=['only_here'])\n"
    assert (manifests.setup_py_dependencies(code), manifests.setup_py_author(code), manifests.module_author(code)) == ({"only_here"}, "me <>", "x <>")
    toml = '[project]\ndependencies = ["only-here2"]\nauthors = [{name = "me"}]\n'
    assert (manifests.pyproject_dependencies(toml), manifests.pyproject_author(toml)) == ({"only-here2"}, "me <>")
    assert seen == [code, toml]


def test_plain_names_are_as_the_full_parser_says():
    def full(spec):
        try:
            return Requirement(spec.strip().rstrip(",")).name.lower()
        except (InvalidRequirement, ValueError):
            return None

    for spec in ("a", "A.b-C_d", "a_", "a-", "-a", "a\n", "9", "and", "or", "in", "os_name", "a b", "a,", "é", "a>=1", "a[x]", "", " a ", "a..b", "python_version", "extra"):
        assert manifests.requirement_name(spec) == full(spec), spec
