"""Package manifests: package.json in the JVM; Python's own formats in one Arrow pass.

Nothing of a package is run: setup.py and modules are read as syntax trees.
"""

from __future__ import annotations

import ast
import configparser
import re
import tomllib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from packaging.requirements import InvalidRequirement, Requirement
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relsift.operators.batches import slices

PYTHON_MANIFESTS = ("pyproject.toml", "setup.cfg", "setup.py", "requirements.txt")


#: A requirement that is a name alone.
_PLAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?")


@lru_cache(1 << 14)
def requirement_name(spec: str) -> str | None:
    """Lower-cased name of a requirement, None if it is none."""
    if _PLAIN.fullmatch(spec):
        return spec.lower()
    try:
        return Requirement(spec.strip().rstrip(",")).name.lower()
    except (InvalidRequirement, ValueError):
        return None


def _names(specs) -> set[str]:
    return {n for s in specs if isinstance(s, str) and (n := requirement_name(s))}


# a file is asked for its dependencies, then for its authors: the last one's parsed form is kept
@lru_cache(1)
def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError):
        return {}


def _table(data: dict, name: str) -> dict:
    found = data.get(name)
    return found if isinstance(found, dict) else {}


def pyproject_dependencies(text: str) -> set[str]:
    """Dependencies, optional groups, and what the build requires."""
    data = _toml(text)
    project = _table(data, "project")
    groups = [project.get("dependencies"), _table(data, "build-system").get("requires"), *_table(project, "optional-dependencies").values()]
    return _names(s for g in groups if isinstance(g, list) for s in g)


def setup_cfg_dependencies(text: str) -> set[str]:
    """install_requires and every extra."""
    parser = configparser.ConfigParser(interpolation=None)
    try:
        parser.read_string(text)
    except configparser.Error:
        return set()
    values = [parser.get("options", "install_requires", fallback="")]
    if parser.has_section("options.extras_require"):
        values += [v for _, v in parser.items("options.extras_require")]
    return _names(line for v in values for line in v.splitlines())


@lru_cache(1)
def _tree(text: str) -> list[ast.AST]:
    try:
        return list(ast.walk(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


def _literal(node: ast.AST) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def setup_py_dependencies(text: str) -> set[str]:
    """Literal lists given as install_requires or setup_requires to any call."""
    lists = [k.value for node in _tree(text) if isinstance(node, ast.Call) for k in node.keywords if k.arg in ("install_requires", "setup_requires")]
    return _names(_literal(e) for v in lists if isinstance(v, (ast.List, ast.Tuple)) for e in v.elts)


def requirements_dependencies(text: str) -> set[str]:
    """Names of a requirements file; options are left out."""
    lines = (line.partition("#")[0].strip() for line in text.splitlines())
    return _names(x for x in lines if x and x[0] != "-")


def _signature(name: str | None, mail: str | None) -> str:
    return f"{name or ''} <{mail or ''}>"


def pyproject_author(text: str) -> str | None:
    authors = _table(_toml(text), "project").get("authors")
    signed = sorted(_signature(a.get("name"), a.get("email")) for a in authors if isinstance(a, dict)) if isinstance(authors, list) else []
    return "; ".join(signed) or None


def setup_py_author(text: str) -> str | None:
    for node in _tree(text):
        if isinstance(node, ast.Call):
            given = {k.arg: _literal(k.value) for k in node.keywords if k.arg in ("author", "author_email") and _literal(k.value) is not None}
            if given:
                return _signature(given.get("author"), given.get("author_email"))
    return None


def module_author(text: str) -> str | None:
    """First literal __author__ and __email__ of a module."""
    given: dict[str, str] = {}
    for node in _tree(text):
        if isinstance(node, ast.Assign) and _literal(node.value) is not None:
            for target in node.targets:
                if isinstance(target, ast.Name) and target.id in ("__author__", "__email__"):
                    given.setdefault(target.id, node.value.value)
    return _signature(given.get("__author__"), given.get("__email__")) if given else None


DEPENDENCIES = {"pyproject.toml": pyproject_dependencies, "setup.cfg": setup_cfg_dependencies, "setup.py": setup_py_dependencies, "requirements.txt": requirements_dependencies}


def npm_manifests(files: DataFrame) -> DataFrame:
    """(pair_id, side, deps, scripts, author) of root package.json files that are JSON objects.

    Keys of dependencies and devDependencies; names of scripts; the author as JSON with sorted keys, so that order doesn't matter (D9).
    """
    got = files.where("path = 'package.json'").withColumn("j", F.try_parse_json("text")).where("schema_of_variant(j) like 'OBJECT%'")
    keys = lambda name: F.coalesce(F.map_keys(F.try_variant_get("j", f"$.{name}", "map<string,variant>")), F.array().cast("array<string>"))
    return got.select("pair_id", "side", F.array_union(keys("dependencies"), keys("devDependencies")).alias("deps"), keys("scripts").alias("scripts"), F.to_json(F.try_variant_get("j", "$.author", "variant")).alias("author"))


def python_manifests(files: DataFrame) -> DataFrame:
    """(pair_id, side, path, deps, author) of root manifests and modules, in Arrow batches.

    Parsing takes long for few bytes, so files are dealt to all tasks first: a small table may be read by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        authors = {"pyproject.toml": pyproject_author, "setup.py": setup_py_author}
        for b in slices(batches, "text"):
            rows = []
            for pair, side, path, text in zip(*(c.to_pylist() for c in b.columns)):
                deps = DEPENDENCIES.get(path, lambda _: set())(text or "")
                author = authors[path](text or "") if path in authors else None
                rows.append({"pair_id": pair, "side": side, "path": path, "deps": sorted(deps), "author": author, "dunder": module_author(text or "") if path.endswith(".py") else None})
            kind = pa.schema([("pair_id", pa.string()), ("side", pa.string()), ("path", pa.string()), ("deps", pa.list_(pa.string())), ("author", pa.string()), ("dunder", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, kind)

    wanted = files.where(F.col("path").isin(*PYTHON_MANIFESTS) | (F.col("path").endswith(".py") & ~F.contains("path", F.lit("/"))))
    # a given number, which isn't lowered for small shuffles
    spread = wanted.select("pair_id", "side", "path", "text").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pair_id", "side", "path")
    return spread.mapInArrow(run, "pair_id string, side string, path string, deps array<string>, author string, dunder string")


def manifest_facts(files: DataFrame) -> DataFrame:
    """(pair_id, side, deps, has_npm, scripts, author, py_author): all manifests of a side together.

    py_author joins three sources with bars and is null only where none of them declares one (D10).
    """
    py = python_manifests(files)
    at = lambda name: F.max(F.when(F.col("path") == name, F.col("author")))
    sides = py.groupBy("pair_id", "side").agg(F.flatten(F.collect_list("deps")).alias("py_deps"), at("pyproject.toml").alias("a"), at("setup.py").alias("b"), F.min_by("dunder", F.when(F.col("dunder").isNotNull(), F.col("path"))).alias("c"))
    joined = F.when(F.coalesce("a", "b", "c").isNotNull(), F.concat_ws("|", F.coalesce("a", F.lit("")), F.coalesce("b", F.lit("")), F.coalesce("c", F.lit(""))))
    sides = sides.select("pair_id", "side", "py_deps", joined.alias("py_author"))
    npm = npm_manifests(files).withColumnRenamed("deps", "npm_deps").withColumn("has_npm", F.lit(True))
    none = F.array().cast("array<string>")
    both = sides.join(npm, ["pair_id", "side"], "full")
    return both.select("pair_id", "side", F.array_union(F.coalesce("py_deps", none), F.coalesce("npm_deps", none)).alias("deps"), F.coalesce("has_npm", F.lit(False)).alias("has_npm"), "scripts", "author", "py_author")
