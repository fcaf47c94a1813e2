"""Lockfiles as tables of (ecosystem, name, version): (file_name, text) in, pinned dependencies out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relsift.session import new_folder

#: Fixed value: an exact pin; a wildcard's trailing dot is none.
PIN = r"^([A-Za-z0-9][A-Za-z0-9._-]*?)(?:\[[^\]]*\])?\s*==\s*([A-Za-z0-9.!+_-]+)"
#: Ranges that no registry serves.
ELSEWHERE = r"^(workspace:|file:|link:|portal:|patch:|exec:|git|github:|gitlab:|bitbucket:|http://|https://)"

MODULES = "node_modules/"


def lock_key_name(key: Column) -> Column:
    """Package name of a packages key: what follows the last node_modules/; null without one."""
    name = F.substring_index(key, MODULES, -1)
    return F.when(F.contains(key, F.lit(MODULES)) & (name != ""), name)


def specifier_name(spec: Column) -> Column:
    """Registry name of name@range: aliases give the real name, other origins null."""
    at = F.locate("@", spec, 2)
    name = F.when(at > 0, F.substring(spec, F.lit(1), at - 1))
    rest = F.when(at > 0, F.substring(spec, at + 1, F.length(spec)))
    real = F.regexp_extract(rest, r"^npm:(.[^@]*)@", 1)
    found = F.when(rest.startswith("npm:"), F.when(real != "", real).otherwise(name)).when(~rest.rlike(ELSEWHERE), name)
    return F.when(found != "", found)


def pinned(line: Column) -> tuple[Column, Column]:
    """(name, version) of a requirements line, null where it is no exact pin."""
    bare = F.trim(F.substring_index(line, "#", 1))
    version = F.regexp_extract(bare, PIN, 2)
    ok = (bare != "") & ~bare.startswith("-") & (version != "") & ~version.endswith(".")
    return F.when(ok, F.regexp_extract(bare, PIN, 1)), F.when(ok, version)


def ecosystem_of(file_name: Column) -> Column:
    """By lower-cased name (S17); null if it is no lockfile."""
    base = F.lower(F.element_at(F.split(file_name, "/"), -1))
    return F.when(base.isin("package-lock.json", "npm-shrinkwrap.json", "yarn.lock"), "npm").when(base.rlike(r"^requirements.*\.txt$"), "pypi")


def _lines(files: DataFrame) -> DataFrame:
    return files.select("file_name", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("pos", "line"))


def requirements_pins(files: DataFrame) -> DataFrame:
    name, version = pinned(F.col("line"))
    return _lines(files).select("file_name", F.lit("pypi").alias("ecosystem"), name.alias("name"), version.alias("version")).where("name is not null").distinct()


def yarn_pins(files: DataFrame) -> DataFrame:
    """Both yarn formats (S20, W05): a column-0 line ending in a colon names specifiers, its two-space version line the version.

    Only these lines become rows; a version belongs to the last line at column 0 before it, and of several the last counts.
    """
    line = F.col("line")
    blank = (F.trim(line) == "") | F.ltrim(line).startswith("#")
    head = ~blank & ~line.rlike(r"^\s")
    key = F.trim(F.regexp_replace(F.rtrim(line), ":$", ""))
    named = F.when(F.rtrim(line).endswith(":") & (key != "__metadata"), key).otherwise("")
    version = F.regexp_extract(line, r'^ {2}version[: ]\s*"?(\d[^"]*?)"?\s*$', 1)
    told = _lines(files).select("file_name", "pos", F.when(head, F.struct("pos", named.alias("specs"))).alias("head"), F.when(~head & ~blank & (version != ""), version).alias("version")).where("head is not null or version is not null")
    # a file is one text, which bounds its lines
    before = Window.partitionBy("file_name").orderBy("pos")
    carried = told.withColumn("head", F.last("head", True).over(before)).where("version is not null")
    entries = carried.groupBy("file_name", "head").agg(F.max_by("version", "pos").alias("version"))
    specs = entries.select("file_name", F.explode(F.split("head.specs", ",")).alias("spec"), "version")
    name = specifier_name(F.regexp_replace(F.trim("spec"), '^"+|"+$', ""))
    return specs.select("file_name", F.lit("npm").alias("ecosystem"), name.alias("name"), "version").where("name is not null").distinct()


def npm_lock_pins(files: DataFrame) -> DataFrame:
    """package-lock of all versions (S18, S19): the packages map, or else the nested dependencies, flattened level by level."""
    parsed = files.select("file_name", F.try_parse_json("text").alias("j"))
    packages = F.try_variant_get("j", "$.packages", "map<string,variant>")
    flat = parsed.select("file_name", F.explode(packages).alias("key", "v")).select(
        "file_name",
        lock_key_name(F.col("key")).alias("name"),
        F.try_variant_get("v", "$.version", "string").alias("version"),
        F.coalesce(F.try_variant_get("v", "$.link", "boolean"), F.lit(False)).alias("link"),
    )
    new = flat.where("not link and name is not null and version <> ''").select("file_name", "name", "version")
    # variants don't recurse, their JSON text does
    nested = parsed.where(packages.isNull()).select("file_name", F.to_json(F.try_variant_get("j", "$.dependencies", "variant")).alias("deps")).where("deps is not null")
    return new.unionByName(_flattened(nested)).select("file_name", F.lit("npm").alias("ecosystem"), "name", "version").distinct()


def _flattened(nested: DataFrame) -> DataFrame:
    """(file_name, name, version) of nested dependencies (file_name, deps), of any number and depth.

    Level by level: the frontier of a level is a written table that holds what stands below, and the next level
    reads it alone, until none is left.
    """
    spark = nested.sparkSession
    folder = new_folder(spark, "levels")
    kind = "file_name string, name string, version string, deps string"
    level = 0
    while True:
        inner = nested.select("file_name", F.explode(F.from_json("deps", "map<string,string>")).alias("name", "value"))
        rows = inner.select("file_name", "name", F.try_variant_get(F.try_parse_json("value"), "$.version", "string").alias("version"), F.get_json_object("value", "$.dependencies").alias("deps"))
        rows.write.parquet(f"{folder}/level={level}")
        made = spark.read.schema(kind).parquet(f"{folder}/level={level}")
        nested = made.where("deps is not null").select("file_name", "deps")
        if nested.isEmpty():
            break
        level += 1
    return spark.read.schema(kind).parquet(folder).where("name is not null and version <> ''").select("file_name", "name", "version")


def parse_lockfiles(files: DataFrame) -> DataFrame:
    """(file_name, ecosystem, name, version) of all lockfiles, each by its own format; other files give no rows."""
    base = F.lower(F.element_at(F.split("file_name", "/"), -1))
    yarn = yarn_pins(files.where(base == "yarn.lock"))
    npm = npm_lock_pins(files.where(base.isin("package-lock.json", "npm-shrinkwrap.json")))
    return npm.unionByName(yarn).unionByName(requirements_pins(files.where(ecosystem_of(F.col("file_name")) == "pypi")))


def malformed(files: DataFrame) -> DataFrame:
    """(file_name, error) of lockfiles that can't be read."""
    base = F.lower(F.element_at(F.split("file_name", "/"), -1))
    j = F.try_parse_json("text")
    error = F.when(ecosystem_of(F.col("file_name")).isNull(), "unknown lockfile name").when(base.endswith(".json") & (F.try_variant_get(j, "$.packages", "map<string,variant>").isNull() & F.try_variant_get(j, "$.dependencies", "map<string,variant>").isNull()), "not a lockfile of a known form")
    return files.select("file_name", error.alias("error")).where("error is not null")
