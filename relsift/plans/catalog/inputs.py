"""Readers: each input is written from rows of a table in its own format, read back by the operator, and must give the rows again."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from relsift.functions import feeds, scoring
from relsift.operators import metadata, tree
from relsift.plans.catalog import query, table
from relsift.session import written
from relsift.settings import Settings
from relsift.sources import archives, lockfiles, manifests, registry, services

_NAME = "replace(p_name, ' ', '-')"


@query("""select source as package, cast(doc_id as varchar) as version, case doc_id % 4 when 0 then 'no_data' when 1 then 'clean' when 2 then 'malicious' else 'suspicious' end as status,
  case doc_id % 4 when 0 then null when 1 then '' else case doc_id % 4 when 2 then 'MAL-' else 'A-' end || substr(sha256(coalesce(text, '')), 1, 12) end as ids from documents""")
def advisories_replayed(spark, sf_dir):
    """A document as a version whose saved answer of advisories names its text's digest, none, or is a failure; the saved folder also
    holds an answer of another kind for each, which the data source doesn't give."""
    k, digest = F.col("doc_id") % 4, F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 12)
    body = F.when(k == 1, "{}").when(k > 1, F.to_json(F.struct(F.array(F.struct(F.concat(F.when(k == 2, "MAL-").otherwise("A-"), digest).alias("id"))).alias("vulns"))))
    docs = table(spark, sf_dir, "documents").select(F.lit(services.ADVISORIES).alias("kind"), F.lit("npm").alias("ecosystem"), F.col("source").alias("package"), F.col("doc_id").cast("string").alias("version"), body.alias("body"), F.when(k == 0, 500).otherwise(200).alias("status"), F.when(k == 0, "status 500").alias("error"))
    saved = written(docs.unionByName(docs.withColumn("kind", F.lit(services.DOCUMENT))), "saved")
    answers = services.register(spark).read.format(services.NAME).option("replay", saved.scratch).load().where(F.col("kind") == services.ADVISORIES)
    return registry.advisories(answers).select("package", "version", feeds.advisory_status(F.col("ids")).alias("status"), F.array_join("ids", ",").alias("ids"))


@query(f"select distinct p_brand || '/package-lock.json' as file_name, 'npm' as ecosystem, {_NAME} || p_partkey % 40 as name, p_size || '.0.1' as version from part where p_partkey % 9 <> 0")
def npm_lock_pins(spark, sf_dir):
    """Parts of a brand as one lockfile's packages; every ninth is a link."""
    key = F.expr(f"case p_partkey % 3 when 0 then 'node_modules/x/' else '' end || 'node_modules/' || {_NAME} || p_partkey % 40")
    entry = F.concat(F.to_json(F.create_map(F.concat(F.lit("k"), F.col("p_partkey").cast("string"), F.lit("/"), key), F.struct(F.expr("p_size || '.0.1'").alias("version"), F.when(F.col("p_partkey") % 9 == 0, True).alias("link")))))
    body = F.concat(F.lit('{"packages": {"": {"version": "0"}, '), F.array_join(F.collect_list(F.expr("substring(e, 2, length(e) - 2)")), ","), F.lit("}}"))
    files = table(spark, sf_dir, "part").select("p_brand", entry.alias("e")).groupBy("p_brand").agg(body.alias("text"))
    return lockfiles.npm_lock_pins(files.select(F.concat("p_brand", F.lit("/package-lock.json")).alias("file_name"), "text"))


@query(f"""select distinct p_brand || '/yarn.lock' as file_name, 'npm' as ecosystem, case when p_partkey % 2 = 0 then '@s/' || {_NAME} else {_NAME} end as name, p_size || '.2.0' as version from part where p_partkey % 5 <> 0""")
def yarn_pins(spark, sf_dir):
    """Parts of a brand as a lockfile's entries, in both dialects; every fifth comes from a repository."""
    spec = f"case when p_partkey % 2 = 0 then '@s/' else '' end || {_NAME} || case when p_partkey % 5 = 0 then '@git+ssh://h/r' else '@^' || p_size end"
    entry = f"case when p_partkey % 3 = 0 then '\"' || {spec} || '\", \"' || {spec} || '.x\":' || chr(10) || '  version: ' || p_size || '.2.0' else {spec} || ':' || chr(10) || '  version \"' || p_size || '.2.0\"' end || chr(10) || '  dependencies:' || chr(10) || '    version \"9.9.9\"'"
    files = table(spark, sf_dir, "part").select("p_brand", F.expr(entry).alias("e")).groupBy("p_brand").agg(F.concat(F.lit("# lockfile\n__metadata:\n  version: 6\n\n"), F.array_join(F.collect_list("e"), "\n\n"), F.lit("\n")).alias("text"))
    return lockfiles.yarn_pins(files.select(F.concat("p_brand", F.lit("/yarn.lock")).alias("file_name"), "text"))


@query("select cast(user_id as varchar) as package, 'v' || event_id as version, cast(ts as varchar) as published_at from events where event_type <> 'view'")
def npm_history(spark, sf_dir):
    """Events of a user as a package's times; views have a time but no version."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("package"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("v"), F.col("ts").cast("string").alias("at"), (F.col("event_type") != "view").alias("kept"))
    times = F.map_from_entries(F.collect_list(F.struct("v", "at")))
    versions = F.map_from_entries(F.filter(F.collect_list(F.when(F.col("kept"), F.struct("v", F.struct(F.col("at").alias("x"))))), lambda x: x.isNotNull()))
    docs = e.groupBy("package").agg(F.to_json(F.struct(times.alias("time"), versions.alias("versions"))).alias("body"))
    return registry.npm_history(docs)


@query("""select cast(user_id as varchar) as package, event_type as version, cast(min(ts) as varchar) as published_at from events group by user_id, event_type""")
def pypi_history(spark, sf_dir):
    """Events of a user by type as the files of a project's releases."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("package"), "event_type", F.col("ts").cast("string").alias("upload_time_iso_8601"))
    files = e.groupBy("package", "event_type").agg(F.collect_list(F.struct("upload_time_iso_8601")).alias("f"))
    docs = files.groupBy("package").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("event_type", "f"))).alias("releases"))).alias("body"))
    return registry.pypi_history(docs)


@query("""with e as (select *, row_number() over (partition by user_id, event_type order by case event_id % 3 when 1 then 0 when 2 then 1 else 2 end, event_id) as n from events)
select cast(user_id as varchar) as package, event_type as version, 'f' || event_id as filename from e where n = 1""")
def pypi_artifacts(spark, sf_dir):
    """Events as files of a version, in order of event_id: of three kinds by its remainder."""
    kind = F.element_at(F.array(F.lit("other"), F.lit("sdist"), F.lit("bdist_wheel")), (F.col("event_id") % 3).cast("int") + 1)
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("package"), F.col("event_type").alias("version"), F.struct("event_id", F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("filename"), kind.alias("packagetype")).alias("f"))
    docs = e.groupBy("package", "version").agg(F.to_json(F.struct(F.sort_array(F.collect_list("f")).alias("urls"))).alias("body"))
    return registry.pypi_artifacts(docs).select("package", "version", "filename")


#: Bounds of one archive made here, far below those of Settings: members, and bytes before the last one is added.
_PACKED_FILES, _PACKED_BYTES = 1_000, 4 << 20


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives of bounded size from rows (pair_id, side, doc_id, text), as they come: no key is gathered in one place."""
    kind = pa.schema([("pair_id", pa.string()), ("side", pa.string()), ("file_name", pa.string()), ("content", pa.binary())])

    def archive(pair_id: str, side: str, files: list[tuple[str, bytes]]) -> pa.RecordBatch:
        out = io.BytesIO()
        if side == "from":
            with tarfile.open(fileobj=out, mode="w:gz") as t:
                for name, data in files:
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
        else:
            with zipfile.ZipFile(out, "w") as z:
                for name, data in files:
                    z.writestr(name, data)
        return pa.RecordBatch.from_pylist([{"pair_id": pair_id, "side": side, "file_name": "p.tgz" if side == "from" else "p.zip", "content": out.getvalue()}], kind)

    for b in batches:
        open_: dict[tuple[str, str], tuple[list, int]] = {}
        for pair_id, side, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("pair_id", "side", "doc_id", "text"))):
            files, held = open_.pop((pair_id, side), ([], 0))
            data = text.encode()
            files.append((f"package/lib/d{doc_id}.js", data))
            if len(files) >= _PACKED_FILES or held + len(data) >= _PACKED_BYTES:
                yield archive(pair_id, side, files)
            else:
                open_[pair_id, side] = files, held + len(data)
        for (pair_id, side), (files, _) in open_.items():
            yield archive(pair_id, side, files)


@query("""select source as pair_id, case when doc_id % 2 = 0 then 'from' else 'to' end as side, 'lib/d' || doc_id || '.js' as path, sha256(text) as sha256 from documents""")
def archive_members(spark, sf_dir):
    """Documents of a source packed into tars and zips, by whether doc_id is even; an archive that breaks a limit fails the query."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("pair_id"), F.when(F.col("doc_id") % 2 == 0, "from").otherwise("to").alias("side"), "doc_id", "text")
    made = docs.mapInArrow(_packed, "pair_id string, side string, file_name string, content binary")
    read = archives.members(made).where(F.assert_true(F.col("error").isNull(), F.col("error")).isNull())
    return tree.with_facts(read).select("pair_id", "side", "path", "sha256")


@query("""with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
s as (select doc_id, len(l) as files, list_max(list_transform(l, lambda x: octet_length(encode(x)))) as largest, list_sum(list_transform(l, lambda x: octet_length(encode(x)))) as total from l)
select doc_id, files > 40 or largest > 1500 or total > 9000 as rejected, case when files > 40 or largest > 1500 or total > 9000 then 0 else files end::bigint as files,
  case when files > 40 or largest > 1500 or total > 9000 then 0 else total end::bigint as bytes from s""")
def archive_limits(spark, sf_dir):
    """A document's lines as the members of an archive, even documents' as a tar and others' as a zip, read under small limits of members, of bytes in one and of bytes in all."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                lines = (text or "").split("\n")
                out = io.BytesIO()
                if doc_id % 2:
                    with zipfile.ZipFile(out, "w") as z:
                        for i, line in enumerate(lines):
                            z.writestr(f"p/l{i}", line.encode())
                else:
                    with tarfile.open(fileobj=out, mode="w:gz", compresslevel=1) as t:
                        for i, line in enumerate(lines):
                            info = tarfile.TarInfo(f"p/l{i}")
                            info.size = len(line.encode())
                            t.addfile(info, io.BytesIO(line.encode()))
                yield pa.RecordBatch.from_arrays([pa.array([str(doc_id)]), pa.array(["p.zip" if doc_id % 2 else "p.tgz"]), pa.array([out.getvalue()], pa.binary())], ["pair_id", "file_name", "content"])

    made = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(packed, "pair_id string, file_name string, content binary").withColumn("side", F.lit("to"))
    read = archives.members(made, Settings(max_archive_files=40, max_archive_file_bytes=1500, max_extracted_bytes=9000))
    got = read.groupBy(F.col("pair_id").cast("long").alias("doc_id")).agg(F.bool_or(F.col("error").isNotNull()).alias("rejected"), F.count("path").alias("files"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).cast("long").alias("bytes"))
    return got.select("doc_id", "rejected", "files", "bytes")


@query(r"""with p as (select page_id, regexp_replace(url, '^[a-z]+://', '') as p from pages),
q as (select page_id, case page_id % 4 when 0 then '/' || p when 1 then '../' || p when 2 then replace(p, '/', chr(92)) else p end as path from p)
select page_id, path <> '' and not contains(path, chr(92)) and not starts_with(path, '/') and not list_contains(string_split(path, '/'), '..') as safe from q""")
def safe_path(spark, sf_dir):
    p = F.regexp_replace("url", "^[a-z]+://", "")
    k = F.col("page_id") % 4
    path = F.when(k == 0, F.concat(F.lit("/"), p)).when(k == 1, F.concat(F.lit("../"), p)).when(k == 2, F.translate(p, "/", "\\")).otherwise(p)
    return table(spark, sf_dir, "pages").select("page_id", archives.is_safe(path).alias("safe"))


@query("""select p_brand as pair_id, array_to_string(list_sort(list(distinct lower(p_type) || '-' || p_size)), ',') as deps from part group by p_brand""")
def requirements_manifest(spark, sf_dir):
    """Parts of a brand as a requirements file with ranges, options and notes."""
    line = F.expr("p_type || '-' || p_size || case p_partkey % 3 when 0 then '>=1,<2' when 1 then '[x]~=1.0 # note' else '' end")
    files = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("pair_id")).agg(F.concat(F.lit("# head\n-r other.txt\n"), F.array_join(F.collect_list(line), "\n")).alias("text"))
    found = manifests.python_manifests(files.withColumn("side", F.lit("to")).withColumn("path", F.lit("requirements.txt")))
    return found.select("pair_id", F.array_join(F.sort_array("deps"), ",").alias("deps"))


@query("""with o as (select distinct l_orderkey % 500 as k, l_linenumber % 2 as side, l_suppkey as dep from lineitem),
f as (select k, dep from o where side = 0), t as (select k, dep from o where side = 1),
a as (select k, string_agg('d' || dep, ',' order by 'd' || dep) as new_dependencies from t anti join f using (k, dep) group by k),
r as (select k, string_agg('d' || dep, ',' order by 'd' || dep) as removed_dependencies from f anti join t using (k, dep) group by k),
b as (select k from o group by k)
select cast(k as varchar) as pair_id, coalesce(new_dependencies, '') as new_dependencies, coalesce(removed_dependencies, '') as removed_dependencies,
  case when k in (select k from f) and k in (select k from t) then 'postinstall,install' else '' end as new_install_hooks, (k in (select k from f) and k in (select k from t) and k % 3 = 0) as maintainer_changed from b left join a using (k) left join r using (k)""")
def manifest_changes(spark, sf_dir):
    """Suppliers of groups of orders as dependencies in two package.json files; hooks are new, the author changes in every third."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("k"), F.when(F.col("l_linenumber") % 2 == 0, "from").otherwise("to").alias("side"), F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("dep"))
    deps = F.map_from_entries(F.transform(F.collect_set("dep"), lambda d: F.struct(d, F.lit("1"))))
    new = F.col("side") == "to"
    scripts = F.when(new, F.create_map(F.lit("install"), F.lit("x"), F.lit("postinstall"), F.lit("y"))).otherwise(F.create_map(F.lit("test"), F.lit("z")))
    author = F.when(new & (F.col("k") % 3 == 0), F.struct(F.lit("b").alias("name"))).otherwise(F.struct(F.lit("a").alias("name")))
    files = li.groupBy("k", "side").agg(deps.alias("dependencies")).select(F.col("k").cast("string").alias("pair_id"), "side", F.lit("package.json").alias("path"), F.to_json(F.struct("dependencies", scripts.alias("scripts"), author.alias("author"))).alias("text"))
    out = metadata.metadata_diff(files)
    return out.select("pair_id", F.array_join("new_dependencies", ",").alias("new_dependencies"), F.array_join("removed_dependencies", ",").alias("removed_dependencies"), F.array_join("new_install_hooks", ",").alias("new_install_hooks"), "maintainer_changed")


@query("""select p_partkey, case when p_type = '' or p_brand = '' or p_partkey % 7 = 0 then null else lower(p_type) || ':' || p_brand || ':w' || case when p_partkey % 2 = 0 then ':e' else '' end end as identity from part""")
def publisher_identity(spark, sf_dir):
    k = F.col("p_partkey")
    p = F.struct(F.col("p_type").alias("kind"), F.col("p_brand").alias("repository"), F.when(k % 7 != 0, "w").alias("workflow"), F.when(k % 2 == 0, "e").otherwise("").alias("environment"))
    return table(spark, sf_dir, "part").select("p_partkey", feeds.publisher_identity(p).alias("identity"))


@query("select p_partkey, cast(p_size as double) * 2 as score, repeat('█', floor(least(p_size * 2.0, 100) / 100 * 40)::int) || repeat('░', 40 - floor(least(p_size * 2.0, 100) / 100 * 40)::int) as bar from part")
def score_bar(spark, sf_dir):
    score = F.col("p_size") * F.lit(2.0)
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"), scoring.score_bar(score).alias("bar"))


@query("""select source as pair_id, cast(doc_id // 1000 as varchar) as side,
  sha256(string_agg(doc_id || ':' || sha256(text), chr(10) order by cast(doc_id as varchar))) as digest from documents group by source, doc_id // 1000""")
def tree_digest(spark, sf_dir):
    """Digests of trees: a source's documents of a thousand ids are a tree, and an id is a path."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("source").alias("pair_id"), F.floor(F.col("doc_id") / 1000).cast("string").alias("side"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    return tree.digests(files)
