"""Packages: manifests, lockfiles by name, identities, statistics and feeds, written from rows of a table and read by the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from relsift.functions import feeds
from relsift.operators import history, metadata, tree
from relsift.plans.catalog import query, table
from relsift.sources import lockfiles, manifests, registry, reports

_LOCKED = "case doc_id % 5 when 0 then 'Package-Lock.json' when 1 then 'npm-SHRINKWRAP.json' when 2 then 'Yarn.lock' when 3 then 'Requirements-dev.TXT' else 'Cargo.lock' end"


@query(f"""select source || '/' || doc_id || '/' || {_LOCKED} as file_name, case when doc_id % 5 = 3 then 'pypi' else 'npm' end as ecosystem, 'd' || doc_id as name, n_chars || '.1.0' as version
from documents where doc_id % 5 <> 4""")
def lockfile_dispatch(spark, sf_dir):
    """A document as a lockfile of one of five names, in mixed case, that pins one package; the fifth name is none of the engine's."""
    pin = F.concat(F.col("n_chars").cast("string"), F.lit(".1.0"))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    k = F.col("doc_id") % 5
    entry = F.create_map(F.when(k == 0, F.concat(F.lit("node_modules/"), name)).otherwise(name), F.struct(pin.alias("version")))
    body = (
        F.when(k == 0, F.to_json(F.struct(entry.alias("packages"))))
        .when(k == 1, F.to_json(F.struct(entry.alias("dependencies"))))
        .when(k == 2, F.concat(name, F.lit('@^1:\n  version "'), pin, F.lit('"\n')))
        .otherwise(F.concat(name, F.lit("=="), pin, F.lit("  # kept\n")))
    )
    docs = table(spark, sf_dir, "documents")
    return lockfiles.parse_lockfiles(docs.select(F.concat_ws("/", "source", "doc_id", F.expr(_LOCKED)).alias("file_name"), body.alias("text")))


@query("""with d as (select p_partkey, lower(p_type) as a, 'p' || p_size as b, 'q' || p_partkey as c, p_partkey % 3 as k from part)
select p_partkey as part, case k when 0 then 'pyproject.toml' when 1 then 'setup.cfg' else 'setup.py' end as path,
  array_to_string(list_sort(list_distinct(case when k = 2 then [a, b] else [a, b, c] end)), ',') as deps from d""")
def python_manifest_deps(spark, sf_dir):
    """A part as a Python project of one of three forms: required, extra and build dependencies; setup.py also has one that isn't literal."""
    a, b, c = F.col("p_type"), F.concat(F.lit("P"), F.col("p_size").cast("string")), F.concat(F.lit("q"), F.col("p_partkey").cast("string"))
    toml = F.concat(F.lit('[project]\ndependencies = ["'), a, F.lit('>=1,<2"]\n[project.optional-dependencies]\nx = ["'), b, F.lit('[y]~=1.0"]\n[build-system]\nrequires = ["'), c, F.lit('"]\n'))
    cfg = F.concat(F.lit("[metadata]\nname = x\n[options]\ninstall_requires =\n  "), a, F.lit(">=1\n[options.extras_require]\nx =\n  "), b, F.lit("\ny =\n  "), c, F.lit("; python_version > '3'\n"))
    code = F.concat(F.lit("import setuptools\nsetuptools.setup(install_requires=['"), a, F.lit("==1', other], setup_requires=('"), b, F.lit("',), tests_require=['"), c, F.lit("'])\n"))
    k = F.col("p_partkey") % 3
    path = F.when(k == 0, "pyproject.toml").when(k == 1, "setup.cfg").otherwise("setup.py")
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("pair_id"), F.lit("to").alias("side"), path.alias("path"), F.when(k == 0, toml).when(k == 1, cfg).otherwise(code).alias("text"))
    return manifests.python_manifests(files).select(F.col("pair_id").cast("long").alias("part"), "path", F.array_join("deps", ",").alias("deps"))


def _customers(spark, sf_dir):
    """A customer as two releases of a Python project: the second names a segment as author where the key is a multiple of 3; even keys
    have a setup.py too, and every fifth a module that names its author; native code comes by nation."""
    key = F.col("c_custkey")
    project = lambda who: F.concat(F.lit('[project]\nauthors = [{email = "x@y", name = "'), who, F.lit('"}]\n'))
    setup = F.concat(F.lit("from setuptools import setup\nsetup(author='"), F.col("c_name"), F.lit("')\n"))
    module = F.concat(F.lit("__email__ = 'm@x'\n__author__ = '"), F.col("c_mktsegment"), F.lit("'\n"))
    native = F.when(F.col("c_nationkey") % 4 == 0, "lib/x.so").when(F.col("c_nationkey") % 4 == 1, "binding.gyp")
    one = lambda path, text: F.struct(F.lit(path).alias("path") if isinstance(path, str) else path.alias("path"), text.alias("text"))

    def side(name: str, who, *more):
        files = F.array(one("pyproject.toml", project(who)), F.when(key % 2 == 0, one("setup.py", setup)), F.when(key % 5 == 0, one("pkg.py", module)), *more)
        each = table(spark, sf_dir, "customer").select(key.cast("string").alias("pair_id"), F.lit(name).alias("side"), F.explode(files).alias("f")).where("f is not null")
        return each.select("pair_id", "side", "f.path", "f.text")

    changed = F.when(key % 3 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name"))
    old_native = F.when(key % 7 == 0, one(F.lit("old.node"), F.lit("")))
    return side("from", F.col("c_name"), old_native).unionAll(side("to", changed, F.when(native.isNotNull(), one(native, F.lit("")))))


_SIDES = "s as (select *, 'from' as side, c_name as who from customer union all select *, 'to', case when c_custkey % 3 = 0 then c_mktsegment else c_name end from customer)"


@query(f"""with {_SIDES} select c_custkey as customer, side, who || ' <x@y>|' || case when c_custkey % 2 = 0 then c_name || ' <>' else '' end || '|' || case when c_custkey % 5 = 0 then c_mktsegment || ' <m@x>' else '' end as author from s""")
def python_authors(spark, sf_dir):
    """The author of each side, from up to three sources."""
    return manifests.manifest_facts(_customers(spark, sf_dir)).select(F.col("pair_id").cast("long").alias("customer"), "side", F.col("py_author").alias("author"))


@query("""select c_custkey as customer, c_custkey % 3 = 0 and c_name <> c_mktsegment as maintainer_changed, c_nationkey % 4 < 2 and c_custkey % 7 <> 0 as native_addons_added from customer""")
def author_and_native_changes(spark, sf_dir):
    got = metadata.metadata_diff(_customers(spark, sf_dir))
    return got.select(F.col("pair_id").cast("long").alias("customer"), "maintainer_changed", "native_addons_added")


@query("""with s as (select source, doc_id // 1000 as side, case doc_id % 4 when 0 then 'js' when 1 then 'py' when 2 then 'TS' else 'md' end as ext, doc_id from documents)
select source as pair_id, cast(side as varchar) as side, count(*) as files, count(*) filter (where ext <> 'md') as source_files, bool_or(doc_id % 97 = 0) as native from s group by source, side""")
def tree_counts(spark, sf_dir):
    """Files of trees, at any depth: a source's documents of a thousand ids are a tree; every 97th is a native addon beside its text."""
    docs = table(spark, sf_dir, "documents")
    ext = F.expr("case doc_id % 4 when 0 then 'js' when 1 then 'py' when 2 then 'TS' else 'md' end")
    native = F.when(F.col("doc_id") % 97 == 0, "setup.py")
    files = docs.select(F.col("source").alias("pair_id"), F.floor(F.col("doc_id") / 1000).cast("string").alias("side"), F.concat(F.lit("a/b/d"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), F.lit("").alias("text"), native.alias("extra"))
    marked = files.unionByName(files.where("extra is not null").withColumn("path", F.col("extra")).withColumn("text", F.lit("ext_modules=[]")))
    return tree.counts(files).join(tree.has_native(marked), ["pair_id", "side"])


@query("""with c as (select s_suppkey, 's' || s_suppkey as package, s_suppkey % 9 as versions, case when s_suppkey % 4 = 3 then null else s_suppkey % 4 end as maintainers from supplier where s_suppkey % 5 <> 0),
n as (select distinct l_orderkey, 's' || l_suppkey as package from lineitem),
a as (select l_orderkey, count(*) as total from n group by l_orderkey),
g as (select l_orderkey, count(*) as resolved, string_agg(package, ', ' order by package) filter (where versions <= 5 and coalesce(maintainers, 0) <= 1) as low from n join c using (package) group by l_orderkey)
select o_orderkey as pair, case when total is null then 'clean' when resolved is null then 'no_data' when low is not null then 'suspicious' else 'clean' end as status, coalesce(low, '') as low
from orders left join a on o_orderkey = a.l_orderkey left join g on o_orderkey = g.l_orderkey""")
def new_dependencies_feed(spark, sf_dir):
    """An order as a pair whose new dependencies are its lines' suppliers; four of five suppliers have a registry document, with
    versions and maintainers. Named are the little-known ones, read from the feed's words."""
    k = F.col("s_suppkey")
    versions = F.map_from_entries(F.transform(F.sequence(F.lit(1), k % 9), lambda i: F.struct(F.concat(F.lit("v"), i.cast("string")), F.struct(i.alias("n")))))
    versions = F.when(k % 9 > 0, versions).otherwise(F.create_map().cast("map<string,struct<n:bigint>>"))
    people = F.when(k % 4 != 3, F.slice(F.array(F.lit("x"), F.lit("y")), 1, (k % 4).cast("int")))
    documents = table(spark, sf_dir, "supplier").where(k % 5 != 0).select(F.concat(F.lit("s"), k.cast("string")).alias("package"), F.to_json(F.struct(versions.alias("versions"), people.alias("maintainers"))).alias("body"))
    stats = registry.package_stats(documents, documents.limit(0))
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("pair_id"), F.lit("npm").alias("ecosystem"))
    added = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("pair_id")).agg(F.sort_array(F.collect_set(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))).alias("new_dependencies"))
    got = feeds.new_deps(pairs, added, stats)
    return got.select(F.col("pair_id").cast("long").alias("pair"), "feed.status", F.regexp_extract("feed.details", r"^Little-known new dependencies: (.*)\.$", 1).alias("low"))


@query("""select p_partkey as pair, case when p_partkey % 4 = 3 or p_partkey % 6 = 5 or p_partkey % 7 = 0 then 'no_data' when p_size / 5.0 < 4 then 'suspicious' else 'clean' end as status,
  case when p_partkey % 4 = 3 or p_partkey % 6 = 5 or p_partkey % 7 = 0 then null else p_size / 5.0 end::double as score from part""")
def scorecard_feed(spark, sf_dir):
    """A part as a package: its document names a repository, in one of three forms or none; the repository's answer has a score, an
    aggregate one, or neither, or is missing."""
    k = F.col("p_partkey")
    slug = F.concat(F.lit("o/r"), k.cast("string"))
    part = table(spark, sf_dir, "part").withColumn("package", F.concat(F.lit("p"), k.cast("string")))
    url = F.when(k % 4 == 0, F.concat(F.lit("git+https://github.com/"), slug, F.lit(".git"))).when(k % 4 == 1, F.concat(F.lit("git+ssh://git@github.com/"), slug, F.lit(".git/"))).when(k % 4 == 2, F.concat(F.lit("https://github.com/"), slug)).otherwise(F.concat(F.lit("https://example.org/"), slug))
    documents = part.select("package", F.to_json(F.struct(F.struct(url.alias("url")).alias("repository"))).alias("body"))
    repos = registry.repositories(documents, documents.limit(0))
    number = F.col("p_size") / F.lit(5.0)
    answers = part.where(k % 6 != 5).select(slug.alias("package"), F.to_json(F.struct(F.when((k % 2 == 0) & (k % 7 != 0), number).alias("score"), F.when((k % 2 == 1) & (k % 7 != 0), number).alias("aggregate_score"))).alias("body"))
    pairs = part.select(k.cast("string").alias("pair_id"), F.lit("npm").alias("ecosystem"), "package")
    got = feeds.scorecard(pairs, repos, registry.scorecards(answers))
    return got.select(F.col("pair_id").cast("long").alias("pair"), "feed.status", F.col("feed.scorecard_score").alias("score"))


@query("""select doc_id as pair, unnest(['osv', 'rekor', 'scorecard', 'new_deps']) as feed, 'no_data' as status from documents""")
def feeds_off(spark, sf_dir):
    """A document as a pair that no feed is asked for."""
    off = feeds.no_feeds(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pair_id")))
    return off.select(F.col("pair_id").cast("long").alias("pair"), F.explode("feed_results").alias("f")).select("pair", F.col("f.source").alias("feed"), "f.status")


@query("""select 'p' || p_partkey as package, cast(p_size as varchar) as version,
  case when p_partkey % 2 = 0 then 'github' else 'gitlab' end || ':' || p_brand || ':w' as identity, 'https://search.sigstore.dev/?logIndex=' || p_partkey as url from part where p_partkey % 5 <> 0""")
def publisher_bundles(spark, sf_dir):
    """A part as a version's answer: a bundle that names no publisher, the one that counts, and a later one; every fifth has the first only."""
    k = F.col("p_partkey")
    publisher = lambda repository: F.struct(F.when(k % 2 == 0, "GitHub").otherwise("GitLab").alias("kind"), repository.alias("repository"), F.lit("w").alias("workflow"), F.lit(None).cast("string").alias("environment"))
    proofs = lambda n: F.array(F.struct(F.struct(F.array(F.struct(n.cast("string").alias("logIndex"))).alias("transparency_entries")).alias("verification_material")))
    bundle = lambda repository, n: F.struct(publisher(repository).alias("publisher"), proofs(n).alias("attestations"))
    none = bundle(F.lit(None).cast("string"), k + 1)
    bundles = F.when(k % 5 == 0, F.array(none)).otherwise(F.array(none, bundle(F.col("p_brand"), k), bundle(F.lit("later"), k + 2)))
    answers = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("package"), F.col("p_size").cast("string").alias("version"), F.to_json(F.struct(bundles.alias("attestation_bundles"))).alias("body"))
    return registry.pypi_identities(answers).select("package", "version", "identity", "url")


@query("""with v as (select distinct user_id, 'v' || (100000 + event_id) as version from events),
n as (select *, row_number() over (partition by user_id order by version desc) as n from v)
select cast(user_id as varchar) as package, 'none' as to_version, user_id || ' has no version none; its last ones are ' || string_agg(version, ', ' order by version) as error from n where n <= 10 group by user_id""")
def unknown_versions(spark, sf_dir):
    """A user as a package whose events are its versions, and a pin of a version that it never had: the error names the last ten."""
    e = table(spark, sf_dir, "events")
    releases = e.select(F.col("user_id").cast("string").alias("package"), F.concat(F.lit("v"), (F.col("event_id") + 100000).cast("string")).alias("version"), F.col("ts").alias("published_at"))
    locked = releases.select("package").distinct().withColumn("version", F.lit("none"))
    return history.scan_entries(locked, releases).select("package", "to_version", "error")


@query("""select '{"package":"' || source || '","from_version":' || case when doc_id % 3 = 0 then 'null' else '"' || (doc_id - 1) || '"' end || ',"to_version":"' || doc_id || '","risk_score":' || case when doc_id % 3 = 0 then 'null' else cast(n_chars % 100 as varchar) end
 || ',"error":' || case when doc_id % 3 = 0 then '"no earlier \\"release\\""' else 'null' end || '}' as value from documents""")
def scan_lines(spark, sf_dir):
    """A document as a scan's entry, one JSON line each, with nulls kept."""
    k = F.col("doc_id")
    bad = k % 3 == 0
    entries = table(spark, sf_dir, "documents").select(F.col("source").alias("package"), F.when(~bad, (k - 1).cast("string")).alias("from_version"), k.cast("string").alias("to_version"), F.when(~bad, F.col("n_chars") % 100).alias("risk_score"), F.when(bad, 'no earlier "release"').alias("error"))
    return reports.as_json(entries)


@query("""with p as (select doc_id // 50 as pair, case doc_id % 3 when 0 then 1 when 1 then 0 else 2 end as kind, 'd' || doc_id || '.js' as path from documents)
select pair, coalesce(string_agg(path, ',' order by kind, path) filter (where kind < 2), '') as diffs, coalesce(string_agg(path, ',' order by path) filter (where kind = 2), '') as removed from p group by pair""")
def diff_order(spark, sf_dir):
    """Fifty documents as the files of a pair: by the remainder of doc_id a file is new, changed or gone; the order that reports have."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 3
    side = lambda name, text, there: docs.where(there).select(F.floor(F.col("doc_id") / 50).cast("string").alias("pair_id"), F.lit(name).alias("side"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), text.cast("binary").alias("content"))
    text = F.coalesce("text", F.lit(""))
    files = tree.with_facts(side("from", text, k != 0).unionAll(side("to", F.concat(F.lit("new\n"), text), k != 2)))
    got = tree.summaries(tree.file_diffs(files), texts=False)
    return got.select(F.col("pair_id").cast("long").alias("pair"), F.array_join("file_diffs.path", ",").alias("diffs"), F.array_join("files_removed", ",").alias("removed"))
