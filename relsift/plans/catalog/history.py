"""Versions, lockfiles, registries, dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from relsift.operators import history, metadata
from relsift.plans.catalog import query, table
from relsift.sources import lockfiles


@query("select source, doc_id, lag(doc_id) over (partition by source order by doc_id) as previous_version from documents")
def predecessor_version(spark, sf_dir):
    return history.predecessors(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"], "doc_id")


@query("""with l as (select source, doc_id, lag(doc_id) over (partition by source order by doc_id) as p from documents)
select source as package, cast(p as varchar) as from_version, cast(doc_id as varchar) as to_version,
  case when p is null then 'no earlier published version of ' || source || '@' || doc_id end as error from l""")
def scan_entries(spark, sf_dir):
    releases = table(spark, sf_dir, "documents").select(F.col("source").alias("package"), F.col("doc_id").cast("string").alias("version"), F.col("doc_id").alias("published_at"))
    return history.scan_entries(releases.select("package", "version"), releases)


@query("select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as previous_version from events")
def predecessor_by_time(spark, sf_dir):
    return history.predecessors(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "previous_version")


@query("select user_id, event_type, min(ts) as published_at from events where ts is not null group by user_id, event_type")
def first_upload_per_release(spark, sf_dir):
    return history.published(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")


@query("""with e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by case event_type when 'purchase' then 0 when 'signup' then 1 else 2 end, event_id) as n from events)
select user_id, event_id, event_type from e where n = 1""")
def artifact_choice(spark, sf_dir):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    return history.best(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], [rank, F.col("event_id")])


@query("select distinct p_brand, p_size from part order by p_brand, p_size limit 25")
def sorted_limit(spark, sf_dir):
    return history.sorted_limit(table(spark, sf_dir, "part").select("p_brand", "p_size"), ["p_brand", "p_size"], 25)


@query("""with r as (select o_custkey, o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as prev from orders),
s as (select l_orderkey, list(distinct l_partkey) as parts from lineitem group by l_orderkey),
j as (select r.o_orderkey, coalesce(n.parts, []) as new, coalesce(p.parts, []) as old from r left join s n on n.l_orderkey = r.o_orderkey left join s p on p.l_orderkey = r.prev where r.prev is not null)
select o_orderkey, array_to_string(list_sort(list_filter(new, lambda x: not list_contains(old, x))), ',') as new_dependencies,
  array_to_string(list_sort(list_filter(old, lambda x: not list_contains(new, x))), ',') as removed_dependencies from j""")
def dependency_sets(spark, sf_dir):
    """Orders of a customer are releases, their parts dependencies."""
    orders = history.predecessors(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").where("previous_version is not null")
    parts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    none = F.array().cast("array<bigint>")
    j = orders.join(parts.select(F.col("l_orderkey").alias("o_orderkey"), F.col("parts").alias("new")), "o_orderkey", "left").join(parts.select(F.col("l_orderkey").alias("previous_version"), F.col("parts").alias("old")), "previous_version", "left")
    added, removed = metadata.added_and_removed(F.coalesce("old", none), F.coalesce("new", none))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return j.select("o_orderkey", text(added).alias("new_dependencies"), text(removed).alias("removed_dependencies"))


@query("""with e as (select conv_id, min(turn) as a, max(turn) as z from conversations group by conv_id),
f as (select distinct conv_id, role from conversations join e using (conv_id) where turn = a),
l as (select distinct conv_id, role from conversations join e using (conv_id) where turn = z)
select conv_id, case role when 'system' then 'preinstall' when 'user' then 'install' when 'assistant' then 'postinstall' end as hook from l anti join f using (conv_id, role) where role in ('system', 'user', 'assistant')""")
def new_hooks(spark, sf_dir):
    """Roles of a conversation's last turn that its first doesn't have, as hooks of two manifests."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    ends = c.groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("z"))
    hook = F.create_map(*map(F.lit, ("system", "preinstall", "user", "install", "assistant", "postinstall")))
    roles = lambda at: F.collect_set(F.when(F.col("turn") == F.col(at), F.try_element_at(hook, F.col("role"))))
    both = c.join(ends, "conv_id").groupBy("conv_id").agg(roles("a").alias("old"), roles("z").alias("new"))
    return both.select("conv_id", F.explode(metadata.new_hooks(F.col("old"), F.col("new"))).alias("hook"))


_PIN_LINES = "case p_partkey % 5 when 0 then replace(p_name, ' ', '-') || '==' || p_size || '.0' when 1 then replace(p_name, ' ', '_') || '[extra] == 1.' || p_size || '  # note' when 2 then replace(p_name, ' ', '.') || '>=' || p_size when 3 then '-r ' || p_name || '==1' else replace(p_name, ' ', '') || '==' || p_size || '.*' end"


@query(rf"""with l as (select p_partkey, trim(split_part({_PIN_LINES}, '#', 1)) as line from part),
m as (select p_partkey, line, regexp_extract(line, '^([A-Za-z0-9][A-Za-z0-9._-]*?)(?:\[[^\]]*\])?\s*==\s*([A-Za-z0-9.!+_-]+)', 1) as name,
  regexp_extract(line, '^([A-Za-z0-9][A-Za-z0-9._-]*?)(?:\[[^\]]*\])?\s*==\s*([A-Za-z0-9.!+_-]+)', 2) as version from l)
select p_partkey, name, version from m where not starts_with(line, '-') and version <> '' and not ends_with(version, '.')""")
def lock_pins(spark, sf_dir):
    name, version = lockfiles.pinned(F.expr(_PIN_LINES))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), version.alias("version")).where("name is not null")


_SPECS = "case p_partkey % 6 when 0 then '@' || lower(p_type) || '/' || replace(p_name, ' ', '-') || '@^' || p_size when 1 then replace(p_name, ' ', '-') || '@~' || p_size || '.1' when 2 then 'alias@npm:' || replace(p_name, ' ', '-') || '@' || p_size when 3 then replace(p_name, ' ', '-') || '@workspace:*' when 4 then 'x@git+ssh://host/' || p_size else replace(p_name, ' ', '-') end"


@query(rf"""with s as (select p_partkey, {_SPECS} as spec from part),
m as (select p_partkey, regexp_extract(spec, '^(.[^@]*)@(.*)$', 1) as name, regexp_extract(spec, '^(.[^@]*)@(.*)$', 2) as rest from s)
select p_partkey, case when name = '' then null when starts_with(rest, 'npm:') then coalesce(nullif(regexp_extract(rest, '^npm:(.[^@]*)@', 1), ''), name)
  when regexp_matches(rest, '^(workspace:|file:|link:|portal:|patch:|exec:|git|github:|gitlab:|bitbucket:|http://|https://)') then null else name end as name from m""")
def specifier_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", lockfiles.specifier_name(F.expr(_SPECS)).alias("name"))


_KEYS = "case p_partkey % 4 when 0 then 'node_modules/' || replace(p_name, ' ', '-') when 1 then 'node_modules/a/node_modules/@' || lower(p_type) || '/' || replace(p_name, ' ', '-') when 2 then 'packages/' || replace(p_name, ' ', '-') else 'node_modules/' end"


@query(f"with k as (select p_partkey, {_KEYS} as k from part) select p_partkey, case when contains(k, 'node_modules/') then nullif(string_split(k, 'node_modules/')[-1], '') end as name from k")
def lock_key_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", lockfiles.lock_key_name(F.expr(_KEYS)).alias("name"))


@query("""select 'c' || c_custkey || '/package-lock.json' as file_name, 'npm' as ecosystem, unnest(['r' || n_regionkey, 'n' || n_nationkey, 'c' || c_custkey]) as name,
  unnest(['1.0', '2.0', c_custkey || '.0']) as version from customer join nation on c_nationkey = n_nationkey""")
def recursive_flatten(spark, sf_dir):
    """A lockfile of nested dependencies for each customer, in its nation, in its region, read by the engine's parser."""
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.format_string('{"dependencies": {"r%d": {"version": "1.0", "dependencies": {"n%d": {"version": "2.0", "dependencies": {"c%d": {"version": "%d.0"}}}}}}}', "n_regionkey", "n_nationkey", "c_custkey", "c_custkey")
    return lockfiles.npm_lock_pins(both.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("/package-lock.json")).alias("file_name"), text.alias("text")))
