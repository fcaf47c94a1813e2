"""Dimensions, modifiers, severities, feeds, counts, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relsift.functions import evaluation, feeds, scoring
from relsift.operators import history, scorers, tree
from relsift.plans import release
from relsift.plans.catalog import query, table
from relsift.plans.catalog.files import _LINES, release_pairs
from relsift.schemas import DIMENSIONS, FEEDS
from relsift.sources import reports

_NAMES = [n for n, _, _ in DIMENSIONS]
_WEIGHTS = [w for _, _, w in DIMENSIONS]


@query("""with r as (select user_id, event_type, value, event_id, row_number() over (partition by user_id, event_type order by value desc, event_id) as n from events where value is not null)
select user_id, event_type, value, event_id from r where n = 1""")
def max_score_per_dim(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    return scorers.best_by_dimension(rows, ["user_id", "event_type"], "value", "event_id")


@query("select conv_id, arg_max(text, turn) as llm_summary from conversations group by conv_id")
def last_summary(spark, sf_dir):
    """Turns of a conversation as a scorer's responses to chunks; the engine takes the last one's summary."""
    rated = F.array(F.struct(F.lit("obfuscation").alias("name"), F.lit(1.0).alias("score"), F.lit(0.5).alias("confidence"), F.lit("").alias("reasoning")))
    raw = F.to_json(F.struct(rated.alias("dimensions"), F.col("text").alias("summary")), {"ignoreNullFields": "false"})
    responses = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("chunk_idx"), raw.alias("raw"), F.lit(None).cast("string").alias("error"))
    return scorers.rated_dimensions(responses).select(F.col("pair_id").alias("conv_id"), "llm_summary")


_DIM_ROWS = ", ".join(f"('{n}', {w})" for n, _, w in DIMENSIONS)


@query(f"""with d(name, weight) as (values {_DIM_ROWS}),
m as (select case event_type when 'view' then 'network_calls' when 'click' then 'obfuscation' when 'signup' then 'install_hooks' when 'error' then 'env_conditional' else 'unknown' end as name, max(value) / 40 as score from events group by 1)
select d.name, cast(d.weight as double) as weight, greatest(least(coalesce(m.score, 0.0), 10.0), 0.0) as score from d left join m on m.name = d.name""")
def dimension_left_join(spark, sf_dir):
    """Event types as rated dimensions, two of the six unrated and one unknown."""
    dims = spark.createDataFrame([(n, w) for n, _, w in DIMENSIONS], "name string, weight double")
    name = F.create_map(*map(F.lit, ("view", "network_calls", "click", "obfuscation", "signup", "install_hooks", "error", "env_conditional")))
    rated = table(spark, sf_dir, "events").groupBy(F.coalesce(F.try_element_at(name, F.col("event_type")), F.lit("unknown")).alias("name")).agg((F.max("value") / 40).alias("score"))
    score = scoring.clamp(F.coalesce("score", F.lit(0.0)), 0.0, 10.0)
    return dims.join(rated, "name", "left").select("name", "weight", score.alias("score"))


def _scores(key: str) -> str:
    """Six made-up scores of a key, 0 to 10 in tenths, as SQL of both engines."""
    return ", ".join(f"cast((({key} * {7 + 4 * i} + {13 * i}) % 101) as double) / 10 as s{i}" for i in range(6))


_CONFIDENCE = "cast((s.k % 11) as double) / 10"
_USERS = f"u as (select distinct c_custkey as k from customer), s as (select k, {_scores('k')} from u)"
_SUM = " + ".join(f"cast(s{i} as decimal(10,4)) * {w:.2f} * 10" for i, w in enumerate(_WEIGHTS))
_BASE = f"cast({_SUM} as decimal(20,8))"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).distinct()
    s = k.selectExpr("k", *[x.strip() for x in _scores("k").split(", ")])
    dims = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(label).alias("label"), F.col(f"s{i}").alias("score"), F.lit(w).alias("weight"), F.lit("").alias("reasoning"), ((F.col("k") % 11).cast("double") / 10).alias("confidence")) for i, (n, label, w) in enumerate(DIMENSIONS)])
    return s.select("k", dims.alias("dimensions"))


@query(f"with {_USERS} select k, cast(round({_BASE}, 1) as double) as llm_base_score from s")
def weighted_base(spark, sf_dir):
    return _customers(spark, sf_dir).select("k", F.round(scoring.base_score(F.col("dimensions")), 1).cast("double").alias("llm_base_score"))


_TOP = "greatest(" + ", ".join(f"s{i}" for i in range(6)) + ")"
_LEAD = "case " + " ".join(f"when s{i} = {_TOP} then '{n}'" for i, n in enumerate(_NAMES)) + " end"
_FLOORED = f"{_TOP} >= 9 and {_CONFIDENCE} >= 0.9 and {_BASE} < 30"


@query(f"with {_USERS} select k, cast(round(case when {_FLOORED} then 30 else {_BASE} end, 1) as double) as score, case when {_FLOORED} then {_LEAD} end as lead from s")
def dimension_floor(spark, sf_dir):
    out = _customers(spark, sf_dir).withColumn("f", scoring.dimension_floor(scoring.base_score(F.col("dimensions")), F.col("dimensions")))
    note = F.get(F.col("f.mods"), F.lit(0))["note"]
    return out.select("k", F.round("f.score", 1).cast("double").alias("score"), F.substring_index(note, " ", 1).alias("lead"))


def _feeds(k) :
    """Feed rows of a key: malicious for each 7th, identity changed for each 5th, new dependencies for each 3rd, scorecard by remainder of 11."""
    row = feeds.feed_row
    say = F.lit("d")
    return F.array(
        row("osv", F.when(k % 7 == 0, "malicious").otherwise("clean"), say),
        row("rekor", F.when(k % 5 == 0, "suspicious").otherwise("clean"), say, signing_identity_changed=F.when(k % 4 != 0, k % 5 == 0)),
        row("scorecard", F.lit("clean"), say, scorecard_score=F.when(k % 13 != 0, (k % 11).cast("double"))),
        row("new_deps", F.when(k % 3 == 0, "suspicious").otherwise("clean"), say),
    )


_FOLD = f"""{_USERS}, b as (select *, {_BASE} as base, case when {_FLOORED} then 30 else {_BASE} end as f0 from s),
m as (select *, case when k % 7 = 0 and f0 < 55 then 55 else f0 end as f1 from b),
r as (select *, f1 + case when k % 5 = 0 and k % 4 <> 0 then 10 else 0 end as f2 from m),
c as (select *, f2 + case when k % 13 <> 0 and k % 11 < 4 then 5 when k % 13 <> 0 and k % 11 > 7 then -5 else 0 end as f3 from r),
z as (select *, f3 + case when k % 3 = 0 then 5 else 0 end as f4, round(greatest(least(f3 + case when k % 3 = 0 then 5 else 0 end, 100), 0), 1) as risk from c)"""
_SEVERITY = "case when risk >= 80 then 'CRITICAL' when risk >= 55 then 'HIGH' when risk >= 30 then 'MEDIUM' else 'LOW' end"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(_customers(spark, sf_dir).withColumn("feed_results", _feeds(F.col("k"))))


@query(f"""with {_FOLD} select k, cast(risk as double) as risk_score, {_SEVERITY} as severity, concat_ws(',',
 case when f0 <> base then 'definitive_dimension_floor' end, case when f1 <> f0 then 'malicious_floor' end, case when f2 <> f1 then 'rekor_identity_changed' end,
 case when f3 > f2 then 'scorecard_poor' when f3 < f2 then 'scorecard_good' end, case when f4 <> f3 then 'new_dependency_low_scrutiny' end) as rules from z""")
def feed_fold(spark, sf_dir):
    return _scored(spark, sf_dir).select("k", "risk_score", "severity", F.array_join(F.transform("score_modifiers", lambda m: m["rule"]), ",").alias("rules"))


@query("select doc_id, n_chars % 1001 / 10.0::double as score, case when n_chars % 1001 >= 800 then 'CRITICAL' when n_chars % 1001 >= 550 then 'HIGH' when n_chars % 1001 >= 300 then 'MEDIUM' else 'LOW' end as severity from documents")
def severity_bucket(spark, sf_dir):
    """A score for each document, from 0 to 100 by tenths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 1001 / F.lit(10.0)).alias("score"))
    return docs.select("doc_id", "score", scoring.severity(F.col("score")).alias("severity"))


@query(f"with {_FOLD} select k, cast(risk + case when k % 4 = 0 then 1 else 0 end as double) as risk_score, k % 4 <> 0 as decomposes from z")
def score_decomposition(spark, sf_dir):
    """Whether base and modifiers, as reports list them, give the score; every fourth report's is a point off, which is told."""
    off = _scored(spark, sf_dir).withColumn("risk_score", F.round(F.col("risk_score") + F.when(F.col("k") % 4 == 0, 1).otherwise(0), 1))
    return off.select("k", "risk_score", scoring.decomposes(off).alias("decomposes"))


_EVEN = " + ".join(f"cast(s{i} as decimal(10,4)) * {w} * 10" for i, w in enumerate((0.5, 0.5, 0, 0, 0, 0)))


@query(f"with {_USERS} select k, cast(round(cast({_EVEN} as decimal(20,8)), 1) as double) as llm_base_score from s")
def reweight(spark, sf_dir):
    new = dict(zip(_NAMES, (0.5, 0.5, 0.0, 0.0, 0.0, 0.0)))
    df = _customers(spark, sf_dir).withColumn("feed_results", _feeds(F.col("k")))
    return scoring.reweighted(df, new).select("k", "llm_base_score")


@query("""with g as (select source, list_sort(list('d' || doc_id) filter (where n_chars > 8000)) as big, count(*) as n from documents group by source),
t as (select source, n, big, case when len(big) > 5 then array_to_string(big[1:5], ', ') || ' and ' || (len(big) - 5) || ' more' else array_to_string(big, ', ') end as shown from g)
select source, concat_ws('|', case when len(big) > 0 then len(big) || ' file(s) are over the size limit of a diff, so no scorer read them: ' || shown || '. The score says nothing of them.' end,
 case when n > 1 then n || ' chunks were rated apart: a dimension has the highest of its ratings, and the summary is the last chunk''s.' end) as caveats from t""")
def caveats(spark, sf_dir):
    """Large documents of a source as skipped files, its documents as chunks."""
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.sort_array(F.collect_list(F.when(F.col("n_chars") > 8000, F.concat(F.lit("d"), F.col("doc_id").cast("string"))))).alias("skipped_files"), F.count("*").alias("n"))
    none = F.array().cast("array<string>")
    s = F.struct("skipped_files", none.alias("truncated_files"), none.alias("split_files"), none.alias("files_not_analyzed"), F.lit(False).alias("large_files_split"), F.col("n").alias("chunks_sent_to_llm"), F.lit(False).alias("comments_stripped"), F.lit(0).alias("comment_lines_stripped"))
    return g.where("n > 1").select("source", F.array_join(scoring.caveats(s), "|").alias("caveats"))


@query("""with g as (select user_id, list_sort(list((case when event_type = 'error' then 'MAL-' else 'GHSA-' end) || event_id) filter (where event_type in ('error', 'signup') and value > 150)) as ids from events group by user_id)
select user_id, coalesce(len(ids), 0)::bigint as n, case when coalesce(len(ids), 0) = 0 then 'clean' when len(list_filter(ids, lambda x: starts_with(x, 'MAL-'))) > 0 then 'malicious' else 'suspicious' end as status,
 coalesce(array_to_string(ids[1:5], ', '), '') || case when len(ids) > 5 then ' (and ' || (len(ids) - 5) || ' more)' else '' end as preview from g""")
def advisory_status(spark, sf_dir):
    """Events of high value as advisories of a user; errors are confirmed malware."""
    e = table(spark, sf_dir, "events")
    one = F.when(F.col("event_type").isin("error", "signup") & (F.col("value") > 150), F.concat(F.when(F.col("event_type") == "error", "MAL-").otherwise("GHSA-"), F.col("event_id").cast("string")))
    g = e.groupBy("user_id").agg(F.sort_array(F.collect_list(one)).alias("ids"))
    return g.select("user_id", F.size("ids").cast("long").alias("n"), feeds.advisory_status(F.col("ids")).alias("status"), feeds.advisory_preview(F.col("ids")).alias("preview"))


@query("""with l as (select event_id, nullif(event_type, 'view') as new, nullif(lag(event_type) over (partition by user_id order by ts, event_id), 'view') as old from events)
select event_id, case when new is null then 'no_data' when old is null or old = new then 'clean' else 'suspicious' end as status, case when new is not null and old is not null then old <> new end as changed from l""")
def identity_changed(spark, sf_dir):
    """An event's type as signing identity, its predecessor's as the former one; a view has none."""
    e = history.predecessors(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    old, new = F.nullif("previous_version", F.lit("view")), F.nullif("event_type", F.lit("view"))
    return e.select("event_id", feeds.identity_status(old, new).alias("status"), (old != new).alias("changed"))


@query("""select n_nationkey, s_suppkey, case when s_acctbal is null then 'no_data' when s_acctbal / 1000 < 4 then 'suspicious' else 'clean' end as status
from nation left join (select * from supplier where s_acctbal > 0) on s_nationkey = n_nationkey""")
def repo_score_status(spark, sf_dir):
    """Suppliers' balances as scorecards of their nations; a nation without one has no data."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").select("n_nationkey", "s_suppkey", feeds.scorecard_status(F.col("s_acctbal") / 1000).alias("status"))


@query("""select l_partkey, count(distinct l_orderkey)::bigint as versions, count(distinct l_suppkey)::bigint as maintainers from lineitem group by l_partkey
having count(distinct l_orderkey) <= 25 and count(distinct l_suppkey) <= 20""")
def low_scrutiny(spark, sf_dir):
    """Orders of a part as versions and its suppliers as maintainers, with thresholds that fit them."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey").alias("versions"), F.count_distinct("l_suppkey").alias("maintainers"))
    return g.where(feeds.low_scrutiny(F.col("versions"), F.col("maintainers"), 25, 20))


_FEED_LIST = ", ".join(f"('{f}', {i})" for i, f in enumerate(FEEDS))


@query(f"""with f(source, pos) as (values {_FEED_LIST}),
given as (select c_custkey as k, 'osv' as source, case when c_custkey % 7 = 0 then 'malicious' else 'clean' end as status from customer where c_custkey % 2 = 0
  union all select c_custkey, 'new_deps', 'clean' from customer where c_custkey % 3 = 0)
select k.c_custkey as k, f.source, f.pos::integer as pos, coalesce(g.status, 'no_data') as status from customer k cross join f left join given g on g.k = k.c_custkey and g.source = f.source""")
def feeds_union(spark, sf_dir):
    """Two feeds with rows for some customers; the four come in their order, no_data where none is."""
    pairs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("pair_id"), F.col("c_custkey").alias("k"))
    osv = pairs.where("k % 2 = 0").select("pair_id", feeds.feed_row("osv", F.when(F.col("k") % 7 == 0, "malicious").otherwise("clean"), F.lit("")).alias("feed"))
    deps = pairs.where("k % 3 = 0").select("pair_id", feeds.feed_row("new_deps", F.lit("clean"), F.lit("")).alias("feed"))
    return feeds.all_feeds(pairs, osv, deps).select(F.col("pair_id").cast("long").alias("k"), F.posexplode("feed_results").alias("pos", "f")).select("k", "f.source", "pos", "f.status")


@query(f"""with {_FOLD}, e as (select k, case when k % 10 = 0 then 'failed' end as error, {_SEVERITY} as severity from z)
select count(*)::bigint as total, count(*) filter (where error is null)::bigint as scored, count(*) filter (where error is null and severity <> 'LOW')::bigint as flagged, count(*) filter (where error is not null)::bigint as errored from e""")
def scan_summary(spark, sf_dir):
    error = F.when(F.col("k") % 10 == 0, "failed")
    e = _scored(spark, sf_dir).select(error.alias("error"), F.when(error.isNull(), F.col("severity")).alias("severity"))
    return reports.scan_counts(e)


@query(f"with {_FOLD} select k, cast(risk as double) as risk_score from z where risk > 60")
def threshold_exceeded(spark, sf_dir):
    return reports.exceeding(_scored(spark, sf_dir), 60.0).select("k", "risk_score")


@query("""with j as (select n_chars > 2000 as flagged, quality = 0 as bad from documents join labels using (doc_id))
select count(*) filter (where flagged and bad)::bigint as tp, count(*) filter (where flagged and not bad)::bigint as fp, count(*) filter (where not flagged and bad)::bigint as fn, count(*) filter (where not flagged and not bad)::bigint as tn from j""")
def confusion_matrix(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).alias("flagged")).join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("bad")), "doc_id")
    return evaluation.confusion(j, F.col("flagged"), F.col("bad"))


@query("""select user_id, (floor(epoch(min(ts) filter (where event_type = 'error'))) - floor(epoch(min(ts) filter (where event_type = 'signup'))))::bigint as gap_seconds from events group by user_id
having min(ts) filter (where event_type = 'error') is not null and min(ts) filter (where event_type = 'signup') is not null""")
def detection_gap(spark, sf_dir):
    kind = F.col("event_type")
    return evaluation.detection_gap(table(spark, sf_dir, "events"), "user_id", "ts", kind == "signup", kind == "error")


#: How a release's size becomes dimension scores here is a harness of ours, and no rule of the engine.
_HARNESS = ("least(total_diff_lines / 10.0, 10.0)", "least(total_diff_lines / 20.0, 10.0)", "0.0", "0.0", "least(total_diff_lines / 40.0, 10.0)", "least(total_diff_lines / 5.0, 10.0)")
_HARNESS_SQL = " + ".join(f"cast(cast({x} as double) as decimal(20,8)) * {w:.2f} * 10" for x, w in zip(_HARNESS, _WEIGHTS))


@query(f"""with {_LINES},
t as (select p.source, p.from_id, p.doc_id, d.lines_added + d.lines_removed as total_diff_lines from p join d using (doc_id) where sha256(p.from_text) <> sha256(p.to_text)),
r as (select *, round(cast({_HARNESS_SQL} as decimal(20,8)), 1) as risk from t)
select source as package, from_id as from_version, doc_id as to_version, total_diff_lines, cast(risk as double) as risk_score, {_SEVERITY} as severity from r""")
def release_risk(spark, sf_dir):
    """Flagship: sources as packages, consecutive documents as releases; changed pairs are diffed by lines and scored."""
    pairs = release_pairs(spark, sf_dir)
    changed = pairs.where(F.sha2("from_text", 256) != F.sha2("to_text", 256))
    lines = tree.multiset_line_changes(changed.withColumnRenamed("doc_id", "key")).withColumn("total_diff_lines", F.col("lines_added") + F.col("lines_removed"))
    j = changed.select("source", "previous_version", "doc_id").join(lines, changed.doc_id == lines.key)
    dims = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(label).alias("label"), F.expr(x).cast("double").alias("score"), F.lit(w).alias("weight"), F.lit("").alias("reasoning"), F.lit(0.5).alias("confidence")) for x, (n, label, w) in zip(_HARNESS, DIMENSIONS)])
    out = scoring.scored(j.withColumn("dimensions", dims).withColumn("feed_results", F.array().cast("array<struct<source:string,status:string,details:string,signing_identity_changed:boolean,scorecard_score:double>>")))
    return out.select(F.col("source").alias("package"), F.col("previous_version").alias("from_version"), F.col("doc_id").alias("to_version"), "total_diff_lines", "risk_score", "severity")


@query("""with d as (select source, doc_id, (doc_id // 20) % 2 = 1 as second, doc_id % 7 = 0 as twice, sha256(text) as h from documents),
f as (select source, doc_id as k, h from d where not twice and not second), t as (select source, doc_id - 20 as k, h from d where not twice and second),
c as (select source, f.h is null as added, t.h is null as removed, f.h <> t.h as modified from f full join t using (source, k)
  union all select source, false, false, false from d where twice)
select source as package, count(*) filter (where added)::bigint as n_added, count(*) filter (where removed)::bigint as n_removed, count(*) filter (where modified)::bigint as n_modified,
  3.5::double as risk_score, 'LOW' as severity, true as decomposes from c group by source""")
def release_reports(spark, sf_dir):
    """The whole plan, archives aside: a source is a package, the stub scorer rates."""
    docs = table(spark, sf_dir, "documents")
    pairs = docs.select(F.col("source").alias("pair_id")).distinct().select("pair_id", F.lit("npm").alias("ecosystem"), F.col("pair_id").alias("package"), F.lit("1").alias("from_version"), F.lit("2").alias("to_version"))
    out = release.reports(pairs, tree.with_facts(release_files(docs)), texts=False)
    n = lambda c: F.size(f"diff_summary.files_{c}").cast("long").alias(f"n_{c}")
    return out.select("package", n("added"), n("removed"), n("modified"), "risk_score", "severity", scoring.decomposes(out).alias("decomposes"))


def release_files(docs: DataFrame) -> DataFrame:
    """(pair_id, side, path, content) of all documents, paths unique on each side of a source.

    Documents 20 apart are a file's two sides, under the first one's doc_id. A multiple of 7 is a file of its own on
    both sides, with other line ends on the second: its texts are compared and found equal, and what it would have been
    paired with is added or removed.
    """
    k = F.col("doc_id")
    second = F.floor(k / 20) % 2 == 1
    path = lambda kind, key: F.concat(F.lit(f"lib/{kind}"), key.cast("string"), F.lit(".js"))
    one = F.array(F.struct(F.when(second, "to").otherwise("from").alias("side"), path("f", F.when(second, k - 20).otherwise(k)).alias("path"), F.col("text").cast("binary").alias("content")))
    other_ends = F.regexp_replace(tree.decoded(F.col("text")), "\n", "\r\n").cast("binary")
    both = F.array(*[F.struct(F.lit(side).alias("side"), path("s", k).alias("path"), content.alias("content")) for side, content in (("from", F.col("text").cast("binary")), ("to", other_ends))])
    return docs.select(F.col("source").alias("pair_id"), F.inline(F.when(k % 7 == 0, both).otherwise(one)))
