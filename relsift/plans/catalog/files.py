"""File trees, diffs, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relsift.operators import chunk, history, strip, tree
from relsift.plans.catalog import query, table
from relsift.settings import Settings

#: part as two trees: a file is p_partkey, its text p_name, which changes in the second where the key is a multiple of 3.
#: Every part is on one side at least: multiples of 7 are new, those of 5 that aren't are gone.
_TREES = """
a as (select p_partkey, p_name from part where p_partkey % 7 <> 0),
b as (select p_partkey, case when p_partkey % 3 = 0 then p_name || '*' else p_name end as p_name from part where p_partkey % 5 <> 0 or p_partkey % 7 = 0)"""


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    new = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("*"))).otherwise(F.col("p_name"))
    return part.where("p_partkey % 7 <> 0"), part.where("p_partkey % 5 <> 0 or p_partkey % 7 = 0").select("p_partkey", new.alias("p_name"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _trees(spark, sf_dir)
    return tree.compared(a, b, ["p_partkey"], F.col("l.p_name") == F.col("r.p_name"), ["p_name"])


_STATUS = "case when a.p_partkey is null then 'added' when b.p_partkey is null then 'removed' when a.p_name = b.p_name then 'unchanged' else 'modified' end"


@query(f"with {_TREES} select coalesce(a.p_partkey, b.p_partkey) as p_partkey, a.p_name as from_p_name, b.p_name as to_p_name, {_STATUS} as status from a full join b on a.p_partkey = b.p_partkey")
def tree_compare(spark, sf_dir):
    return _compared(spark, sf_dir)


@query(f"with {_TREES} select p_partkey, p_name from b anti join a using (p_partkey)")
def tree_compare_added(spark, sf_dir):
    return _compared(spark, sf_dir).where(F.col("status") == tree.ADDED).select("p_partkey", F.col("to_p_name").alias("p_name"))


@query(f"with {_TREES} select p_partkey, p_name from a anti join b using (p_partkey)")
def tree_compare_removed(spark, sf_dir):
    return _compared(spark, sf_dir).where(F.col("status") == tree.REMOVED).select("p_partkey", F.col("from_p_name").alias("p_name"))


def _two_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files of two releases, a pair a document; every third one's text changes in the second."""
    docs = table(spark, sf_dir, "documents")
    new = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    side = lambda name, text: docs.select(F.col("doc_id").cast("string").alias("pair_id"), F.lit(name).alias("side"), F.lit("f.js").alias("path"), text.cast("binary").alias("content"))
    return tree.with_facts(side("from", F.col("text")).unionAll(side("to", new)))


@query("""select cast(doc_id as varchar) as pair_id, octet_length(encode(text))::bigint + 1 as to_size, 'modified' as change_type from documents where doc_id % 3 = 0""")
def unchanged_skip(spark, sf_dir):
    """Files of equal bytes are skipped by the engine's own comparison."""
    return tree.tree_changes(_two_releases(spark, sf_dir)).select("pair_id", "to_size", "change_type")


@query("""select cast(doc_id as varchar) as pair_id, octet_length(encode(text)) + 1 > 8000 as oversized,
  case when octet_length(encode(text)) + 1 > 8000 then '[diff skipped: file size ' || (octet_length(encode(text)) + 1) || ' bytes exceeds max_diff_file_bytes=8000]' end as note from documents where doc_id % 3 = 0""")
def oversize_changes(spark, sf_dir):
    """Changed files over the limit are told by their digests, and get a placeholder."""
    small = Settings(max_diff_file_bytes=8000)
    found = tree.file_diffs(_two_releases(spark, sf_dir), small)
    return found.select("pair_id", "oversized", F.when(F.col("oversized"), F.col("unified_diff")).alias("note"))


@query("select doc_id, n_chars, '[diff skipped: file size ' || n_chars || ' bytes exceeds max_diff_file_bytes=8000]' as note from documents where n_chars > 8000")
def oversize_skip(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("n_chars > 8000").select("doc_id", "n_chars", tree.oversize_note(F.col("n_chars"), Settings(max_diff_file_bytes=8000)).alias("note"))


def release_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as releases: a source is a package, doc_ids are its versions in order. Texts join after the pairs are known."""
    docs = table(spark, sf_dir, "documents")
    ids = history.predecessors(docs.select("source", "doc_id"), ["source"], ["doc_id"], "doc_id").where("previous_version is not null")
    new = ids.join(docs.select("doc_id", F.col("text").alias("to_text")), "doc_id")
    return new.join(docs.select(F.col("doc_id").alias("previous_version"), F.col("text").alias("from_text")), "previous_version")


_PAIRS = "p as (select source, doc_id, text as to_text, lag(doc_id) over w as from_id, lag(text) over w as from_text from documents window w as (partition by source order by doc_id))"
_LINES = f"""{_PAIRS},
o as (select doc_id, unnest(string_split(from_text, chr(10))) as line, -1 as n from p where from_id is not null),
n as (select doc_id, unnest(string_split(to_text, chr(10))) as line, 1 as n from p where from_id is not null),
net as (select doc_id, line, sum(n) as n from (select * from o union all select * from n) group by doc_id, line),
d as (select doc_id, sum(greatest(n, 0))::bigint as lines_added, sum(greatest(-n, 0))::bigint as lines_removed from net group by doc_id)"""


@query(f"with {_LINES} select * from d")
def line_diff_counts(spark, sf_dir):
    pairs = release_pairs(spark, sf_dir).withColumnRenamed("doc_id", "key")
    return tree.multiset_line_changes(pairs).withColumnRenamed("key", "doc_id")


@query("select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: '+' || x), chr(10)) as body, len(string_split(text, chr(10)))::bigint as lines_added from documents where text <> ''")
def added_file_body(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text <> ''")
    return docs.select("doc_id", tree.added_body(F.col("text")).alias("body"), F.size(tree.lines_of(F.col("text"))).cast("long").alias("lines_added"))


@query(f"with {_PAIRS} select cast(doc_id as varchar) || '.js' as path, from_text <> to_text as changed, sha256(to_text) as new_sha256 from p where from_id is not null")
def unified_diff(spark, sf_dir):
    """The engine's diffs, checked by what they must give back: the new text, from the old one and the diff alone."""
    pairs = release_pairs(spark, sf_dir).select(F.col("source").alias("pair_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), "from_text", "to_text")
    return tree.rebuilt(tree.unified_diffs(pairs, "from_text")).select("path", "changed", F.sha2("text", 256).alias("new_sha256"))


#: Lines of documents as source files: every fourth is made a comment of its file's kind, kinds go by doc_id.
_EXT = "case doc_id % 4 when 0 then '.js' when 1 then '.py' when 2 then '.bat' else '.md' end"


@query(f"""with l as (select doc_id, {_EXT} as ext, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
c as (select doc_id, ext, case when pos % 4 = 1 then (case ext when '.js' then '  // ' when '.py' then '# ' when '.bat' then 'Rem ' else '# ' end) || line else line end as line from l),
f as (select doc_id, case ext when '.js' then starts_with(trim(line), '//') when '.py' then starts_with(trim(line), '#') and not starts_with(trim(line), '#!')
  when '.bat' then regexp_matches(lower(trim(line)), '^(rem[ \\t]|::)') else false end as gone from c)
select doc_id, count(*) filter (where gone)::bigint as removed, count(*) filter (where not gone)::bigint as kept from f group by doc_id""")
def comment_strip(spark, sf_dir):
    """Documents as diffs of new files."""
    lines = F.split("text", "\n")
    mark = F.expr("case ext when '.js' then '  // ' when '.py' then '# ' when '.bat' then 'Rem ' else '# ' end")
    made = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("+"), F.when(i % 4 == 1, F.concat(F.col("mark"), x)).otherwise(x))), "\n")
    docs = table(spark, sf_dir, "documents").withColumn("ext", F.expr(_EXT)).withColumn("mark", mark)
    diffs = docs.select("doc_id", F.size(lines).alias("n"), F.concat(F.lit("f"), F.col("ext")).alias("path"), made.alias("unified_diff"))
    gone = F.col("comment_lines_stripped")
    return strip.stripped(diffs).select("doc_id", gone.alias("removed"), (F.col("n") - gone).cast("long").alias("kept"))


_BLOCK = _EXT.replace("'.bat'", "'.ps1'")


@query(f"""with d as (select doc_id, {_BLOCK} as ext, string_split(regexp_replace(text, '[^A-Za-z\n]', '', 'g'), chr(10)) as l from documents),
t as (select doc_id, ext, l, '+=' || array_to_string(l, chr(10) || '+=') || chr(10) || '+/* open' || chr(10) || '+x' as tail from d)
select doc_id, ext <> '.md' as known, case when ext = '.md' then 0 else len(l) + 2 end::bigint as gone,
  sha256(case when ext = '.md' then '+/* head' || chr(10) || '+ ' || array_to_string(l, chr(10) || '+ ') || chr(10) || '+ end */' || chr(10) else '' end || tail) as left_sha256 from t""")
def comment_block_strip(spark, sf_dir):
    """A document's letters as a diff, once in a block comment in its kind's signs and once as code, and then a block that never closes."""
    docs = table(spark, sf_dir, "documents").withColumn("ext", F.expr(_BLOCK)).withColumn("l", F.split(F.regexp_replace("text", "[^A-Za-z\n]", ""), "\n"))
    opens = F.when(F.col("ext") == ".py", "'''").when(F.col("ext") == ".ps1", "<#").otherwise("/*")
    shuts = F.when(F.col("ext") == ".py", "'''").when(F.col("ext") == ".ps1", "#>").otherwise("*/")
    body = F.concat(F.lit("+"), opens, F.lit(" head\n+ "), F.array_join("l", "\n+ "), F.lit("\n+ end "), shuts, F.lit("\n+="), F.array_join("l", "\n+="), F.lit("\n+/* open\n+x"))
    diffs = docs.select("doc_id", F.concat(F.lit("f"), F.col("ext")).alias("path"), body.alias("unified_diff"))
    return strip.stripped(diffs).select("doc_id", (F.col("path") != "f.md").alias("known"), F.col("comment_lines_stripped").alias("gone"), F.sha2("unified_diff", 256).alias("left_sha256"))


#: The fold as a recursion over each source's documents in order: which chunk, and how full it is.
_PACKED = """
d as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) as i from documents),
f as (select source, doc_id, n_chars, i, 0 as chunk, n_chars as used from d where i = 1
  union all
  select d.source, d.doc_id, d.n_chars, d.i,
    case when f.used + d.n_chars > 4000 and f.used > 0 then f.chunk + 1 else f.chunk end,
    case when f.used + d.n_chars > 4000 and f.used > 0 then d.n_chars else f.used + d.n_chars end
  from f join d on d.source = f.source and d.i = f.i + 1)"""


@query(f"with recursive {_PACKED} select source, doc_id, n_chars, chunk::integer as chunk from f")
def chunk_pack(spark, sf_dir):
    return chunk.packed_rows(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 4000)


@query(f"with recursive {_PACKED} select source, doc_id, n_chars, (case when chunk >= 3 then -1 else chunk end)::integer as chunk from f")
def chunk_cap(spark, sf_dir):
    return chunk.packed_rows(table(spark, sf_dir, "documents"), "source", "doc_id", "n_chars", 4000, most=3)


@query("""select doc_id, case when length(text) > 2000 then substr(text, 1, 1800) || chr(10) || '[cut: 1800 of ' || length(text)
 || ' characters fit into 500 tokens, ' || (length(text) - 1800) || ' are left out]' || chr(10) else text end as block from documents""")
def head_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunk.truncated(F.col("text"), budget=2000).alias("block"))


@query("""with n as (select doc_id, text, greatest(ceil(length(text) / 500.0), 1)::integer as n from documents)
select doc_id, i::integer as pos, substr(text, (i * 500 + 1)::bigint, 500) as piece from (select *, unnest(range(0, n)) as i from n)""")
def segment_hard_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.hard_pieces(F.col("text"), 500)).alias("pos", "piece"))


@query(f"""with {_TREES},
j as (select coalesce(a.p_partkey, b.p_partkey) as k, {_STATUS} as status from a full join b on a.p_partkey = b.p_partkey),
g as (select k % 25 as grp, list_sort(list('p' || k) filter (where status = 'added')) as added, list_sort(list('p' || k) filter (where status = 'removed')) as removed,
  count(*) filter (where status = 'modified') as modified from j group by k % 25)
select grp as grp, '# What the release changes' || chr(10) || chr(10) || 'added files: ' || coalesce(len(added), 0) || chr(10) || 'removed files: ' || coalesce(len(removed), 0) || chr(10)
 || 'modified files: ' || modified || chr(10) || 'changed lines: ' || (modified * 2) || chr(10) || chr(10)
 || case when len(added) > 0 then '## Added' || chr(10) || array_to_string(list_transform(added, lambda x: '  + ' || x), chr(10)) || chr(10) || chr(10) else '' end
 || case when len(removed) > 0 then '## Removed' || chr(10) || array_to_string(list_transform(removed, lambda x: '  - ' || x), chr(10)) || chr(10) || chr(10) else '' end
 || '# Diffs' || chr(10) as preamble from g""")
def preamble(spark, sf_dir):
    rows = _compared(spark, sf_dir).select((F.col("p_partkey") % 25).alias("grp"), "status", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"))
    kind = lambda k: F.sort_array(F.collect_list(F.when(F.col("status") == k, F.col("path")))).alias(f"files_{k}")
    g = rows.groupBy("grp").agg(kind("added"), kind("removed"), kind("modified"))
    none = F.array().cast("array<string>")
    s = {c: F.col(c) for c in ("files_added", "files_removed", "files_modified")} | {c: none for c in ("new_dependencies", "removed_dependencies", "new_install_hooks")}
    s |= {"total_diff_lines": F.size("files_modified") * 2, "maintainer_changed": F.lit(False), "native_addons_added": F.lit(False), "comments_stripped": F.lit(False), "comment_lines_stripped": F.lit(0)}
    return g.select("grp", chunk.preamble(s).alias("preamble"))


@query("""with d as (select source, lang, doc_id, row_number() over (partition by source, lang order by doc_id) as n from documents)
select source, lang, doc_id from d where n = 1""")
def distinct_ordered(spark, sf_dir):
    return chunk.first_occurrences(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"])


#: Segments of a document's lines as a recursion: which one, and how full it is; lines over the limit are cut first.
_SEGMENTS = """
l as (select doc_id, unnest(string_split(coalesce(nullif(text, ''), '(no text)'), chr(10))) as line, generate_subscripts(string_split(coalesce(nullif(text, ''), '(no text)'), chr(10)), 1) as pos from documents),
c as (select doc_id, pos, line, unnest(range(0, greatest(length(line), 1), 1800)) as start from l),
d as (select doc_id, substr(line, start + 1, 1800) as piece, row_number() over (partition by doc_id order by pos, start) as i from c),
f as (select doc_id, i, piece, 0 as seg, length(piece) + 1 as used from d where i = 1
  union all
  select d.doc_id, d.i, d.piece, case when f.used + length(d.piece) + 1 > 1800 then f.seg + 1 else f.seg end,
    case when f.used + length(d.piece) + 1 > 1800 then length(d.piece) + 1 else f.used + length(d.piece) + 1 end
  from f join d on d.doc_id = f.doc_id and d.i = f.i + 1),
s as (select doc_id, seg, string_agg(piece, chr(10) order by i) as body from f group by doc_id, seg),
m as (select doc_id, least(count(*), 3) as n, coalesce(sum(length(body) + 1) filter (where seg >= 3), 0)::bigint as lost from s group by doc_id)"""


@query(f"""with recursive {_SEGMENTS}
select doc_id, (seg + 1)::integer as part, lost > 0 as cut, sha256('## d' || doc_id || '.js, part ' || (seg + 1) || ' of ' || n || ' (added, +' || (doc_id % 7) || ' -0 in all parts)' || chr(10) || '```diff' || chr(10) || body
 || case when lost > 0 and seg = 2 then chr(10) || '[cut: ' || lost || ' characters beyond 3 part(s) are left out]' else '' end || chr(10) || '```' || chr(10)) as part_sha256
from s join m using (doc_id) where seg < 3""")
def split_parts(spark, sf_dir):
    """Documents as diffs too large for a chunk, in labelled parts of 1800 characters, three a file at most."""
    d = F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), F.lit("added").alias("change_type"), (F.col("doc_id") % 7).alias("lines_added"), F.lit(0).cast("long").alias("lines_removed"), F.col("text").alias("unified_diff"))
    blocks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pair_id"), F.lit(1).alias("at"), F.lit(3000).alias("base"), d.alias("d"))
    got = chunk.split_parts(blocks, Settings(max_tokens_per_chunk=1000, max_split_parts_per_file=3))
    return got.select(F.col("pair_id").cast("long").alias("doc_id"), "cut", F.posexplode("parts").alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("part"), "cut", F.sha2("text", 256).alias("part_sha256"))


@query(f"""with {_PAIRS}, n as (select doc_id, len(string_split(to_text, chr(10))) - case when to_text = '' or suffix(to_text, chr(10)) then 1 else 0 end as t,
  len(string_split(from_text, chr(10))) - case when from_text = '' or suffix(from_text, chr(10)) then 1 else 0 end as f from p where from_id is not null and from_text <> to_text)
select doc_id, (t - f)::bigint as net_lines, true as fits from n""")
def diff_net_lines(spark, sf_dir):
    """The counts that reports give, of documents as releases of their source: they differ as the texts' lengths do, and are those of the diff's own lines."""
    pairs = release_pairs(spark, sf_dir).where("from_text <> to_text").select("source", F.col("doc_id").cast("string").alias("path"), "from_text", "to_text")
    got = tree.unified_diffs(pairs.withColumnRenamed("source", "pair_id"))
    marked = lambda sign: F.size(F.filter(F.split("unified_diff", "\n"), lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))
    fits = (marked("+") == F.col("lines_added")) & (marked("-") == F.col("lines_removed"))
    return got.select(F.col("path").cast("long").alias("doc_id"), (F.col("lines_added") - F.col("lines_removed")).alias("net_lines"), fits.alias("fits"))


#: Chunks of a pair as a recursion over its blocks: the first chunk holds more than the others, which begin with a line that says so.
_BOOKS = """
p as (select doc_id // 20 as pair, 'd' || doc_id || '.js' as path, coalesce(text, '') as text from documents),
h as (select pair, '# What the release changes' || chr(10) || chr(10) || 'added files: ' || count(*) || chr(10) || 'removed files: 0' || chr(10) || 'modified files: 0' || chr(10) || 'changed lines: ' || count(*) || chr(10) || chr(10)
  || '## Added' || chr(10) || string_agg('  + ' || path, chr(10) order by path) || chr(10) || chr(10) || '# Diffs' || chr(10) as head from p group by pair),
b as (select pair, path, '## ' || path || ' (added, +1 -0)' || chr(10) || '```diff' || chr(10) || case when text = '' then '(no text)' else text end || chr(10) || '```' || chr(10) as block from p),
d as (select pair, path, length(head) as base, length(block) > 4000 as cut,
  case when length(block) > 4000 then substr(block, 1, 3800) || chr(10) || '[cut: 3800 of ' || length(block) || ' characters fit into 1000 tokens, ' || (length(block) - 3800) || ' are left out]' || chr(10) else block end as block,
  row_number() over (partition by pair order by path) as i from b join h using (pair)),
f as (select pair, path, base, cut, block, i, 0 as chunk, length(block) as used from d where i = 1
  union all
  select d.pair, d.path, d.base, d.cut, d.block, d.i, case when f.used + length(d.block) > 4000 - d.base - (case when f.chunk = 0 then 0 else 14 end) then f.chunk + 1 else f.chunk end,
    case when f.used + length(d.block) > 4000 - d.base - (case when f.chunk = 0 then 0 else 14 end) then length(d.block) else f.used + length(d.block) end
  from f join d on d.pair = f.pair and d.i = f.i + 1)"""


def _books(spark, sf_dir):
    """Twenty documents as the new files of a pair, in chunks of 4000 characters, eight a pair at most."""
    docs = table(spark, sf_dir, "documents").select((F.floor(F.col("doc_id") / 20)).cast("string").alias("pair_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), F.coalesce("text", F.lit("")).alias("unified_diff"))
    one = F.lit(1).cast("long")
    diffs = docs.select("pair_id", "path", F.lit(tree.ADDED).alias("change_type"), one.alias("lines_added"), (one - 1).alias("lines_removed"), "unified_diff")
    none = F.array().cast("array<string>")
    no = F.lit(False)
    summary = F.struct(
        "files_added", none.alias("files_removed"), none.alias("files_modified"), F.size("files_added").cast("long").alias("total_diff_lines"), none.alias("new_dependencies"), none.alias("removed_dependencies"), none.alias("new_install_hooks"),
        no.alias("maintainer_changed"), no.alias("native_addons_added"), no.alias("comments_stripped"), F.lit(0).cast("long").alias("comment_lines_stripped"),
    )
    summaries = docs.groupBy("pair_id").agg(F.sort_array(F.collect_list("path")).alias("files_added")).select("pair_id", summary.alias("summary"))
    return chunk.chunks(summaries, Settings(max_tokens_per_chunk=1000, max_chunks_per_analysis=8), diffs=diffs)


@query(f"""with recursive {_BOOKS}, t as (select pair, chunk, string_agg(block, chr(10) order by i) as body from f where chunk < 8 group by pair, chunk)
select pair, chunk::integer as chunk, sha256(head || chr(10) || case when chunk > 0 then '# More diffs' || chr(10) else '' end || body) as chunk_sha256 from t join h using (pair)""")
def chunk_contents(spark, sf_dir):
    """Whole chunks as a scorer reads them: facts, labelled fenced blocks, what was cut."""
    return _books(spark, sf_dir)[0].select(F.col("pair_id").cast("long").alias("pair"), F.col("chunk_idx").alias("chunk"), F.sha2("content", 256).alias("chunk_sha256"))


@query(f"""with recursive {_BOOKS}
select pair, least(max(chunk) + 1, 8)::bigint as chunks_sent, bool_or(cut) as diff_truncated, coalesce(string_agg(path, ',' order by path) filter (where cut), '') as truncated,
  coalesce(string_agg(path, ',' order by path) filter (where chunk >= 8), '') as not_analyzed from f group by pair""")
def chunk_books(spark, sf_dir):
    """What the bookkeeping of the same chunks says of files that were cut or left out."""
    names = lambda c: F.array_join(c, ",")
    return _books(spark, sf_dir)[1].select(F.col("pair_id").cast("long").alias("pair"), F.col("chunks_sent_to_llm").alias("chunks_sent"), "diff_truncated", names("truncated_files").alias("truncated"), names("files_not_analyzed").alias("not_analyzed"))
