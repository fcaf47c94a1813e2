"""The queries opN_<name>: each operator on its whole table, reduced to the columns agreed on.

The query `pipeline` is corpus_pipeline.run, which uses this package and is not part of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relsift.llm import collocations, decontaminate, embedding_dedup, html_extract, line_dedup, mixing, quality, secrets, simhash, substring_dedup, tokenizer_alignment, toxicity, warc
from relsift.llm._labels import held_out
from relsift.llm._session import new_folder, prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _judged(scores: DataFrame, apart, threshold: float) -> DataFrame:
    return scores.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = held_out(5, 0)
    return _judged(toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~apart), apart, 0.5)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    found = secrets.scan(documents, secrets.fit(secrets.samples(spark, documents)))
    count = lambda kind: F.size(F.filter("found", lambda s: s["rank"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = secrets.listed(F.col("found"), "assign", "access", "hex")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), secrets.listed(F.col("found"), *secrets.KINDS).alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = held_out(4, 2)
    return _judged(quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~apart), apart, quality.THRESHOLD)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"), html_extract.fit(html_extract.labelled_pages()))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(prepare(spark), "warc")
    warc.archive(_table(spark, sf_dir, "pages"), folder)
    return warc.pages(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment.aligned(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_secrets, op3_quality, op4_line_dedup, op5_html_text, op6_embedding_dedup, op7_decontaminate, op8_mix, op9_simhash, op10_substring_dedup, op11_warc, op12_collocations, op13_align)}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op4_line_dedup": rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
l as (select r, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d),
k as (select *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
rep as (select key, min(doc_id) as first_id from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
j as (select k.*, rep.first_id is not null and k.doc_id > rep.first_id as gone from k left join rep using (key))
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from j group by r""",
    # links within labels by cosine; components by the least id that reaches a vector over them
    "op6_embedding_dedup": r"""
with recursive e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
fine as (select vec_id, label, v, sqrt(list_dot_product(v, v)) as size from e
  where vec_id is not null and label is not null and v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from fine a join fine b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.93),
r(node, root) as (select vec_id, vec_id from e union select l.b, r.root from r join l on l.a = r.node where r.root < l.b),
c as (select node, min(root) as component_id from r group by node),
n as (select a, count(*) as n_links from l group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from e join c on c.node = e.vec_id left join n on n.a = e.vec_id""",
    "op7_decontaminate": rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
bn as (select item_id, w, least(10, len(w)) as n from b where len(w) > 0),
bw as (select distinct item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as x from (select *, unnest(range(1, len(w) - n + 2)) as i from bn)),
sizes as (select distinct n from bw),
dw as (select r, s.n, i, array_to_string(list_slice(w, i, i + s.n - 1), ' ') as x from (select r, n, w, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n) s),
m as (select dw.r, dw.i, dw.n, bw.item_id from dw join bw on dw.x = bw.x and dw.n = bw.n),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from m) group by r),
items as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as names from m group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join items using (r)""",
    "op8_mix": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
  substr(sha256('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 32) as key from documents),
s as (select source, sum(size)::hugeint as source_size from d group by source),
w as (select *, ((row_number() over (order by source nulls last) - 1) % 3 + 1)::hugeint as w, source_size * 3 as cap, sum(source_size) over () as total from s),
f as (select *, row_number() over o as nth, coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as filled,
  sum(w) over (o rows between current row and unbounded following) as left_w from w window o as (order by cap::double / w::double, source nulls last)),
g as (select *, total - filled as rest, (total - filled)::double * w::double <= cap::double * left_w::double as open from f),
h as (select *, min(nth) filter (where open) over () as fro from g),
i as (select *, max(case when nth = fro then rest end) over () as rest_, max(case when nth = fro then left_w end) over () as left_ from h),
t as (select source, source_size::bigint as source_size, case when fro is null or nth < fro then cap::double else w::double * rest_::double / left_::double end as target from i),
p as (select d.*, t.source_size, t.target, floor(t.target)::bigint as budget,
  coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as ahead
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  ((case when source_size > 0 then budget // source_size else 0 end) * size
   + greatest(0, least(size, (case when source_size > 0 then budget % source_size else 0 end) - ahead)))::bigint as taken
from p""",
    "op10_substring_dedup": r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
x as (select r, doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) as h from (select *, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
f as (select h, min(doc_id) as first_id from x group by h),
gone as (select distinct r, unnest(range(i, i + 50)) as p from x join f using (h) where x.doc_id > f.first_id),
words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select r, string_agg(word, ' ' order by p) as text from words anti join gone using (r, p) group by r),
n as (select r, count(*) as n_removed from gone group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (r) left join n using (r)""",
    # base32 of the hex digits, five of them being four letters
    "op11_warc": r"""
with d as (select page_id, url, row_number() over () as r, coalesce(html, '') as p from pages),
o as (select *, row_number() over (partition by p order by page_id desc nulls last, url desc nulls last, r) as nth, first_value(page_id) over (partition by p order by page_id desc nulls last, url desc nulls last, r) as head from d),
h as (select *, list_transform(range(8), lambda g: ('0x' || substr(sha1(p), 5 * g + 1, 5))::bigint) as five from o)
select page_id, strlen(p)::bigint as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((five[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), 'string_agg', '') as payload_digest,
  case when nth = 1 then 'response' else 'revisit' end as record_type, case when nth > 1 then head end as refers_to
from h""",
    "op12_collocations": rf"""
with p as (select coalesce(lang, 'und') as lang, row_number() over () as r, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
n as (select lang, sum(len(w))::hugeint as n from w group by lang),
g as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, range(1, 6) t(k)),
f as (select lang, k, list_slice(w, i, i + k - 1) as ws, count(*) as f from g where len(w) >= k group by all having count(*) >= 100),
t as (select lang, k, ws, array_to_string(ws, ' ') as phrase, f from f),
longer as (select lang, part as phrase, max(f) as most from (select lang, f, unnest([array_to_string(ws[1:k-1], ' '), array_to_string(ws[2:k], ' ')]) as part from t where k > 2) group by all),
c as (select t.* from t left join longer using (lang, phrase) where k > 1 and (most is null or most < f)),
cuts as (select lang, phrase, f as a, cut, array_to_string(ws[1:cut], ' ') as first, array_to_string(ws[cut+1:k], ' ') as rest from (select *, unnest(range(1, k)) as cut from c)),
s as (select cuts.*, x.f as l, y.f as r, n.n, (1000::hugeint * a * n) // (x.f::hugeint * y.f) as score
  from cuts join t x on x.lang = cuts.lang and x.phrase = first join t y on y.lang = cuts.lang and y.phrase = rest join n on n.lang = cuts.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b) where rank <= 2000""",
}
