"""Addresses, digests, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from relsift.functions import feeds
from relsift.operators import scorers
from relsift.plans.catalog import query, table
from relsift.sources import fetch

_HOSTS = ("spam-farm.example.org", "m.ththth.example.net")


@query(r"""with u as (select page_id, url, regexp_extract(url, '^([a-z]+)://', 1) as scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) as host from pages)
select page_id, host, scheme = 'https' and host <> '' and not contains(host, '@') as allowed,
  scheme = 'https' and host in ('spam-farm.example.org', 'm.ththth.example.net') as listed from u""")
def url_guard(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.try_parse_url(url, F.lit("HOST"))).alias("host"), fetch.url_allowed(url).alias("allowed"), fetch.url_allowed(url, _HOSTS).alias("listed"))


@query(r"""with p as (select page_id, rtrim(regexp_extract('https://github.com/' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/' || regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]*)', 1) || '.git', 'github\.com/(.*)$', 1), '/') as p from pages)
select page_id, regexp_extract(regexp_replace(p, '\.git$', ''), '^([^/]*/[^/]*)', 1) as slug from p""")
def url_slug(spark, sf_dir):
    """Host and first path part as owner and repository of an address."""
    made = F.concat(F.lit("https://github.com/"), F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1), F.lit("/"), F.regexp_extract("url", r"^[a-z]+://[^/]*/([^/?#]*)", 1), F.lit(".git"))
    return table(spark, sf_dir, "pages").select("page_id", feeds.github_slug(made).alias("slug"))


@query("""select doc_id, sha256(text) = sha256(case when doc_id % 4 = 0 then text || 'x' else text end) as pypi_ok,
  case doc_id % 3 when 0 then true when 1 then doc_id % 2 = 0 else false end as npm_ok from documents""")
def digest_verify(spark, sf_dir):
    """Digests made from the text, wrong in every fourth document; for npm an integrity text, a SHA-1 that is wrong in odd ones, or nothing."""
    content = F.col("text").cast("binary")
    told = F.sha2(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256)
    kind = F.col("doc_id") % 3
    integrity = F.when(kind == 0, F.concat(F.lit("sha384-AAAA sha512-"), F.regexp_replace(F.base64(F.unhex(F.sha2("text", 512))), r"\s", "")))
    shasum = F.when(kind == 1, F.sha1(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x")))))
    return table(spark, sf_dir, "documents").select("doc_id", fetch.pypi_verified(content, told).alias("pypi_ok"), fetch.npm_verified(content, integrity, shasum).alias("npm_ok"))


@query("""select event_id, greatest(least(cast(json_extract(props, '$.k') as double) / 5.0, 10.0), 0.0) as score, 'r' || event_type as reasoning from events""")
def json_response(spark, sf_dir):
    """props as the score in a fenced response; the contract's parser reads it back, clamped."""
    raw = F.concat(F.lit('```json\n{"dimensions": [{"name": "obfuscation", "score": '), (F.get_json_object("props", "$.k").cast("double") / 5).cast("string"), F.lit(', "confidence": "0.5", "reasoning": "r'), F.col("event_type"), F.lit('"}], "summary": "s"}\n```'))
    d = F.get(scorers.parsed(raw)["dimensions"], F.lit(0))
    return table(spark, sf_dir, "events").select("event_id", F.greatest(F.least(d["score"], F.lit(10.0)), F.lit(0.0)).alias("score"), d["reasoning"].alias("reasoning"))
