"""Threat feeds as tables: each gives one row a pair with a status, and the four are unioned in a fixed order.

Inputs are bronze tables of saved responses, so a feed that is missing for a pair is a left join
without a match, reported as no_data, and never an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relsift.schemas import FEED, FEEDS

CLEAN, SUSPICIOUS, MALICIOUS, NO_DATA = "clean", "suspicious", "malicious", "no_data"
#: What counts as little scrutiny, and the checks that are summarised.
FEW_VERSIONS, FEW_MAINTAINERS = 5, 1
KEY_CHECKS = ("Maintained", "Code-Review", "Branch-Protection", "Signed-Releases")
#: project_urls keys in the order in which they are tried.
URL_KEYS = ("Source", "Repository", "Source Code", "Homepage", "Code", "GitHub")


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def feed_row(source: str, status: Column, details: Column, **more: Column) -> Column:
    """A feed result with nulls for what it lacks."""
    order = ("url", "advisory_ids", "signing_identity", "signing_identity_changed", "scorecard_score")
    kinds = dict(zip(order, ("string", "array<string>", "string", "boolean", "double")))
    given = {"advisory_ids": F.array().cast("array<string>")} | more
    return F.struct(F.lit(source).alias("source"), status.alias("status"), details.alias("details"), *[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in order]).cast(FEED)


def any_confirmed(ids: Column) -> Column:
    """Whether any advisory is of confirmed malware."""
    return F.exists(ids, lambda i: i.startswith("MAL-"))


def advisory_status(ids: Column) -> Column:
    """None: clean; confirmed malware: malicious; else suspicious; unknown: no_data."""
    return F.when(ids.isNull(), NO_DATA).when(F.size(ids) == 0, CLEAN).when(any_confirmed(ids), MALICIOUS).otherwise(SUSPICIOUS)


def advisory_preview(ids: Column, most: int = 5) -> Column:
    """The first ids and how many more there are."""
    extra = F.size(ids) - most
    return F.concat(F.array_join(F.slice(ids, 1, most), ", "), F.when(extra > 0, _say(" (and ", extra.cast("string"), " more)")).otherwise(""))


def identity_status(old: Column, new: Column) -> Column:
    """Signing identities compared."""
    return F.when(new.isNull(), NO_DATA).when(old.isNull() | (old == new), CLEAN).otherwise(SUSPICIOUS)


def scorecard_status(score: Column) -> Column:
    return F.when(score.isNull(), NO_DATA).when(score < 4.0, SUSPICIOUS).otherwise(CLEAN)


def low_scrutiny(versions: Column, maintainers: Column, few: int = FEW_VERSIONS, few_maintainers: int = FEW_MAINTAINERS) -> Column:
    """Few versions, and few or unknown maintainers."""
    return (versions <= few) & (maintainers.isNull() | (maintainers <= few_maintainers))


def publisher_identity(p: Column) -> Column:
    """kind:repository:workflow, and the environment if there is one; null if any of the three is missing."""
    some = lambda c: F.nullif(p[c], F.lit(""))
    whole = some("kind").isNotNull() & some("repository").isNotNull() & some("workflow").isNotNull()
    return F.when(whole, F.concat_ws(":", F.lower(p["kind"]), p["repository"], p["workflow"], some("environment")))


def github_slug(url: Column) -> Column:
    """owner/repo of an address on github.com; null for others."""
    path = F.regexp_replace(F.regexp_extract(url, r"github\.com/(.*)$", 1), r"/+$", "")
    path = F.regexp_replace(path, r"\.git$", "")
    slug = F.regexp_extract(path, r"^([^/]*/[^/]*)", 1)
    return F.when(slug != "", slug)


def project_slug(urls: Column, home_page: Column) -> Column:
    """The first of the usual project_urls that is a repository, else the home page."""
    return F.coalesce(*[github_slug(F.try_element_at(urls, F.lit(k))) for k in URL_KEYS], github_slug(home_page))


def check_summary(checks: Column) -> Column:
    """The four named checks with their scores."""
    found = F.transform(F.filter(checks, lambda c: c["name"].isin(*KEY_CHECKS)), lambda c: F.concat_ws("=", c["name"], F.coalesce(c["score"].cast("string"), F.lit("?"))))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("none of the main checks")


def osv(pairs: DataFrame, advisories: DataFrame) -> DataFrame:
    """advisories: ecosystem, package, version, ids (null: the lookup failed)."""
    found = pairs.join(advisories.select("ecosystem", "package", F.col("version").alias("to_version"), "ids", F.lit(True).alias("known")), ["ecosystem", "package", "to_version"], "left")
    ids = F.col("ids")
    name = _say(F.col("package"), "@", F.col("to_version"))
    details = F.when(ids.isNull(), "The lookup of advisories had no answer.").when(F.size(ids) == 0, _say(name, " has no advisories.")).otherwise(_say("Advisories (", F.size(ids).cast("string"), "): ", advisory_preview(ids)))
    url = F.when(ids.isNotNull(), _say("https://osv.dev/list?q=", F.col("package")))
    return found.select("pair_id", feed_row("osv", advisory_status(ids), details, url=url, advisory_ids=F.coalesce(ids, F.array().cast("array<string>"))).alias("feed"))


def rekor(pairs: DataFrame, identities: DataFrame) -> DataFrame:
    """identities: ecosystem, package, version, identity, url; a version without a row has none."""
    side = lambda v, i, u: identities.select("ecosystem", "package", F.col("version").alias(v), F.col("identity").alias(i), F.col("url").alias(u))
    both = pairs.join(side("from_version", "old", "old_url"), ["ecosystem", "package", "from_version"], "left").join(side("to_version", "new", "url"), ["ecosystem", "package", "to_version"], "left")
    old, new = F.col("old"), F.col("new")
    details = (
        F.when(new.isNull(), _say(F.col("package"), "@", F.col("to_version"), " has no attestation."))
        .when(old.isNull(), _say("Signed by ", new, "; ", F.col("package"), "@", F.col("from_version"), " has nothing to compare it with."))
        .when(old == new, _say("Signed by ", new, ", like the release before."))
        .otherwise(_say("Signed by ", new, ", the release before by ", old, "."))
    )
    return both.select("pair_id", feed_row("rekor", identity_status(old, new), details, url=F.when(new.isNotNull(), F.col("url")), signing_identity=new, signing_identity_changed=old != new).alias("feed"))


def scorecard(pairs: DataFrame, repos: DataFrame, cards: DataFrame) -> DataFrame:
    """repos: ecosystem, package, slug. cards: slug, score, aggregate_score, checks."""
    both = pairs.join(repos, ["ecosystem", "package"], "left").join(cards.withColumn("known", F.lit(True)), "slug", "left")
    score = F.coalesce("score", "aggregate_score").cast("double")
    details = (
        F.when(F.col("slug").isNull(), _say(F.col("package"), " names no repository that could have a scorecard."))
        .when(F.col("known").isNull(), _say(F.col("package"), " has no scorecard."))
        .when(score.isNull(), _say("The scorecard of ", F.col("slug"), " has no score."))
        .otherwise(_say(F.format_string("%.1f", score), " of 10; ", check_summary(F.coalesce("checks", F.array().cast(dict(cards.dtypes)["checks"])))))
    )
    url = F.when(F.col("known"), _say("https://scorecard.dev/viewer/?uri=github.com/", F.col("slug")))
    return both.select("pair_id", feed_row("scorecard", scorecard_status(score), details, url=url, scorecard_score=score).alias("feed"))


def new_deps(pairs: DataFrame, added: DataFrame, stats: DataFrame) -> DataFrame:
    """added: pair_id, new_dependencies. stats: ecosystem, package, versions, maintainers of known packages."""
    base = pairs.select("pair_id", "ecosystem").join(added.select("pair_id", "new_dependencies"), "pair_id", "left")
    each = base.select("pair_id", "ecosystem", F.explode("new_dependencies").alias("package")).join(stats, ["ecosystem", "package"])
    low = low_scrutiny(F.col("versions"), F.col("maintainers"))
    found = each.groupBy("pair_id").agg(F.count("*").alias("resolved"), F.sort_array(F.collect_list(F.when(low, F.col("package")))).alias("low"))
    all_ = base.join(found, "pair_id", "left")
    n = F.size(F.coalesce("new_dependencies", F.array().cast("array<string>")))
    status = F.when(n == 0, CLEAN).when(F.col("resolved").isNull(), NO_DATA).when(F.size("low") > 0, SUSPICIOUS).otherwise(CLEAN)
    details = (
        F.when(n == 0, "No dependency is new.")
        .when(F.col("resolved").isNull(), _say("None of the new dependencies (", n.cast("string"), ") could be looked up."))
        .when(F.size("low") > 0, _say("Little-known new dependencies: ", F.array_join("low", ", "), "."))
        .otherwise(_say("New dependencies looked up (", F.col("resolved").cast("string"), "): none is little-known."))
    )
    return all_.select("pair_id", feed_row("new_deps", status, details).alias("feed"))


def no_feeds(pairs: DataFrame, why: str = "Feeds are off.") -> DataFrame:
    """All four feeds without data."""
    off = lambda n: feed_row(n, F.lit(NO_DATA), F.lit(why))
    return pairs.select("pair_id", F.array(*map(off, FEEDS)).alias("feed_results"))


def all_feeds(pairs: DataFrame, *feeds: DataFrame) -> DataFrame:
    """(pair_id, feed_results): four rows a pair in their fixed order, no_data where one is missing."""
    rows = feeds[0]
    for more in feeds[1:]:
        rows = rows.unionByName(more)
    by_name = rows.groupBy("pair_id").agg(F.map_from_entries(F.collect_list(F.struct("feed.source", "feed"))).alias("m"))
    missing = lambda n: feed_row(n, F.lit(NO_DATA), F.lit("No response."))
    kept = F.array(*[F.coalesce(F.try_element_at("m", F.lit(n)), missing(n)) for n in FEEDS])
    return pairs.select("pair_id").join(by_name, "pair_id", "left").select("pair_id", kept.alias("feed_results"))
