"""What pairs need from registries and feeds: requests out, answers back, the four feeds and the artifacts made of them.

`ask` maps a table of requests to one of answers (sources.services.asker): from services, or from a folder of saved
answers. All pairs are two jobs of requests, as scorecards and attestations of files are known by the first job's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relsift.functions import feeds
from relsift.session import written
from relsift.settings import Settings
from relsift.sources import registry
from relsift.sources.services import ADVISORIES, ATTESTATIONS, DOCUMENT, SCORECARD, VERSION

Ask = Callable[[DataFrame], DataFrame]


def _npm() -> Column:
    return F.col("ecosystem") == "npm"


def _request(rows: DataFrame, kind: str, url: Column, post: Column | None = None) -> DataFrame:
    version = F.col("version") if "version" in rows.columns else F.lit(None)
    return rows.select(F.lit(kind).alias("kind"), "ecosystem", "package", version.cast("string").alias("version"), url.alias("url"), (F.lit(None) if post is None else post).cast("string").alias("post"))


def _part(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def documents(names: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Requests for the registry documents of packages (ecosystem, package)."""
    p = F.col("package")
    return _request(names.select("ecosystem", "package").distinct(), DOCUMENT, F.when(_npm(), registry.npm_url(settings.npm_registry, p)).otherwise(registry.pypi_url(settings.pypi_registry, p)))


def version_documents(versions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Requests for documents of PyPI versions among (ecosystem, package, version)."""
    return _request(versions.where(~_npm()), VERSION, registry.pypi_url(settings.pypi_registry, F.col("package"), F.col("version")))


def advisories(versions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Requests for advisories of versions (ecosystem, package, version)."""
    # fixed values: the service's names of ecosystems
    asked = F.to_json(F.struct("version", F.struct(F.col("package").alias("name"), F.when(_npm(), "npm").otherwise("PyPI").alias("ecosystem")).alias("package")))
    return _request(versions, ADVISORIES, F.lit(f"{settings.osv_api}/query"), asked)


def npm_attestations(versions: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Requests for attestations of npm versions among (ecosystem, package, version)."""
    name = F.replace(_part(F.col("package")), F.lit("%40"), F.lit("@"))
    return _request(versions.where(_npm()), ATTESTATIONS, F.concat(F.lit(f"{settings.npm_registry}/-/npm/v1/attestations/"), name, F.lit("@"), "version"))


def pypi_attestations(artifacts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Requests for provenance of files (package, version, filename) on PyPI."""
    url = F.concat(F.lit(f"{settings.pypi_integrity}/"), _part(F.col("package")), F.lit("/"), "version", F.lit("/"), _part(F.col("filename")), F.lit("/provenance"))
    return _request(artifacts.withColumn("ecosystem", F.lit("pypi")), ATTESTATIONS, url)


def scorecards(repos: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Requests for scorecards of repositories (slug)."""
    rows = repos.select("slug").distinct().select(F.lit("github").alias("ecosystem"), F.col("slug").alias("package"))
    return _request(rows, SCORECARD, F.concat(F.lit(f"{settings.scorecard_api}/projects/github.com/"), "package"))


def _versions(pairs: DataFrame) -> DataFrame:
    """Both versions of the pairs, once each."""
    return pairs.select("ecosystem", "package", F.explode(F.array("from_version", "to_version")).alias("version")).distinct()


def of_kind(answers: DataFrame, kind: str, ecosystem: str | None = None) -> DataFrame:
    rows = answers.where(F.col("kind") == kind)
    return rows if ecosystem is None else rows.where(F.col("ecosystem") == ecosystem)


def _latest(answers: DataFrame) -> DataFrame:
    """One answer a request, as a folder of saved ones may hold several: one with a body goes first, then the smallest."""
    best = F.max_by(F.struct("body", "status", "error"), F.struct(F.col("body").isNotNull(), -F.coalesce("status", F.lit(0)), "body", "error"))
    return answers.groupBy("kind", "ecosystem", "package", "version").agg(best.alias("a")).select("kind", "ecosystem", "package", "version", "a.*")


def answers_of(pairs: DataFrame, added: DataFrame, ask: Ask, settings: Settings = Settings()) -> DataFrame:
    """All answers that the feeds of the pairs need. pairs: as in reports; added: (pair_id, new_dependencies).

    Pairs without a version ask for nothing of that version."""
    new = pairs.select("pair_id", "ecosystem").join(added, "pair_id").select("ecosystem", F.explode("new_dependencies").alias("package"))
    both = _versions(pairs).where("version is not null")
    wanted = documents(pairs.select("ecosystem", "package").unionByName(new).where("package is not null"), settings)
    target = pairs.select("ecosystem", "package", F.col("to_version").alias("version")).where("version is not null")
    for more in (advisories(target, settings), npm_attestations(both, settings), version_documents(both, settings)):
        wanted = wanted.unionByName(more)
    first = written(_latest(ask(wanted)), "answers")
    docs = of_kind(first, DOCUMENT)
    own = docs.join(pairs.select("ecosystem", "package").distinct(), ["ecosystem", "package"], "left_semi")
    repos = registry.repositories(of_kind(own, DOCUMENT, "npm"), of_kind(own, DOCUMENT, "pypi"))
    later = scorecards(repos, settings).unionByName(pypi_attestations(registry.pypi_artifacts(of_kind(first, VERSION)), settings))
    return written(first.unionByName(_latest(ask(later))), "answers")


def feeds_from(pairs: DataFrame, added: DataFrame, answers: DataFrame) -> DataFrame:
    """(pair_id, feed_results) from answers. A failed lookup gives no_data; that a version has no attestation (status 404) is no failure."""
    npm, pypi = of_kind(answers, DOCUMENT, "npm"), of_kind(answers, DOCUMENT, "pypi")
    signed = registry.npm_identities(of_kind(answers, ATTESTATIONS, "npm")).unionByName(registry.pypi_identities(of_kind(answers, ATTESTATIONS, "pypi")))
    failed = answers.where(F.col("kind").isin(ATTESTATIONS, VERSION) & F.col("body").isNull() & (F.coalesce("status", F.lit(0)) != 404)).select("ecosystem", "package", "version")
    broken = pairs.select("pair_id", "ecosystem", "package", F.explode(F.array("from_version", "to_version")).alias("version")).join(failed, ["ecosystem", "package", "version"], "left_semi")
    return feeds.all_feeds(
        pairs,
        feeds.osv(pairs, registry.advisories(of_kind(answers, ADVISORIES))),
        feeds.rekor(pairs, signed).join(broken.select("pair_id").distinct(), "pair_id", "left_anti"),
        feeds.scorecard(pairs, registry.repositories(npm, pypi), registry.scorecards(of_kind(answers, SCORECARD))),
        feeds.new_deps(pairs, added, registry.package_stats(npm, pypi)),
    )


def feeds_by(ask: Ask, settings: Settings = Settings(), record: str | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A function of (pairs, added) that looks the feeds up, for reports; answers are added to the folder `record`, to be replayed."""

    def look_up(pairs: DataFrame, added: DataFrame) -> DataFrame:
        answers = answers_of(pairs, added, ask, settings)
        if record:
            answers.write.mode("append").parquet(record)
        return feeds_from(pairs, added, answers)

    return look_up


def artifact_requests(pairs: DataFrame, ask: Ask, settings: Settings = Settings()) -> DataFrame:
    """Requests for release.files_of_requests: the artifact of each side of the pairs, with what its registry says of it.

    A version that isn't known has no url, and so an error in the end."""
    sides = pairs.select("pair_id", "ecosystem", "package", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_version").alias("version")) for s in ("from", "to")])).alias("s")).select("pair_id", "ecosystem", "package", "s.*")
    answers = written(_latest(ask(documents(pairs.where(_npm()), settings).unionByName(version_documents(_versions(pairs), settings)))), "answers")
    file_of = lambda c: F.substring_index(c, "/", -1).alias("file_name")
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    npm = registry.npm_versions(of_kind(answers, DOCUMENT, "npm")).select(F.lit("npm").alias("ecosystem"), "package", "version", file_of("tarball"), F.col("tarball").alias("url"), "integrity", "shasum", *none("sha256"))
    pypi = registry.pypi_artifacts(of_kind(answers, VERSION)).select(F.lit("pypi").alias("ecosystem"), "package", "version", F.col("filename").alias("file_name"), "url", *none("integrity", "shasum"), "sha256")
    return sides.join(npm.unionByName(pypi), ["ecosystem", "package", "version"], "left")
