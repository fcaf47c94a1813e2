"""Registry documents as bronze tables: (package, body) JSON text in, versions, histories and artifacts out.

Fetching is apart (sources.fetch): a table of bodies is read once and serves history, artifacts and
repositories alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relsift.functions.feeds import github_slug, project_slug, publisher_identity
from relsift.operators.history import artifact_rank, best, published


def _json(documents: DataFrame) -> DataFrame:
    return documents.withColumn("j", F.try_parse_json("body"))


def npm_url(registry: str, package) -> Column:
    """Address of a package document; the whole name is one encoded path part."""
    return F.concat(F.lit(registry.rstrip("/") + "/"), F.replace(F.url_encode(package), F.lit("+"), F.lit("%20")))


def pypi_url(registry: str, package: Column, version: Column | None = None) -> Column:
    """Address of a project document (S04), or of one version's."""
    part = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    name = F.concat(F.lit(registry.rstrip("/") + "/"), part(package))
    return F.concat(name, F.lit("/json")) if version is None else F.concat(name, F.lit("/"), part(version), F.lit("/json"))


def npm_versions(documents: DataFrame) -> DataFrame:
    """(package, version, tarball, integrity, shasum) of each version."""
    v = _json(documents).select("package", F.explode(F.try_variant_get("j", "$.versions", "map<string,variant>")).alias("version", "v"))
    at = lambda p: F.try_variant_get("v", f"$.dist.{p}", "string").alias(p)
    return v.select("package", "version", at("tarball"), at("integrity"), at("shasum"))


def npm_history(documents: DataFrame) -> DataFrame:
    """(package, version, published_at): the document's times of versions that it still has."""
    times = _json(documents).select("package", F.explode(F.try_variant_get("j", "$.time", "map<string,string>")).alias("version", "published_at"))
    return times.join(npm_versions(documents).select("package", "version"), ["package", "version"], "left_semi")


def pypi_history(documents: DataFrame) -> DataFrame:
    """(package, version, published_at): the first upload of each release."""
    files = _json(documents).select("package", F.explode(F.try_variant_get("j", "$.releases", "map<string,array<variant>>")).alias("version", "files"))
    each = files.select("package", "version", F.explode("files").alias("f")).select("package", "version", F.try_variant_get("f", "$.upload_time_iso_8601", "string").alias("uploaded"))
    return published(each, ["package", "version"], "uploaded")


def pypi_artifacts(documents: DataFrame) -> DataFrame:
    """(package, version, filename, url, sha256, packagetype): the preferred file of each version document."""
    files = _json(documents).select("package", "version", F.posexplode(F.try_variant_get("j", "$.urls", "array<variant>")).alias("pos", "f"))
    at = lambda p, name: F.try_variant_get("f", f"$.{p}", "string").alias(name)
    each = files.select("package", "version", "pos", at("filename", "filename"), at("url", "url"), at("digests.sha256", "sha256"), at("packagetype", "packagetype"))
    return best(each, ["package", "version"], [artifact_rank(F.col("packagetype")), F.col("pos")]).drop("pos")


def repositories(npm: DataFrame, pypi: DataFrame) -> DataFrame:
    """(ecosystem, package, slug) of packages whose repository is known."""
    n = _json(npm)
    address = F.coalesce(F.try_variant_get("j", "$.repository.url", "string"), F.try_variant_get("j", "$.repository", "string"))
    a = n.select(F.lit("npm").alias("ecosystem"), "package", github_slug(address).alias("slug"))
    p = _json(pypi)
    urls = F.try_variant_get("j", "$.info.project_urls", "map<string,string>")
    b = p.select(F.lit("pypi").alias("ecosystem"), "package", project_slug(urls, F.try_variant_get("j", "$.info.home_page", "string")).alias("slug"))
    return a.unionByName(b).where("slug is not null")


def package_stats(npm: DataFrame, pypi: DataFrame) -> DataFrame:
    """(ecosystem, package, versions, maintainers); PyPI tells no maintainers."""
    a = _json(npm).select(F.lit("npm").alias("ecosystem"), "package", F.size(F.map_keys(F.try_variant_get("j", "$.versions", "map<string,variant>"))).cast("long").alias("versions"), F.size(F.try_variant_get("j", "$.maintainers", "array<variant>")).cast("long").alias("maintainers"))
    b = _json(pypi).select(F.lit("pypi").alias("ecosystem"), "package", F.size(F.map_keys(F.try_variant_get("j", "$.releases", "map<string,variant>"))).cast("long").alias("versions"), F.lit(None).cast("long").alias("maintainers"))
    return a.unionByName(b).where("versions >= 0").withColumn("maintainers", F.when(F.col("maintainers") >= 0, F.col("maintainers")))


def advisories(responses: DataFrame) -> DataFrame:
    """(ecosystem, package, version, ids) from advisory responses (ecosystem, package, version, body)."""
    vulns = F.try_variant_get("j", "$.vulns", "array<struct<id:string>>")
    ids = F.filter(F.transform(F.coalesce(vulns, F.array().cast("array<struct<id:string>>")), lambda v: v["id"]), lambda i: i.isNotNull())
    return _json(responses).select("ecosystem", "package", "version", F.when(F.col("j").isNotNull(), ids).alias("ids"))


def scorecards(responses: DataFrame) -> DataFrame:
    """(slug, score, aggregate_score, checks) from answers (package, body) whose package is the repository's slug."""
    at = lambda p, kind: F.try_variant_get("j", f"$.{p}", kind).alias(p)
    return _json(responses).where("j is not null").select(F.col("package").alias("slug"), at("score", "double"), at("aggregate_score", "double"), at("checks", "array<struct<name:string,score:string>>"))


def pypi_identities(responses: DataFrame) -> DataFrame:
    """(ecosystem, package, version, identity, url): the first bundle that names a publisher."""
    bundle = "struct<publisher:struct<kind:string,repository:string,workflow:string,environment:string>,attestations:array<struct<verification_material:struct<transparency_entries:array<struct<logIndex:string>>>>>>"
    each = _json(responses).select("package", "version", F.posexplode(F.try_variant_get("j", "$.attestation_bundles", f"array<{bundle}>")).alias("pos", "b"))
    index = F.get(F.get(F.col("b.attestations"), F.lit(0))["verification_material"]["transparency_entries"], F.lit(0))["logIndex"]
    named = each.select("package", "version", "pos", publisher_identity(F.col("b.publisher")).alias("identity"), log_url(index).alias("url")).where("identity is not null")
    return best(named, ["package", "version"], [F.col("pos")]).select(F.lit("pypi").alias("ecosystem"), "package", "version", "identity", "url")


def log_url(index: Column) -> Column:
    """Where a transparency-log entry can be looked at."""
    return F.concat(F.lit("https://search.sigstore.dev/?logIndex="), index)


def npm_identities(responses: DataFrame) -> DataFrame:
    """(ecosystem, package, version, identity, url): provenance attestations before others, the first readable certificate."""
    from relsift.sources.certificates import identities

    kind = "struct<predicateType:string,bundle:struct<verificationMaterial:struct<certificate:struct<rawBytes:string>,x509CertificateChain:struct<certificates:array<struct<rawBytes:string>>>,tlogEntries:array<struct<logIndex:string>>>>>"
    each = _json(responses).select("package", "version", F.posexplode(F.try_variant_get("j", "$.attestations", f"array<{kind}>")).alias("pos", "a"))
    m = F.col("a.bundle.verificationMaterial")
    raw = F.coalesce(m["certificate"]["rawBytes"], F.get(m["x509CertificateChain"]["certificates"], F.lit(0))["rawBytes"])
    rows = each.select("package", "version", "pos", F.coalesce(F.col("a.predicateType").startswith("https://slsa.dev/provenance/"), F.lit(False)).alias("slsa"), F.try_to_binary(raw, F.lit("base64")).alias("der"), log_url(F.get(m["tlogEntries"], F.lit(0))["logIndex"]).alias("url"))
    named = identities(rows).where("identity is not null")
    return best(named, ["package", "version"], [F.col("slsa").desc(), F.col("pos")]).select(F.lit("npm").alias("ecosystem"), "package", "version", "identity", "url")
