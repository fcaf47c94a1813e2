"""What may be downloaded, and how it is checked: URL rules, integrity, retries, bounded reads."""

from __future__ import annotations

import ipaddress
import time
from collections.abc import Callable
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from relsift.settings import Settings

#: Hosts of the registries.
NPM_HOSTS = ("registry.npmjs.org",)
PYPI_HOSTS = ("pypi.org", "files.pythonhosted.org")
MAX_REDIRECTS = 5


#: Seconds that are waited at most for a service that asks for more time.
MAX_WAIT = 120.0


class Refused(Exception):
    """A download that breaks a rule, or that its service refuses: with the service's status, and the seconds it asks to wait."""

    def __init__(self, message: str, status: int | None = None, wait: float | None = None):
        super().__init__(message)
        self.status, self.wait = status, wait


def limited(e: Exception) -> bool:
    """Whether a service said that it is asked too often."""
    return getattr(e, "status", None) == 429


def asked_wait(headers: dict) -> float | None:
    """The seconds of a retry-after header; null where there is none, or it is a date."""
    text = (headers.get("retry-after") or "").strip()
    return float(text) if text.isdecimal() else None


def check_url(url: str, hosts: tuple[str, ...] = ()) -> str:
    """The URL if it is public https, without credentials, and on an allowed host if any are given."""
    parts = urlsplit(url)
    host = (parts.hostname or "").rstrip(".").lower()
    if parts.scheme != "https" or "@" in parts.netloc or not host:
        raise Refused(f"not a plain https address: {url}")
    if host == "localhost" or host.endswith(".localhost"):
        raise Refused(f"a local address: {url}")
    try:
        if not ipaddress.ip_address(host).is_global:
            raise Refused(f"a private address: {url}")
    except ValueError:
        pass
    if hosts and host not in {h.lower() for h in hosts}:
        raise Refused(f"host not allowed: {url}")
    return url


def url_allowed(url: Column, hosts: tuple[str, ...] = ()) -> Column:
    """The same rules as a column expression; literal addresses of private ranges are refused by pattern."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    local = (host == "localhost") | host.endswith(".localhost")
    private = host.rlike(r"^(0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(22[4-9]|2[3-5]\d)\.|^\[")
    ok = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.try_parse_url(url, F.lit("USERINFO")).isNull() & host.isNotNull() & (host != "") & ~local & ~private
    if hosts:
        ok = ok & host.isin(*[h.lower() for h in hosts])
    return F.coalesce(ok, F.lit(False))


def allowed_hosts(ecosystem: str, settings: Settings) -> tuple[str, ...]:
    more = tuple(h.strip() for h in settings.extra_hosts.split(",") if h.strip())
    return (NPM_HOSTS if ecosystem == "npm" else PYPI_HOSTS) + more


def service_hosts(settings: Settings) -> tuple[str, ...]:
    """Hosts that lookups may go to: those of the settings' services, the registries, and extra ones."""
    own = (settings.npm_registry, settings.pypi_registry, settings.osv_api, settings.pypi_integrity, settings.scorecard_api)
    return tuple(h for u in own if (h := urlsplit(u).hostname)) + allowed_hosts("npm", settings)


def sri_matches(integrity: Column, content: Column) -> Column:
    """Whether any token of an integrity text is the content's digest."""
    hexes = {"sha512": F.sha2(content, 512), "sha384": F.sha2(content, 384), "sha256": F.sha2(content, 256)}

    def one(token: Column) -> Column:
        kind, value = F.substring_index(token, "-", 1), F.substring_index(F.substring_index(token, "?", 1), "-", -1)
        given = F.lower(F.hex(F.try_to_binary(value, F.lit("base64"))))
        out = F.lit(False)
        for name, digest in hexes.items():
            out = out | F.coalesce((kind == name) & (given == digest), F.lit(False))
        return out

    return F.exists(F.filter(F.split(integrity, r"\s+"), lambda t: t != ""), one)


def npm_verified(content: Column, integrity: Column, shasum: Column) -> Column:
    """An integrity text decides where there is one, else the SHA-1; without either nothing is trusted."""
    return F.when(F.coalesce(integrity, F.lit("")) != "", sri_matches(integrity, content)).when(F.coalesce(shasum, F.lit("")) != "", F.lower(shasum) == F.sha1(content)).otherwise(F.lit(False))


def pypi_verified(content: Column, sha256: Column) -> Column:
    """The digest must be there and equal."""
    return F.coalesce(F.lower(sha256) == F.sha2(content, 256), F.lit(False))


def with_retry(call: Callable[[], object], limited: Callable[[Exception], bool], settings: Settings = Settings(), sleep=time.sleep):
    """Calls again after 1, 2, 4 ... seconds, or as many as the service asks for, while the failure is a rate limit.

    A service that asks for more than MAX_WAIT seconds isn't waited for."""
    for attempt in range(settings.max_retries + 1):
        try:
            return call()
        except Exception as e:
            wait = getattr(e, "wait", None)
            if attempt == settings.max_retries or not limited(e) or (wait or 0) > MAX_WAIT:
                raise
            sleep(2**attempt if wait is None else wait)


def download(url: str, hosts: tuple[str, ...], opener: Callable[[str], tuple[int, dict, object]], most: int) -> bytes:
    """Bytes of a URL, at most so many; each redirect is checked anew.

    opener(url) gives (status, lower-cased headers, iterable of bytes) without following redirects.
    """
    for _ in range(MAX_REDIRECTS + 1):
        status, headers, body = opener(check_url(url, hosts))
        if 300 <= status < 400 and headers.get("location"):
            url = urljoin(url, headers["location"])
            continue
        if status != 200:
            raise Refused(f"status {status}: {url}", status, asked_wait(headers))
        if int(headers.get("content-length") or 0) > most:
            raise Refused(f"declares more than {most} bytes: {url}")
        out = bytearray()
        for part in body:
            out += part
            if len(out) > most:
                raise Refused(f"more than {most} bytes: {url}")
        return bytes(out)
    raise Refused(f"too many redirects: {url}")


def https_opener(settings: Settings = Settings()):
    """An opener over the standard library that doesn't follow redirects."""
    import http.client

    def open_(url: str, post: str | None = None):
        parts = urlsplit(url)
        connection = http.client.HTTPSConnection(parts.hostname, parts.port or 443, timeout=settings.http_timeout_seconds)
        where = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
        if post is None:
            connection.request("GET", where)
        else:
            connection.request("POST", where, post.encode(), {"content-type": "application/json"})
        reply = connection.getresponse()
        return reply.status, {k.lower(): v for k, v in reply.getheaders()}, iter(lambda: reply.read(1 << 16), b"")

    return open_


#: Columns of requests that `fetched` carries along, so that archives needn't meet them in a join.
TOLD = ("ecosystem", "integrity", "shasum", "sha256")


def fetched(requests, settings: Settings = Settings(), opener=None, concurrency: int | None = None):
    """(pair_id, side, file_name, content, error) of requests (pair_id, side, ecosystem, file_name, url) (S10, S11, X01, X03),
    and what requests have of TOLD.

    The number of partitions bounds how many downloads run at once; a failure is a row's error.
    """
    told = [c for c in TOLD if c in requests.columns]
    kept = ["pair_id", "side", "file_name", *told]

    def run(batches):
        import pyarrow as pa

        get = opener or https_opener(settings)
        kind = pa.schema([(c, pa.string()) for c in kept] + [("content", pa.binary()), ("error", pa.string())])
        for b in batches:
            for r in b.to_pylist():
                row = {k: r[k] for k in kept} | {"content": None, "error": None}
                try:
                    row["content"] = with_retry(lambda: download(r["url"] or "", allowed_hosts(r["ecosystem"], settings), get, settings.max_download_bytes), limited, settings)
                except Exception as e:  # noqa: BLE001  one bad pair must not end the scan
                    row["error"] = str(e)
                yield pa.RecordBatch.from_pylist([row], kind)

    spread = requests.repartition(concurrency or settings.dependency_concurrency)
    made = ", ".join(f"{c} string" for c in kept) + ", content binary, error string"
    return spread.select(*kept, "url").mapInArrow(run, made)
