"""Settings that change results, from arguments or the environment (prefix RELSIFT_, also read from a .env file)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "RELSIFT_"


@dataclass(frozen=True)
class Settings:
    """Bounds are inclusive and checked; URLs lose trailing slashes."""

    max_tokens_per_chunk: int = 8_000
    max_diff_file_bytes: int = 2 * 1024 * 1024
    max_split_parts_per_file: int = 16
    max_chunks_per_analysis: int = 40
    max_download_bytes: int = 100 * 1024 * 1024
    max_extracted_bytes: int = 500 * 1024 * 1024
    max_archive_files: int = 25_000
    max_archive_file_bytes: int = 50 * 1024 * 1024
    max_response_tokens: int = 4_096
    max_retries: int = 3
    http_timeout_seconds: float = 30.0
    chunk_concurrency: int = 4
    dependency_concurrency: int = 3
    npm_registry: str = "https://registry.npmjs.org"
    pypi_registry: str = "https://pypi.org/pypi"
    osv_api: str = "https://api.osv.dev/v1"
    pypi_integrity: str = "https://pypi.org/integrity"
    scorecard_api: str = "https://api.securityscorecards.dev"
    extra_hosts: str = ""

    def __post_init__(self):
        for name, (low, high) in BOUNDS.items():
            value = getattr(self, name)
            if not low <= value <= high:
                raise ValueError(f"{name} must be from {low} to {high}, not {value}")
        for name in ("npm_registry", "pypi_registry", "osv_api", "pypi_integrity", "scorecard_api"):
            object.__setattr__(self, name, getattr(self, name).rstrip("/"))

    @property
    def budget_chars(self) -> int:
        return self.max_tokens_per_chunk * CHARS_PER_TOKEN

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, dotenv: str | None = ".env") -> Settings:
        """The environment goes before the .env file, and that before defaults."""
        found = {}
        if dotenv and Path(dotenv).is_file():
            for line in Path(dotenv).read_text().splitlines():
                key, eq, value = line.partition("=")
                if eq and not key.lstrip().startswith("#"):
                    found[key.strip()] = value.strip().strip("\"'")
        found.update(os.environ if env is None else env)
        given = {}
        for f in fields(cls):
            if (text := found.get(PREFIX + f.name.upper())) is not None:
                given[f.name] = type(f.default)(text)
        return cls(**given)


#: Fixed value: the approximation that all budgets rest on.
CHARS_PER_TOKEN = 4

#: Least and greatest of each bounded setting.
BOUNDS = {
    "max_tokens_per_chunk": (1_000, 50_000),
    "max_split_parts_per_file": (1, 200),
    "max_chunks_per_analysis": (1, 1_000),
    "max_response_tokens": (256, 8_192),
    "max_retries": (0, 10),
    "http_timeout_seconds": (5, float("inf")),
}
