"""Schemas of the data model, and its fixed tables."""

from __future__ import annotations

SCHEMA_VERSION = "0.4.0"

PAIRS = "pair_id string, ecosystem string, package string, from_version string, to_version string"
FILES = "pair_id string, side string, path string, content binary"
DIMENSION = "struct<name:string,label:string,score:double,weight:double,reasoning:string,confidence:double>"
FEED = "struct<source:string,status:string,details:string,url:string,advisory_ids:array<string>,signing_identity:string,signing_identity_changed:boolean,scorecard_score:double>"
MODIFIER = "struct<source:string,rule:string,delta:double,note:string>"
FILE_DIFF = "struct<path:string,change_type:string,lines_added:bigint,lines_removed:bigint,unified_diff:string>"
SUMMARY = (
    "struct<files_added:array<string>,files_removed:array<string>,files_modified:array<string>,"
    f"file_diffs:array<{FILE_DIFF}>,new_dependencies:array<string>,removed_dependencies:array<string>,"
    "new_install_hooks:array<string>,maintainer_changed:boolean,native_addons_added:boolean,total_diff_lines:bigint,"
    "chunks_sent_to_llm:bigint,diff_truncated:boolean,truncated_files:array<string>,skipped_files:array<string>,"
    "large_files_split:boolean,split_files:array<string>,files_not_analyzed:array<string>,comments_stripped:boolean,"
    "comment_lines_stripped:bigint>"
)
TIMINGS = "struct<fetch_seconds:double,diff_seconds:double,llm_seconds:double,feeds_seconds:double,analysis_seconds:double,total_seconds:double>"
REPORT_FIELDS = (
    "schema_version string", "ecosystem string", "package string", "from_version string", "to_version string",
    "risk_score double", "severity string", "llm_base_score double", f"dimensions array<{DIMENSION}>",
    f"feed_results array<{FEED}>", f"score_modifiers array<{MODIFIER}>", "caveats array<string>",
    f"diff_summary {SUMMARY}", "llm_model string", "llm_summary string", "timestamp timestamp",
    "from_version_sha256 string", "to_version_sha256 string", f"timings {TIMINGS}",
)
REPORT = ", ".join(REPORT_FIELDS)

#: The risk dimensions, with labels and weights (which add up to 1).
DIMENSIONS = (
    ("network_calls", "New or changed network calls", 0.20),
    ("obfuscation", "Obfuscation / encoding patterns (base64, eval, dynamic require)", 0.20),
    ("install_hooks", "Postinstall / preinstall script additions or changes", 0.15),
    ("env_conditional", "Conditional logic gated on env vars/platform/CI, or environment variables read/exfiltrated for credential theft", 0.15),
    ("dependency_changes", "Dependency graph changes (new transitive deps)", 0.10),
    ("resource_exhaustion", "Denial-of-service / resource-exhaustion patterns (unbounded loops, recursion, unthrottled blocking calls)", 0.20),
)

#: The feeds in the order in which they are reported and folded.
FEEDS = ("osv", "rekor", "scorecard", "new_deps")

ECOSYSTEMS = ("npm", "pypi")
#: Severities by the least score of each.
SEVERITIES = (("CRITICAL", 80), ("HIGH", 55), ("MEDIUM", 30), ("LOW", 0))
