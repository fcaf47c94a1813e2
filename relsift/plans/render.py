"""Reports and scans for people: plain text on the driver, one report or one bounded table at a time.

What packages say is untrusted: control signs are shown as text, and nothing is parsed as markup (K08).
"""

from __future__ import annotations

import json
import logging
import re
import sys

from pyspark.sql import DataFrame

CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f-\x9f]")


def plain(text) -> str:
    return CONTROL.sub(lambda m: f"\\x{ord(m[0]):02x}", "" if text is None else str(text))


def bar(score: float, width: int = 40) -> str:
    full = int(min(max(score, 0), 100) / 100 * width)
    return "█" * full + "░" * (width - full)


def report_text(r: dict) -> str:
    """Eight sections: heading, score, dimensions, feeds, modifiers, caveats, diff, summary."""
    d = r.get("diff_summary") or {}
    out = [f"{r['ecosystem']}: {r['package']} {r['from_version']} -> {r['to_version']}", f"risk {r['risk_score']:.1f}/100 {r['severity']}  {bar(r['risk_score'])}", "", "Dimensions"]
    out += [f"  {x['label']}: {x['score']:.1f}/10 (weight {x['weight']:.2f}) {x['reasoning']}" for x in r["dimensions"]]
    out += ["", "Feeds"] + [f"  {x['source']}: {x['status']} {x['details']}" + (f" ({x['url']})" if x.get("url") else "") for x in r["feed_results"]]
    if r.get("score_modifiers"):
        out += ["", f"Modifiers (base {r['llm_base_score']:.1f})"] + [f"  {m['delta']:+.1f} {m['source']}/{m['rule']}: {m['note']}" for m in r["score_modifiers"]]
    if r.get("caveats"):
        out += ["", "Caveats"] + [f"  - {c}" for c in r["caveats"]]
    out += ["", "Diff", f"  +{len(d.get('files_added') or [])} -{len(d.get('files_removed') or [])} ~{len(d.get('files_modified') or [])} files, {d.get('total_diff_lines') or 0} changed lines"]
    out += [f"  new dependency: {x}" for x in d.get("new_dependencies") or []] + [f"  dependency gone: {x}" for x in d.get("removed_dependencies") or []] + [f"  new install hook: {x}" for x in d.get("new_install_hooks") or []]
    out += [f"  {said}" for name, said in (("maintainer_changed", "maintainers differ"), ("native_addons_added", "native code is new")) if d.get(name)]
    out += ["", "Summary", f"  {r.get('llm_summary') or ''}"]
    return "\n".join(plain(x) for x in out)


def scan_text(rows: list[dict]) -> str:
    """A line a dependency, and counts: all, diffed, flagged, errored."""
    out = [f"{r['package']} {r['from_version'] or '-'} -> {r['to_version']}: " + (f"error: {r['error']}" if r["error"] else f"{r['risk_score']:.1f} {r['severity']}") for r in rows]
    scored = [r for r in rows if not r["error"]]
    out.append(f"{len(rows)} dependencies, {len(scored)} diffed, {sum(r['severity'] != 'LOW' for r in scored)} flagged, {len(rows) - len(scored)} errored")
    return "\n".join(plain(x) for x in out)


def error_text(message: str, as_json: bool) -> str:
    return json.dumps({"error": message}) if as_json else f"error: {plain(message)}"


def emit(text: str, output: str | None = None) -> None:
    """To a file if one is named, else to stdout, which carries nothing but results."""
    if output:
        with open(output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        sys.stdout.write(text + "\n")


def log_to_stderr(verbose: bool) -> None:
    """Logs never mix with results."""
    logging.basicConfig(stream=sys.stderr, level=logging.DEBUG if verbose else logging.WARNING, format="%(levelname)s %(name)s: %(message)s")


def json_lines(df: DataFrame) -> list[str]:
    """JSON texts of a bounded result: one report, or a scan's entries."""
    from relsift.sources.reports import as_json

    return [r.value for r in as_json(df).collect()]
