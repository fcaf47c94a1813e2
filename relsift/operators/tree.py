"""File trees compared by path, and the diffs of their files.

package_files has rows (pair_id, side, path, text, size, sha256). Sides meet in one full outer
join on (pair_id, path) that carries hashes and sizes; unchanged files are dropped on their
hashes, so texts reach the Python diff only for files that changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relsift.operators import batches, diffing
from relsift.settings import Settings

#: Extensions of the files that are compared.
SOURCE_EXTENSIONS = (".js", ".mjs", ".cjs", ".ts", ".jsx", ".tsx", ".py", ".pyi", ".sh", ".bat", ".ps1", ".cmd")
#: Extensions and names that mark a native addon.
NATIVE_EXTENSIONS = (".node", ".so", ".pyd", ".dylib", ".dll", ".pyx")
NATIVE_NAME = "binding.gyp"

MODIFIED, ADDED, REMOVED = "modified", "added", "removed"


def suffix(path: Column) -> Column:
    """Lower-cased extension of the last path part; a leading dot alone starts none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def is_source(path: Column) -> Column:
    """Whether a file is compared at all."""
    return suffix(path).isin(*SOURCE_EXTENSIONS)


def decoded(content: Column) -> Column:
    """Bytes as text with universal newlines; bad bytes become replacement signs."""
    return F.regexp_replace(F.regexp_replace(content.cast("string"), "\r\n", "\n"), "\r", "\n")


def with_facts(files: DataFrame) -> DataFrame:
    """Adds text, size and sha256 to rows with binary content."""
    return files.withColumn("text", decoded(F.col("content"))).withColumn("size", F.length("content").cast("long")).withColumn("sha256", F.sha2("content", 256))


def compared(left: DataFrame, right: DataFrame, keys: list[str], same: Column, carry: list[str]) -> DataFrame:
    """Full outer join of two keyed sides with a status: added, removed, modified or unchanged.

    same is a condition over columns l.* and r.*; the columns of `carry` come as from_x and to_x.
    """
    a, b = left.alias("l"), right.alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys]
    joined = a.join(b, on, "full")
    first = keys[0]
    status = F.when(F.col(f"l.{first}").isNull(), ADDED).when(F.col(f"r.{first}").isNull(), REMOVED).when(same, "unchanged").otherwise(MODIFIED)
    return joined.select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys], *[F.col(f"l.{c}").alias(f"from_{c}") for c in carry], *[F.col(f"r.{c}").alias(f"to_{c}") for c in carry], status.alias("status"))


def tree_changes(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Changed source files: (pair_id, path, change_type, oversized, to_size, from_text, to_text).

    Texts are null where they won't be read: files over the size limit and removed files.
    """
    some = files.where(is_source(F.col("path")))
    facts = some.select("pair_id", "side", "path", "size", "sha256")
    a, b = facts.where("side = 'from'"), facts.where("side = 'to'")
    # universal newlines make files of different bytes equal, hence the texts' own check below
    status = compared(a, b, ["pair_id", "path"], F.col("l.sha256") == F.col("r.sha256"), ["size"]).where("status <> 'unchanged'")
    limit = settings.max_diff_file_bytes
    oversized = F.coalesce(F.col("to_size") > limit, F.lit(False)) | F.coalesce(F.col("from_size") > limit, F.lit(False))
    status = status.withColumn("oversized", oversized)
    wanted = status.where("not oversized and status <> 'removed'").select("pair_id", "path")
    texts = some.join(wanted, ["pair_id", "path"], "left_semi").groupBy("pair_id", "path").agg(F.max(F.when(F.col("side") == "from", F.col("text"))).alias("from_text"), F.max(F.when(F.col("side") == "to", F.col("text"))).alias("to_text"))
    out = status.join(texts, ["pair_id", "path"], "left")
    return out.where(~((F.col("status") == MODIFIED) & ~F.col("oversized") & (F.col("from_text") == F.col("to_text")))).withColumnRenamed("status", "change_type").drop("from_size")


def _diff_texts(old: str, new: str, path: str) -> tuple[str, int, int]:
    """Text of the unified diff and its added and removed lines.

    Lines keep their ends and are joined by newlines, so every other line is empty (D5), and
    changed lines that begin with ++ or -- are not counted (D7).
    """
    lines = diffing.unified(old.splitlines(True), new.splitlines(True), path)
    plus = sum(x[:1] == "+" and x[:3] != "+++" for x in lines)
    minus = sum(x[:1] == "-" and x[:3] != "---" for x in lines)
    return "\n".join(lines), plus, minus


def unified_diffs(changed: DataFrame, *kept: str) -> DataFrame:
    """Unified diffs of (pair_id, path, from_text, to_text), in Arrow batches; kept: further columns that stay."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches.slices(given, "from_text", "to_text"):
            made = [_diff_texts(old or "", new or "", path) for path, old, new in zip(*(b.column(c).to_pylist() for c in ("path", "from_text", "to_text")))]
            text, plus, minus = zip(*made) if made else ((), (), ())
            stay = ("pair_id", "path", *kept)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in stay), pa.array(text, pa.string()), pa.array(plus, pa.int64()), pa.array(minus, pa.int64())], [*stay, "unified_diff", "lines_added", "lines_removed"])

    asked = changed.select("pair_id", "path", "from_text", "to_text", *[c for c in kept if c not in ("from_text", "to_text")])
    more = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in asked.select(*kept).schema) if kept else ""
    return asked.mapInArrow(run, f"pair_id string, path string, {more}unified_diff string, lines_added long, lines_removed long")


def rebuilt(diffs: DataFrame) -> DataFrame:
    """(pair_id, path, changed, text): new texts from (pair_id, path, from_text, unified_diff); null where a diff doesn't fit its old text."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches.slices(given, "from_text", "unified_diff"):
            old, diff = (b.column(c).to_pylist() for c in ("from_text", "unified_diff"))
            made = [None if d is None else diffing.patched(o or "", d) for o, d in zip(old, diff)]
            yield pa.RecordBatch.from_arrays([b.column("pair_id"), b.column("path"), pa.array([bool(d) for d in diff]), pa.array(made, pa.string())], ["pair_id", "path", "changed", "text"])

    return diffs.select("pair_id", "path", "from_text", "unified_diff").mapInArrow(run, "pair_id string, path string, changed boolean, text string")


#: What ends a line for Python's splitlines once newlines are universal.
LINE_ENDS = "\n|\x0b|\x0c|\x1c|\x1d|\x1e|\x85| | "


def lines_of(text: Column) -> Column:
    """Lines without their ends; a last empty one is none."""
    parts = F.split(text, LINE_ENDS)
    return F.when(F.coalesce(F.element_at(parts, -1), F.lit("")) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def added_body(text: Column) -> Column:
    """Diff text of a new file: every line with a plus."""
    return F.array_join(F.transform(lines_of(text), lambda x: F.concat(F.lit("+"), x)), "\n")


def oversize_note(size: Column, settings: Settings = Settings()) -> Column:
    """Placeholder of a file too large to compare (C03b); a fixed value, as stored reports hold it."""
    return F.concat(F.lit("[diff skipped: file size "), size.cast("string"), F.lit(f" bytes exceeds max_diff_file_bytes={settings.max_diff_file_bytes}]"))


def file_diffs(files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(pair_id, path, change_type, lines_added, lines_removed, unified_diff, oversized) of all changed files.

    Removed files are named, with no diff and no count of lines (D4).
    """
    changed = tree_changes(files, settings)
    plain = changed.where((F.col("change_type") == MODIFIED) & ~F.col("oversized"))
    modified = unified_diffs(plain).select("pair_id", "path", F.lit(MODIFIED).alias("change_type"), "lines_added", "lines_removed", "unified_diff", F.lit(False).alias("oversized"))
    rest = changed.where((F.col("change_type") != MODIFIED) | F.col("oversized"))
    new = (F.col("change_type") == ADDED) & ~F.col("oversized")
    body = F.when(F.col("change_type") == REMOVED, F.lit(None)).when(F.col("oversized"), oversize_note(F.col("to_size"), settings)).otherwise(added_body(F.col("to_text")))
    count = F.when(new, F.size(lines_of(F.col("to_text")))).otherwise(0).cast("long")
    return rest.select("pair_id", "path", "change_type", count.alias("lines_added"), F.lit(0).cast("long").alias("lines_removed"), body.alias("unified_diff"), (F.col("oversized") & (F.col("change_type") != REMOVED)).alias("oversized")).unionByName(modified)


def summaries(diffs: DataFrame, texts: bool = True) -> DataFrame:
    """One row a pair: names by kind, sorted; diffs as modified then added by path (L01); total lines.

    Without texts the diffs are listed by path, kind and counts: a pair's row then follows its files' number and not their size."""
    kind = lambda k: F.sort_array(F.collect_list(F.when(F.col("change_type") == k, F.col("path"))))
    rank = F.when(F.col("change_type") == MODIFIED, 0).otherwise(1)
    one = F.struct(rank.alias("rank"), F.col("path"), F.col("change_type"), F.col("lines_added"), F.col("lines_removed"), F.col("unified_diff") if texts else F.lit(None).cast("string").alias("unified_diff"))
    out = diffs.groupBy("pair_id").agg(
        kind(ADDED).alias("files_added"),
        kind(REMOVED).alias("files_removed"),
        kind(MODIFIED).alias("files_modified"),
        F.sort_array(F.collect_list(F.when(F.col("change_type") != REMOVED, one))).alias("ordered"),
        F.sum(F.col("lines_added") + F.col("lines_removed")).alias("total_diff_lines"),
        F.array_sort(F.collect_list(F.when(F.col("oversized"), F.struct(rank.alias("rank"), F.col("path"))))).alias("skipped"),
    )
    drop_rank = lambda d: F.struct(d["path"].alias("path"), d["change_type"].alias("change_type"), d["lines_added"].alias("lines_added"), d["lines_removed"].alias("lines_removed"), d["unified_diff"].alias("unified_diff"))
    return out.select("pair_id", "files_added", "files_removed", "files_modified", F.transform("ordered", drop_rank).alias("file_diffs"), "total_diff_lines", F.transform("skipped", lambda s: s["path"]).alias("skipped_files"))


def counts(files: DataFrame) -> DataFrame:
    """(pair_id, side, files, source_files): files of whole trees at any depth, and those that are compared."""
    return files.groupBy("pair_id", "side").agg(F.count("*").alias("files"), F.count_if(is_source(F.col("path"))).alias("source_files"))


def has_native(files: DataFrame) -> DataFrame:
    """(pair_id, side, native): any sign of a compiled or buildable addon."""
    name = F.element_at(F.split("path", "/"), -1)
    built = (F.col("path") == "setup.py") & (F.contains("text", F.lit("ext_modules")) | F.contains("text", F.lit("Extension(")))
    return files.groupBy("pair_id", "side").agg(F.bool_or((name == NATIVE_NAME) | suffix(F.col("path")).isin(*NATIVE_EXTENSIONS) | F.coalesce(built, F.lit(False))).alias("native"))


def digests(files: DataFrame) -> DataFrame:
    """(pair_id, side, digest) of whole trees: of paths and the files' own digests, in order of paths."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat_ws(":", x["path"], x["sha256"]))
    return files.groupBy("pair_id", "side").agg(F.sha2(F.array_join(listed, "\n"), 256).alias("digest"))


def multiset_line_changes(pairs: DataFrame) -> DataFrame:
    """(key, lines_added, lines_removed) of (key, from_text, to_text): lines counted as multisets, all in the JVM.

    Cheaper than a diff where order doesn't matter: one shuffle on (key, line), counts summed ahead of it.
    """
    old = pairs.select("key", F.explode(F.split("from_text", "\n")).alias("line"), F.lit(-1).alias("n"))
    new = pairs.select("key", F.explode(F.split("to_text", "\n")).alias("line"), F.lit(1).alias("n"))
    net = old.unionAll(new).groupBy("key", "line").agg(F.sum("n").alias("n"))
    return net.groupBy("key").agg(F.sum(F.greatest("n", F.lit(0))).cast("long").alias("lines_added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).cast("long").alias("lines_removed"))
