"""Manifest facts of both sides compared: dependencies, install hooks, authors, native addons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relsift.operators.tree import has_native
from relsift.sources.manifests import manifest_facts

#: Hooks that run at install time, in the order in which they are reported.
HOOKS = ("postinstall", "preinstall", "install")


def added_and_removed(old: Column, new: Column) -> tuple[Column, Column]:
    """Sorted set differences both ways."""
    return F.sort_array(F.array_except(new, old)), F.sort_array(F.array_except(old, new))


def new_hooks(old: Column, new: Column) -> Column:
    """Hook names that only the new side has (J03); null scripts on either side give none."""
    known = F.array(*map(F.lit, HOOKS))
    return F.coalesce(F.filter(known, lambda h: F.array_contains(new, h) & ~F.array_contains(old, h)), F.array().cast("array<string>"))


def differs(old: Column, new: Column) -> Column:
    """Whether two values are both there and unlike."""
    return F.coalesce(old != new, F.lit(False))


def metadata_diff(files: DataFrame) -> DataFrame:
    """(pair_id, new_dependencies, removed_dependencies, new_install_hooks, maintainer_changed, native_addons_added)."""
    facts = manifest_facts(files).join(has_native(files), ["pair_id", "side"], "full")
    one = F.struct("deps", "has_npm", "scripts", "author", "py_author", "native")
    both = facts.groupBy("pair_id").agg(F.max(F.when(F.col("side") == "from", one)).alias("f"), F.max(F.when(F.col("side") == "to", one)).alias("t"))
    empty = F.array().cast("array<string>")
    deps = lambda s: F.coalesce(F.col(f"{s}.deps"), empty)
    added, removed = added_and_removed(deps("f"), deps("t"))
    npm = F.coalesce(F.col("f.has_npm") & F.col("t.has_npm"), F.lit(False))
    hooks = F.when(npm, new_hooks(F.col("f.scripts"), F.col("t.scripts"))).otherwise(empty)
    maintainer = (npm & ~F.col("f.author").eqNullSafe(F.col("t.author"))) | differs(F.col("f.py_author"), F.col("t.py_author"))
    native = F.coalesce(F.col("t.native"), F.lit(False)) & ~F.coalesce(F.col("f.native"), F.lit(False))
    return both.select("pair_id", added.alias("new_dependencies"), removed.alias("removed_dependencies"), hooks.alias("new_install_hooks"), maintainer.alias("maintainer_changed"), native.alias("native_addons_added"))
