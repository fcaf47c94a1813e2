"""Intermediate tables in the cluster's shared folder, and columns by their exact names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relsift.session import dropped, new_folder, prepare, scratch, shared_folder, written  # noqa: F401  for this subpackage


def column(name: str, of: str | None = None) -> Column:
    """The column, or field of a struct, of exactly this name, whatever signs it holds."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted).alias(name)
