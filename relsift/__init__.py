"""Package-release diffs and risk scores as Spark DataFrame operations."""
