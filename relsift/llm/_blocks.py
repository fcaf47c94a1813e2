"""Large cells cut into blocks, so that a task holds a block and no comparison is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks(rows: DataFrame, cuts: Column, node: Column, home: Column, *kept: str) -> DataFrame:
    """The rows (columns kept, cut, mine, other) dealt over the cuts x cuts blocks of their cell; line i, column j is cut i * cuts + j.

    A row at home stands in the blocks of a line as mine, and each row in those of a column as other: whatever is at
    home meets every row once, in a block that holds about 1 / cuts of either side. node: what rows are dealt by.
    """
    line, column = (F.pmod(F.xxhash64(node, F.lit(salt)), cuts).cast("int") for salt in (1, 2))
    rows = rows.select(*kept, cuts.cast("int").alias("__k"), line.alias("__line"), column.alias("__column"), home.alias("__home"))
    place = lambda cut, mine, other: F.struct(cut.alias("cut"), mine.alias("mine"), other.alias("other"))
    k, line, column, home = (F.col(c) for c in ("__k", "__line", "__column", "__home"))
    every = F.sequence(F.lit(0), k - 1)
    down = F.transform(every, lambda i: place(i * k + column, home & (i == line), F.lit(True)))
    along = F.transform(F.filter(every, lambda j: home & (j != column)), lambda j: place(line * k + j, F.lit(True), F.lit(False)))
    return rows.select(*kept, F.inline(F.when(k == 1, F.array(place(F.lit(0), home, F.lit(True)))).otherwise(F.concat(down, along))))
