"""Greedy packing of rows into bounded chunks, for keys of any size.

Rows are taken in order; a chunk that holds something closes when the next row doesn't fit. Where a chunk may begin depends on
the sum of sizes before it alone, so a key's rows are numbers on a line, and chunk heads are the orbit of 0 under one
function: from x on to the greatest sum within the room, or over the one row at x where that has no room. The steps:

1. Running sums: rows are sorted by key and order, dealt by range; each range sums its own, and ranges' totals are added up.
2. Each key's line is cut into stretches of SPAN rooms, or of LEAST_WIDE where that is more: with little or no room a stretch would
   else hold a row or none, and a call of Python be spent on each. A stretch, with the first sums of the next, is all that is needed to
   follow the function from any of its sums to the first head beyond: these jumps are kept for sums by which one can come in.
3. Jumps from 0 on give each stretch's first head and its number: by one task while jumps are few, else by
   pointer doubling, each round a written table.
4. Each stretch numbers its rows from its first head.

A stretch holds at most as many sums as it is wide, distinct whole numbers, whatever the key; nothing else is grouped. Rows of size 0 stay in the chunk
before them, unless that is one row too large for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relsift.session import prepare, written

SPAN = 16
#: A stretch is so wide at least, and so holds so many sums at most where rooms are small.
LEAST_WIDE = 1 << 20
#: So many jumps are one task's work.
ALONE = 1 << 20


def running_sums(rows: DataFrame, key: str, order: list[str], size: str, out: str = "ahead") -> DataFrame:
    """rows with the sum of sizes before each, by order within key; no task holds a key."""
    prepare(rows.sparkSession)
    ordered = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("__part", F.spark_partition_id())
    local = written(ordered.withColumn("__n", F.monotonically_increasing_id()), "ordered")
    # a range's own running sums: rows of a key within a range
    totals = local.groupBy(key, "__part").agg(F.sum(size).alias("__total"))
    ahead = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("__start", F.coalesce(F.sum("__total").over(ahead), F.lit(0)).cast("long")).drop("__total")
    own = Window.partitionBy("__part", key).orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)
    summed = local.withColumn(out, F.coalesce(F.sum(size).over(own), F.lit(0)).cast("long"))
    a, b = summed.alias("a"), starts.alias("b")
    return a.join(b, (F.col("a.__part") == F.col("b.__part")) & F.equal_null(F.col(f"a.{key}"), F.col(f"b.{key}"))).select(*[F.col(f"a.{c}") for c in rows.columns], (F.col(f"a.{out}") + F.col("b.__start")).alias(out))


def follow(at: np.ndarray, size: np.ndarray, room: int, first_room: int) -> np.ndarray:
    """The next head after each sum of `at` (sorted, distinct); size is that of the row that begins there, 0 for none."""
    reach = np.maximum(np.where(at == 0, first_room, room), 0)
    last = np.searchsorted(at, at + reach, "right") - 1
    to, end = at[last], at[last] + size[last]
    to = np.where(end <= at + reach, end, to)  # a key's last row, behind which no other begins
    return np.where(to > at, to, at + size)


LINE = "key long, stretch long, ahead long, n long, own boolean, over boolean, room long, first_room long, wide long"


class Stretch:
    """A stretch of a key's line, from the rows of LINE, in its order of sums."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("ahead")
        column = lambda c: table.column(c).to_numpy()
        one = lambda c: table.column(c)[0].as_py()
        self.key, self.stretch, self.room, self.first_room, wide = map(one, ("key", "stretch", "room", "first_room", "wide"))
        self.at, self.size, self.over, self.start, self.end = column("ahead"), column("n"), column("over"), self.stretch * wide, (self.stretch + 1) * wide
        self.own = int(np.searchsorted(self.at, self.end))
        self.nexts = follow(self.at, self.size, self.room, self.first_room)

    def jumps(self) -> pa.Table:
        """(key, stretch, at, to, heads): where one comes in, where one goes on to, and the heads passed until there."""
        own, nexts = self.own, self.nexts[: self.own]
        to, heads = nexts.copy(), np.ones(own, np.int64)
        place = np.searchsorted(self.at[:own], nexts)
        for i in range(own - 1, -1, -1):
            if self.at[i] < nexts[i] and place[i] < own and self.at[place[i]] == nexts[i]:
                to[i], heads[i] = to[place[i]], heads[place[i]] + 1
        entry = self.at[:own] - self.start <= max(self.room, self.first_room, 0)
        entry[:1] = True  # what comes over a row too large
        n = int(entry.sum())
        return pa.table({"key": pa.array([self.key] * n, pa.int64()), "stretch": pa.array([self.stretch] * n, pa.int64()), "at": self.at[:own][entry], "to": to[entry], "heads": heads[entry]})

    def numbered(self, entry: int, number: int) -> pa.Table:
        """(key, ahead, chunk, empty): chunk of the row that begins at a sum, and of rows of size 0 there."""
        heads = [entry]
        place = dict(zip(self.at[: self.own].tolist(), self.nexts[: self.own].tolist()))
        while heads[-1] < place.get(heads[-1], -1) < self.end:
            heads.append(place[heads[-1]])
        at = self.at[: self.own]
        chunk = number - 1 + np.searchsorted(np.array(heads), at, "right")
        head = np.isin(at, heads) & (at > 0)
        # a chunk of a row too large is closed, else rows of size 0 still fit
        return pa.table({"key": pa.array([self.key] * len(at), pa.int64()), "ahead": at, "chunk": chunk, "empty": chunk - (head & ~self.over[: self.own])})


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, stretch, entry, number): the first head of each stretch, from all jumps (key, stretch, at, to, heads)."""
    jumps = {(key, at): (stretch, to, heads) for b in batches for key, stretch, at, to, heads in zip(*(c.to_pylist() for c in b.columns))}
    out = []
    for key in dict.fromkeys(k for k, _ in jumps):
        at, number = 0, 0
        while found := jumps.get((key, at)):
            stretch, to, heads = found
            out.append((key, stretch, at, number))
            if to <= at:
                break
            at, number = to, number + heads
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["key", "stretch", "entry", "number"])


def _doubled(jumps: DataFrame) -> DataFrame:
    """As _walk, by pointer doubling: each round knows twice as many heads, and its jumps reach twice as far."""
    places = jumps.select("key", "at", "stretch")
    known = written(jumps.where("at = 0").select("key", "at", F.lit(0).cast("long").alias("number")), "known")
    while True:
        on = known.join(jumps.where("to > at"), ["key", "at"]).select("key", F.col("to").alias("at"), (F.col("number") + F.col("heads")).alias("number"))
        more = written(on.join(places, ["key", "at"], "left_semi").join(known, ["key", "at"], "left_anti"), "more")
        if more.isEmpty():
            return known.join(places, ["key", "at"]).select("key", "stretch", F.col("at").alias("entry"), "number")
        known = written(known.unionByName(more), "known")
        far = jumps.where("to > at").select("key", F.col("at").alias("to"), F.col("to").alias("on"), F.col("heads").alias("more"))
        jumps = written(jumps.join(far, ["key", "to"], "left").select("key", "stretch", "at", F.coalesce("on", "to").alias("to"), (F.col("heads") + F.coalesce("more", F.lit(0))).alias("heads")), "jumps")


def packed(rows: DataFrame, key: str, order: list[str], size: str, room: Column, first_room: Column | None = None, alone: int = ALONE) -> DataFrame:
    """rows with their chunk's number (long) as `chunk`.

    room: what later chunks hold, first_room what a key's first one does; each is one number a key. Null sizes are 0, a null key is a key, equal
    places in order are taken in any order. An empty table gives an empty one.
    """
    name = F.xxhash64(F.col(key).cast("string"), F.col(key).isNull())
    made = rows.withColumns({"__room": room.cast("long"), "__first": (room if first_room is None else first_room).cast("long"), "__size": F.coalesce(F.col(size), F.lit(0)).cast("long")})
    summed = written(running_sums(made, key, order, "__size", "__ahead").withColumn("__key", name), "sums")
    reach = F.greatest("room", "first_room", F.lit(0))
    line = summed.select(F.col("__key").alias("key"), F.col("__ahead").alias("ahead"), F.col("__size").alias("n"), F.col("__room").alias("room"), F.col("__first").alias("first_room")).withColumn("wide", F.greatest(reach * SPAN, F.lit(LEAST_WIDE)))
    large = F.col("n") > F.when(F.col("ahead") == 0, F.col("first_room")).otherwise(F.col("room"))
    stretch = lambda at: F.floor(at / F.col("wide"))
    here = lambda at, shift, n, own, over: F.struct((stretch(at) - shift).alias("stretch"), at.alias("ahead"), n.cast("long").alias("n"), F.lit(own).alias("own"), F.lit(over).alias("over"))
    ahead, n = F.col("ahead"), F.col("n")
    # the first sums of a stretch are what the one before looks ahead to; the end of a row too large is marked
    early = (ahead - stretch(ahead) * F.col("wide") <= reach) & (stretch(ahead) > 0)
    places = F.array(here(ahead, 0, n, True, False), F.when(early, here(ahead, 1, n, False, False)), F.when(large, here(ahead + n, 0, F.lit(0), False, True)))
    dealt = line.select("key", "room", "first_room", "wide", F.inline(F.array_compact(places)))
    few = dealt.groupBy("key", "stretch", "ahead", "room", "first_room", "wide").agg(F.max("n").alias("n"), F.bool_or("own").alias("own"), F.bool_or("over").alias("over"))
    # a mark alone is no sum of a row
    few = written(few.where("own or not over").select(*[c.split()[0] for c in LINE.split(", ")]), "line")
    jumps = written(few.groupBy("key", "stretch").applyInArrow(lambda t: Stretch(t).jumps(), "key long, stretch long, at long, to long, heads long"), "jumps")
    known = jumps.coalesce(1).mapInArrow(_walk, "key long, stretch long, entry long, number long") if jumps.count() <= alone else _doubled(jumps)
    entered = few.join(known, ["key", "stretch"])
    numbers = entered.groupBy("key", "stretch").applyInArrow(lambda t: Stretch(t).numbered(t.column("entry")[0].as_py(), t.column("number")[0].as_py()), "key long, ahead long, chunk long, empty long")
    numbers = numbers.select(F.col("key").alias("__key"), F.col("ahead").alias("__ahead"), F.col("chunk").alias("__chunk"), F.col("empty").alias("__empty"))
    out = summed.join(numbers, ["__key", "__ahead"])
    return out.select(*rows.columns, F.when(F.col("__size") > 0, F.col("__chunk")).otherwise(F.col("__empty")).alias("chunk"))
