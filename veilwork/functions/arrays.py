"""Running values along an array of a row, in time that grows with the array's length.

``aggregate`` copies what it has gathered at each step, so gathering n values with it takes n squared. Here an array is cut
into blocks: within a block values are gathered so, then each block's values are moved on by what the blocks before it make.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each item what ``combine`` (associative, of whole numbers) makes of ``zero`` and the values of all items before it.

    An empty array gives an empty one, null gives null. Values must not be null.
    """
    none = F.array().cast("array<int>")

    def within(block: Column) -> Column:
        start = F.struct(F.lit(zero).alias("all"), none.alias("before"))
        return F.aggregate(block, start, lambda s, x: F.struct(combine(s["all"], value(x)).alias("all"), F.concat(s["before"], F.array(s["all"])).alias("before")))

    def cut(all_: Column) -> Column:
        firsts = F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.size(all_) - 1, F.lit(BLOCK))).otherwise(none)
        return F.transform(firsts, lambda i: within(F.slice(all_, i + 1, F.lit(BLOCK))))

    def joined(s: Column, block: Column) -> Column:
        moved = F.transform(block["before"], lambda v: combine(s["all"], v))
        return F.struct(combine(s["all"], block["all"]).alias("all"), F.concat(s["before"], F.array(moved)).alias("before"))

    start = F.struct(F.lit(zero).alias("all"), F.array().cast("array<array<int>>").alias("before"))
    return let(items, lambda all_: F.flatten(F.aggregate(cut(all_), start, joined, lambda s: s["before"])))


def prefix_sums(items: Column, value: Callable[[Column], Column]) -> Column:
    return running(items, value, lambda a, b: a + b, 0)


def prefix_greatest(items: Column, value: Callable[[Column], Column]) -> Column:
    """The greatest value, none of which is below 0, of the items before; -1 where there are none."""
    return running(items, value, lambda a, b: F.greatest(a, b), -1)
