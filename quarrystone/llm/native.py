"""Column helpers for the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once for a row, however often use names it, also inside other lambdas."""
    return F.transform(F.array(value), use)[0]


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def prefix_sums(numbers: Column, chunk: int = 128) -> Column:
    """What lies before each of an array of longs, in chunks, so that long arrays cost little more than their length."""

    def of_chunks(chunks: Column) -> Column:
        return let(
            F.transform(chunks, total),
            lambda sums: F.flatten(
                F.transform(chunks, lambda c, k: let(total(F.slice(sums, 1, k)), lambda before: F.transform(c, lambda x, i: before + total(F.slice(c, 1, i)))))
            ),
        )

    def of(a: Column) -> Column:
        return F.when(F.size(a) == 0, a).otherwise(
            let(F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / chunk).cast("int")), lambda c: F.slice(a, c * chunk + 1, chunk)), of_chunks)
        )

    return let(numbers, of)
