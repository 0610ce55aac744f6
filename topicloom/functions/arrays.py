"""Array expressions used on one-row-per-document tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Naming an expression in a projection does not ensure that: the optimizer may
    copy it to each place of use, also into lambdas that run per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def run_lengths(sorted_array: Column, values: str, counts: str) -> Column:
    """Struct of the distinct ``values`` of a sorted array and their ``counts``."""

    def starts(a):
        positions = F.sequence(F.lit(0), F.size(a) - 1)
        begins = F.filter(positions, lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))
        return F.when(F.size(a) > 0, begins).otherwise(F.expr("cast(array() as array<int>)"))

    def pair(a, s):
        return F.struct(
            F.transform(s, lambda i: F.get(a, i)).alias(values),
            F.transform(
                s, lambda start, at: F.coalesce(F.get(s, at + 1), F.size(a)) - start
            ).alias(counts),
        )

    return let(sorted_array, lambda a: let(starts(a), lambda s: pair(a, s)))
