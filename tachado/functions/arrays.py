"""Array helpers: Column -> Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_STRETCH = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is referred to: as the one element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _from(base: Column, sizes: Column) -> Column:
    sums = F.aggregate(sizes, F.array(base), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.slice(sums, F.lit(1), F.size(sizes))


def sums_before(sizes: Column) -> Column:
    """For each whole number of an array the sum of those before it.

    An array that grows by one copies all it has at each step, so sums run inside stretches of bounded length, from
    the sums of the stretches before.
    """
    def of_stretches(stretches: Column) -> Column:
        totals = F.transform(stretches, lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x))
        return F.flatten(F.zip_with(stretches, _from(F.lit(0), totals), lambda xs, base: _from(base, xs)))

    def of_all(xs: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(xs), F.lit(_STRETCH))
        return F.when(F.size(xs) == 0, xs).otherwise(
            bound(F.transform(firsts, lambda at: F.slice(xs, at, F.lit(_STRETCH))), of_stretches))

    return bound(sizes, of_all)
