"""Array expressions that stay in Spark: sums along an array and cuts of a text, also for very many elements.

An array is taken in blocks of about the square root of its length, so that the work for n elements
grows as n ** 1.5; building an array element by element would copy it each time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column) -> Column:
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int"))
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.slice(items, at, size))


def before(values: Column, op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element, ``op`` over ``zero`` and the elements before it."""

    def each(blocks: Column, whole: Column) -> Column:
        def block(b: Column, k: Column) -> Column:
            base = F.aggregate(F.slice(whole, F.lit(1), k), zero, op)
            return let(base, lambda first: F.transform(b, lambda _, i: F.aggregate(F.slice(b, F.lit(1), i), first, op)))

        return F.flatten(F.transform(blocks, block))

    def folded(blocks: Column) -> Column:
        return let(F.transform(blocks, lambda b: F.aggregate(b, zero, op)), lambda whole: each(blocks, whole))

    return let(values, lambda v: let(_blocks(v), folded))


def sums_before(values: Column) -> Column:
    """For each element of an array of int the sum of those before it."""
    return before(values, lambda a, b: a + b, F.lit(0))


def greatest_before(values: Column) -> Column:
    """For each element of an array of int the greatest of those before it, 0 at least."""
    return before(values, lambda a, b: F.greatest(a, b), F.lit(0))


def pieces(text: Column, spans: Column) -> Column:
    """The pieces of a text at spans (start, end) that rise and don't overlap, in code points."""

    def block(t: Column, b: Column) -> Column:
        low, high = F.element_at(b, 1)["start"], F.element_at(b, -1)["end"]
        part = F.substring(t, low + 1, high - low)
        return let(part, lambda p: F.transform(b, lambda s: F.substring(p, s["start"] - low + 1, s["end"] - s["start"])))

    return let(text, lambda t: let(spans, lambda v: F.flatten(F.transform(_blocks(v), lambda b: block(t, b)))))
