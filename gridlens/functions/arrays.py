"""Row-local array helpers: they need neither a key nor a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    A plain column reference may be inlined into every lambda that mentions
    it and then be computed again per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(ordered: Column, key: Callable[[Column], Column]) -> Column:
    """Runs of equal keys in a sorted array, as structs (start, len), 0-based."""

    def spans(items: Column) -> Column:
        positions = F.transform(
            items,
            lambda x, i: F.when(
                (i == 0) | (key(x) != key(F.get(items, i - 1))), i
            ),
        )
        starts = F.filter(positions, lambda p: p.isNotNull())
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda p, k: F.struct(
                    p.alias("start"),
                    (F.coalesce(F.get(s, k + 1), F.size(items)) - p).alias("len"),
                ),
            ),
        )

    return let(ordered, spans)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def preceding_sums(values: Column, block: int = 128) -> Column:
    """For each element, the sum of the integers before it.

    Sums of whole blocks come first, so a row with n elements costs about
    n * block steps and not n * n.
    """

    def inner(v: Column) -> Column:
        n_blocks = F.ceil(F.size(v) / F.lit(block)).cast("int")
        sums = F.when(
            F.size(v) > 0,
            F.transform(
                F.sequence(F.lit(0), n_blocks - 1),
                lambda b: F.aggregate(
                    F.slice(v, b * block + 1, F.lit(block)), F.lit(0), lambda a, x: a + x
                ),
            ),
        )
        before = let(
            sums,
            lambda s: F.transform(
                s, lambda _, b: F.aggregate(F.slice(s, F.lit(1), b), F.lit(0), lambda a, x: a + x)
            ),
        )
        return let(
            before,
            lambda base: F.transform(
                v,
                lambda _, i: F.get(base, F.floor(i / F.lit(block)).cast("int"))
                + F.aggregate(
                    F.slice(v, i - i % block + 1, i % block), F.lit(0), lambda a, x: a + x
                ),
            ),
        )

    return let(values, inner)


def softmax(scores: Column) -> Column:
    """Softmax of an array of scores, shifted by its maximum."""

    def shares(values: Column) -> Column:
        powers = let(
            F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top))
        )
        return let(powers, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))

    return let(scores, shares)
