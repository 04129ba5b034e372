"""Running aggregates of an ordered sequence, computed in slices of time.

A window over all rows of a key is one task's work, however busy the key. Here the rows of a key are cut into slices of time: each slice is
summed up in parallel, a prefix over the slices of a key (a row each) gives what came before each of them, and rows add that to what they
have within their slice. So a key that has all rows is as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a slice: long enough that slices are few beside rows, short enough that a busy key has many.
SLICE = 21_600_000_000


def with_slice(rows: DataFrame, width: int = SLICE, us: str = "us") -> DataFrame:
    return rows.withColumn("_slice", F.floor(F.col(us) / width))


def meet(rows: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns that ``per`` has for their keys; null keys are keys as well."""
    named = per.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(named, same).drop(*[f"_key_{k}" for k in keys])


def running(rows: DataFrame, by: list[str], order: list[str], totals: dict[str, Column], firsts: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """Adds, up to and with each row, in ``order`` among the rows alike in ``by``: sums of ``totals``, least of ``firsts``, greatest of ``lasts``.

    ``rows`` has _slice, which must follow the order; ``by`` need not. A null counts for nothing; a sum of nothing is 0, a least or greatest null.
    """
    firsts, lasts = firsts or {}, lasts or {}
    inside = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    names = [*totals, *firsts, *lasts]
    made = rows.withColumns({f"_in_{n}": c for n, c in {**totals, **firsts, **lasts}.items()})
    how = {**{n: F.sum for n in totals}, **{n: F.min for n in firsts}, **{n: F.max for n in lasts}}
    slices = made.groupBy(*by, "_slice").agg(*[how[n](f"_in_{n}").alias(f"_of_{n}") for n in names])
    slices = slices.select(*by, "_slice", *[how[n](f"_of_{n}").over(before).alias(f"_before_{n}") for n in names])
    within = made.withColumns({f"_in_{n}": how[n](f"_in_{n}").over(inside) for n in names})
    joined = meet(within, slices, [*by, "_slice"])
    value = {n: F.coalesce(f"_before_{n}", F.lit(0)) + F.coalesce(f"_in_{n}", F.lit(0)) for n in totals}
    value |= {n: F.least(f"_before_{n}", f"_in_{n}") for n in firsts} | {n: F.greatest(f"_before_{n}", f"_in_{n}") for n in lasts}
    return joined.withColumns(value).drop(*[f"{p}{n}" for n in names for p in ("_in_", "_before_")])


def with_reach(rows: DataFrame, reach: int, width: int = SLICE, us: str = "us") -> DataFrame:
    """``rows`` with ``_slice``, and with copies of those that later slices look back on within ``reach``, marked by ``_context``.

    A frame [us - reach, us] of a row then lies in its own slice. A row is copied to as many slices as reach is wide, to one if it is less.
    """
    slice_of = lambda c: F.floor(c / width)
    spread = rows.withColumn("_slice", F.explode(F.sequence(slice_of(F.col(us)), slice_of(F.col(us) + reach))))
    return spread.withColumn("_context", F.col("_slice") > slice_of(F.col(us)))


def reach_slice(reach: int, width: int = SLICE) -> int:
    """A width of slices for frames of ``reach``: at least four times as wide, so that at most about a fourth of the rows is copied."""
    return max(width, 4 * reach)
