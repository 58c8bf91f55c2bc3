"""Order statistics, predicates of a wanted selectivity, and selectivities."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P

#: Selectivities for which workloads are made (fixed values).
BANDS = (0.001, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75)
#: Distinct values up to which one window ranks them; beyond it ranges of values are ranked apart.
ONE_WINDOW = 50_000


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int], one_window: int = ONE_WINDOW) -> dict[int, float]:
    """Values at 0-based ranks of the column in ascending order, nulls left out. Ranks beyond the end are left out.

    Equal values are counted before anything is ordered, so a hot value is one row, and ranges of values, cut at rough
    quantiles, are ordered in different tasks."""
    counts = df.select(F.col(column).alias("x")).filter("x is not null").groupBy("x").agg(F.count("*").alias("c"))
    n, rows_in_all = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    cuts = [] if n <= one_window else sorted(set(counts.approxQuantile("x", [i / 64 for i in range(1, 64)], 0.005)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda e: e <= F.col("x"))) if cuts else F.lit(0)
    counts = counts.withColumn("part", part)
    sizes = {r["part"]: r["n"] for r in counts.groupBy("part").agg(F.sum("c").alias("n")).collect()} if cuts else {0: rows_in_all}
    before, at = {}, 0
    for k in sorted(sizes):
        before[k], at = at, at + sizes[k]
    wanted = sorted({r for r in ranks if 0 <= r < at})
    if not wanted:
        return {}
    offset = F.element_at(F.map_from_arrays(F.array(*[F.lit(k) for k in before]), F.array(*[F.lit(v).cast("long") for v in before.values()])), F.col("part"))
    upto = F.sum("c").over(Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + offset
    rows = counts.withColumn("upto", upto)
    inside = F.filter(F.array(*[F.lit(r).cast("long") for r in wanted]), lambda r: (r >= F.col("upto") - F.col("c")) & (r < F.col("upto")))
    return {r["rank"]: r["x"] for r in rows.select(F.explode(inside).alias("rank"), "x").collect()}


def quantile_rank(p: float, n: int) -> int:
    return min(n - 1, math.floor(min(1.0, max(0.0, p)) * n))


def quantiles(df: DataFrame, column: str, ps: Sequence[float]) -> list[float]:
    """The value at place floor(p * n), at most the last; 0 for an empty column."""
    n = df.filter(F.col(column).isNotNull()).count()
    if not n:
        return [0.0] * len(ps)
    ranks = [quantile_rank(p, n) for p in ps]
    found = order_statistics(df, column, ranks)
    return [found[r] for r in ranks]


#: Selectivity from which on a one-sided atom takes every value.
ALL = 0.999


def lt_for(df: DataFrame, column: str, *sels: float) -> list[P.Atom]:
    """An atom for each selectivity; all come from one pass over the order statistics."""
    top = df.agg(F.max(column)).first()[0] if max(sels) >= ALL else None
    return [P.lt(column, (top or 0.0) + 1 if s >= ALL else q) for s, q in zip(sels, quantiles(df, column, sels), strict=True)]


def gt_for(df: DataFrame, column: str, *sels: float) -> list[P.Atom]:
    low = df.agg(F.min(column)).first()[0] if max(sels) >= ALL else None
    return [P.gt(column, (low or 0.0) - 1 if s >= ALL else q) for s, q in zip(sels, quantiles(df, column, [1 - s for s in sels]), strict=True)]


def interval_for(df: DataFrame, column: str, *sels: float) -> list[P.Atom]:
    ends = quantiles(df, column, [e for s in sels for e in (0.5 - s / 2, 0.5 + s / 2)])
    return [P.interval(column, *ends[2 * k : 2 * k + 2]) for k in range(len(sels))]


def categories(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def selectivity(df: DataFrame, predicate: P.DNF) -> DataFrame:
    """The share of rows that satisfy the predicate; 0 without rows."""
    return df.agg(F.coalesce(F.avg(predicate.condition().cast("double")), F.lit(0.0)).alias("selectivity"))
