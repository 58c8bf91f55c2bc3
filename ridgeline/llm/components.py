"""Connected components of an edge list by alternating large-star and small-star steps, all in grouped aggregates.

Every step is written to the shared folder, so an executor's loss repeats one step at most; nothing is collected but two
numbers a round. The joins have a plain exchange on both sides, so that a hub with many neighbours is split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import settle

MAX_ROUNDS = 60


def _star(edges: DataFrame, *, large: bool) -> DataFrame:
    """edges(a, b) with a > b. Large star: each node's larger neighbours go to its least one; small star: its smaller."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    out = both.join(least, "a")
    out = out.filter("b > a") if large else out
    out = out.select(F.col("b").alias("v"), "m")
    if not large:
        out = out.union(least.select(F.col("a").alias("v"), "m"))
    return settle(out.filter("v <> m").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).distinct())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """id, component (the smallest id reachable) for each id that has an edge to another one.

    Ids must be whole numbers or strings of one type. Loops and edges with a null end are left out; edges may repeat and
    point either way. An empty table gives an empty one.
    """
    x, y = F.col(a), F.col(b)
    now = settle(edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    was = state(now)
    for _ in range(MAX_ROUNDS):
        if not was[0]:
            break
        nxt = _star(_star(now, large=True), large=False)
        now, has = nxt, state(nxt)
        if has == was:
            break
        was = has
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
