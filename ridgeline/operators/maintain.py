"""Maintenance of the forest's statistics by deltas of inserts, updates and deletes, and rebuilding of trees.

The rules keep statistics cheap, not exact: updates leave histograms as they are, deletes only reach the root, and a
tree is rebuilt once enough of it has changed. Presence only grows until a rebuild, so that pruning by it stays sound.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .stats import Forest, Schema, Stats, attributes, bound, errors, keep, rollup

REBUILD_SHARE, REBUILD_LEAST = 0.5, 16


@dataclass(frozen=True)
class State:
    """Statistics and trees(tree, n, cnt_mod, cnt_del)."""

    stats: Stats
    trees: DataFrame


def trees_of(f: Forest) -> DataFrame:
    """(tree, n, cnt_mod, cnt_del)."""
    n = f.fca.join(f.candidates.select("c", "tree"), "c").groupBy("tree").agg(F.count("*").alias("n"))
    return n.select("tree", "n", F.lit(0).cast("long").alias("cnt_mod"), F.lit(0).cast("long").alias("cnt_del"))


def _above(stats: Stats, f: Forest, points: DataFrame) -> DataFrame:
    """(id, node, tree): the bound candidates above each point(id, c)."""
    up = points.join(f.closure, "c").join(f.candidates.select(F.col("c"), "tree"), "c")
    return up.join(stats.sizes.select(F.col("node").alias("anc")), "anc").select("id", F.col("anc").alias("node"), "tree", "depth")


def _add(table: DataFrame, delta: DataFrame, keys: list[str], value: str, floor: bool = False) -> DataFrame:
    both = table.select(*keys, value).union(delta.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))
    return both.withColumn(value, F.greatest(F.lit(0), F.col(value))) if floor else both


def insert_deltas(state: State, f: Forest, points: DataFrame, attrs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """points(id, c): first candidates of new rows. (hist delta, size delta, region of each point)."""
    above = settle(_above(state.stats, f, points))
    known = state.stats.hist.select("col", "bucket").distinct().filter(F.col("col").isin(list(state.stats.schema.categorical)))
    numeric = attrs.filter(F.col("col").isin(list(state.stats.schema.edges)))
    usable = numeric.union(attrs.join(known, ["col", "bucket"], "left_semi").select(*attrs.columns))
    kept = state.stats.hist_node.select("col", "node").distinct()
    hist = usable.join(above, "id").join(kept, ["col", "node"], "left_semi").groupBy("col", "node", "bucket").agg(F.count("*").alias("cnt"))
    sizes = above.groupBy("node").agg(F.count("*").alias("n"))
    return hist, sizes, above.groupBy("id").agg(F.min_by("node", "depth").alias("region"))


def insert(state: State, f: Forest, points: DataFrame, base: DataFrame) -> State:
    """Counts go to all bound ancestors' sizes and kept histograms; codes that statistics don't know aren't counted and
    mark their column; presence bits are added; trees grow."""
    s, attrs = state.stats, settle(attributes(base, state.stats.schema))
    hist, sizes, regions = insert_deltas(state, f, points, attrs)
    known = s.hist.select("col", "bucket").distinct()
    strange = attrs.filter(F.col("col").isin(list(s.schema.categorical))).join(known, ["col", "bucket"], "left_anti").select("col").distinct()
    region_map = settle(s.region_map.union(points.select("id").join(regions, "id", "left").select("id", F.coalesce("region", F.lit(s.sizes.agg(F.min("node")).first()[0])).alias("region"))))
    bits = attrs.join(region_map, "id").select("col", "region", "bucket")
    grown = points.join(f.candidates.select("c", "tree"), "c").groupBy("tree").agg(F.count("*").alias("n"))
    stats = replace(
        s, region_map=region_map, sizes=settle(_add(s.sizes, sizes, ["node"], "n")), hist=settle(_add(s.hist, hist, ["col", "node", "bucket"], "cnt")),
        presence=None if s.presence is None else settle(s.presence.union(bits).distinct()), degraded=s.degraded | {r["col"] for r in strange.collect()},
    )
    trees = state.trees.join(grown.withColumnRenamed("n", "more"), "tree", "left").select("tree", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "cnt_mod", "cnt_del")
    return State(stats, settle(trees))


def threshold(n) -> F.Column:
    return F.greatest(F.lit(REBUILD_LEAST), F.floor(F.lit(REBUILD_SHARE) * n))


def update(state: State, f: Forest, changes: DataFrame) -> tuple[State, DataFrame]:
    """changes(id, col, bucket): a new value's bucket. Presence grows, counts stay; (state, trees(tree) due for rebuilding)."""
    s = state.stats
    where = changes.join(f.fca, "id").join(f.candidates.select("c", "tree"), "c").groupBy("tree").agg(F.count("*").alias("more"))
    trees = settle(state.trees.join(where, "tree", "left").select("tree", "n", (F.col("cnt_mod") + F.coalesce("more", F.lit(0))).alias("cnt_mod"), "cnt_del"))
    bits = changes.join(s.region_map, "id").select("col", "region", F.col("bucket").cast("double").alias("bucket"))
    stats = replace(s, presence=None if s.presence is None else settle(s.presence.union(bits).distinct()))
    return State(stats, trees), trees.filter(F.col("cnt_mod") >= threshold(F.col("n"))).select("tree")


def delete_deltas(f: Forest, gone: DataFrame, attrs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hist delta, size delta) of the roots above the rows gone(id)."""
    at = gone.join(f.fca, "id").join(f.candidates.select("c", "tree"), "c").select("id", F.col("tree").alias("node"))
    hist = attrs.join(at, "id").groupBy("col", "node", "bucket").agg((-F.count("*")).alias("cnt"))
    return hist, at.groupBy("node").agg((-F.count("*")).alias("n"))


def delete(state: State, f: Forest, gone: DataFrame, base: DataFrame) -> tuple[State, DataFrame]:
    """Roots' sizes and histograms shrink, not below 0; (state, trees due). The thresholds see the shrunk trees."""
    s = state.stats
    hist, sizes = delete_deltas(f, gone, attributes(base, s.schema).join(gone, "id", "left_semi"))
    fewer = gone.join(f.fca, "id").join(f.candidates.select("c", "tree"), "c").groupBy("tree").agg(F.count("*").alias("less"))
    less = F.coalesce("less", F.lit(0))
    trees = settle(state.trees.join(fewer, "tree", "left").select("tree", (F.col("n") - less).alias("n"), "cnt_mod", (F.col("cnt_del") + less).alias("cnt_del")))
    stats = replace(s, sizes=settle(_add(s.sizes, sizes, ["node"], "n", floor=True)), hist=settle(_add(s.hist, hist, ["col", "node", "bucket"], "cnt", floor=True)))
    return State(stats, trees), trees.filter(F.col("cnt_del") >= threshold(F.col("n"))).select("tree")


def rebuild(state: State, f: Forest, live: DataFrame, due: DataFrame, *, slack: float = 1.0, delta_range: float = 0.05, eps_point: float = 0.10) -> State:
    """Recounts the live rows of the trees due, decides anew what is kept there, and sets their counters to 0.

    Other trees keep their tables as they are; rows are read for the trees due only."""
    s, schema = state.stats, state.stats.schema
    inside = f.candidates.join(due, "tree", "left_semi")
    part = Forest(settle(inside), settle(f.fca.join(live.select("id"), "id", "left_semi").join(inside.select("c"), "c", "left_semi").select("id", "c")), settle(f.closure.join(inside.select("c"), "c", "left_semi")), f.lmin, f.lmax)
    attrs = settle(attributes(live.join(part.fca.select("id"), "id", "left_semi"), schema))
    hist, sizes = (settle(x) for x in rollup(part, attrs))
    kept = settle(keep(part, errors(part, hist, sizes, schema, slack), schema, {}, delta_range=delta_range, eps_point=eps_point))
    new = bound(part, kept, hist, sizes, part.fca.select("id"), attrs, schema)
    ours = inside.select(F.col("c").alias("node"))
    outside = lambda table, key: table.join(ours.withColumnRenamed("node", key), key, "left_anti").select(*table.columns)
    merged = Stats(
        schema, settle(s.region_map.join(new.region_map.select("id"), "id", "left_anti").select("id", "region").union(new.region_map)), settle(outside(s.sizes, "node").union(new.sizes.select(*s.sizes.columns))),
        settle(outside(s.hist, "node").union(new.hist.select(*s.hist.columns))), settle(outside(s.hist_node, "region").union(new.hist_node.select(*s.hist_node.columns))),
        None if s.presence is None else settle(outside(s.presence, "region").union(new.presence.select(*s.presence.columns))), s.degraded,
    )
    n = part.fca.join(part.candidates.select("c", "tree"), "c").groupBy("tree").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    fresh = due.join(n, "tree", "left").select("tree", F.coalesce("n", F.lit(0)).cast("long").alias("n"), zero.alias("cnt_mod"), zero.alias("cnt_del"))
    return State(merged, settle(state.trees.join(due, "tree", "left_anti").select("tree", "n", "cnt_mod", "cnt_del").union(fresh)))
