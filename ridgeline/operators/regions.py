"""Regions of the vector space. A region is named by the id of the node that it starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_sqr
from ..session import settle
from .graph import max_level
from .knn import nearest_centroid


def forest_regions(nodes: DataFrame, level: int = 2) -> DataFrame:
    """(id, region, parent): nodes of at least the level start regions, the others follow their fathers to one; a root of a
    lower level starts its own."""
    hop = nodes.select(F.col("id").alias("at"), F.col("level").alias("at_level"), F.col("father").alias("at_father"))
    now = nodes.select("id", F.col("father").alias("parent"), F.col("id").alias("at"))
    for _ in range(max(1, min(level, max_level(nodes)))):
        now = now.join(hop, "at").select("id", "parent", F.when((F.col("at_level") >= level) | (F.col("at_father") == F.col("at")), F.col("at")).otherwise(F.col("at_father")).alias("at"))
    return now.select("id", F.col("at").alias("region"), "parent")


def voronoi_regions(base: DataFrame, nodes: DataFrame, level: int = 2) -> DataFrame:
    """(id, region, dist): the nearest node of at least the level. True cells: the growth along edges that approximates
    them elsewhere depends on the order of visits. Where no node has the level, the entry point (the smallest id of the
    highest level) is the only anchor."""
    return nearest_centroid(base, _anchors(base, nodes, level)).select("id", F.col("cid").alias("region"), "dist")


def _anchors(base: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """(id, v) of the nodes of at least the level; without any, of the entry point: the smallest id of the highest level."""
    entry = nodes.agg(F.max(F.struct("level", (-F.col("id")).alias("i"))).alias("e")).select((-F.col("e.i")).alias("id"), (F.col("e.level") < level).alias("alone"))
    first = settle(nodes.filter(F.col("level") >= level).select("id").union(entry.filter("alone").select("id")))
    return base.join(first, "id", "left_semi").select("id", "v")


def grown_regions(base: DataFrame, nodes: DataFrame, edges: DataFrame, level: int = 2) -> DataFrame:
    """(id, region, dist): regions that grow from the anchors along edges(src, dst), all at the same pace.

    In every round the nodes that changed offer their region to the nodes they point to, and a node takes the offer of the
    nearest anchor if that is nearer than its own. It ends when nothing changes. Nodes that no anchor reaches are regions of their own."""
    vectors = base.select("id", F.col("v").cast("array<double>").alias("v"))
    anchors = settle(_anchors(base, nodes, level).select(F.col("id").alias("region"), F.col("v").cast("array<double>").alias("anchor")))
    now = front = settle(anchors.select(F.col("region").alias("id"), "region", F.lit(0.0).alias("dist")))
    while not front.isEmpty():
        offers = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id"), "region").distinct()
        offers = offers.join(vectors, "id").join(anchors, "region").select("id", "region", l2_sqr(F.col("v"), F.col("anchor")).alias("dist")).filter("dist is not null")
        best = offers.groupBy("id").agg(F.min(F.struct("dist", "region")).alias("o")).select("id", F.col("o.region").alias("new"), F.col("o.dist").alias("nearer"))
        front = settle(best.join(now, "id", "left").filter("dist is null or nearer < dist").select("id", F.col("new").alias("region"), F.col("nearer").alias("dist")))
        now = settle(now.join(front.select("id"), "id", "left_anti").union(front))
    alone = nodes.select("id").join(now.select("id"), "id", "left_anti")
    return now.union(alone.select("id", F.col("id").alias("region"), F.lit(0.0).alias("dist")))


def region_sizes(region_map: DataFrame) -> DataFrame:
    return region_map.groupBy("region").agg(F.count("*").alias("n"))


def region_adjacency(edges: DataFrame, region_map: DataFrame) -> DataFrame:
    """(r_src, r_dst, target, n_edges) for ordered pairs of regions that an edge joins; target: the smallest node reached."""
    a = region_map.select(F.col("id").alias("src"), F.col("region").alias("r_src"))
    b = region_map.select(F.col("id").alias("dst"), F.col("region").alias("r_dst"))
    pairs = edges.join(a, "src").join(b, "dst").filter("r_src <> r_dst")
    return pairs.groupBy("r_src", "r_dst").agg(F.min("dst").alias("target"), F.count("*").alias("n_edges"))


def region_members(region_map: DataFrame, base: DataFrame) -> DataFrame:
    """base with its region, dealt by region, so that scans of admitted regions and aggregates by region need no exchange."""
    return base.join(region_map.select("id", "region"), "id").repartition("region")


def region_centroids(base: DataFrame, region_map: DataFrame) -> DataFrame:
    """(region, pos, mean): mean vectors, one row for each component, so partial sums are combined before they move."""
    parts = base.join(region_map.select("id", "region"), "id").select("region", F.posexplode("v").alias("pos", "x"))
    return parts.groupBy("region", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def region_rho_hat(base: DataFrame, region_map: DataFrame) -> DataFrame:
    """(region, rho_hat): mean distance of a region's members to its centroid."""
    c = region_centroids(base, region_map).groupBy("region").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("c"))
    rows = base.join(region_map.select("id", "region"), "id").join(settle(c), "region")
    return rows.groupBy("region").agg(F.avg(F.sqrt(l2_sqr(F.col("v"), F.col("c")))).alias("rho_hat"))


def transparent_frontier(adjacency: DataFrame, empty: DataFrame, start: DataFrame) -> DataFrame:
    """(start, region): regions that are not empty and are reached from start(region) through empty regions only.

    empty(region). Every hop adds regions not seen before; it ends when there are none."""
    seen = settle(start.select(F.col("region").alias("start"), "region").distinct())
    edge = adjacency.select(F.col("r_src").alias("region"), F.col("r_dst").alias("next")).distinct()
    front = seen
    while not front.isEmpty():
        # The start itself is left whether empty or not; beyond it only empty regions are passed.
        through = front.join(empty.select("region"), "region", "left_semi").union(front.filter("start = region")).distinct()
        step = through.join(edge, "region").select("start", F.col("next").alias("region")).distinct()
        front = settle(step.join(seen, ["start", "region"], "left_anti"))
        seen = settle(seen.union(front))
    return seen.filter("start <> region").join(empty.select("region"), "region", "left_anti").select("start", "region")
