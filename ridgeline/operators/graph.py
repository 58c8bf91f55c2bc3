"""The proximity graph as tables: nodes(id, level, father) and edges(src, dst).

Levels follow the geometric law by integer arithmetic on the id, so they need no state. A node's father is its nearest
node of a strictly higher level; a node without one is its own father and a root.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import by_length, exact_distances, near_matrix
from ..session import settle
from .knn import PAIRS, SEND_BYTES, exact_topk

#: A fourth of the nodes of a level reach the next one; the hash's range allows 15 levels above the lowest.
BASE, TOP = 4, 15
SPREAD, SHIFT, SPACE = 2654435761, 12345, 1 << 32


def level_of(node_id: Column) -> Column:
    # Multiplied in decimals: a product of 64-bit integers could overflow for large ids.
    h = F.pmod(F.pmod(node_id, F.lit(SPACE)) * F.lit(SPREAD).cast("decimal(20,0)") + F.lit(SHIFT), F.lit(SPACE).cast("decimal(20,0)")).cast("long")
    return reduce(lambda x, y: x + y, [F.when(h < SPACE // BASE**k, 1).otherwise(0) for k in range(1, TOP + 1)])


def nodes(base: DataFrame, send_bytes: int = SEND_BYTES) -> DataFrame:
    """(id, level, father) for base(id, v); rows without a vector are no nodes, and one that has no distance to any is a root.

    While the nodes above the lowest level fit into a message, one scan finds all fathers; else each level is searched."""
    leveled = base.select("id", "v", level_of(F.col("id")).alias("level"))
    upper = leveled.filter("level > 0 and v is not null").select("id", "level", F.col("v").cast("array<double>").alias("v"))
    n, dim = upper.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if n * 8 * (dim + 2) > send_bytes:
        return _nodes_by_level(settle(leveled))
    held = upper.toArrow()
    ids, levels = held.column("id").to_numpy(), held.column("level").to_numpy()
    above = {dim: (ids[rows], levels[rows], x) for dim, (rows, x) in by_length(held.column("v")).items()}

    def fathers(batches):
        for batch in batches:
            own, level = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = own.copy()
            for dim, (rows, v) in by_length(batch.column(2)).items():
                if dim not in above:
                    continue
                ids, levels, x = above[dim]
                step = max(1, PAIRS // max(1, len(ids)))
                for at in range(0, len(rows) if len(ids) else 0, step):
                    part = slice(at, at + step)
                    near = near_matrix("l2", v[part], x)
                    near[levels[None, :] <= level[rows[part]][:, None]] = np.inf
                    best = near.min(axis=1)
                    for i in np.nonzero(np.isfinite(best))[0]:
                        some = np.nonzero(near[i] <= best[i] + 1e-9 * (1 + abs(best[i])))[0]
                        d = exact_distances("l2", x[some], v[at + i])
                        found[rows[at + i]] = ids[some][np.lexsort((ids[some], d))[0]]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(level, pa.int32()), pa.array(found, pa.int64())], names=["id", "level", "father"])

    rows = leveled.select(F.col("id").cast("long").alias("id"), "level", F.col("v").cast("array<double>").alias("v"))
    return settle(rows.filter("v is not null").mapInArrow(fathers, "id bigint, level int, father bigint"))


def _nodes_by_level(leveled: DataFrame) -> DataFrame:
    found = []
    for level in range(max(1, max_level(leveled))):
        asks = leveled.filter(F.col("level") == level).select(F.col("id").alias("qid"), F.col("v").alias("qvec"))
        found.append(exact_topk(leveled.filter(F.col("level") > level), asks, 1).select("qid", F.col("id").alias("father")))
    fathers = reduce(DataFrame.union, found)
    out = leveled.filter("v is not null").join(fathers, leveled["id"] == fathers["qid"], "left")
    return settle(out.select("id", "level", F.coalesce("father", "id").alias("father")))


def knn_edges(base: DataFrame, m: int) -> DataFrame:
    """(src, dst, rank): each node's m nearest others."""
    near = exact_topk(base, base.select(F.col("id").alias("qid"), F.col("v").alias("qvec")), m, skip_self=True)
    return near.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "rank")


def local_selectivity(edges: DataFrame, base: DataFrame, condition: Column, m: int) -> DataFrame:
    """(src, sigma, regime): the share of a node's neighbours that satisfy the condition, and how to go on from it:
    one_hop from one half; two_hop if sigma * (m + 1) * m reaches 3 m; else blind. m: links allowed at the lowest level."""
    mask = base.select(F.col("id").alias("dst"), condition.cast("double").alias("ok"))
    s = edges.join(mask, "dst").groupBy("src").agg(F.avg("ok").alias("sigma"))
    regime = F.when(F.col("sigma") >= 0.5, "one_hop").when(F.col("sigma") * (m + 1) * m >= 3 * m, "two_hop").otherwise("blind")
    return s.select("src", "sigma", regime.alias("regime"))


def max_level(nodes: DataFrame) -> int:
    return nodes.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0]
