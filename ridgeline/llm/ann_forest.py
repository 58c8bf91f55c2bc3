"""Approximate nearest neighbours: forests of random-projection trees, one shared priority queue, exact reranking.

Rows are dealt to shards of bounded size; each shard grows a forest over all its rows, and every query searches the
forest of every shard. The queue holds branches of all trees by the widest cut crossed on their way, so that it is
followed across trees until enough rows are gathered; no further leaf is opened. Each shard's audit holds some queries against brute force and
doubles what is gathered until the recall asked for is reached; what is gathered is ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import dense, pack, settle, sharded, unpack, usable

#: Rows of a shard; queries of a block; trees; rows of a leaf; rows gathered to begin with; queries of an audit; recall it asks for.
SHARD, BLOCK, TREES, LEAF, GATHER, AUDIT, RECALL = 8192, 1024, 12, 64, 512, 48, 0.96


class ForestIndex:
    """Trees as full binary trees of equal depth: nodes in breadth-first order, rows of each leaf."""

    def __init__(self, x: np.ndarray, seed: int = 7, trees: int = TREES):
        rng = np.random.default_rng(seed)
        n, dim = x.shape
        self.depth = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
        self.planes = np.zeros((trees, 2**self.depth - 1, dim))
        self.cuts = np.zeros((trees, 2**self.depth - 1))
        self.leaf_of = np.zeros((trees, n), np.int64)
        for t in range(trees):
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                w = rng.standard_normal((2**level, dim))
                # A direction between two of the node's own rows splits better than one at large, if they differ.
                order = np.argsort(at, kind="stable")
                nodes, begin, count = np.unique(at[order], return_index=True, return_counts=True)
                for node, b, c in zip(nodes, begin, count, strict=True):
                    rows = order[b : b + c]
                    two = x[rows[rng.integers(c)]] - x[rows[rng.integers(c)]]
                    if np.isfinite(two).all() and two.any():
                        w[node] = two / np.abs(two).max()
                    w[node] /= np.sqrt((w[node] ** 2).sum())
                    self.cuts[t, first + node] = np.median(x[rows] @ w[node])
                self.planes[t, first : first + 2**level] = w
                at = at * 2 + (np.einsum("nd,nd->n", x, w[at]) > self.cuts[t, first + at])
            self.leaf_of[t] = at

    def state(self) -> dict:
        return {"planes": self.planes, "cuts": self.cuts, "leaf_of": self.leaf_of}

    @classmethod
    def load(cls, held: dict) -> ForestIndex:
        self = object.__new__(cls)
        self.planes, self.cuts, self.leaf_of = held["planes"], held["cuts"], held["leaf_of"]
        self.depth = int(np.log2(self.planes.shape[1] + 1))
        return self

    def finder(self):
        """leaf number (over all trees) -> rows."""
        trees, n = self.leaf_of.shape
        leaves = 2**self.depth
        order = np.argsort(self.leaf_of, axis=1, kind="stable")
        begin = np.stack([np.searchsorted(self.leaf_of[t][order[t]], np.arange(leaves + 1)) for t in range(trees)])
        return lambda k: order[k // leaves, begin[k // leaves, k % leaves] : begin[k // leaves, k % leaves + 1]]

    def margins(self, q: np.ndarray) -> np.ndarray:
        """How far each query lies above the cut of each node: (query, tree, node)."""
        return np.einsum("qd,tnd->qtn", q, self.planes, optimize=True) - self.cuts

    def leaves(self, margin: np.ndarray) -> Iterator[int]:
        """Leaves of all trees for one query's margins, as one queue shared by the trees gives them out: the branch whose
        way crossed cuts by the least comes first; the nearer side is followed at once and the other is queued."""
        inner = margin.shape[1]
        rows = margin.tolist()
        queue = [(0.0, t, 0) for t in range(len(rows))]
        while queue:
            crossed, t, node = heappop(queue)
            row = rows[t]
            while node < inner:
                m = row[node]
                near, far = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heappush(queue, (max(crossed, abs(m)), t, far))
                node = near
            yield t * (inner + 1) + node - inner


def nearest_rows(index: ForestIndex, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, recall: float):
    """For each query its nearest rows gathered: (row numbers, distances), nearest first, ties to the smaller id."""
    n = len(x)

    def best(i: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[ids[rows] != q_ids[i]]
        apart = x[rows] - q[i]
        if len(rows) > k:
            d = np.einsum("nd,nd->n", apart, apart)
            close = d <= np.partition(d, k - 1)[k - 1] * (1 + 1e-9)
            rows, apart = rows[close], apart[close]
        d = np.sqrt(np.cumsum(apart * apart, axis=1)[:, -1])  # summed in order, as SQL's distance is
        top = np.lexsort((ids[rows], d))[:k]
        return rows[top], d[top]

    leaf, margin = index.finder(), index.margins(q)

    def gather(i: int, most: int) -> np.ndarray:
        if most >= n:
            return np.arange(n)
        seen = np.zeros(n, bool)
        for k, number in enumerate(index.leaves(margin[i])):
            seen[leaf(number)] = True
            if k % 8 == 7 and int(seen.sum()) >= most:
                break
        return np.nonzero(seen)[0]

    most = GATHER
    sample = np.unique(np.linspace(0, len(q) - 1, min(len(q), AUDIT)).astype(int))
    truth = {i: best(i, np.arange(n))[0] for i in sample}
    while most < n:
        hit = sum(len(np.intersect1d(truth[i], best(i, gather(i, most))[0])) for i in sample)
        if hit >= recall * sum(map(len, truth.values())):
            break
        most *= 2
    return [best(i, gather(i, most)) for i in range(len(q))]


def search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, recall: float = RECALL) -> DataFrame:
    """query_id, rank (int, from 1), id, score: each query's k nearest rows found by Euclidean distance in double precision.

    A query's own row, that is every row with its id, is no candidate. Fewer candidates than k: all of them. Ties go to
    the smaller id. Vectors or queries that are null, empty, zero or hold null or non-finite components, and rows with a
    null id, take no part; only vectors as long as the query are candidates. Repeated rows are candidates each; queries
    of the same id and vector are asked once, those of the same id and other vectors have a list each. Ids are whole
    numbers. Empty tables give an empty result.
    """

    def clean(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        return df.filter(F.col("id").isNotNull() & usable(F.col("vec"))).withColumn("dim", F.size("vec"))

    def grow(rows: pa.Table) -> pa.Table:
        x, ids = dense(rows.column("vec")), rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        blob = pack(x=x, ids=ids, **ForestIndex(x).state())
        return pa.table({**{c: rows.column(c).slice(0, 1) for c in ("dim", "shard", "shards")}, "blob": pa.array([blob], pa.binary())})

    def bundle(rows: pa.Table) -> pa.Table:
        blob = pack(x=dense(rows.column("vec")), ids=rows.column("id").to_numpy(), asks=rows.column("ask").to_numpy())
        return pa.table({**{c: rows.column(c).slice(0, 1) for c in ("dim", "shard", "shards")}, "blob": pa.array([blob], pa.binary())})

    def ask(rows: pa.Table) -> pa.Table:
        held: dict[str, dict] = {r["role"]: unpack(r["blob"]) for r in rows.to_pylist()}
        out: dict[str, list] = {"ask": [], "query_id": [], "id": [], "score": []}
        if len(held) == 2:
            x, ids = held["index"]["x"], held["index"]["ids"]
            got = nearest_rows(ForestIndex.load(held["index"]), x, ids, held["query"]["x"], held["query"]["ids"], k, recall)
            for ask, q, (found, d) in zip(held["query"]["asks"], held["query"]["ids"], got, strict=True):
                out["ask"] += [int(ask)] * len(found)
                out["query_id"] += [int(q)] * len(found)
                out["id"] += ids[found].tolist()
                out["score"] += d.tolist()
        return pa.table({**{c: pa.array(out[c], pa.int64()) for c in ("ask", "query_id", "id")}, "score": pa.array(out["score"], pa.float64())})

    schema = "dim int, shard int, shards int, blob binary"
    keys = ["dim", "shard", "shards"]
    rows, asked = settle(clean(vectors)), settle(clean(queries).distinct().withColumn("ask", F.monotonically_increasing_id()))
    index = settle(sharded(rows, ["dim"], "id", SHARD).select(*keys, "id", "vec").groupBy(*keys).applyInArrow(grow, schema))
    blocks = settle(sharded(asked, ["dim"], "ask", BLOCK).select(*keys, "ask", "id", "vec").groupBy(*keys).applyInArrow(bundle, schema))
    # Each block of queries meets each shard: a stated query set against all rows, in blocks.
    of_index = index.join(blocks.groupBy("dim").agg(F.max("shards").alias("n")), "dim").select("dim", "shard", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), F.lit("index").alias("role"), "blob")
    of_block = blocks.join(index.groupBy("dim").agg(F.max("shards").alias("n")), "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("shard"), F.col("shard").alias("block"), F.lit("query").alias("role"), "blob")
    near = of_index.union(of_block).groupBy("dim", "shard", "block").applyInArrow(ask, "ask bigint, query_id bigint, id bigint, score double")
    ranks = Window.partitionBy("ask").orderBy("score", "id")
    ranked = near.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
