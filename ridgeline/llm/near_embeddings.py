"""Near-duplicate embeddings: small-world graphs per shard, every shard queried, cosine verified, components united.

Exact copies are one vector with a multiplicity. A shard holds a bounded number of distinct vectors of one label; its
graph is searched by its own vectors and by those of every earlier shard of the label. The recall audit counts every
query's links, as a rare link is in no sample: a query whose beam found fewer searches again with a beam twice as wide,
until none misses a link. Cosines are verified in double precision. Counts leave a task, never pairs within a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.small_world import TOGETHER, Graph
from ._shared import dense, pack, settle, sharded, unit, unpack, usable
from .components import components
from .simhash import Forest

#: Distinct vectors of a shard; beam to begin with.
SHARD, BEAM = 4096, 32
#: Slack for single precision while searching, before the exact check.
SLACK = 1e-4


def found_links(graph: Graph, exact: np.ndarray, queries: np.ndarray, threshold: float, own: bool, beam: int = BEAM):
    """Yields (query rows, index rows) that link, a part at a time; every query's beam widens until the audit finds none missing.

    exact and queries: unit vectors in double precision; own: the queries are the index's rows, in its order."""

    def search(rows: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        if beam < len(exact):
            ids, sims = graph.search(queries[rows].astype(np.float32), beam, own=rows if own else None)
            a, place = np.nonzero((sims >= threshold - SLACK) & (ids >= 0))
            a, b = rows[a], ids[a, place]
        else:
            a, b = np.nonzero(queries[rows] @ exact.T >= threshold - SLACK)
            a = rows[a]
        good = cosines(queries, exact, a, b) >= threshold
        if own:
            good &= a != b
        return a[good], b[good]

    for at in range(0, len(queries), TOGETHER):
        rows, wide = np.arange(at, min(len(queries), at + TOGETHER)), beam
        audit = links(queries[rows], exact, threshold, rows if own else None)
        while len(rows):
            a, b = search(rows, wide)
            missed = np.bincount(a - at, minlength=len(audit))[rows - at] < audit[rows - at]
            whole = ~np.isin(a, rows[missed])
            yield a[whole], b[whole]
            rows, wide = rows[missed], 2 * wide


def cosines(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x[a], y[b])


def links(queries: np.ndarray, exact: np.ndarray, threshold: float, own: np.ndarray | None) -> np.ndarray:
    """How many rows each query links with, itself left out. A product of matrices and a sum may round apart, so pairs near the threshold are summed."""
    near = queries @ exact.T
    out = (near >= threshold + SLACK).sum(axis=1)
    a, b = np.nonzero((near >= threshold - SLACK) & (near < threshold + SLACK))
    np.add.at(out, a, cosines(queries, exact, a, b) >= threshold)
    return out - (cosines(queries, exact, np.arange(len(own)), own) >= threshold) if own is not None else out


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept (id = component_id).

    Vectors link if their labels are equal and not null and their cosine in double precision is threshold or more.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of other
    lengths. Exact copies link with each other and share their links. Rows of the same id are one node of a component,
    whatever their vectors; each row has its own vector's links, and each still counts as another vector. Rows with a null
    id don't take part and have a null component. Ids are whole numbers. An empty table gives an empty one.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    valid = base.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    copies = valid.groupBy("label", "vec").agg(F.min("id").alias("gid"), F.count("*").alias("n"))
    # An id with several vectors may be the least of each, so vectors have numbers of their own.
    copies = settle(copies.withColumn("dim", F.size("vec")).withColumn("node", F.monotonically_increasing_id()))
    shards = sharded(copies, ["label", "dim"], "node", SHARD)

    def inside(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows.column("node").to_numpy(), kind="stable")))
        nodes, ids, n = (rows.column(c).to_numpy() for c in ("node", "gid", "n"))
        x = unit(dense(rows.column("vec")))
        graph, forest = Graph(x, nodes), Forest(len(x))
        for a, b in found_links(graph, x, x, threshold, own=True):
            forest.union(a, b)
        roots = forest.roots(np.arange(len(x)))
        # Inside a component all pairs are compared, so that counts don't depend on which of its links were found.
        links = n - 1
        order = np.argsort(roots, kind="stable")
        for part in np.split(order, np.nonzero(np.diff(roots[order]))[0] + 1):
            for at in range(0, len(part) if len(part) > 1 else 0, TOGETHER):
                some = part[at : at + TOGETHER]
                near = x[some] @ x[part].T >= threshold
                near[np.arange(len(some)), np.arange(at, at + len(some))] = False
                links[some] += near @ n[part]
        asked = graph_blob = None
        if rows.column("shards")[0].as_py() > 1:
            asked = pack(nodes=nodes, ids=ids, n=n, x=x)
            graph_blob = pack(order=graph.order, sizes=np.array(graph.sizes), **{f"near{k}": v for k, v in enumerate(graph.near)})
        more = [] if asked is None else [asked]
        size = len(nodes) + len(more)
        pad = lambda a: pa.array(np.append(a, [-1] * len(more)).astype(np.int64), pa.int64())
        blobs = {"blob": pa.array([None] * len(nodes) + more, pa.binary()), "graph": pa.array([None] * len(nodes) + [graph_blob] * len(more), pa.binary())}
        return pa.table({"node": pad(nodes), "a": pad(ids), "b": pad(ids[roots]), "n": pad(links)} | blobs | {k: pa.array([rows.column(k)[0].as_py()] * size, rows.schema.field(k).type) for k in ("label", "dim", "shard", "shards")})

    def between(rows: pa.Table) -> pa.Table:
        index = asked = None
        for r in rows.to_pylist():
            if r["graph"] is None:
                asked = unpack(r["blob"])
            else:
                index = unpack(r["blob"]) | unpack(r["graph"])
        graph = Graph.of(index["x"], index["order"], index["sizes"].tolist(), [index[f"near{k}"] for k in range(len(index["sizes"]))])
        forest, own = Forest(len(asked["ids"]) + len(index["ids"])), len(asked["ids"])
        links = np.zeros(own + len(index["ids"]), np.int64)
        for a, b in found_links(graph, index["x"], asked["x"], threshold, own=False):
            forest.union(a, b + own)
            np.add.at(links, a, index["n"][b])
            np.add.at(links, b + own, asked["n"][a])
        roots, nodes, ids = forest.roots(np.arange(len(links))), *(np.concatenate((asked[c], index[c])) for c in ("nodes", "ids"))
        some = links > 0
        return pa.table({k: pa.array(v, pa.int64()) for k, v in {"node": nodes[some], "a": ids[some], "b": ids[roots[some]], "n": links[some]}.items()})

    kind = copies.schema["label"].dataType.simpleString()
    edge = "node bigint, a bigint, b bigint, n bigint"
    own = settle(shards.select("label", "dim", "shard", "shards", "node", "gid", "n", "vec").groupBy("label", "dim", "shard").applyInArrow(inside, f"{edge}, blob binary, graph binary, label {kind}, dim int, shard int, shards int"))
    found = own.filter("blob is null").select("node", "a", "b", "n")
    blobs = own.filter("blob is not null")
    # A shard asks every later one; its graph goes to every earlier one.
    others = lambda where: F.explode(F.filter(F.sequence(F.lit(0), F.col("shards") - 1), where))
    pairs = blobs.select("label", "dim", F.col("shard").alias("i"), others(lambda k: k > F.col("shard")).alias("j"), "blob", F.lit(None).cast("binary").alias("graph"))
    pairs = pairs.union(blobs.select("label", "dim", others(lambda k: k < F.col("shard")).alias("i"), F.col("shard").alias("j"), "blob", "graph"))
    found = settle(found.union(pairs.groupBy("label", "dim", "i", "j").applyInArrow(between, edge)))
    again = settle(base.filter("id is not null").groupBy("id").agg(F.count("*").alias("k")).filter("k > 1").select("id"))
    several = valid.join(again, "id", "left_semi").join(copies.select("label", "vec", "gid"), ["label", "vec"]).select(F.col("id").alias("a"), F.col("gid").alias("b"))
    parts = settle(components(found.select("a", "b").union(several), "a", "b"))
    total = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    known = copies.join(total, "node", "left").join(parts.withColumnRenamed("id", "gid"), "gid", "left")
    known = settle(known.select(F.col("label").alias("k_label"), F.col("vec").alias("k_vec"), "n_links", F.coalesce("component", "gid").alias("of_copies")))
    out = base.join(known, (base["label"] == known["k_label"]) & (base["vec"] == known["k_vec"]), "left").join(parts, "id", "left")
    out = out.withColumns({"n_links": F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0), "component_id": F.when(F.col("id").isNotNull(), F.coalesce("component", "of_copies", "id"))})
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
