"""Exact nearest neighbours under a predicate, and the variants that are measured against them.

The exact operator never shuffles the larger side: the smaller of base and queries, if its size is within a bound, goes
to all tasks, which score Arrow batches by a matrix product and keep their own k nearest; only those meet in a window.
Beyond the bound both sides are cut into blocks, and a task joins one block of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import DNF
from ..functions.vectors import Near, by_length, distance_rows, exact_distances, near_matrix
from ..session import settle

#: Bytes of vectors up to which a side is sent to all tasks.
SEND_BYTES = 64 << 20
#: Rows of a block when neither side can be sent; rows, and pairs, scored by one matrix product.
BLOCK, STEP, PAIRS = 16_384, 2048, 1 << 22
#: Pairs of a task that sees all of a query's distances.
TASK_PAIRS = 1 << 24
OUT = "qid bigint, id bigint, dist double"


def top_rows(metric: str, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, skip_self: bool) -> pa.RecordBatch:
    """Each query's k nearest of these rows by (distance, id), with distances summed in order."""
    out_q, out_i, out_d = [], [], []
    if len(ids) and len(qids):
        near = near_matrix(metric, q, x)
        if skip_self:
            near[qids[:, None] == ids[None, :]] = np.inf
        for i in range(len(qids)):
            row = near[i]
            if len(row) > k:
                edge = np.partition(row, k - 1)[k - 1]
                some = np.nonzero(row <= edge + 1e-9 * (1 + abs(edge)))[0] if np.isfinite(edge) else np.nonzero(np.isfinite(row))[0]
            else:
                some = np.nonzero(row < np.inf)[0]
            d = exact_distances(metric, x[some], q[i])
            best = np.lexsort((ids[some], d))[:k]
            out_q.append(np.full(len(best), qids[i]))
            out_i.append(ids[some][best])
            out_d.append(d[best])
    cat = lambda a, t: np.concatenate(a).astype(t) if a else np.zeros(0, t)
    return pa.RecordBatch.from_arrays([pa.array(cat(out_q, np.int64)), pa.array(cat(out_i, np.int64)), pa.array(cat(out_d, np.float64))], names=["qid", "id", "dist"])


Held = dict[int, tuple[np.ndarray, np.ndarray]]


def by_dim(ids: np.ndarray, vectors: pa.Array | pa.ChunkedArray) -> Held:
    """Length of vectors -> (ids, matrix): only vectors of one length have a distance."""
    return {n: (ids[rows], x) for n, (rows, x) in by_length(vectors).items()}


def _held(df: DataFrame) -> Held:
    t = df.toArrow()
    return by_dim(t.column(0).to_numpy(), t.column(1))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("dist", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def exact_topk(base: DataFrame, queries: DataFrame, k: int, *, predicate: DNF | Column | None = None, metric: str = "l2", skip_self: bool = False, send_bytes: int = SEND_BYTES) -> DataFrame:
    """(qid, rank, id, dist) of each query's k nearest rows of base(id, v, ..) that satisfy the predicate.

    Fewer than k if fewer match. Ties go to the smaller id. Vectors that are null, of another length than the query's or
    with a null or non-finite component have no distance and are left out. The predicate is a plain filter of the scan.
    skip_self leaves out the row of the query's own id.
    """
    if predicate is not None:
        base = base.filter(predicate.condition() if isinstance(predicate, DNF) else predicate)
    b = base.filter("id is not null and v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    q = queries.filter("qid is not null and qvec is not null").select(F.col("qid").cast("long").alias("qid"), F.col("qvec").cast("array<double>").alias("qvec"))
    n_q, dim = q.agg(F.count("*"), F.coalesce(F.max(F.size("qvec")), F.lit(0))).first()
    row = 8 * (dim + 1)
    if n_q * row <= send_bytes:
        asked = _held(q)

        def by_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A task keeps k rows a query: what a batch finds is merged with what earlier ones found.
            best = None
            for batch in batches:
                for dim, (ids, x) in by_dim(batch.column(0).to_numpy(), batch.column(1)).items():
                    qids, qv = asked.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
                    for at in range(0, len(ids), STEP):
                        found = [top_rows(metric, ids[at : at + STEP], x[at : at + STEP], qids[i : i + 256], qv[i : i + 256], k, skip_self) for i in range(0, len(qids), 256)]
                        part = pa.Table.from_batches(found) if found else None
                        if part is not None:
                            best = part if best is None else _merge(best, part, k)
            if best is not None:
                yield from best.combine_chunks().to_batches()

        return _best(b.mapInArrow(by_rows, OUT), k)
    if b.count() * row <= send_bytes:
        held = _held(b)

        def by_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for dim, (qids, qv) in by_dim(batch.column(0).to_numpy(), batch.column(1)).items():
                    if dim in held:
                        ids, x = held[dim]
                        step = max(1, PAIRS // max(1, len(ids)))
                        for at in range(0, len(qids), step):
                            yield top_rows(metric, ids, x, qids[at : at + step], qv[at : at + step], k, skip_self)

        found = q.mapInArrow(by_queries, OUT)
        # A query is scored against the whole base in one place, so its rows need numbers but no exchange of vectors.
        return _best(found, k)
    blocks = lambda n: max(1, -(-n // BLOCK))
    n_b, m = blocks(b.count()), blocks(n_q)
    rows = b.select("id", "v", F.lit(False).alias("asks"), F.pmod(F.xxhash64("id"), F.lit(n_b)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    asks = q.select(F.col("qid").alias("id"), F.col("qvec").alias("v"), F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(n_b - 1))).alias("i"), F.pmod(F.xxhash64("qid"), F.lit(m)).cast("int").alias("j"))

    def by_blocks(t: pa.Table) -> pa.Table:
        asking = np.asarray(t.column("asks").to_numpy(zero_copy_only=False), bool)
        ids, out = t.column("id").to_numpy(), [top_rows(metric, *[np.zeros(0, np.int64)] * 4, k, skip_self)]
        for rows, x in by_length(t.column("v")).values():
            asks, of = asking[rows], ids[rows]
            own = np.nonzero(asks)[0]
            out += [top_rows(metric, of[~asks], x[~asks], of[own[at : at + 256]], x[own[at : at + 256]], k, skip_self) for at in range(0, len(own), 256)]
        return pa.Table.from_batches(out)

    return _best(rows.union(asks.select(*rows.columns)).groupBy("i", "j").applyInArrow(by_blocks, OUT), k)


def _merge(a: pa.Table, b: pa.Table, k: int) -> pa.Table:
    q, i, d = (np.concatenate((a.column(c).to_numpy(), b.column(c).to_numpy())) for c in ("qid", "id", "dist"))
    order = np.lexsort((i, d, q))
    q, i, d = q[order], i[order], d[order]
    begin = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(begin, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    keep = place < k
    return pa.table({"qid": q[keep], "id": i[keep], "dist": d[keep]})


def n_satisfying(base: DataFrame, predicate: DNF) -> DataFrame:
    return base.agg(F.count_if(predicate.condition()).alias("n_satisfying"))


def post_filter(base: DataFrame, queries: DataFrame, predicate: DNF, ef: int, k: int) -> DataFrame:
    """The ef nearest without the predicate, those of them that satisfy it, and of these the first k."""
    near = exact_topk(base, queries, max(1, ef)).drop("rank")
    matching = base.filter(predicate.condition()).select("id")
    return _best(near.join(matching, "id", "left_semi"), k)


def rank_range(base: DataFrame, queries: DataFrame, column: str, predicate: DNF, k: int) -> DataFrame:
    """Rows in order of (column, id) get ranks; the predicate is widened to the interval from its first to its last rank.

    That interval is the one of (value, id) pairs, so no ranks need be stored: the pairs themselves bound it."""
    pair = F.struct(F.col(column).alias("value"), F.col("id").alias("id"))
    ends = base.filter(predicate.condition()).agg(F.min(pair).alias("low"), F.max(pair).alias("high")).first()
    if ends["low"] is None:
        return exact_topk(base, queries, k, predicate=F.lit(False))
    low, high = ends["low"], ends["high"]
    c = F.col(column)
    inside = ((c > low["value"]) | ((c == low["value"]) & (F.col("id") >= low["id"]))) & ((c < high["value"]) | ((c == high["value"]) & (F.col("id") <= high["id"])))
    return exact_topk(base, queries, k, predicate=inside)


def first_label(base: DataFrame, queries: DataFrame, label: str, predicate: DNF, k: int) -> DataFrame:
    """Nearest among the rows whose label is that of the first row (by id) that satisfies the predicate."""
    first = base.filter(predicate.condition()).agg(F.min_by(label, "id").alias("l")).first()["l"]
    return exact_topk(base, queries, k, predicate=F.lit(False) if first is None else F.col(label) == F.lit(first))


def padded(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """found with k rows for every query: ranks that nothing was found for have a null id and distance."""
    slots = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return slots.join(found, ["qid", "rank"], "left").select("qid", "rank", "id", "dist")


def without(base: DataFrame, deleted: DataFrame) -> DataFrame:
    """base without the ids of a table of tombstones."""
    return base.join(deleted.select("id"), "id", "left_anti")


class Rows:
    """Vectors of one length as columns of a matrix, in order of (code of the label, id); counts are the rows that each stands for."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, x: np.ndarray, counts: np.ndarray | None = None):
        order = np.lexsort((ids, codes))
        self.ids, self.codes, self.x = ids[order], codes[order], np.ascontiguousarray(x[order].T)
        self.counts = np.ones(len(ids), np.int64) if counts is None else counts[order]

    @staticmethod
    def of(ids: np.ndarray, codes: np.ndarray, vectors: pa.Array | pa.ChunkedArray) -> dict[int, Rows]:
        return {n: Rows(ids[rows], codes[rows], x) for n, (rows, x) in by_length(vectors, finite=False).items()}

    def first_copies(self, k: int) -> Rows:
        """Without rows that k rows of the same label and vector and smaller ids come before: these are at no other distance."""
        same = _same(self.x)
        order = np.lexsort((self.ids, same, self.codes))
        keep = np.zeros(len(order), bool)
        keep[order[_place(self.codes[order] * (int(same.max(initial=0)) + 1) + same[order]) < k]] = True
        return self if keep.all() else Rows(self.ids[keep], self.codes[keep], self.x[:, keep].T)

    def distinct(self) -> Rows:
        """Every vector once, with the number of its rows."""
        _, first, counts = np.unique(_same(self.x), return_index=True, return_counts=True)
        return self if len(first) == len(self.ids) else Rows(self.ids[first], self.codes[first], self.x[:, first].T, counts)

    def near(self) -> Near:
        """Made once in a process, and not sent."""
        if "_near" not in self.__dict__:
            self._near = Near(self.x)
        return self._near

    def exact(self, v: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """Distances of a query to some of the columns."""
        if 4 * len(columns) > len(self.ids):
            return distance_rows(v[None, :], self.x)[0][columns]
        if "_whole" not in self.__dict__:
            self._whole = np.ascontiguousarray(self.x.T)
        return distance_rows(v[None, :], np.ascontiguousarray(self._whole[columns].T))[0]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}


def _same(x: np.ndarray) -> np.ndarray:
    """A number for each column that columns of the same bytes share."""
    bits, mixed = x.view(np.uint64), np.zeros(x.shape[1], np.uint64)
    for row, factor in zip(bits, np.random.default_rng(0).integers(0, 2**64, len(x), np.uint64), strict=True):
        mixed += (row ^ (row >> np.uint64(29))) * (factor | np.uint64(1))
    _, first, same = np.unique(mixed, return_index=True, return_inverse=True)
    if all(np.array_equal(row, row[first[same]]) for row in bits):
        return same
    return np.unique(bits, axis=1, return_inverse=True)[1].reshape(-1)


def _nearest(own: Rows, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the k nearest of each query, a row of v, and each code, as _segments gives them.

    Near distances leave the few columns that can be among them, and exact ones decide."""
    d, error = own.near().distances(v)
    begin = np.concatenate(([0], np.nonzero(np.diff(own.codes))[0] + 1, [len(own.codes)]))
    maybe = np.ones(d.shape, bool)
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a > k:
            part = d[:, a:b]
            edge = np.partition(part, k - 1, axis=1)[:, k - 1 : k]
            maybe[:, a:b] = (part <= edge + 2 * error[:, None]) | np.isnan(edge)
    maybe[~np.isfinite(error)] = True
    rows, cols, dists = [], [], []
    for i in range(len(v)):
        some = np.nonzero(maybe[i])[0]
        exact = own.exact(v[i], some)
        _, c = _segments(exact[None, :], own.ids[some], own.codes[some], k)
        rows.append(np.full(len(c), i))
        cols.append(some[c])
        dists.append(exact[c])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)


def _at_places(own: Rows, v: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each query, a row of v, its distances at these places, ascending, among those of all rows in order.

    Near distances are put in order. The one at a place is within the error of the exact one there, which is thus found among
    the exact distances of all columns that are near within twice the error."""
    d, error = own.near().distances(v)
    n = d.shape[1]
    # Distances are not negative, so their bits are in their order; the lowest ones give way to the column's number.
    low = (1 << max(1, (n - 1).bit_length())) - 1
    slack = 2 * (low + 1) * np.finfo(float).eps
    keys = d.view(np.int64)
    keys &= np.iinfo(np.int64).max ^ low
    keys |= np.arange(n)
    keys.sort(axis=1)
    out = np.empty((len(v), len(places)))
    alone = (own.counts == 1).all()
    for i, key in enumerate(keys):
        cols = key & low
        rough = (key ^ cols).view(np.float64)
        upto = None if alone else np.cumsum(own.counts[cols])
        at = rough[places if alone else np.searchsorted(upto, places, "right")]
        begin = np.searchsorted(rough, (at - 2 * error[i]) * (1 - slack), "left") if np.isfinite(error[i]) else np.zeros(len(at), int)
        end = np.searchsorted(rough, at * (1 + slack) + 2 * error[i], "right") if np.isfinite(error[i]) else np.full(len(at), n)
        # Runs of columns that overlap are one; those before and after a run are nearer and farther than all in it.
        new = np.nonzero(np.concatenate(([True], begin[1:] >= end[:-1])))[0]
        first, sizes = begin[new], end[np.append(new[1:], len(at)) - 1] - begin[new]
        start = np.cumsum(sizes) - sizes
        run = np.repeat(np.arange(len(new)), sizes)
        some = cols[np.arange(len(run)) - start[run] + first[run]]
        exact = own.exact(v[i], some)
        if len(new) < len(run):
            order = np.lexsort((exact, run))
            some, exact = some[order], exact[order]
        if alone:
            of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(at))))
            out[i] = exact[places - first[of] + start[of]]
        else:
            before = np.concatenate(([0], upto))
            ends = np.cumsum(own.counts[some])
            ends += (before[first] - np.concatenate(([0], ends))[start])[run]
            out[i] = exact[np.searchsorted(ends, places, "right")]
    return out


def _segments(d: np.ndarray, ids: np.ndarray, codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k nearest of each row of d and each code, by (distance, id), in order; codes are ordered, NaN is the farthest."""
    begin = np.concatenate(([0], np.nonzero(np.diff(codes))[0] + 1, [len(codes)])) if len(codes) else np.zeros(1, int)
    sizes = np.diff(begin)
    few = np.nonzero(np.repeat(sizes <= k, sizes))[0]
    rows, cols = [np.repeat(np.arange(len(d)), len(few))], [np.tile(few, len(d))]
    for a, n in zip(begin[:-1][sizes > k], sizes[sizes > k], strict=True):
        part = d[:, a : a + n]
        edge = np.partition(part, k - 1, axis=1)[:, k - 1 : k]
        r, c = np.nonzero((part <= edge) | np.isnan(edge))
        rows.append(r)
        cols.append(c + a)
    r, c = np.concatenate(rows), np.concatenate(cols)
    order = np.lexsort((ids[c], d[r, c], codes[c], r))
    r, c = r[order], c[order]
    keep = _place(r * (int(codes.max(initial=0)) + 1) + codes[c]) < k
    return r[keep], c[keep]


def _place(groups: np.ndarray) -> np.ndarray:
    """Each row's place in its run of equal groups, from 0."""
    at = np.arange(len(groups))
    begin = np.concatenate(([True], groups[1:] != groups[:-1])) if len(groups) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(begin, at, 0)) if len(groups) else at


def _places(n: int, n_quant: int) -> np.ndarray:
    """Where the points of a grid are among n distances in order."""
    return np.arange(n_quant) * (n - 1) // max(1, n_quant - 1)


def _points(d: np.ndarray, n_quant: int) -> np.ndarray:
    """The grid of each row of distances, which are in order."""
    return d[:, _places(d.shape[1], n_quant)]


#: What is made of a block of queries: their ids, distances (a row each), and the rows they are distances to, by code and id.
Work = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]
#: The same from queries' ids, vectors and the rows.
Direct = Callable[[np.ndarray, np.ndarray, Rows], pa.RecordBatch]


def _by_query(queries: DataFrame, rows: int, held: dict[int, Rows], work: Work, schema: T.StructType, direct: Direct | None = None) -> DataFrame:
    """work() on each query's distances to all held rows; queries are dealt to tasks by id, so one that has several vectors is whole.

    direct() instead, if there is one, for queries that have one vector."""
    q = queries.filter("qid is not null and qvec is not null").select(F.col("qid").cast("long").alias("qid"), F.col("qvec").cast("array<double>").alias("qvec"))
    n = q.count()
    tasks = max(1, min(n, max(-(-n * rows // TASK_PAIRS), min(-(-n * rows // (TASK_PAIRS // 8)), 2 * q.sparkSession.sparkContext.defaultParallelism))))
    sent = q.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [*batches]
        if not batches:
            return
        asked = pa.Table.from_batches(batches)
        ids, held = asked.column(0).to_numpy(), sent.value
        known, counts = np.unique(ids, return_counts=True)
        several = known[counts > 1]
        parts = {}
        for dim, (at, v) in by_length(asked.column(1), finite=False).items():
            if dim not in held:
                continue
            own, alone = held[dim], np.nonzero(~np.isin(ids[at], several))[0]
            step = max(1, min(16 if direct is None else 64, PAIRS // max(1, len(own.ids))))
            for i in range(0, len(alone), step):
                some = alone[i : i + step]
                yield work(ids[at[some]], distance_rows(v[some], own.x), own.ids, own.codes) if direct is None else direct(ids[at[some]], v[some], own)
            for i in np.nonzero(np.isin(ids[at], several))[0]:
                parts.setdefault(ids[at[i]], []).append((own, v[i : i + 1]))
        for qid, found in parts.items():
            i, c, n = (np.concatenate([getattr(own, name) for own, _ in found]) for name in ("ids", "codes", "counts"))
            order = np.repeat(np.lexsort((i, c)), n[np.lexsort((i, c))])
            yield work(np.array([qid]), np.concatenate([distance_rows(v, own.x) for own, v in found], axis=1)[:, order], i[order], c[order])

    return q.repartition(tasks, "qid").mapInArrow(run, schema)


def _by_rows(base: DataFrame, queries: DataFrame, label: str | None, of: Callable[[np.ndarray, np.ndarray, Rows, pa.Array | None], pa.RecordBatch], schema: T.StructType, send_bytes: int) -> DataFrame:
    """of(query ids, vectors, rows, labels by code) on blocks of rows and queries, for a base that is too large to be sent.

    Queries are sent to all tasks, in as many parts as need be, so every pair of row and query meets once."""
    q = queries.filter("qid is not null and qvec is not null").select(F.col("qid").cast("long").alias("qid"), F.col("qvec").cast("array<double>").alias("qvec"))
    n, dim = q.agg(F.count("*"), F.coalesce(F.max(F.size("qvec")), F.lit(0))).first()
    parts = max(1, -(-8 * n * (dim + 1) // send_bytes))
    spark = q.sparkSession
    tasks = min(-(-base.count() // BLOCK), spark.sparkContext.defaultParallelism)
    base = base.repartition(tasks, "id") if base.rdd.getNumPartitions() < tasks else base

    def part(k: int) -> DataFrame:
        t = q.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == k).toArrow()
        ids = t.column(0).to_numpy()
        sent = spark.sparkContext.broadcast({dim: (ids[at], v) for dim, (at, v) in by_length(t.column(1), finite=False).items()})

        def block(t: pa.Table) -> Iterator[pa.RecordBatch]:
            labels = None if label is None else _encoded(t.column(2))
            codes = np.zeros(t.num_rows, np.int64) if labels is None else labels.indices.to_numpy().astype(np.int64)
            for dim, own in Rows.of(t.column(0).to_numpy(), codes, t.column(1)).items():
                qids, v = sent.value.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
                for at in range(0, len(qids), 64):
                    yield of(qids[at : at + 64], v[at : at + 64], own, None if labels is None else labels.dictionary)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows = [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    piece = batch.slice(at, BLOCK)
                    if rows + piece.num_rows > BLOCK:
                        yield from block(pa.Table.from_batches(held))
                        held, rows = [], 0
                    held.append(piece)
                    rows += piece.num_rows
            if held:
                yield from block(pa.Table.from_batches(held))

        return base.mapInArrow(run, schema)

    return reduce(DataFrame.union, [part(k) for k in range(parts)])


def _encoded(labels: pa.Array | pa.ChunkedArray) -> pa.DictionaryArray:
    """Labels as codes; null is a label too."""
    whole = labels.combine_chunks() if isinstance(labels, pa.ChunkedArray) else labels
    return whole.dictionary_encode(null_encoding="encode")


def _labelled(base: DataFrame, label: str | None) -> DataFrame:
    rows = base.filter("id is not null and v is not null")
    return rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), *([] if label is None else [label]))


def _kept_here(rows: DataFrame, label: str | None, send_bytes: int) -> tuple[int, dict[int, Rows], pa.Array | None] | None:
    """Number, vectors and labels of the rows, if they fit into a message."""
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if n * 8 * (dim + 2) > send_bytes:
        return None
    t = rows.toArrow()
    if label is None:
        return n, Rows.of(t.column(0).to_numpy(), np.zeros(n, np.int64), t.column(1)), None
    labels = _encoded(t.column(2))
    return n, Rows.of(t.column(0).to_numpy(), labels.indices.to_numpy().astype(np.int64), t.column(1)), labels.dictionary


def _batch(schema: T.StructType, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)


def grouped_topk(base: DataFrame, queries: DataFrame, label: str, k: int, *, send_bytes: int = SEND_BYTES) -> DataFrame:
    """(qid, label, rank, id, dist): k nearest for each query and label, ties to the smaller id; pairs without a distance are left out.

    A base that fits into a message is sent to tasks that hold some of the queries; else tasks find the k nearest of their
    rows for each query and label, and only these are shuffled."""
    rows = _labelled(base, label)
    kind = rows.schema[label].dataType
    held = _kept_here(rows, label, send_bytes)
    if held is None:
        schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField(label, kind), T.StructField("id", T.LongType()), T.StructField("dist", T.DoubleType())])

        def best(qids, v, own, labels):
            r, c, d = _nearest(own, v, k)
            return _batch(schema, qids[r], labels.take(pa.array(own.codes[c])), own.ids[c], d)

        order = Window.partitionBy("qid", label).orderBy("dist", "id")
        pairs = _by_rows(rows, queries, label, best, schema, send_bytes)
        return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", label, "rank", "id", "dist")
    n, held, labels = held
    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField(label, kind), T.StructField("rank", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("dist", T.DoubleType())])

    def work(qids, d, ids, codes):
        r, c = _segments(d, ids, codes, k)
        rank = _place(r * (int(codes.max(initial=0)) + 1) + codes[c]) + 1
        return _batch(schema, qids[r], labels.take(pa.array(codes[c])), rank.astype(np.int32), ids[c], d[r, c])

    def direct(qids, v, own):
        r, c, d = _nearest(own, v, k)
        rank = _place(r * (int(own.codes.max(initial=0)) + 1) + own.codes[c]) + 1
        return _batch(schema, qids[r], labels.take(pa.array(own.codes[c])), rank.astype(np.int32), own.ids[c], d)

    return _by_query(queries, n, {dim: own.first_copies(k) for dim, own in held.items()}, work, schema, direct)


def distance_grid(base: DataFrame, queries: DataFrame, n_quant: int, *, send_bytes: int = SEND_BYTES) -> DataFrame:
    """(qid, i, quant): each query's distances, in order, at places i * (N - 1) / (n_quant - 1), whole division.

    A base that fits into a message is sent to tasks that hold some of the queries, and nothing is shuffled but these; else the
    distances of each block of rows are packed, and a query's are put in order in one task. Pairs without a distance are left out."""
    rows = _labelled(base, None)
    held = _kept_here(rows, None, send_bytes)
    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("quant", T.DoubleType())])

    def grid(qids: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        return shown(qids, _points(np.sort(d, axis=1), n_quant) if d.shape[1] else np.zeros((len(qids), 0)))

    def shown(qids: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        return _batch(schema, np.repeat(qids, points.shape[1]), np.tile(np.arange(points.shape[1], dtype=np.int32), len(qids)), points.ravel())

    if held is not None:
        direct = lambda qids, v, own: shown(qids, _at_places(own, v, _places(int(own.counts.sum()), n_quant)) if len(own.ids) else np.zeros((len(qids), 0)))
        return _by_query(queries, held[0], {dim: own.distinct() for dim, own in held[1].items()}, lambda qids, d, ids, codes: grid(qids, d), schema, direct)
    packed = T.StructType([T.StructField("qid", T.LongType()), T.StructField("dists", T.BinaryType())])

    def pack(qids, v, own, labels):
        return _batch(packed, qids, pa.array([row.tobytes() for row in distance_rows(v, own.x)], pa.binary()))

    def together(t: pa.Table) -> pa.Table:
        d = np.concatenate([np.frombuffer(v.as_buffer(), np.float64) for v in t.column("dists")])
        return pa.Table.from_batches([grid(t.column("qid").to_numpy()[:1], d[None, :])])

    return _by_rows(rows, queries, None, pack, packed, send_bytes).groupBy("qid").applyInArrow(together, schema)


def rank_fractions(base: DataFrame, queries: DataFrame, label: str, k: int, n_quant: int, *, send_bytes: int = SEND_BYTES) -> DataFrame:
    """(qid, label, mean_rho, max_rho): where each label's k nearest stand in the query's grid of distances, 0 to 1.

    A base that fits into a message gives both from one row of distances a query."""
    rows = _labelled(base, label)
    kind = rows.schema[label].dataType
    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField(label, kind), T.StructField("mean_rho", T.DoubleType()), T.StructField("max_rho", T.DoubleType())])
    held = _kept_here(rows, label, send_bytes)
    if held is not None:
        n, held, labels = held

        def work(qids, d, ids, codes):
            r, c = _segments(d, ids, codes, k)
            grids = _points(np.sort(d, axis=1), n_quant) if d.shape[1] else d
            ends = np.searchsorted(r, np.arange(len(d) + 1))
            rho = np.concatenate([np.zeros(0), *[np.searchsorted(grids[i], d[i, c[a:b]], "right") for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]]) / n_quant
            begin = np.nonzero(_place(r * len(labels) + codes[c]) == 0)[0]
            mean, most = (np.add.reduceat(rho, begin) / np.diff([*begin, len(rho)]), np.maximum.reduceat(rho, begin)) if len(begin) else (rho, rho)
            return _batch(schema, qids[r[begin]], labels.take(pa.array(codes[c[begin]])), mean, most)

        found = _by_query(queries, n, held, work, schema)
    else:
        grid = distance_grid(base, queries, n_quant, send_bytes=send_bytes).groupBy("qid").agg(F.sort_array(F.collect_list("quant")).alias("grid"))
        near = grouped_topk(base, queries, label, k, send_bytes=send_bytes).groupBy("qid", label).agg(F.collect_list("dist").alias("dists"))

        def fractions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    b = batch.slice(at, 1024)
                    rho = [np.searchsorted(np.asarray(g.values), np.asarray(d.values), "right") / n_quant for d, g in zip(b.column(2), b.column(3), strict=True)]
                    yield _batch(schema, b.column(0), b.column(1), np.array([r.mean() for r in rho]), np.array([r.max() for r in rho]))

        found = near.join(grid, "qid").mapInArrow(fractions, schema)
    # A row for every query and label is the result asked for; null is a label too.
    every = queries.select(F.col("qid").cast("long").alias("qid")).distinct().crossJoin(_sent(settle(base.select(F.col(label).alias("of")).distinct()), 64))
    out = every.join(found, (every["qid"] == found["qid"]) & every["of"].eqNullSafe(found[label]), "left")
    return out.select(every["qid"], F.col("of").alias(label), F.coalesce("mean_rho", F.lit(1.0)).alias("mean_rho"), F.coalesce("max_rho", F.lit(1.0)).alias("max_rho"))


def _sent(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, to be broadcast if that is a message of bounded size."""
    return F.broadcast(df) if df.count() * row_bytes <= SEND_BYTES else df


def label_counts(base: DataFrame, label: str) -> DataFrame:
    return base.groupBy(label).agg(F.count("*").alias("n"))


def nearest_centroid(base: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, cid, dist): nearest of centroids(id, v) for each row, ties to the smaller centroid."""
    near = exact_topk(centroids, base.select(F.col("id").alias("qid"), F.col("v").alias("qvec")), 1)
    return near.select(F.col("qid").alias("id"), F.col("id").alias("cid"), "dist")
