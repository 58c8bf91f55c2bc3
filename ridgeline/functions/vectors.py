"""Distances between vectors: as Spark expressions, and as NumPy kernels for Arrow scans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip")


def _fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, t: s + t)


def l2_sqr(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision; null if a vector is null or the lengths differ."""
    return _fold(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))


def neg_inner_product(a: Column, b: Column) -> Column:
    """Minus the inner product, so that smaller is nearer."""
    return -_fold(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return l2_sqr(a, b) if metric == "l2" else neg_inner_product(a, b)


#: Vectors whose distances are summed together, so that what is summed stays in a core's cache.
COLUMNS = 4096
#: Squares up to which sums of them stay finite, and an error that is more than what underflow may add.
HUGE, TINY = 1e300, 1e-300


def by_length(column: pa.Array | pa.ChunkedArray, finite: bool = True) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length of vectors -> (places in the column, those vectors as rows of a matrix).

    Vectors that are null or have a null or non-finite component are left out, as they have no distance to any other; without
    finite only those that are null or have a null component."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    at = 0
    for c in chunks:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(c), -1).to_numpy(zero_copy_only=False), np.int64)
        flat = c.flatten()
        there = None if finite or not flat.null_count else flat.is_valid().to_numpy(zero_copy_only=False)
        flat = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64)
        begin = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        for n in np.unique(sizes[sizes >= 0]).tolist():
            rows = np.nonzero(sizes == n)[0]
            taken = lambda a: a.reshape(-1, n) if n and len(rows) == len(sizes) else a[begin[rows][:, None] + np.arange(n)]  # noqa: B023, E731
            x = taken(flat)
            whole = np.isfinite(x).all(axis=1) if finite else np.ones(len(x), bool) if there is None else taken(there).all(axis=1)
            out.setdefault(n, []).append((rows[whole] + at, x if whole.all() else x[whole]))
        at += len(c)
    return {n: (np.concatenate([r for r, _ in parts]), np.concatenate([x for _, x in parts])) for n, parts in out.items()}


def exact_distances(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, summed in order like the Spark expression."""
    terms = (x - q) ** 2 if metric == "l2" else -(x * q)
    return np.cumsum(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


def distance_rows(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """exact_distances of each query, a row of q, to all vectors; x holds these as columns. Squared Euclidean."""
    out, term = np.zeros((len(q), x.shape[1])), np.empty(COLUMNS)
    with np.errstate(invalid="ignore", over="ignore"):
        for at in range(0, x.shape[1], COLUMNS):
            part = x[:, at : at + COLUMNS]
            t = term[: part.shape[1]]
            for row, d in zip(q, out[:, at : at + COLUMNS], strict=True):
                for component, other in zip(row, part, strict=True):
                    np.subtract(other, component, out=t)
                    np.multiply(t, t, out=t)
                    np.add(d, t, out=d)
    return out


class Near:
    """Distances up to a known error, by one matrix product, to vectors of one length, the columns of x.

    Vectors and queries are moved by the mean, so that an offset they have in common adds no error."""

    def __init__(self, x: np.ndarray):
        with np.errstate(invalid="ignore", over="ignore"):
            some = np.isfinite(x).all(axis=0) & ((x * x).sum(axis=0) <= HUGE)
            self.mean = x[:, some].mean(axis=1) if some.any() else np.zeros(len(x))
            self.y = x - self.mean[:, None]
            self.squares = (self.y * self.y).sum(axis=0)
            some &= self.squares <= (1e6 * np.quantile(self.squares[some], 0.99) if some.any() else 0)
        #: Columns that are not finite or lie so far off that they would spoil the bound of all: their distances are exact.
        self.off = np.nonzero(~some)[0]
        self.x_off = x[:, self.off]
        self.y[:, self.off] = self.squares[self.off] = 0
        self.most = np.sqrt(self.squares.max(initial=0))

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances, error) of each query, a row of q: exact_distances differ from them by the error at most. Where the error is
        infinite the distances say nothing."""
        with np.errstate(invalid="ignore", over="ignore"):
            p = q - self.mean
            squares = (p * p).sum(axis=1)
            size = (np.sqrt(squares) + self.most) ** 2
            sound = size <= HUGE
            p[~sound] = squares[~sound] = 0
            # Both ways of summing n terms err by less than (3 n + 13) half units in the last place of size; this is twice that and more.
            error = np.where(sound, 4 * (q.shape[1] + 8) * np.finfo(float).eps * size + TINY, np.inf)
        d = p @ self.y
        d *= -2
        d += squares[:, None]
        d += self.squares
        np.maximum(d, 0, out=d)
        if len(self.off):
            d[:, self.off] = distance_rows(q, self.x_off)
        return d, error


def near_matrix(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of all pairs up to rounding, by one matrix product."""
    dot = q @ x.T
    return -dot if metric == "ip" else (q * q).sum(axis=1)[:, None] - 2 * dot + (x * x).sum(axis=1)[None, :]
