"""Results that need every distance of a query: k nearest by label, grids of distances, and ranks in them."""

import math

import numpy as np
import pytest

from ridgeline.operators import knn

SCHEMA = "id long, v array<double>, label int"
#: A limit that the rows fit into, and ones that they don't: with all queries in one part, and in several.
LIMITS = (knn.SEND_BYTES, 2_000, 300)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(i, [float(x) for x in rng.integers(0, 3, 3)], int(i % 4) if i % 11 else None) for i in range(120)]
    out[7] = (7, None, 1)
    out[9] = (9, [1.0, None, 0.0], 2)
    out[13] = (13, [math.nan, 0.0, 0.0], 3)
    out[17] = (17, [math.inf, 0.0, 0.0], 3)
    out[19] = (19, [1.0, 2.0], 1)
    return [*out, (200, [0.0, 1.0, 2.0], 9), (201, [math.nan, 1.0, 1.0], 9), (202, None, 8)]


def asked(rows):
    """One id has two vectors, one a vector of another length, one none."""
    return [(i, v) for i, v, _ in rows if i % 20 == 0 and i < 200] + [(20, [2.0, 2.0, 1.0]), (300, [1.0, 1.0]), (301, None)]


def distances(rows, queries):
    """qid -> (distance, id, label) of all pairs that have one, in order."""
    found = {}
    for q, w in queries:
        for i, v, label in rows:
            if v and w and len(v) == len(w) and None not in v:
                d = 0.0
                for x, y in zip(v, w, strict=True):
                    d += (x - y) * (x - y)
                found.setdefault(q, []).append((d, i, label))
    return {q: sorted(f, key=lambda t: (math.isnan(t[0]), t[0] if t[0] == t[0] else 0, t[1])) for q, f in found.items()}


def frames(spark, rows):
    q = asked(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(q, "qid long, qvec array<double>"), distances(rows, q)


@pytest.mark.parametrize("limit", LIMITS)
def test_grouped(spark, rows, limit):
    base, queries, pairs = frames(spark, rows)
    want = set()
    for q, found in pairs.items():
        for label in {t[2] for t in found}:
            want |= {(q, label, k + 1, i, str(d)) for k, (d, i, _) in enumerate([t for t in found if t[2] == label][:3])}
    got = [(*r[:4], str(r[4])) for r in knn.grouped_topk(base, queries, "label", 3, send_bytes=limit).collect()]
    assert len(got) == len(want)
    assert set(got) == want


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("points", [1, 7, 300])
def test_grid(spark, rows, limit, points):
    base, queries, pairs = frames(spark, rows)
    want = {(q, i, str(f[i * (len(f) - 1) // max(1, points - 1)][0])) for q, f in pairs.items() for i in range(points)}
    got = [(r["qid"], r["i"], str(r["quant"])) for r in knn.distance_grid(base, queries, points, send_bytes=limit).collect()]
    assert len(got) == len(want)
    assert set(got) == want


@pytest.mark.parametrize("limit", LIMITS)
def test_ranks(spark, rows, limit):
    """A null label has ranks of its own; labels and queries without a distance have 1."""
    base, queries, pairs = frames(spark, rows)
    want = {(q, label): (1.0, 1.0) for q, _ in asked(rows) for label in {t[2] for t in rows}}
    for q, found in pairs.items():
        order = lambda d: (math.isnan(d), d if d == d else 0)
        grid = [order(found[i * (len(found) - 1) // 15][0]) for i in range(16)]
        for label in {t[2] for t in found}:
            rho = [sum(g <= order(d) for g in grid) / 16 for d, _, x in found if x == label][:5]
            want[q, label] = (sum(rho) / len(rho), max(rho))
    got = {(r["qid"], r["label"]): (r["mean_rho"], r["max_rho"]) for r in knn.rank_fractions(base, queries, "label", 5, 16, send_bytes=limit).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


@pytest.mark.parametrize("limit", LIMITS)
def test_nothing(spark, limit):
    base, queries = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, [0.0, 1.0])], "qid long, qvec array<double>")
    assert knn.grouped_topk(base, queries, "label", 3, send_bytes=limit).count() == 0
    assert knn.distance_grid(base, queries, 8, send_bytes=limit).count() == 0
    assert knn.rank_fractions(base, queries, "label", 3, 8, send_bytes=limit).count() == 0
    assert knn.grouped_topk(queries.selectExpr("qid AS id", "qvec AS v", "1 AS label"), queries.filter("false"), "label", 3, send_bytes=limit).count() == 0


@pytest.mark.parametrize("make", [lambda b, q: knn.grouped_topk(b, q, "label", 3), lambda b, q: knn.distance_grid(b, q, 64), lambda b, q: knn.rank_fractions(b, q, "label", 5, 64)], ids=["grouped", "grid", "ranks"])
def test_pairs_are_no_rows(spark, rows, make):
    """Spark sees neither a row for each pair nor a sort or shuffle of them."""
    base, queries, _ = frames(spark, rows)
    plan = make(base, queries)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "Window" not in plan


ODD = {
    "plain": lambda rng, n: rng.standard_normal((n, 8)),
    "ties": lambda rng, n: rng.integers(0, 3, (n, 3)).astype(float),
    "far": lambda rng, n: 1e6 + rng.standard_normal((n, 8)),
    "farther": lambda rng, n: 1e6 + 1e-8 * rng.standard_normal((n, 8)),
    "sizes": lambda rng, n: rng.standard_normal((n, 8)) * 10.0 ** rng.integers(-200, 170, (n, 1)),
    "not finite": lambda rng, n: np.where(rng.random((n, 8)) < 0.02, rng.choice([math.nan, math.inf, -math.inf, 1e200], (n, 8)), rng.standard_normal((n, 8))),
    "copies": lambda rng, n: np.repeat(rng.standard_normal((-(-n // 30), 8)), 30, axis=0)[:n],
    "of length 0": lambda rng, n: np.zeros((n, 0)),
}


def made(kind, n):
    rng = np.random.default_rng(5)
    x = ODD[kind](rng, n)
    own = knn.Rows(rng.permutation(n) * 3, rng.integers(0, 5, n), x)
    q = np.concatenate([x[:20], ODD[kind](rng, 20)])
    return own, q, knn.distance_rows(q, own.x)


def counted(monkeypatch):
    """The numbers of pairs whose distances are summed in order from now on."""
    pairs, f = [], knn.distance_rows
    monkeypatch.setattr(knn, "distance_rows", lambda q, x: pairs.append(len(q) * x.shape[1]) or f(q, x))
    return pairs


@pytest.mark.parametrize("n", [1, 4, 2000])
@pytest.mark.parametrize("kind", ODD)
def test_nearest_of_odd_vectors(kind, n):
    """What a product of matrices leaves, copies left out, gives what all distances give."""
    own, q, d = made(kind, n)
    near, error = own.near().distances(q)
    known = np.isfinite(d) & np.isfinite(error)[:, None]
    assert (np.abs(near[known] - d[known]) <= np.broadcast_to(error[:, None], d.shape)[known]).all()
    r, c = knn._segments(d, own.ids, own.codes, 3)
    for rows in (own, own.first_copies(3)):
        row, col, dist = knn._nearest(rows, q, 3)
        assert np.array_equal(row, r) and np.array_equal(rows.ids[col], own.ids[c]) and np.array_equal(rows.codes[col], own.codes[c])
        assert np.array_equal(dist, d[r, c], equal_nan=True)


@pytest.mark.parametrize("kind", ["plain", "copies"])
def test_nearest_sums_few_distances(monkeypatch, kind):
    own, q, _ = made(kind, 2000)
    pairs = counted(monkeypatch)
    row, _, _ = knn._nearest(own.first_copies(3), q, 3)
    assert len(row) == len(q) * 5 * 3
    assert sum(pairs) <= 0.05 * len(q) * 2000


@pytest.mark.parametrize("n", [1, 4, 2000])
@pytest.mark.parametrize("kind", ODD)
def test_places_of_odd_vectors(kind, n):
    """Places among near distances, every vector once, give what all distances in order give."""
    own, q, d = made(kind, n)
    for points in (1, 7, 300):
        want = knn._points(np.sort(d, axis=1), points)
        for rows in (own, own.distinct()):
            assert np.array_equal(knn._at_places(rows, q, knn._places(int(rows.counts.sum()), points)), want, equal_nan=True)


@pytest.mark.parametrize("kind", ["plain", "copies"])
def test_grid_sums_few_distances(monkeypatch, kind):
    own, q, _ = made(kind, 2000)
    pairs = counted(monkeypatch)
    assert knn._at_places(own.distinct(), q, knn._places(2000, 64)).shape == (len(q), 64)
    assert sum(pairs) <= 0.05 * len(q) * 2000


def test_copies_are_sent_once(spark, monkeypatch):
    """Copies change what is sent by nothing, and the grid as rows of their own."""
    sent, f = [], knn._by_query
    monkeypatch.setattr(knn, "_by_query", lambda queries, rows, held, *more: sent.append({n: own.x.shape for n, own in held.items()}) or f(queries, rows, held, *more))
    base = spark.createDataFrame([(i, [float(i % 3), 0.0]) for i in range(300)], "id long, v array<double>")
    got = knn.distance_grid(base, spark.createDataFrame([(1, [0.0, 0.0])], "qid long, qvec array<double>"), 7).orderBy("i").collect()
    assert [r["quant"] for r in got] == [0.0, 0.0, 0.0, 1.0, 1.0, 4.0, 4.0]
    assert sent == [{2: (2, 3)}]
