import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import predicates as P
from ridgeline.functions.vectors import l2_sqr, neg_inner_product
from ridgeline.operators import graph, knn, metrics, quantiles, regions
from ridgeline.session import settle

TINY = [(0, [0.0], 1.0), (1, [1.0], 1.0), (2, [2.0], 0.0), (3, [3.0], 1.0), (4, [4.0], 1.0)]


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame(TINY, "id bigint, v array<double>, c double"), spark.createDataFrame([(0, [0.0])], "qid bigint, qvec array<double>")


@pytest.fixture(scope="module")
def cloud(spark):
    x = np.random.default_rng(11).standard_normal((3000, 8)).astype("float32")
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, v array<float>").cache(), x.astype(float)


def test_tiny_ground_truth(tiny):
    base, q = tiny
    predicate = P.dnf((P.eq("c", 1),))
    rows = knn.exact_topk(base, q, 3, predicate=predicate).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [0, 1, 3] and rows[0]["dist"] == 0.0
    assert knn.n_satisfying(base, predicate).first()[0] == 4


def test_distances(spark):
    row = spark.createDataFrame([([0.0, 0.0, 0.0], [3.0, 4.0, 0.0], None)], "a array<double>, b array<double>, n array<double>")
    got = row.select(l2_sqr(F.col("a"), F.col("b")), neg_inner_product(F.col("b"), F.col("b")), l2_sqr(F.col("a"), F.col("n"))).first()
    assert tuple(got) == (25.0, -25.0, None)


@pytest.mark.parametrize(("got", "truth", "n", "want"), [([0, 1, 3], [0, 1, 3], 10, 1.0), ([0, 9, 3], [0, 1, 3], 10, 2 / 3), ([0, 1], [0, 1], 2, 1.0), ([0, 7], [0, 1], 2, 0.5), ([], [], 0, 1.0)])
def test_recall(spark, got, truth, n, want):
    rows = lambda ids: spark.createDataFrame([(0, k + 1, i) for k, i in enumerate(ids)], "qid bigint, rank int, id bigint")
    q = spark.createDataFrame([(0,)], "qid bigint")
    assert metrics.recall(rows(got), rows(truth), q, n, 3).first()["recall"] == pytest.approx(want)


@pytest.mark.parametrize("send", [knn.SEND_BYTES, 47, 1])
def test_vectors_of_other_lengths_and_odd_components(spark, send):
    inf = float("inf")
    base = spark.createDataFrame([(1, [1.0]), (2, [2.0, 3.0, 4.0]), (3, [1.0, 3.0]), (4, None), (5, [1.0, None]), (6, [inf, 0.0]), (7, []), (8, [0.0, 2.0])], "id bigint, v array<double>")
    q = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0]), (2, []), (3, None)], "qid bigint, qvec array<double>")
    got = [tuple(r) for r in knn.exact_topk(base, q, 5, send_bytes=send).orderBy("qid", "rank").collect()]
    assert got == [(0, 1, 3, 1.0), (0, 2, 8, 1.0), (1, 1, 1, 1.0), (2, 1, 7, 0.0)]


def test_roots_without_a_distance(spark):
    base = spark.createDataFrame([(i, [float(i)] * (2 if i % 2 else 3)) for i in range(400)] + [(500, None), (501, [1.0] * 9)], "id bigint, v array<double>")
    rows = {r["id"]: r for r in graph.nodes(base).collect()}
    assert 500 not in rows and rows[501]["father"] == 501
    assert all(r["father"] % 2 == i % 2 for i, r in rows.items() if i < 400)
    far = graph.nodes(base, send_bytes=1)
    assert {r["id"]: r["father"] for r in far.collect()} == {i: r["father"] for i, r in rows.items()}


def test_voronoi_cells_without_an_anchor(spark, cloud):
    base, _ = cloud
    n = graph.nodes(base)
    entry = n.orderBy(F.desc("level"), "id").first()["id"]
    assert {r["region"] for r in regions.voronoi_regions(base, n, 99).collect()} == {entry}


def test_regions_grown_along_edges(spark, cloud):
    base, x = cloud
    n, e = settle(graph.nodes(base)), settle(graph.knn_edges(base.filter("id < 2990"), 6))
    got = {r["id"]: (r["region"], r["dist"]) for r in regions.grown_regions(base, n, e, 3).collect()}
    far = lambda a, b: float(((x[a] - x[b]) ** 2).sum())
    out: dict[int, list[int]] = {}
    for r in e.collect():
        out.setdefault(r["src"], []).append(r["dst"])
    now = {r["id"]: (r["id"], 0.0) for r in n.collect() if r["level"] >= 3}
    front = dict(now)
    while front:
        offers: dict[int, tuple[float, int]] = {}
        for i, (region, _) in front.items():
            for j in out.get(i, ()):
                offers[j] = min(offers.get(j, (np.inf, -1)), (far(j, region), region))
        front = {j: (region, d) for j, (d, region) in offers.items() if j not in now or d < now[j][1] - 1e-12}
        now |= front
    assert set(got) == set(range(3000)) and all(got[i] == (i, 0.0) for i in got if i not in now)
    assert all(got[i][0] == now[i][0] and got[i][1] == pytest.approx(now[i][1]) for i in now)


def test_a_frontier_behind_many_empty_regions(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(70)], "r_src bigint, r_dst bigint")
    empty = spark.createDataFrame([(i,) for i in range(1, 70)], "region bigint")
    got = regions.transparent_frontier(pairs, empty, spark.createDataFrame([(0,)], "region bigint")).collect()
    assert [tuple(r) for r in got] == [(0, 70)]


def test_three_ways_agree_with_numpy(spark, cloud):
    base, x = cloud
    q = base.filter("id % 60 = 0").select(F.col("id").alias("qid"), F.col("v").alias("qvec"))
    want = {}
    for i in range(0, 3000, 60):
        d = ((x - x[i]) ** 2).sum(axis=1)
        want[i] = np.lexsort((np.arange(3000), d))[:5].tolist()
    plans = [knn.exact_topk(base, q, 5), knn.exact_topk(base, q, 5, send_bytes=50 * 72 - 1), knn.exact_topk(q.select(F.col("qid").alias("id"), F.col("qvec").alias("v")), base.select(F.col("id").alias("qid"), F.col("v").alias("qvec")), 1, send_bytes=50 * 72)]
    for got in plans[:2]:
        found = {}
        for r in got.orderBy("qid", "rank").collect():
            found.setdefault(r["qid"], []).append(r["id"])
        assert found == want
    near = {r["qid"]: r["id"] for r in plans[2].collect()}
    anchors = np.arange(0, 3000, 60)
    assert all(near[i] == anchors[np.argmin(((x[anchors] - x[i]) ** 2).sum(axis=1))] for i in range(0, 3000, 7))


def test_predicate_edges(spark):
    rows = spark.createDataFrame([(0, float("nan"), "a"), (1, 1.0, ""), (2, None, None), (3, 5.0, "xay")], "id bigint, v double, t string")
    ids = lambda p: [r["id"] for r in rows.filter(p.condition()).orderBy("id").collect()]
    assert ids(P.dnf((P.gt("v", 0),))) == [1, 3]
    assert ids(P.dnf((P.lt("v", 5),))) == [1]
    assert ids(P.dnf((P.interval("v", 1, 5),))) == []
    assert ids(P.dnf((P.contains("t", ""),))) == []
    assert ids(P.dnf((P.contains("t", "a"),))) == [0, 3]
    assert ids(P.dnf()) == [] and ids(P.dnf(())) == [0, 1, 2, 3]
    assert P.dnf((P.lt("v", 0.1000001),)).key() != P.dnf((P.lt("v", 0.1),)).key()


def test_predicates_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(TINY, "id bigint, v array<double>, c double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).filter(P.dnf((P.lt("c", 1),)).condition()).select("id")
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "c#" in plan and "v#" not in plan.split("== Physical Plan ==")[1]


def test_order_statistics_in_parts(spark):
    x = np.random.default_rng(3).integers(0, 500, 4000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    s = np.sort(x)
    ranks = [0, 1, 77, 1999, 3999, 4000]
    for one_window in (10, 10_000):
        assert quantiles.order_statistics(df, "x", ranks, one_window) == {r: float(s[r]) for r in ranks[:-1]}
    assert quantiles.quantiles(spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double"), "x", [0.3, 1.0, -1, 0.0]) == [4.0, 10.0, 1.0, 1.0]
    assert quantiles.quantiles(df.filter("false"), "x", [0.5]) == [0.0]


def test_forest_contract(cloud):
    base, _ = cloud
    n = graph.nodes(base)
    rows = {r["id"]: r for r in n.collect()}
    assert all(r["father"] == i or rows[r["father"]]["level"] > r["level"] for i, r in rows.items())
    two, three = regions.forest_regions(n, 2), regions.forest_regions(n, 3)
    of = {r["id"]: r["region"] for r in two.collect()}
    assert len(of) == 3000 and all(of[r] == r for r in set(of.values()))
    assert regions.region_sizes(two).agg(F.sum("n")).first()[0] == 3000
    for i, r in rows.items():
        assert of[i] == (i if r["level"] >= 2 or r["father"] == i else of[r["father"]])
    assert three.select("region").distinct().count() <= two.select("region").distinct().count()


def test_empty_tables(spark, tiny):
    base, q = tiny
    assert knn.exact_topk(base.filter("false"), q, 3).count() == 0
    assert knn.exact_topk(base, q.filter("false"), 3).count() == 0
    assert graph.nodes(base.filter("false")).count() == 0


def test_settled_tables(spark):
    from ridgeline.session import own_dir, settle

    assert "/ridgeline-" in own_dir(spark)
    df = settle(spark.range(3).filter("id > 5"))
    assert df.count() == 0 and df.schema["id"].dataType.simpleString() == "bigint"


