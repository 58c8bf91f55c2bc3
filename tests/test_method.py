import numpy as np
from pyspark.sql import functions as F

from ridgeline.functions import predicates as P
from ridgeline.operators import cost, graph, navigate
from ridgeline.plans.method import BuildParams, ExactScan, GraphSearch, PostFilter, RegionIndex, RoutedIndex
from ridgeline.session import settle
from ridgeline.sources import convert, files


def test_methods_on_the_same_data(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(4).tolist(), float(rng.integers(0, 4)), float(rng.exponential(10))) for i in range(500)]
    base = settle(spark.createDataFrame(rows, "id bigint, v array<double>, label double, value double"))
    q = base.filter("id < 4").select(F.col("id").alias("qid"), F.col("v").alias("qvec"))
    predicate = P.dnf((P.eq("label", 1), P.lt("value", 5)))
    out = []
    for m in (ExactScan(), PostFilter(500), GraphSearch(500, navigate.EAGER), RoutedIndex(ef=500), RoutedIndex(ef=500, force="best_first"), RegionIndex()):
        m.build(base, BuildParams(numeric=["value"], categorical=["label"], buckets=8))
        out.append(sorted(map(tuple, m.search(q, predicate, 5).collect())))
        assert m.persistent_bytes() > 0 or isinstance(m, (ExactScan, PostFilter))
    assert all(x == out[0] for x in out) and len(out[0]) == 20
    more = base.withColumn("side", (F.col("id") % 2).cast("double"))
    assert m.add_column(more, "side", categorical=True) > 0
    both = P.dnf((P.eq("side", 1), P.lt("value", 5)))
    exact = ExactScan()
    exact.build(more, BuildParams())
    assert sorted(map(tuple, m.search(q, both, 5).collect())) == sorted(map(tuple, exact.search(q, both, 5).collect()))
    assert sorted(map(tuple, graph.nodes(base, send_bytes=0).collect())) == sorted(map(tuple, graph.nodes(base).collect()))


def test_calibration(spark):
    base = spark.range(1000).select("id", F.array(F.rand(1), F.rand(2)).alias("v"), F.rand(3).alias("x"))
    c = cost.calibrate(base, F.col("x") < 0.5, [0.0, 1.0])
    assert c.c_pred > 0 and c.c_dist > 0 and c.degree == 21
    s = spark.createDataFrame([(0.001, 10, 2), (0.005, 20, 3), (0.5, 9, 3), (0.2, 5, 0)], "sigma double, visited int, regions int")
    assert {r["band"]: r["mean_visited"] for r in cost.means_by_band(s).collect()} == {0: 6.0, 4: 3.0, 3: 0.0}


def test_converted_files(spark, tmp_path):
    convert.write_vectors(np.array([[1, 2], [3, 4]]), tmp_path / "a.fvecs")
    assert files.read_fvecs(spark, str(tmp_path / "a.fvecs")).count() == 2
    kinds = convert.write_attributes({"n": np.array([1.5, 2]), "c": np.array(["a,b", "c"], object)}, tmp_path / "a.csv")
    assert kinds == {"n": "numeric", "c": "categorical"}
    rows = files.load_csv_columns(spark, str(tmp_path / "a.csv"), list(kinds.items())).orderBy("id").collect()
    assert [(r["n"], r["c"]) for r in rows] == [(1.5, "a;b"), (2.0, "c")]
