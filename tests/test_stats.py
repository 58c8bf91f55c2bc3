from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import predicates as P
from ridgeline.operators import cost, graph, knn, maintain, search, stats, synth
from ridgeline.session import settle
from ridgeline.streaming.maintenance import Maintainer, maintain_from


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(4).tolist(), float(rng.integers(0, 6)), float(rng.exponential(30))) for i in range(600)]
    base = settle(spark.createDataFrame(rows, "id bigint, v array<double>, label double, value double"))
    n = graph.nodes(base)
    f = stats.forest(n)
    schema = stats.schema_of(base, ["value"], ["label"], 16)
    return base, n, f, schema, stats.forest_stats(f, base, schema), rows


def test_edges_and_buckets(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 2, 3, 4, 5]], "x double")
    edges = stats.equi_depth_edges(df, "x", 4)
    assert edges == [1.0, 1.0, 2.0, 4.0, 6.0]
    got = [r[0] for r in df.select(stats.bucket_of(edges, F.col("x"))).collect()]
    assert got == [1, 1, 1, 1, 2, 2, 3, 3] == [stats.bucket_number(edges, x) for x in [1, 1, 1, 1, 2, 3, 4, 5]]
    assert stats.bucket_number(edges, -9) == 0 and stats.bucket_number(edges, 99) == 3
    assert stats.cover([0.0, 0.0, 2.0], 1.0) == [1.0, 0.5]
    assert stats.equi_depth_edges(df.filter("false"), "x", 4) == []


def test_regions_part_the_rows(made):
    base, _, f, _, s, _ = made
    assert s.region_map.count() == 600 and s.region_map.select("id").distinct().count() == 600
    roots = f.candidates.filter("parent is null").count()
    assert s.sizes.count() >= roots > 0
    top = s.sizes.join(f.candidates.filter("parent is null").select(F.col("c").alias("node")), "node").agg(F.sum("n")).first()[0]
    assert top == 600


PREDICATES = [P.dnf((P.lt("value", 2),)), P.dnf((P.gt("value", 120),)), P.dnf((P.interval("value", 10, 11),)), P.dnf((P.eq("label", 3), P.lt("value", 8))), P.dnf((P.eq("label", 99),)), P.dnf((P.eq("value", 5),), (P.eq("label", 0),)), P.dnf(), P.dnf(())]


@pytest.mark.parametrize("predicate", PREDICATES, ids=lambda p: p.canonical())
def test_pruning_loses_nothing(made, predicate):
    base, _, _, _, s, _ = made
    regions = search.admitted(s, predicate)
    lost = base.filter(predicate.condition()).join(s.region_map, "id").join(regions, "region", "left_anti")
    assert lost.count() == 0


def test_search_is_exact(made):
    base, _, _, _, s, _ = made
    q = base.filter("id < 5").select(F.col("id").alias("qid"), F.col("v").alias("qvec"))
    predicate = PREDICATES[3]
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(knn.exact_topk(base, q, 4, predicate=predicate))
    assert rows(search.search(base, s, q, predicate, 4)) == want
    stored = base.join(s.region_map, "id")
    assert rows(search.search(stored, s, q, predicate, 4)) == want


def test_equality_estimates_are_exact_where_kept(made):
    _, _, f, _, s, rows = made
    kept = s.hist_node.filter("col = 'label' and region = node")
    got = stats.sigma_hats(s, [P.eq("label", 2)]).join(kept, "region").collect()
    below = {}
    for r in f.fca.join(f.closure, "c").select("id", "anc").collect():
        below.setdefault(r["anc"], []).append(rows[r["id"]][2] == 2)
    assert got and all(r["s0"] == pytest.approx(np.mean(below[r["region"]])) for r in got)


def test_flat_mode_has_no_presence(made):
    base, n, _, schema, _, _ = made
    from ridgeline.operators import regions

    s = stats.flat_stats(regions.forest_regions(n), base, schema)
    assert stats.dnf_empty(s, P.dnf((P.eq("label", 99),))).filter("empty").count() == 0
    assert stats.cdf(s, "value", 1e9).filter("cdf < 0.999999").count() == 0


def test_budget(made):
    base, _, f, schema, _, _ = made
    hist, sizes = (settle(x) for x in stats.rollup(f, stats.attributes(base, schema)))
    errs = settle(stats.errors(f, hist, sizes, schema, 0.0))
    widths, budget = {"value": 16, "label": 6}, 3000
    kept = stats.keep(f, errs, schema, widths, budget=budget).collect()
    of = {r["c"]: (r["tree"], r["parent"]) for r in f.candidates.collect()}
    money = {r["tree"]: r["bytes"] for r in stats.tree_budgets(f, budget).collect()}
    assert sum(money.values()) == budget
    # The same greedy walk, written out.
    used = {t: 4 * sum(widths.values()) for t in money}
    want = {(c, k) for k, (_, p) in of.items() if p is None for c in schema.columns}
    rows = [r for r in errs.collect() if r["err"] > (0.05 if r["col"] == "value" else 0.10)]
    for r in sorted(rows, key=lambda r: (-r["err"], r["col"], r["c"])):
        t, size = of[r["c"]][0], 4 * widths[r["col"]]
        if used[t] + size <= money[t]:
            used[t] += size
            want.add((r["col"], r["c"]))
    assert {(r["col"], r["c"]) for r in kept} == want


def test_costs(spark, made):
    _, _, _, _, s, _ = made
    p = P.dnf((P.eq("label", 1), P.lt("value", 20)), (P.eq("label", 2),))
    a, b, c = 0.25, 0.5, 0.1
    row = spark.createDataFrame([(a, b, c)], "s0 double, s1 double, s2 double").select(*[x.alias(n) for n, x in zip("se", cost.dnf_terms(p), strict=True)]).first()
    assert row["s"] == pytest.approx(1 - (1 - a * b) * (1 - c)) and row["e"] == pytest.approx(1 + a + (1 - a * b))
    table = cost.region_costs(s, p, 10)
    assert cost.routes(table, cost.Costs(lambda_tradeoff=0.01)).filter("route <> 'best_first'").count() == 0
    assert cost.routes(table, cost.Costs(lambda_tradeoff=100)).filter("route <> 'flood'").count() == 0
    none = cost.region_costs(s, P.dnf((P.eq("label", 99),)), 10)
    assert none.filter("sel > 0 or best_first < 1e300").count() == 0
    t = spark.range(1).select(cost.theta(24, F.lit(0), cost.Costs()).alias("a"), cost.theta(24, F.lit(10), cost.Costs()).alias("b"), cost.theta(24, F.lit(100), cost.Costs(), r3=True, ratio=0.1).alias("c")).first()
    assert t["a"] == 0 and t["b"] == 1.0 and t["c"] == pytest.approx(0.24 + (0.24 - 1) * 0.1)


def test_maintenance(made):
    base, n, f, schema, s, _ = made
    state = maintain.State(s, settle(maintain.trees_of(f)))
    new = base.filter("id < 3").withColumn("id", F.col("id") + 10_000).withColumn("label", F.when(F.col("id") == 10_000, 77.0).otherwise(F.col("label")))
    first = f.fca.select("c").first()["c"]
    points = new.select("id", F.lit(first).alias("c"))
    after = maintain.insert(state, f, points, new)
    assert after.stats.degraded == {"label"} and after.stats.region_map.count() == 603
    assert after.trees.agg(F.sum("n")).first()[0] == 603
    assert search.admitted(after.stats, P.dnf((P.eq("label", 77),))).count() == 1
    gone, due = maintain.delete(state, f, base.filter("id % 2 = 0").select("id"), base)
    assert gone.trees.agg(F.sum("n")).first()[0] == 300 and due.count() >= 1
    live = base.filter("id % 2 = 1")
    fresh = maintain.rebuild(gone, f, live, settle(due))
    assert fresh.trees.join(due, "tree", "left_semi").filter("cnt_del > 0").count() == 0
    for p in PREDICATES[:5]:
        assert live.filter(p.condition()).join(fresh.stats.region_map, "id").join(search.admitted(fresh.stats, p), "region", "left_anti").count() == 0


def test_stream(spark, made, tmp_path):
    base, _, f, _, s, _ = made
    state = maintain.State(s, settle(maintain.trees_of(f)))
    base.filter("id < 50").select("id").write.parquet(str(tmp_path / "gone"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "gone"))
    m = Maintainer(state, lambda st, batch: maintain.delete(st, f, batch, base)[0])
    maintain_from(stream, m, str(tmp_path / "check"), once=True).awaitTermination()
    assert m.state.trees.agg(F.sum("n")).first()[0] == 550
    m(base.filter("id < 50").select("id"), 0)
    assert m.state.trees.agg(F.sum("n")).first()[0] == 550


def test_a_restarted_stream_finds_its_state(spark, made, tmp_path):
    base, _, f, _, s, _ = made
    first = maintain.State(replace(s, degraded=frozenset({"label"})), settle(maintain.trees_of(f)))
    apply = lambda st, batch: maintain.delete(st, f, batch, base)[0]
    gone, check, kept = (str(tmp_path / x) for x in ("gone", "check", "kept"))
    for low, left in ((0, 550), (50, 500)):
        base.filter(f"id >= {low} and id < {low + 50}").select("id").write.mode("append").parquet(gone)
        m = Maintainer(first, apply, kept)
        maintain_from(spark.readStream.schema("id bigint").parquet(gone), m, check, once=True).awaitTermination()
        assert m.state.trees.agg(F.sum("n")).first()[0] == left
    again = Maintainer(first, apply, kept)
    assert again.done == m.done and again.state.trees.agg(F.sum("n")).first()[0] == 500
    assert again.state.stats.degraded == {"label"} and again.state.stats.schema == s.schema
    for name in ("sizes", "hist", "hist_node", "presence", "region_map"):
        a, b = getattr(again.state.stats, name), getattr(m.state.stats, name)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_codes_of_a_degraded_column_are_estimated_as_one_row(made):
    _, _, _, _, s, _ = made
    least = lambda st: stats.sigma_hats(st, [P.eq("label", 77)]).agg(F.min(F.col("s0") * F.col("n")), F.max(F.col("s0") * F.col("n"))).first()
    assert tuple(least(s)) == (0, 0) and tuple(least(replace(s, degraded=frozenset({"label"})))) == pytest.approx((1, 1))


def test_rows_without_values_keep_their_region(spark, made):
    base, _, f, _, _, _ = made
    holes = base.withColumns({"value": F.when(F.col("id") % 2 == 0, F.col("value")), "label": F.when(F.col("id") % 2 == 0, F.col("label"))})
    schema = stats.schema_of(holes, ["value"], ["label"], 16)
    s = stats.forest_stats(f, holes, schema)
    assert s.region_map.count() == 600 and s.region_map.filter("region is null").count() == 0
    assert stats.attributes(holes, schema).filter("id % 2 = 1").count() == 0


def test_synthetic(spark, made):
    base = made[0]
    row = synth.extra_columns(base).agg(F.min("u_zipf"), F.avg("u_uni2"), F.avg("u_exp"), F.stddev("u_gauss2")).first()
    assert row[0] >= 1 and 0.4 < row[1] < 0.6 and 0.8 < row[2] < 1.2 and 0.85 < row[3] < 1.15
    assert synth.zipf_quotas(10, 3) == [0] * 5 + [1] * 3 + [2] * 2
    cents, own = synth.kmeans(base, 8, iters=2)
    assert cents.count() == 8 and own.count() == 600
