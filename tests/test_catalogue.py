import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["knn_dnf_mix", "knn_filter_contains", "knn_inner_product", "knn_postfilter", "knn_rank_range", "knn_grouped_label", "recall_postfilter", "quantile_grid", "pred_interval_sel", "rho_rank", "coerce_json", "anchor_dist", "kmeans_step", "forest_regions", "region_adjacency", "sigma_hat_gt", "route_region", "search_pruned", "transparent_frontier", "delta_insert", "rebuild_tree"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
