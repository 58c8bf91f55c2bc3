import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import ann_forest, components, near_embeddings, queries, url_rules
from ridgeline.llm.simhash import Forest
from ridgeline.operators.small_world import Graph

INF = float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], "vec_id bigint, embedding array<float>, label int, vec string, id bigint")


def links_of(ids, x, labels, threshold=0.98):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    f = Forest(len(x))
    f.union(*np.nonzero(near))
    roots = f.roots(np.arange(len(x)))
    return {i: (int(near[k].sum()), int(ids[roots == roots[k]].min())) for k, i in enumerate(ids)}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 16))
    parts = [rng.standard_normal((900, 16)), np.repeat(centres, 8, axis=0) + 0.05 * rng.standard_normal((480, 16)), centres[:1] + 0.03 * rng.standard_normal((300, 16)), np.repeat(centres[1:2], 60, axis=0)]
    x = np.concatenate(parts).astype("float32")
    ids = rng.permutation(len(x)) + 5
    return ids, x, rng.integers(0, 3, len(x))


@pytest.mark.parametrize("size", [4096, 150])
def test_near_duplicates_match_brute_force(spark, clustered, monkeypatch, size):
    """In one shard a label, and in several, where shards are queried from one another."""
    monkeypatch.setattr(near_embeddings, "SHARD", size)
    ids, x, labels = clustered
    df = frame(spark, [(int(i), v.tolist(), int(y)) for i, v, y in zip(ids, x, labels, strict=True)])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_embeddings.near_duplicates(df).collect()}
    want = links_of(ids, x.astype(float), labels)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_audit_sees_a_loss_where_links_are_sparse():
    """The graph finds next to nothing: the only link must still be found."""

    class Blind:
        def search(self, q, beam, own=None):
            return np.broadcast_to(np.where(np.arange(beam) == 0, 0, -1), (len(q), beam)), np.full((len(q), beam), -2.0)

    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x, q = unit(rng.standard_normal((200, 64))), unit(rng.standard_normal((1000, 64)))
    q[5] = x[57]
    found = [p for a, b in near_embeddings.found_links(Blind(), x, q, 0.98, own=False) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert found == [(5, 57)]


def test_links_to_lone_points_are_found():
    """Points that lie alone among clusters are hard to reach; every link to them and inside the clusters must be found."""
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    lone = unit(rng.standard_normal((20, 64)))
    x = np.concatenate((unit(np.repeat(rng.standard_normal((40, 64)), 100, axis=0) + 0.02 * rng.standard_normal((4000, 64))), lone))
    q = np.concatenate((unit(rng.standard_normal((3980, 64))), unit(lone + 0.005 * rng.standard_normal((20, 64)))))
    graph = Graph(x, np.arange(len(x)))
    for queries_, own in ((q, False), (x, True)):
        found = sorted(p for a, b in near_embeddings.found_links(graph, x, queries_, 0.98, own) for p in zip(a.tolist(), b.tolist(), strict=True))
        a, b = np.nonzero(queries_ @ x.T >= 0.98)
        want = sorted((i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if not own or i != j)
        assert found == want and len(want) >= 20


def test_near_duplicates_of_an_id_with_several_vectors(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(3, a, 1), (5, a, 1), (5, b, 1), (9, b, 1), (2, c, 1), (2, a, 2), (7, c, 2), (11, None, 1), (11, b, 1)]
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in near_embeddings.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got) == [(2, 0, 2), (2, 0, 2), (3, 1, 3), (5, 1, 3), (5, 2, 3), (7, 0, 7), (9, 2, 3), (11, 0, 3), (11, 2, 3)]


def test_near_duplicates_edges(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [INF, 0.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    got = {r["vec_id"]: tuple(r)[1:] for r in near_embeddings.near_duplicates(frame(spark, rows)).collect()}
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[12] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)) and got[None] == (0, None, None)
    assert near_embeddings.near_duplicates(frame(spark, rows).filter("false")).count() == 0


def test_graph_recall():
    x = np.random.default_rng(7).standard_normal((2000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x, np.arange(2000))
    q = x[(np.arange(50) * 37) % 2000]
    found, _ = g.search(q.astype("float32"), 64)
    assert sum(i in row for i, row in zip((np.arange(50) * 37) % 2000, found, strict=True)) >= 48


@pytest.mark.parametrize("size", [8192, 300])
def test_nearest_neighbours_recall(spark, monkeypatch, size):
    monkeypatch.setattr(ann_forest, "SHARD", size)
    monkeypatch.setattr(ann_forest, "GATHER", 128)
    x = np.random.default_rng(2).standard_normal((2500, 24)).astype("float32")
    df = frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    got = ann_forest.search(df, df.filter("vec_id % 100 = 0")).collect()
    hit = 0
    for q in range(0, 2500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(d[r["vec_id"]], rel=1e-12) for r in mine)
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        hit += len(set(np.argsort(d)[:10]) & {r["vec_id"] for r in mine})
    assert hit / 250 >= 0.9


def test_nearest_neighbours_edges(spark):
    rows = [(100, [0.5, 0.5], 0), (1, [0.5, 0.5], 0), (2, [0.5, 0.5], None), (3, None, 0), (4, [0.0, 0.0], 0), (5, [1.0, None], 0), (6, [INF, 1.0], 0), (7, [1.0, 2.0, 3.0], 0), (8, [1.0, 1.0], 0), (8, [1.0, 1.0], 0), (None, [1.0, 1.0], 0), (200, None, 0)]
    df = frame(spark, rows)
    got = ann_forest.search(df, df.filter("vec_id % 100 = 0")).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(100, 1, 1), (100, 2, 2), (100, 3, 8), (100, 4, 8)]
    two = frame(spark, [(100, [0.0, 1.0], 0), (100, [9.0, 1.0], 0), (100, [9.0, 1.0], 0), (1, [0.0, 2.0], 0), (2, [9.0, 2.0], 0)])
    got = [tuple(r) for r in ann_forest.search(two, two.filter("vec_id % 100 = 0")).orderBy("score", "vec_id").collect()]
    assert [r[:3] for r in got] == [(100, 1, 1), (100, 1, 2), (100, 2, 1), (100, 2, 2)]
    assert ann_forest.search(df.filter("false"), df).count() == 0 and ann_forest.search(df, df.filter("false")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    n = 400
    a, b = rng.integers(0, n, 260), rng.integers(0, n, 260)
    chain = [(1000 + i, 1001 + i) for i in range(70)]
    star = [(5000, 5001 + i) for i in range(300)]
    edges = [*zip(a.tolist(), b.tolist(), strict=True), *chain, *star, (7, 7), (None, 3), (1000, 1001)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "x bigint, y bigint"), "x", "y").collect()}
    names = sorted({v for e in edges for v in e if v is not None and e[0] != e[1] and None not in e})
    at = {v: k for k, v in enumerate(names)}
    f = Forest(len(names))
    pairs = [(at[x], at[y]) for x, y in edges if x is not None and y is not None and x != y]
    f.union(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    roots = f.roots(np.arange(len(names)))
    assert got == {v: names[roots[k]] for v, k in at.items()}
    assert components.components(spark.createDataFrame([], "x bigint, y bigint"), "x", "y").count() == 0


URLS = ["https://www.Example.com/en/12?x", "http://a.b.net/es/1", "http://net/fr/", None, "foo", "", "http://x.com", "http://example.com/en/", "https://x.org/#a", "HTTP://A.ORG/x", "http://com/", "://..net/es/", "http://notexample.com/en/", "http://u@example.com:80/en/", "http://a.net/ES/", "http://a.com?/x", "x://y://z.com/", "http://ÀB.com/" + "p/" * 5000]


def fits(url, rule):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    return host, path, (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])


@pytest.mark.parametrize("bound", [100_000, 0])
def test_url_rules(spark, monkeypatch, bound):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", bound)
    rules = [*queries.URL_RULES, ("b.net", "/e", "allow"), ("org", "", "block")]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)] * 2 + [(None, "http://a.com/", "", "")], "page_id bigint, url string, host string, rule string")
    got = url_rules.judge(pages, url_rules.rules_frame(spark, rules)).collect()
    assert len(got) == 2 * len(URLS) + 1
    for r in got:
        url = URLS[r["page_id"]] if r["page_id"] is not None else "http://a.com/"
        fit = [x for x in rules if fits(url, x)[2]]
        best = max(fit, key=lambda x: (len(x[0] + x[1]), len(x[0]), x[2]), default=None)
        assert (r["host"], r["path"]) == fits(url, rules[0])[:2]
        assert (r["rule"], r["verdict"]) == ((best[0] + best[1], best[2]) if best else (None, "allow"))
    assert url_rules.judge(pages.filter("false"), url_rules.rules_frame(spark, rules)).count() == 0
    assert url_rules.judge(pages, url_rules.rules_frame(spark, [])).filter("rule is not null").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, d).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_ids_of_one_hash_stay_apart(spark):
    """Rows whose ids differ in the last digit only are dealt to all shards."""
    rows = frame(spark, [(i, [float(i + 1), 1.0], 0) for i in range(64)])
    out = near_embeddings.sharded(rows.select("vec_id", F.lit(1).alias("k")), ["k"], "vec_id", 8)
    assert out.select("shard").distinct().count() == 8
