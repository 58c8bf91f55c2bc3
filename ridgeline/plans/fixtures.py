"""Inputs of the registered queries, as DataFrames and as SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coerce
from ..functions import predicates as P
from ..operators import graph, navigate, regions, search, stats
from ..session import once, settle, stamp

#: Queries are the rows whose id is divisible by EVERY.
K, EVERY, LINKS, BUCKETS = 10, 20, 8, 32
#: Ids that are sent to all tasks.
SEND_IDS = 1_000_000
MIX = P.dnf((P.eq("label", 1), P.lt("value", 30)), (P.eq("label", 3), P.lt("value", 30)), (P.eq("ev", 2),))
MIX_SQL = "((label = 1 AND value < 30) OR (label = 3 AND value < 30) OR ev = 2)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def kept(spark: SparkSession, d: str, name: str, make):
    """What make() gives, once for an application and the state of the tables that it comes from."""
    return once(spark, (name, d, stamp(spark, f"{d}/embeddings.parquet"), stamp(spark, f"{d}/events.parquet")), make)


def base(spark: SparkSession, d: str) -> DataFrame:
    """id, v, label, value, event_type, ev (its code): vectors with attributes by equal ids, joined and stored once."""
    return kept(spark, d, "base", lambda: settle(_base(spark, d)))


def _base(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("double").alias("label"))
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), "value", "event_type")
    # Ids of vectors are sent to the scan of the events, so only events that have a vector go on; encoding reads these twice.
    ids = F.broadcast(e.select("id")) if e.count() <= SEND_IDS else e.select("id")
    return e.join(coerce.dict_encode(settle(events.join(ids, "id", "left_semi")), "event_type", "ev"), "id")


def queries(b: DataFrame, every: int = EVERY) -> DataFrame:
    return b.filter(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("v").alias("qvec"))


def shown(df: DataFrame, *rounded: str, digits: int = 6) -> DataFrame:
    """df with the columns rounded; a zero has no sign."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in rounded})


def schema(b: DataFrame) -> stats.Schema:
    return stats.schema_of(b, ["value"], ["label", "ev"], BUCKETS)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "nodes", lambda: graph.nodes(base(spark, d)))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "edges", lambda: settle(graph.knn_edges(base(spark, d), LINKS)))


def region_map(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "regions", lambda: settle(regions.forest_regions(nodes(spark, d))))


def forest(spark: SparkSession, d: str) -> tuple[DataFrame, stats.Forest, stats.Schema]:
    """Base, forest and schema."""
    return kept(spark, d, "forest", lambda: (base(spark, d), stats.forest(nodes(spark, d)), schema(base(spark, d))))


def forest_stats(spark: SparkSession, d: str) -> tuple[DataFrame, stats.Forest, stats.Stats]:
    """Base, forest and its statistics: the index of a search."""
    b, f, s = forest(spark, d)
    return kept(spark, d, "stats", lambda: (b, f, stats.forest_stats(f, b, s)))


def navigable(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, d, "navigable", lambda: navigate.build(base(spark, d)))


def by_region(spark: SparkSession, d: str) -> DataFrame:
    b, _, s = forest_stats(spark, d)
    return kept(spark, d, "by_region", lambda: search.by_region(b, s))


def l2(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda s, t: s + t)"


def ip(a: str, b: str) -> str:
    return f"-list_reduce(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]), lambda s, t: s + t)"


BASE_SQL = f"""b AS MATERIALIZED (SELECT e.vec_id AS id, e.embedding::DOUBLE[] AS v, e.label::DOUBLE AS label, ev.value, ev.event_type,
  (dense_rank() OVER (ORDER BY ev.event_type) - 1)::DOUBLE AS ev FROM embeddings e JOIN events ev ON ev.event_id = e.vec_id),
q AS MATERIALIZED (SELECT id AS qid, v AS qv FROM b WHERE id % {EVERY} = 0)"""

NODES_SQL = f"""{BASE_SQL},
lv AS MATERIALIZED (SELECT id, v, {' + '.join(f'(h < {2**32 // 4**k})::INTEGER' for k in range(1, 16))} AS level
  FROM (SELECT id, v, (id * 2654435761 + 12345) % 4294967296 AS h FROM b)),
nf AS (SELECT a.id, min({{'d': {l2('a.v', 'c.v')}, 'i': c.id}}).i AS father FROM lv a JOIN lv c ON c.level > a.level GROUP BY a.id),
nd AS MATERIALIZED (SELECT a.id, a.level, coalesce(nf.father, a.id) AS father FROM lv a LEFT JOIN nf ON a.id = nf.id)"""

REGIONS_SQL = f"""{NODES_SQL},
r1 AS (SELECT id, father AS parent, CASE WHEN level >= 2 OR father = id THEN id ELSE father END AS step FROM nd),
rg AS MATERIALIZED (SELECT r1.id, r1.parent, CASE WHEN n.level >= 2 OR n.father = n.id THEN n.id ELSE n.father END AS region FROM r1 JOIN nd n ON n.id = r1.step)"""

EDGES_SQL = f"""pe AS (SELECT a.id AS src, c.id AS dst, {l2('a.v', 'c.v')} AS d FROM b a JOIN b c ON a.id <> c.id),
ed AS MATERIALIZED (SELECT src, dst, rank FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d, dst)::INTEGER AS rank FROM pe) WHERE rank <= {LINKS})"""


def attributes_sql(of: str = "b", where: str = "true") -> str:
    """Buckets come from the rows of the table named; attributes of all rows of b."""
    return f"""srt AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS rn, count(*) OVER () AS n FROM {of} WHERE {where}),
eg AS MATERIALIZED (SELECT i, value AS e FROM srt, range({BUCKETS}) t(i) WHERE rn = i * n // {BUCKETS} UNION ALL SELECT {BUCKETS}, max(value) + 1 FROM srt),
el AS MATERIALIZED (SELECT list(e ORDER BY i) AS es FROM eg),
att AS MATERIALIZED (SELECT id, 'value' AS col, greatest(0, least({BUCKETS - 1}, len(list_filter(es, lambda e: e <= value)) - 1))::DOUBLE AS bucket FROM b, el
  UNION ALL SELECT id, 'label', label FROM b UNION ALL SELECT id, 'ev', ev FROM b)"""


CANDIDATES_SQL = """lm AS (SELECT coalesce(max(l), 1) AS lmax FROM range(1, 16) t(l) WHERE (SELECT count(*) FROM nd WHERE level >= l) >= 2),
cd AS MATERIALIZED (SELECT id AS c, level, CASE WHEN level < lmax AND father <> id THEN father END AS parent FROM nd, lm WHERE level >= 1),
cl(c, anc, depth) AS (SELECT c, c, 0 FROM cd UNION ALL SELECT cl.c, cd.parent, cl.depth + 1 FROM cl JOIN cd ON cd.c = cl.anc WHERE cd.parent IS NOT NULL),
tr AS MATERIALIZED (SELECT c, max_by(anc, depth) AS tree FROM cl GROUP BY c)"""


def forest_sql(p: str = "", where: str = "true", slack: float = 1.0) -> str:
    """The forest's statistics over the points that satisfy where, under names that start with p."""
    return f"""{p}fc AS MATERIALIZED (SELECT id, CASE WHEN level >= 1 THEN id ELSE father END AS c FROM nd WHERE (level >= 1 OR father <> id) AND ({where})),
{p}fh AS MATERIALIZED (SELECT col, anc AS node, bucket, count(*) AS cnt FROM att JOIN {p}fc USING (id) JOIN cl USING (c) GROUP BY ALL),
{p}fs AS MATERIALIZED (SELECT anc AS node, count(*) AS n FROM {p}fc JOIN cl USING (c) GROUP BY ALL),
{p}pc AS (SELECT c, parent, coalesce(x.n, 1)::DOUBLE AS nc, coalesce(y.n, 1)::DOUBLE AS np FROM cd LEFT JOIN {p}fs x ON x.node = c LEFT JOIN {p}fs y ON y.node = parent WHERE parent IS NOT NULL),
{p}gr AS (SELECT c, nc, np, sum(coalesce(x.cnt, 0)) OVER w / nc AS fc, sum(coalesce(y.cnt, 0)) OVER w / np AS fp FROM {p}pc JOIN range({BUCKETS}) t(i) ON true
  LEFT JOIN {p}fh x ON x.col = 'value' AND x.node = c AND x.bucket = i LEFT JOIN {p}fh y ON y.col = 'value' AND y.node = parent AND y.bucket = i WINDOW w AS (PARTITION BY c ORDER BY i)),
{p}er AS MATERIALIZED (SELECT 'value' AS col, c, greatest(0.0, max(abs(fc - fp) - {slack} * sqrt(1 / nc + 1 / np))) AS err FROM {p}gr GROUP BY c
  UNION ALL SELECT col, c, max(greatest(0.0, abs(fp - fc) - {slack} * sqrt(greatest(fc * (1 - fc), 1e-12) * (1 / nc + 1 / np))) / fc) FROM
    (SELECT x.col, {p}pc.c, nc, np, x.cnt / nc AS fc, coalesce(y.cnt, 0) / np AS fp FROM {p}pc JOIN {p}fh x ON x.node = c AND x.col IN ('label', 'ev') LEFT JOIN {p}fh y ON y.node = parent AND y.col = x.col AND y.bucket = x.bucket) GROUP BY col, c),
{p}kp AS MATERIALIZED (SELECT col, c FROM cd, (VALUES ('value'), ('label'), ('ev')) t(col) WHERE parent IS NULL
  UNION ALL SELECT col, c FROM {p}er WHERE err > CASE WHEN col = 'value' THEN 0.05 ELSE 0.10 END),
{p}bd AS MATERIALIZED (SELECT DISTINCT c FROM {p}kp),
{p}rm AS MATERIALIZED (SELECT id, coalesce((SELECT min_by(anc, depth) FROM cl WHERE cl.c = f.c AND anc IN (SELECT c FROM {p}bd)), (SELECT min(c) FROM {p}bd)) AS region FROM nd LEFT JOIN {p}fc f USING (id) WHERE {where}),
{p}hn AS MATERIALIZED (SELECT k.col, cl.c AS region, min_by(cl.anc, cl.depth) AS node FROM cl JOIN {p}kp k ON k.c = cl.anc WHERE cl.c IN (SELECT c FROM {p}bd) GROUP BY ALL),
{p}pr AS MATERIALIZED (SELECT DISTINCT col, region, bucket FROM att JOIN {p}rm USING (id))"""


FOREST_SQL = f"{NODES_SQL}, {attributes_sql()}, {CANDIDATES_SQL}, {forest_sql()}"


def cover_sql(x: str) -> str:
    lo, hi = "es[bucket::INTEGER + 1]", "es[bucket::INTEGER + 2]"
    return f"(CASE WHEN {hi} <= {lo} THEN CASE WHEN {x} >= {hi} THEN 1.0 ELSE 0.0 END ELSE least(1.0, greatest(0.0, ({x} - {lo}) / ({hi} - {lo}))) END)"


def sum_sql(col: str, weight: str) -> str:
    return f"coalesce(sum(CASE WHEN hn.col = '{col}' THEN fh.cnt * {weight} / fs.n ELSE 0.0 END), 0.0)"


def eq_sql(col: str, code: float) -> str:
    return sum_sql(col, f"(CASE WHEN bucket = {code} THEN 1.0 ELSE 0.0 END)")


SIGMA_FROM = "FROM hn JOIN fs ON fs.node = hn.node LEFT JOIN fh ON fh.col = hn.col AND fh.node = hn.node, el GROUP BY hn.region"
_low = sum_sql("value", cover_sql("30"))
#: For each region: size, the five atoms of MIX, whether it is proven empty, and the terms of the cost model.
COST_SQL = f"""{FOREST_SQL},
sg AS (SELECT hn.region, {eq_sql('label', 1)} AS s0, {_low} AS s1, {eq_sql('label', 3)} AS s2, {eq_sql('ev', 2)} AS s4 {SIGMA_FROM}),
b30 AS (SELECT greatest(0, least({BUCKETS - 1}, len(list_filter(es, lambda e: e <= 30)) - 1)) AS b FROM el),
em AS (SELECT c AS region, NOT coalesce(p.l1, false) AS e0, NOT coalesce(p.lo, false) AS e1, NOT coalesce(p.l3, false) AS e2, NOT coalesce(p.ev, false) AS e4 FROM bd LEFT JOIN
  (SELECT region, bool_or(col = 'label' AND bucket = 1) AS l1, bool_or(col = 'value' AND bucket <= b) AS lo, bool_or(col = 'label' AND bucket = 3) AS l3, bool_or(col = 'ev' AND bucket = 2) AS ev FROM pr, b30 GROUP BY region) p ON p.region = c),
co AS (SELECT sg.region, fs.n, 1 - (1 - s0 * s1) * (1 - s2 * s1) * (1 - s4) AS raw, (1 + s0) + (1 - s0 * s1) * (1 + s2) + (1 - s0 * s1) * (1 - s2 * s1) AS evals,
  (e0 OR e1) AND (e2 OR e1) AND e4 AS empty FROM sg JOIN em USING (region) JOIN fs ON fs.node = sg.region),
cs AS (SELECT *, CASE WHEN empty THEN 0.0 WHEN raw <= 0 THEN 1e-12 ELSE raw END AS sel FROM co),
ct AS MATERIALIZED (SELECT *, CASE WHEN sel <= 0 THEN 0.0 ELSE n * 20e-9 * evals + sel * n * 50e-9 END + 2e-9 * n AS flood,
  CASE WHEN sel <= 0 THEN 'inf'::DOUBLE ELSE least(n, 10.0 / sel) * (20e-9 * evals + 21 * 101e-9 + 50e-9) END AS best_first FROM cs),
rt AS MATERIALIZED (SELECT *, CASE WHEN best_first < flood THEN 'best_first' ELSE 'flood' END AS route FROM ct)"""
