"""Registered queries, one for each operator, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions import coerce
from ..functions import predicates as P
from ..operators import cost, graph, knn, maintain, metrics, navigate, quantiles, regions, search, stats, synth
from ..session import own_dir, settle
from ..sources import files
from . import fixtures as X
from .fixtures import BASE_SQL, COST_SQL, EDGES_SQL, FOREST_SQL, K, MIX, MIX_SQL, NODES_SQL, REGIONS_SQL, l2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def top_sql(where: str = "true", d: str = l2("q.qv", "b.v"), k: int = K, more: str = "") -> str:
    return f"""WITH {BASE_SQL}{more}, p AS (SELECT qid, b.id, {d} AS d FROM q, b WHERE {where}),
r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d, id)::INTEGER AS rank, id, d FROM p)
SELECT qid, rank, id, round(d, 6) + 0.0 AS dist FROM r WHERE rank <= {k}"""


# --- exact search under predicates ------------------------------------------------------------------------------------

PREDICATES: dict[str, tuple[P.DNF, str]] = {
    "knn_filter_lt": (P.dnf((P.lt("value", 20),)), "value < 20"),
    "knn_filter_gt": (P.dnf((P.gt("value", 60),)), "value > 60 AND NOT isnan(value)"),
    "knn_filter_interval": (P.dnf((P.interval("value", 10, 40),)), "value > 10 AND value < 40"),
    "knn_filter_eq_cat": (P.dnf((P.eq("ev", 1),)), "ev = 1"),
    "knn_dnf_and2": (P.dnf((P.eq("label", 1), P.lt("value", 50))), "label = 1 AND value < 50"),
    "knn_dnf_and4": (P.dnf((P.gt("value", 5), P.lt("value", 80), P.eq("ev", 2), P.gt("label", 3))), "value > 5 AND value < 80 AND ev = 2 AND label > 3"),
    "knn_dnf_or2": (P.dnf((P.eq("label", 1),), (P.lt("value", 5),)), "label = 1 OR value < 5"),
    "knn_dnf_or4": (P.dnf((P.eq("label", 1),), (P.eq("label", 2),), (P.lt("value", 5),), (P.gt("value", 150),)), "label = 1 OR label = 2 OR value < 5 OR value > 150"),
    "knn_dnf_mix": (MIX, MIX_SQL),
    "knn_dnf_no_clause": (P.dnf(), "false"),
    "knn_dnf_empty_clause": (P.dnf(()), "true"),
}


def _under(predicate: P.DNF):
    def run(spark, d):
        b = X.base(spark, d)
        return X.shown(knn.exact_topk(b, X.queries(b), K, predicate=predicate), "dist")

    return run


for _name, (_predicate, _sql) in PREDICATES.items():
    query(top_sql(f"({_sql})"), _name)(_under(_predicate))


@query(top_sql())
def knn_exact_unfiltered(spark, d):
    b = X.base(spark, d)
    return X.shown(knn.exact_topk(b, X.queries(b), K), "dist")


@query(top_sql("contains(coalesce(t.text, ''), 'the')").replace("FROM q, b WHERE", "FROM q, b LEFT JOIN documents t ON t.doc_id = b.id WHERE"))
def knn_filter_contains(spark, d):
    b = X.base(spark, d)
    text = X.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    with_text = b.join(text, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    return X.shown(knn.exact_topk(with_text, X.queries(b), K, predicate=P.dnf((P.contains("text", "the", "ev", 1),))), "dist")


@query(top_sql(d=X.ip("q.qv", "list_transform(b.v, lambda x: x * (1 + b.id % 5))")))
def knn_inner_product(spark, d):
    """Vectors are scaled by an id-dependent factor, so that the order differs from that of distances."""
    b = X.base(spark, d)
    scaled = b.withColumn("v", F.transform(F.col("v").cast("array<double>"), lambda x: x * (1 + F.col("id") % 5)))
    return X.shown(knn.exact_topk(scaled, X.queries(b), K, metric="ip"), "dist")


@query(top_sql("value < 60 AND b.id % 3 <> 0"))
def knn_tombstone(spark, d):
    b = X.base(spark, d).withColumn("deleted", F.col("id") % 3 == 0)
    return X.shown(knn.exact_topk(b, X.queries(b), K, predicate=P.dnf((P.lt("value", 60),), tombstone="deleted")), "dist")


_RAGGED = "CASE WHEN {0}.id % 3 = 0 THEN {0}.v[1:32] ELSE {0}.v END"


@query(f"""WITH {BASE_SQL}, c AS MATERIALIZED (SELECT b.id, {_RAGGED.format('b')} AS v FROM b), p AS (SELECT q.id AS qid, c.id, {l2('q.v', 'c.v')} AS d FROM c q, c WHERE q.id % {X.EVERY} = 0 AND len(q.v) = len(c.v)),
r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d, id)::INTEGER AS rank, id, d FROM p) SELECT qid, rank, id, round(d, 6) + 0.0 AS dist FROM r WHERE rank <= {K}""")
def knn_ragged(spark, d):
    """Every third vector is cut to half its length: only vectors of one length have a distance."""
    b = X.base(spark, d).withColumn("v", F.when(F.col("id") % 3 == 0, F.slice("v", 1, 32)).otherwise(F.col("v")))
    return X.shown(knn.exact_topk(b, X.queries(b), K), "dist")


_POST = f"""WITH {BASE_SQL}, p AS (SELECT qid, b.id, value, label, ev, {l2('q.qv', 'b.v')} AS d FROM q, b),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS k FROM p),
g AS (SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY d, id)::INTEGER AS rank FROM t WHERE k <= 64 AND {MIX_SQL})"""


@query(f"{_POST} SELECT qid, rank, id, round(d, 6) + 0.0 AS dist FROM g WHERE rank <= {K}")
def knn_postfilter(spark, d):
    b = X.base(spark, d)
    return X.shown(knn.post_filter(b, X.queries(b), MIX, 64, K), "dist")


@query(top_sql("(value, b.id) >= (SELECT min((value, id)) FROM b WHERE ev = 2 AND label = 1) AND (value, b.id) <= (SELECT max((value, id)) FROM b WHERE ev = 2 AND label = 1)"))
def knn_rank_range(spark, d):
    b = X.base(spark, d)
    return X.shown(knn.rank_range(b, X.queries(b), "value", P.dnf((P.eq("ev", 2), P.eq("label", 1))), K), "dist")


@query(top_sql("label = (SELECT min_by(label, id) FROM b WHERE value > 100)"))
def knn_label_first(spark, d):
    b = X.base(spark, d)
    return X.shown(knn.first_label(b, X.queries(b), "label", P.dnf((P.gt("value", 100),)), K), "dist")


_GROUPED = f"""WITH {BASE_SQL}, p AS (SELECT qid, label, b.id, {l2('q.qv', 'b.v')} AS d FROM q, b),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY d, id)::INTEGER AS rank FROM p)"""


@query(f"{_GROUPED} SELECT qid, label, rank, id, round(d, 6) + 0.0 AS dist FROM r WHERE rank <= 3")
def knn_grouped_label(spark, d):
    b = X.base(spark, d)
    return X.shown(knn.grouped_topk(b, X.queries(b), "label", 3), "dist")


@query(f"WITH {BASE_SQL} SELECT count(*) FILTER ({MIX_SQL}) AS n_satisfying FROM b")
def n_satisfying(spark, d):
    return knn.n_satisfying(X.base(spark, d), MIX)


@query(f"WITH {BASE_SQL} SELECT qid, (SELECT count(*) FROM b WHERE {MIX_SQL}) AS n_dist, (SELECT count(*) FROM b) AS n_pred, (SELECT count(*) FROM b WHERE {MIX_SQL}) AS n_satisfying FROM q")
def search_counters(spark, d):
    b = X.base(spark, d)
    return metrics.search_counters(b, X.queries(b), MIX.condition())


@query(f"""{_POST}, e AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM p WHERE {MIX_SQL}),
h AS (SELECT g.qid, count(*) AS h FROM g JOIN e ON e.qid = g.qid AND e.id = g.id AND e.rank <= {K} WHERE g.rank <= {K} GROUP BY 1)
SELECT q.qid, coalesce(h.h, 0) / least({K}, (SELECT count(*) FROM b WHERE {MIX_SQL})) AS recall FROM q LEFT JOIN h USING (qid)""")
def recall_postfilter(spark, d):
    b = X.base(spark, d)
    q = X.queries(b)
    n = b.filter(MIX.condition()).count()
    return metrics.recall(knn.post_filter(b, q, MIX, 64, K), knn.exact_topk(b, q, K, predicate=MIX), q, n, K)


@query(f"WITH {BASE_SQL} SELECT qid, 1.0::DOUBLE AS recall FROM q")
def recall_empty(spark, d):
    b = X.base(spark, d)
    none = knn.exact_topk(b, X.queries(b), K, predicate=P.dnf())
    return metrics.recall(none, none, X.queries(b), 0, K)


@query(f"""WITH {BASE_SQL}, c AS (SELECT lv.id, lv.v, lv.label FROM b lv WHERE id % 16 = 0),
a AS (SELECT b.id, min({{'d': {l2('b.v', 'c.v')}, 'i': c.id}}).i AS region FROM b, c GROUP BY b.id),
n AS (SELECT qid, c.id AS region, row_number() OVER (PARTITION BY qid ORDER BY {l2('q.qv', 'c.v')}, c.id) AS k FROM q, c),
p AS (SELECT n.qid, b.id, {l2('q.qv', 'b.v')} AS d FROM n JOIN a USING (region) JOIN b ON b.id = a.id JOIN q ON q.qid = n.qid WHERE k <= 4 AND value < 60),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id)::INTEGER AS rank FROM p)
SELECT qid, rank, id, round(d, 6) + 0.0 AS dist FROM r WHERE rank <= {K}""")
def knn_probe(spark, d):
    b = X.base(spark, d)
    anchors = b.filter("id % 16 = 0")
    cells = knn.nearest_centroid(b, anchors).select("id", F.col("cid").alias("region"))
    return X.shown(search.probe(b, cells, anchors, X.queries(b), K, 4, P.dnf((P.lt("value", 60),))), "dist")


@query(top_sql("value IS NOT NULL AND round_even(value * 100, 0)::BIGINT % 2 = 1"))
def lambda_udf(spark, d):
    """A user's function as predicate, evaluated on Arrow batches."""

    @F.pandas_udf("boolean")
    def odd_cents(value):
        return (value * 100).round().astype("int64") % 2 == 1

    b = X.base(spark, d)
    return X.shown(knn.exact_topk(b, X.queries(b), K, predicate=P.dnf((P.function("odd_cents", lambda: odd_cents("value")),))), "dist")


@query(top_sql("value < 20"))
def cost_udf(spark, d):
    """The same rows as the predicate that is made costly."""
    b = X.base(spark, d)
    return X.shown(knn.exact_topk(b, X.queries(b), K, predicate=P.spinning(P.lt("value", 20).condition(), 10)), "dist")


#: Written by hand: what the predicates' texts must be.
_CANONICAL = {
    "knn_filter_lt": "OR(AND(value<20.0))", "knn_filter_gt": "OR(AND(value>60.0))", "knn_filter_interval": "OR(AND(10.0<value<40.0))", "knn_filter_eq_cat": "OR(AND(ev=1.0))",
    "knn_dnf_and2": "OR(AND(label=1.0,value<50.0))", "knn_dnf_and4": "OR(AND(value>5.0,value<80.0,ev=2.0,label>3.0))", "knn_dnf_or2": "OR(AND(label=1.0),AND(value<5.0))",
    "knn_dnf_or4": "OR(AND(label=1.0),AND(label=2.0),AND(value<5.0),AND(value>150.0))", "knn_dnf_mix": "OR(AND(label=1.0,value<30.0),AND(label=3.0,value<30.0),AND(ev=2.0))",
    "knn_dnf_no_clause": "OR()", "knn_dnf_empty_clause": "OR(AND())",
}


@query("SELECT name, canonical, sha256(canonical) AS key FROM (VALUES " + ", ".join(f"('{n}', '{c}')" for n, c in _CANONICAL.items()) + ") t(name, canonical)")
def predicate_canonical(spark, d):
    rows = [(name, p.canonical(), p.key()) for name, (p, _) in PREDICATES.items()]
    return spark.createDataFrame(rows, "name string, canonical string, key string")


@query(f"SELECT '{__version__}' AS version")
def version(spark, d):
    return spark.range(1).select(F.lit(__version__).alias("version"))


# --- quantiles and selectivity ----------------------------------------------------------------------------------------

#: Points of a query's grid of distances.
QUANTS = 1024
_GRID = [k / 10 for k in range(11)]
_SORTED = "s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events)"


@query(f"WITH {_SORTED} SELECT p, value AS quantile FROM s, (SELECT unnest({_GRID})::DOUBLE AS p) WHERE k = least(n - 1, floor(p * n)::BIGINT)")
def quantile_grid(spark, d):
    found = quantiles.quantiles(X.table(spark, d, "events"), "value", _GRID)
    return spark.createDataFrame(list(zip(_GRID, found, strict=True)), "p double, quantile double")


def _band(make, sql_for):
    sql = " UNION ALL ".join(f"SELECT {s}::DOUBLE AS sel, {sql_for(s)}" for s in (*quantiles.BANDS, 1.0))

    def run(spark, d):
        e = X.table(spark, d, "events")
        sels = (*quantiles.BANDS, 1.0)
        return spark.createDataFrame([(s, a.a, a.b) for s, a in zip(sels, make(e, "value", *sels), strict=True)], "sel double, a double, b double")

    return f"WITH {_SORTED} {sql}", run


def _at(p: float) -> str:
    return f"(SELECT value FROM s WHERE k = least(n - 1, floor({min(1.0, max(0.0, p))!r}::DOUBLE * n)::BIGINT))"


for _name, _make, _for in (
    ("pred_lt_sel", quantiles.lt_for, lambda s: ("(SELECT max(value) + 1 FROM s)" if s >= 0.999 else _at(s)) + " AS a, 0.0::DOUBLE AS b"),
    ("pred_gt_sel", quantiles.gt_for, lambda s: ("(SELECT min(value) - 1 FROM s)" if s >= 0.999 else _at(1 - s)) + " AS a, 0.0::DOUBLE AS b"),
    ("pred_interval_sel", quantiles.interval_for, lambda s: f"{_at(0.5 - s / 2)} AS a, {_at(0.5 + s / 2)} AS b"),
):
    _sql, _run = _band(_make, _for)
    query(_sql, _name)(_run)


@query("SELECT DISTINCT event_type FROM events")
def categories(spark, d):
    return quantiles.categories(X.table(spark, d, "events"), "event_type")


@query(f"WITH {BASE_SQL} SELECT avg(({MIX_SQL})::INTEGER::DOUBLE) AS selectivity FROM b")
def selectivity(spark, d):
    return quantiles.selectivity(X.base(spark, d), MIX)


@query(f"""WITH {BASE_SQL}, p AS (SELECT qid, {l2('q.qv', 'b.v')} AS d FROM q, b), s AS (SELECT qid, d, row_number() OVER (PARTITION BY qid ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY qid) AS n FROM p)
SELECT qid, i::INTEGER AS i, round(d, 6) + 0.0 AS quant FROM s, range({QUANTS}) t(i) WHERE k = i * (n - 1) // {QUANTS - 1}""")
def distance_quantiles(spark, d):
    b = X.base(spark, d)
    return X.shown(knn.distance_grid(b, X.queries(b), QUANTS).withColumn("i", F.col("i").cast("int")), "quant")


@query(f"""{_GROUPED}, s AS (SELECT qid, d, row_number() OVER (PARTITION BY qid ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY qid) AS n FROM p),
g AS (SELECT qid, list(d) AS grid FROM s, range({QUANTS}) t(i) WHERE k = i * (n - 1) // {QUANTS - 1} GROUP BY qid),
f AS (SELECT qid, label, len(list_filter(grid, lambda x: x <= d)) / {QUANTS} AS rho FROM r JOIN g USING (qid) WHERE rank <= 5)
SELECT qid, label, round(avg(rho), 12) AS mean_rho, round(max(rho), 12) AS max_rho FROM f GROUP BY ALL""")
def rho_rank(spark, d):
    b = X.base(spark, d)
    return X.shown(knn.rank_fractions(b, X.queries(b), "label", 5, QUANTS), "mean_rho", "max_rho", digits=12)


@query(f"WITH {BASE_SQL} SELECT label, count(*) AS n FROM b GROUP BY label")
def label_counts(spark, d):
    return knn.label_counts(X.base(spark, d), "label")


# --- coercions and synthetic columns ----------------------------------------------------------------------------------


@query("SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::DOUBLE AS code FROM events")
def dict_encode(spark, d):
    return coerce.dict_encode(X.table(spark, d, "events").select("event_id", "event_type"), "event_type", "code").select("event_id", "code")


@query("SELECT event_id, coalesce((props->>'$.k')::DOUBLE, 0.0) AS k_number, coalesce(props->>'$.k', '<null>') AS k_category, 0.0::DOUBLE AS missing_number, '<null>' AS missing_category FROM events")
def coerce_json(spark, d):
    k, none = coerce.json_field(F.col("props"), "k"), coerce.json_field(F.col("props"), "no_such_field")
    return X.table(spark, d, "events").select("event_id", coerce.as_number(k).alias("k_number"), coerce.as_category(k).alias("k_category"), coerce.as_number(none).alias("missing_number"), coerce.as_category(none).alias("missing_category"))


_WRITTEN = "SELECT event_id::DOUBLE AS event_id, value, event_type, (dense_rank() OVER (ORDER BY event_type) - 1)::DOUBLE AS event_type_code, {0} AS k FROM events"


def _written(spark, d, lines: Callable[[DataFrame], DataFrame]) -> str:
    """A folder of text files made from all events, for the readers."""
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    lines(X.table(spark, d, "events")).write.text(path)
    return path


@query(_WRITTEN.format("coalesce((props->>'$.k')::DOUBLE, 0.0)"))
def read_jsonl(spark, d):
    path = _written(spark, d, lambda e: e.select(F.to_json(F.struct("event_id", "value", "event_type", F.get_json_object("props", "$.k").cast("double").alias("p.k")))))
    columns = [("event_id", "numeric"), ("value", "numeric"), ("event_type", "categorical"), ("p.k", "numeric")]
    return files.load_jsonl_columns(spark, path, columns).drop("id").withColumnRenamed("p.k", "k")


@query(_WRITTEN.format("'<null>'"))
def read_csv(spark, d):
    """One file, as only its first line is a header."""
    header = spark.createDataFrame([("event_id,value,event_type,k",)], "value string")
    path = _written(spark, d, lambda e: header.union(e.select(F.concat_ws(",", "event_id", "value", "event_type", F.lit("")))).coalesce(1))
    return files.load_csv_columns(spark, path, [("event_id", "numeric"), ("value", "numeric"), ("event_type", "categorical"), ("k", "categorical")]).select("event_id", "value", "event_type", "event_type_code", "k")


@query(f"WITH {BASE_SQL} SELECT id, id % 6 AS w0, (id // 6) % 6 + 6 AS w1, (id // 36) % 6 + 12 AS w2, (id // 216) % 6 + 18 AS w3 FROM b")
def quad_words(spark, d):
    return X.base(spark, d).select("id", *[F.get(coerce.quad_words(F.col("id")), F.lit(k)).cast("long").alias(f"w{k}") for k in range(4)])


_CENTROID = "m AS (SELECT i, avg(v[i]) AS m FROM b, range(1, 65) t(i) GROUP BY i), c AS (SELECT list(m ORDER BY i) AS c FROM m)"


@query(f"WITH {BASE_SQL}, {_CENTROID} SELECT id, round({l2('b.v', 'c.c')}, 6) AS anchor_dist FROM b, c")
def anchor_dist(spark, d):
    return X.shown(synth.anchor_dist(X.base(spark, d)), "anchor_dist")


_CENTS = "c AS MATERIALIZED (SELECT id AS cid, v FROM b WHERE id < 16)"


def _cents(b: DataFrame) -> DataFrame:
    return b.filter("id < 16").select("id", F.col("v").cast("array<double>").alias("v"))


@query(f"WITH {BASE_SQL}, {_CENTS} SELECT b.id, min({{'d': {l2('b.v', 'c.v')}, 'i': cid}}).i AS cid FROM b, c GROUP BY b.id")
def voronoi_assign(spark, d):
    b = X.base(spark, d)
    return knn.nearest_centroid(b, _cents(b)).select("id", "cid")


@query(f"""WITH {BASE_SQL}, {_CENTS}, a AS (SELECT b.id, min({{'d': {l2('b.v', 'c.v')}, 'i': cid}}).i AS cid FROM b, c GROUP BY b.id),
m AS (SELECT cid, i, avg(v[i]) AS m, count(*) AS n FROM a JOIN b USING (id), range(1, 65) t(i) GROUP BY ALL)
SELECT c.cid AS id, (m.i - 1)::INTEGER AS pos, round(m.m, 6) + 0.0 AS mean, m.n FROM c JOIN m USING (cid)""")
def kmeans_step(spark, d):
    b = X.base(spark, d)
    out = synth.kmeans_step(b, _cents(b)).select("id", F.posexplode("v").alias("pos", "mean"), "n")
    return X.shown(out.select("id", "pos", "mean", "n"), "mean")


@query(f"WITH {BASE_SQL}, {_CENTS}, a AS (SELECT v AS av FROM c WHERE cid = 3) SELECT cid, (row_number() OVER (ORDER BY {l2('c.v', 'a.av')}, cid) - 1) / 15 AS grade FROM c, a")
def cf_arange(spark, d):
    c = _cents(X.base(spark, d))
    anchor = c.filter("id = 3").select(F.col("v").alias("av"))
    from ..functions.vectors import l2_sqr

    return synth.graded_range(c.crossJoin(F.broadcast(anchor)), l2_sqr(F.col("v"), F.col("av")))


@query(f"WITH {BASE_SQL}, {_CENTS} SELECT cid, (row_number() OVER (ORDER BY list_reduce(list_transform(v, lambda x, i: x * (i % 3 - 1)), lambda s, t: s + t), cid) - 1) / 15 AS grade FROM c")
def cf_range(spark, d):
    c = _cents(X.base(spark, d))
    along = F.aggregate(F.transform("v", lambda x, k: x * ((k + 1) % 3 - 1)), F.lit(0.0), lambda s, x: s + x)
    return synth.graded_range(c, along)




@query(f"""WITH h AS (SELECT l, (1.0 / (l + 1)) / (SELECT sum(1.0 / (i + 1)) FROM range(10) t(i)) AS w FROM range(10) t(l)), a AS (SELECT l, sum(w) OVER (ORDER BY l) AS acc FROM h),
u AS (SELECT l, CASE WHEN l = 9 THEN 48 ELSE floor(acc * 48 + 0.5)::INTEGER END AS upto FROM a),
o AS (SELECT i AS cid, row_number() OVER (ORDER BY (i * 48271 + 5) % 2147483647, i) AS k FROM range(48) t(i)) SELECT cid, (SELECT min(l) FROM u WHERE upto >= k)::INTEGER AS label FROM o""")
def zipf_label_map(spark, d):
    return synth.zipf_label_map(spark.range(48).withColumnRenamed("id", "cid"), 48, 10, 5)


@query()
def synthetic_columns(spark, d):
    b = X.base(spark, d)
    return synth.synthetic_columns(b).join(synth.extra_columns(b), "id")


@query(f"WITH {REGIONS_SQL} SELECT rg.region, id, label FROM rg JOIN b USING (id)")
def region_members(spark, d):
    return regions.region_members(X.region_map(spark, d), X.base(spark, d)).select("region", "id", "label")


@query(top_sql("value < 60 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = b.id AND o_orderstatus = 'F')"))
def knn_tombstone_table(spark, d):
    """Finished orders are the tombstones."""
    gone = X.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    b = X.base(spark, d)
    return X.shown(knn.exact_topk(knn.without(b, gone), X.queries(b), K, predicate=P.dnf((P.lt("value", 60),))), "dist")


@query(f"WITH {BASE_SQL}, p AS (SELECT qid, b.id, {l2('q.qv', 'b.v')} AS d FROM q, b WHERE value > 150), r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY d, id)::INTEGER AS rank, id, d FROM p) SELECT q.qid, s.rank::INTEGER AS rank, coalesce(r.id, -1) AS id, coalesce(round(r.d, 6) + 0.0, -1.0) AS dist FROM q CROSS JOIN range(1, 41) s(rank) LEFT JOIN r ON r.qid = q.qid AND r.rank = s.rank")
def knn_padded(spark, d):
    b = X.base(spark, d)
    found = knn.exact_topk(b, X.queries(b), 40, predicate=P.dnf((P.gt("value", 150),)))
    return X.shown(knn.padded(found, X.queries(b), 40).na.fill(-1, ["id"]).na.fill(-1.0, ["dist"]), "dist")


@query()
def cluster_columns(spark, d):
    return synth.cluster_columns(X.base(spark, d), compact=True)


@query()
def kmeans(spark, d):
    return synth.kmeans(X.base(spark, d), 16)[1]


# --- graph and regions ------------------------------------------------------------------------------------------------


@query(f"WITH {NODES_SQL} SELECT id, level, father FROM nd")
def nodes_level_father(spark, d):
    return X.nodes(spark, d)


@query(f"WITH {REGIONS_SQL} SELECT id, region, parent FROM rg")
def forest_regions(spark, d):
    return X.region_map(spark, d)


@query(f"WITH {NODES_SQL}, a AS (SELECT lv.id, lv.v FROM lv WHERE level >= 2) SELECT b.id, min({{'d': {l2('b.v', 'a.v')}, 'i': a.id}}).i AS region FROM b, a GROUP BY b.id")
def voronoi_regions(spark, d):
    b = X.base(spark, d)
    return regions.voronoi_regions(b, X.nodes(spark, d)).select("id", "region")


@query(f"WITH {REGIONS_SQL} SELECT region, count(*) AS n FROM rg GROUP BY region")
def region_sizes(spark, d):
    return regions.region_sizes(X.region_map(spark, d))


@query(f"WITH {BASE_SQL}, {EDGES_SQL} SELECT src, dst, rank FROM ed")
def knn_graph_edges(spark, d):
    return X.edges(spark, d)


@query(f"WITH {REGIONS_SQL}, {EDGES_SQL} SELECT s.region AS r_src, t.region AS r_dst, min(ed.dst) AS target, count(*) AS n_edges FROM ed JOIN rg s ON s.id = ed.src JOIN rg t ON t.id = ed.dst WHERE s.region <> t.region GROUP BY ALL")
def region_adjacency(spark, d):
    b = X.base(spark, d)
    return regions.region_adjacency(X.edges(spark, d), X.region_map(spark, d))


@query(f"WITH {REGIONS_SQL} SELECT region, (i - 1)::INTEGER AS pos, round(avg(v[i]), 6) + 0.0 AS mean FROM b JOIN rg USING (id), range(1, 65) t(i) GROUP BY ALL")
def region_centroid(spark, d):
    b = X.base(spark, d)
    return X.shown(regions.region_centroids(b, X.region_map(spark, d)), "mean")


@query(f"""WITH {REGIONS_SQL}, m AS (SELECT region, i, avg(v[i]) AS m FROM b JOIN rg USING (id), range(1, 65) t(i) GROUP BY ALL), c AS (SELECT region, list(m ORDER BY i) AS c FROM m GROUP BY region)
SELECT region, round(avg(sqrt({l2('b.v', 'c.c')})), 6) AS rho_hat FROM b JOIN rg USING (id) JOIN c USING (region) GROUP BY region""")
def region_rho_hat(spark, d):
    b = X.base(spark, d)
    return X.shown(regions.region_rho_hat(b, X.region_map(spark, d)), "rho_hat")


@query(f"""WITH {BASE_SQL}, {EDGES_SQL}, s AS (SELECT src, avg((value < 30)::INTEGER::DOUBLE) AS sigma FROM ed JOIN b ON b.id = ed.dst GROUP BY src)
SELECT src, round(sigma, 6) AS sigma, CASE WHEN sigma >= 0.5 THEN 'one_hop' WHEN sigma * 17 * 16 >= 48 THEN 'two_hop' ELSE 'blind' END AS regime FROM s""")
def local_selectivity_regime(spark, d):
    b = X.base(spark, d)
    return X.shown(graph.local_selectivity(X.edges(spark, d), b, P.lt("value", 30).condition(), 16), "sigma")


@query("SELECT name, true AS good FROM (VALUES ('plain'), ('adaptive'), ('gated'), ('tombstones'), ('flood'), ('routed')) t(name)")
def graph_recall(spark, d):
    """Whether searches along the navigable graph find nine tenths of what an exact scan finds, and floods all."""
    b, _, s = _forest_stats(spark, d)
    q, g, stored = X.queries(b), X.navigable(spark, d), X.by_region(spark, d)
    gone, routed = b.filter("id % 3 = 1").select("id"), lambda force: navigate.routed_search(g, stored, s, search.routing_table(s, MIX, K, force=force), q, MIX, K, ef=128)
    left = b.join(gone, "id", "left_anti")
    found = {
        "plain": (navigate.beam_search(g, q, K, ef=128), b, None), "adaptive": (navigate.beam_search(g, q, K, ef=128, base=b, predicate=MIX), b, MIX),
        "gated": (navigate.beam_search(g, q, K, ef=128, base=b, predicate=MIX, policy=navigate.GATED), b, MIX), "tombstones": (navigate.beam_search(g, q, K, ef=128, base=b, deleted=gone), left, None),
        "flood": (routed("flood"), b, MIX), "routed": (routed("random"), b, MIX),
    }
    out, truths = [], {}
    for name, (got, rows, predicate) in found.items():
        key = id(rows), predicate is None
        if key not in truths:
            truths[key] = rows.filter(predicate.condition()).count() if predicate else rows.count(), settle(knn.exact_topk(rows, q, K, predicate=predicate))
        n, truth = truths[key]
        r = metrics.recall(got, truth, q, n, K).agg(F.avg("recall")).first()[0]
        out.append((name, r >= (1.0 if name == "flood" else 0.9)))
    return spark.createDataFrame(out, "name string, good boolean")


# --- statistics -------------------------------------------------------------------------------------------------------

_ATT = X.attributes_sql()


@query(f"WITH {BASE_SQL}, {_ATT} SELECT i::INTEGER AS i, e AS edge FROM eg")
def hist_edges(spark, d):
    edges = stats.equi_depth_edges(X.base(spark, d), "value", X.BUCKETS)
    return spark.createDataFrame(list(enumerate(edges)), "i int, edge double")


def _flat(spark, d) -> tuple[DataFrame, stats.Schema, DataFrame]:
    b = X.base(spark, d)
    schema = X.schema(b)
    return b, schema, stats.flat_histogram(X.region_map(spark, d), stats.attributes(b, schema))


_FLAT = f"WITH {REGIONS_SQL}, {_ATT} SELECT col, region, bucket, count(*) AS cnt FROM att JOIN rg USING (id)"


@query(f"{_FLAT} WHERE col = 'value' GROUP BY ALL")
def hist_numeric(spark, d):
    return _flat(spark, d)[2].filter("col = 'value'")


@query(f"{_FLAT} WHERE col <> 'value' GROUP BY ALL")
def hist_categorical(spark, d):
    return _flat(spark, d)[2].filter("col <> 'value'")


_NULLS = f"""n AS (SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE value END AS value FROM b), s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS rn, count(*) OVER () AS n FROM n WHERE value IS NOT NULL),
eg AS (SELECT i, value AS e FROM s, range({X.BUCKETS}) t(i) WHERE rn = i * n // {X.BUCKETS}), el AS (SELECT list(e ORDER BY i) AS es FROM eg)"""


@query(f"""WITH {REGIONS_SQL}, {_NULLS}
SELECT 'value' AS col, region, greatest(0, len(list_filter(es, lambda e: e <= value)) - 1)::DOUBLE AS bucket, count(*) AS cnt FROM n JOIN rg USING (id), el WHERE value IS NOT NULL GROUP BY ALL""")
def hist_with_nulls(spark, d):
    """Every fourth value is null: it sets no edge and is in no bucket."""
    b = X.base(spark, d).withColumn("value", F.when(F.col("id") % 4 != 0, F.col("value")))
    return stats.flat_histogram(X.region_map(spark, d), stats.attributes(b, stats.schema_of(b, ["value"], [], X.BUCKETS)))


@query(f"""WITH {REGIONS_SQL}, {_NULLS}, h AS (SELECT id, region, value, greatest(0, len(list_filter(es, lambda e: e <= value)) - 1) AS k FROM n JOIN rg USING (id), el),
ed AS (SELECT list_append(es, (SELECT max(value) + 1 FROM n)) AS es FROM el),
c AS (SELECT region, CASE WHEN value IS NULL THEN NULL WHEN es[k + 2] <= es[k + 1] THEN (30 >= es[k + 2])::INTEGER::DOUBLE ELSE least(1.0, greatest(0.0, (30 - es[k + 1]) / (es[k + 2] - es[k + 1]))) END AS below FROM h, ed)
SELECT region, count(*) AS n, round(coalesce(sum(below), 0) / count(*), 6) AS lt, round(coalesce(sum(1 - below), 0) / count(*), 6) AS gt FROM c GROUP BY region""")
def sigma_with_nulls(spark, d):
    """Nulls count as rows of a region, and satisfy neither side."""
    b = X.base(spark, d).withColumn("value", F.when(F.col("id") % 4 != 0, F.col("value")))
    s = stats.flat_stats(X.region_map(spark, d), b, stats.schema_of(b, ["value"], [], X.BUCKETS))
    return X.shown(stats.sigma_hats(s, [P.lt("value", 30), P.gt("value", 30)]).select("region", "n", F.col("s0").alias("lt"), F.col("s1").alias("gt")), "lt", "gt")


@query(f"WITH {NODES_SQL}, e AS (SELECT id AS region FROM nd ORDER BY level DESC, id LIMIT 1) SELECT b.id, e.region FROM b, e")
def voronoi_without_anchor(spark, d):
    """No node has the level asked for, so the entry point's cell holds every row."""
    return regions.voronoi_regions(X.base(spark, d), X.nodes(spark, d), 99).select("id", "region")


_forest, _forest_stats = X.forest, X.forest_stats
WR = "WITH RECURSIVE"


@query(f"{WR} {FOREST_SQL} SELECT col, node, bucket, cnt FROM fh")
def forest_ancestor_rollup(spark, d):
    b, f, schema = _forest(spark, d)
    return stats.rollup(f, stats.attributes(b, schema))[0]


def _errors(spark, d) -> DataFrame:
    b, f, schema = _forest(spark, d)
    hist, sizes = (settle(x) for x in stats.rollup(f, stats.attributes(b, schema)))
    return X.shown(stats.errors(f, hist, sizes, schema, 1.0), "err")


@query(f"{WR} {FOREST_SQL} SELECT c, round(err, 6) + 0.0 AS err FROM er WHERE col = 'value'")
def discard_err_numeric(spark, d):
    return _errors(spark, d).filter("col = 'value'").select("c", "err")


@query(f"{WR} {FOREST_SQL} SELECT col, c, round(err, 6) + 0.0 AS err FROM er WHERE col <> 'value'")
def discard_err_categorical(spark, d):
    return _errors(spark, d).filter("col <> 'value'")


@query(f"{WR} {FOREST_SQL} SELECT id, region FROM rm")
def bound_regions(spark, d):
    return _forest_stats(spark, d)[2].region_map


@query(f"{WR} {FOREST_SQL} SELECT col, region, node FROM hn")
def hist_nodes(spark, d):
    return _forest_stats(spark, d)[2].hist_node


@query(f"""{WR} {FOREST_SQL}, t AS (SELECT tr.tree, count(fc.id) AS n FROM tr LEFT JOIN fc USING (c) GROUP BY tr.tree), s AS (SELECT tree, n, floor(100000.0 * n / (SELECT count(*) FROM fc))::BIGINT AS share FROM t)
SELECT tree, n, share + CASE WHEN tree = (SELECT tree FROM s ORDER BY n DESC, tree LIMIT 1) THEN 100000 - (SELECT sum(share) FROM s) ELSE 0 END::BIGINT AS bytes FROM s""")
def tree_budget(spark, d):
    return stats.tree_budgets(_forest(spark, d)[1], 100_000)


@query(f"""{WR} {FOREST_SQL}, t AS (SELECT tr.tree, count(fc.id) AS n FROM tr LEFT JOIN fc USING (c) GROUP BY tr.tree), s AS (SELECT tree, n, floor(4000.0 * n / (SELECT count(*) FROM fc))::BIGINT AS share FROM t),
bu AS MATERIALIZED (SELECT tree, share + CASE WHEN tree = (SELECT tree FROM s ORDER BY n DESC, tree LIMIT 1) THEN 4000 - (SELECT sum(share) FROM s) ELSE 0 END::BIGINT AS bytes FROM s),
ab AS MATERIALIZED (SELECT tree, col, c, CASE col WHEN 'value' THEN 128 WHEN 'label' THEN 40 ELSE 20 END AS size, row_number() OVER (PARTITION BY tree ORDER BY err DESC, col, c) AS k FROM er JOIN tr USING (c) WHERE err > CASE WHEN col = 'value' THEN 0.05 ELSE 0.10 END),
gy(tree, k, used, take) AS (SELECT tree, 0::BIGINT, 188::BIGINT, false FROM bu UNION ALL
  SELECT g.tree, a.k, g.used + CASE WHEN g.used + a.size <= bu.bytes THEN a.size ELSE 0 END, g.used + a.size <= bu.bytes FROM gy g JOIN ab a ON a.tree = g.tree AND a.k = g.k + 1 JOIN bu ON bu.tree = g.tree)
SELECT col, c FROM cd, (VALUES ('value'), ('label'), ('ev')) x(col) WHERE parent IS NULL UNION ALL SELECT col, c FROM gy JOIN ab USING (tree, k) WHERE take""")
def budget_greedy(spark, d):
    b, f, schema = _forest(spark, d)
    hist, sizes = (settle(x) for x in stats.rollup(f, stats.attributes(b, schema)))
    widths = {"value": X.BUCKETS, "label": 10, "ev": 5}
    return stats.keep(f, stats.errors(f, hist, sizes, schema, 1.0), schema, widths, budget=4000)


@query(f"{WR} {FOREST_SQL} SELECT hn.region, round({X.sum_sql('value', X.cover_sql('50'))}, 6) + 0.0 AS cdf {X.SIGMA_FROM}")
def cdf_region(spark, d):
    return X.shown(stats.cdf(_forest_stats(spark, d)[2], "value", 50), "cdf")


SIGMAS = {
    "sigma_hat_lt": (P.lt("value", 30), X.sum_sql("value", X.cover_sql("30"))),
    "sigma_hat_gt": (P.gt("value", 30), "greatest(0.0, 1 - " + X.sum_sql("value", X.cover_sql("30")) + ")"),
    "sigma_hat_interval": (P.interval("value", 10, 70), "greatest(0.0, " + X.sum_sql("value", X.cover_sql("70")) + " - " + X.sum_sql("value", X.cover_sql("10")) + ")"),
    "sigma_hat_eq": (P.eq("label", 1), X.eq_sql("label", 1)),
    "sigma_hat_eq_numeric": (P.eq("value", 1), "0.0 * " + X.eq_sql("label", 1)),
}


def _sigma(atom: P.Atom):
    return lambda spark, d: X.shown(stats.sigma_hats(_forest_stats(spark, d)[2], [atom]).select("region", "n", F.col("s0").alias("sigma")), "sigma")


for _name, (_atom, _sql) in SIGMAS.items():
    query(f"{WR} {FOREST_SQL} SELECT hn.region, (SELECT n FROM fs WHERE node = hn.region) AS n, round({_sql}, 6) + 0.0 AS sigma {X.SIGMA_FROM}", _name)(_sigma(_atom))


@query(f"{WR} {FOREST_SQL} SELECT col, region, bucket FROM pr")
def presence(spark, d):
    return _forest_stats(spark, d)[2].presence


@query(f"{WR} {FOREST_SQL} SELECT col, region, count(*) AS bits FROM pr GROUP BY ALL")
def presence_bitmap(spark, d):
    bits = stats.presence_bitmaps(_forest_stats(spark, d)[2].presence)
    return bits.select("col", "region", F.bitmap_count("bitmap").alias("bits"))


_BUCKET10 = f"(SELECT greatest(0, least({X.BUCKETS - 1}, len(list_filter(es, lambda e: e <= 10)) - 1)) FROM el)"


@query(f"""{WR} {FOREST_SQL} SELECT c AS region, NOT EXISTS (SELECT 1 FROM pr WHERE region = c AND col = 'ev' AND bucket = 2) AS eq_empty,
NOT EXISTS (SELECT 1 FROM pr WHERE region = c AND col = 'value' AND bucket <= {_BUCKET10}) AS lt_empty, NOT EXISTS (SELECT 1 FROM pr WHERE region = c AND col = 'ev' AND bucket = 77) AS unknown_empty, false AS range_on_category FROM bd""")
def atom_empty(spark, d):
    s = _forest_stats(spark, d)[2]
    found = stats.empty_atoms(s, [P.eq("ev", 2), P.lt("value", 10), P.eq("ev", 77), P.lt("ev", 2)])
    return found.select("region", F.col("e0").alias("eq_empty"), F.col("e1").alias("lt_empty"), F.col("e2").alias("unknown_empty"), F.col("e3").alias("range_on_category"))


@query(f"{WR} {COST_SQL} SELECT region, empty FROM co")
def dnf_empty(spark, d):
    return stats.dnf_empty(_forest_stats(spark, d)[2], MIX)


@query(f"{WR} {FOREST_SQL} SELECT k.col, count(*) AS rows, (count(*) * 4 * CASE WHEN k.col = 'value' THEN {X.BUCKETS} ELSE (SELECT count(DISTINCT bucket) FROM att WHERE att.col = k.col) END)::BIGINT AS bytes FROM kp k GROUP BY k.col")
def hist_bytes(spark, d):
    return stats.storage_bytes(_forest_stats(spark, d)[2])


# --- costs and routing ------------------------------------------------------------------------------------------------


@query(f"""WITH {REGIONS_SQL}, s AS (SELECT region, count(*) AS n FROM rg GROUP BY region), t AS (SELECT region, n, greatest(0.0, least(1.0, 24.0 / n - 0.4)) AS theta FROM s)
SELECT region, n, round(theta, 6) AS theta, CASE WHEN 0.3 < theta THEN 'flood' ELSE 'best_first' END AS decision FROM t""")
def theta(spark, d):
    sizes = regions.region_sizes(X.region_map(spark, d))
    t = cost.theta(24.0, F.col("n"), cost.Costs())
    return X.shown(sizes.select("region", "n", t.alias("theta"), cost.decide(F.lit(0.3), t).alias("decision")), "theta")


def _routed(spark, d) -> DataFrame:
    return search.routing_table(_forest_stats(spark, d)[2], MIX, K)


def _nano(*columns: str) -> list[Column]:
    return [F.round(F.col(c) * 1e9, 3).alias(c) for c in columns]


@query(f"{WR} {COST_SQL} SELECT region, n, round(sel, 9) AS sel FROM cs")
def sel_dnf(spark, d):
    return X.shown(_routed(spark, d).select("region", "n", "sel"), "sel", digits=9)


@query(f"{WR} {COST_SQL} SELECT region, round(evals, 6) AS evals FROM cs")
def expected_pred_evals(spark, d):
    return X.shown(_routed(spark, d).select("region", "evals"), "evals")


@query(f"{WR} {COST_SQL} SELECT region, round(flood * 1e9, 3) AS flood FROM ct")
def flood_cost(spark, d):
    return _routed(spark, d).select("region", *_nano("flood"))


@query(f"{WR} {COST_SQL} SELECT region, round(flood * 1e9, 3) AS flood, round(best_first * 1e9, 3) AS best_first, route FROM rt")
def route_region(spark, d):
    return _routed(spark, d).select("region", *_nano("flood", "best_first"), "route")


@query(f"{WR} {COST_SQL} SELECT route, round(sum(sel * n), 6) AS matches, round(sum(CASE route WHEN 'flood' THEN flood ELSE best_first END) * 1e9, 3) AS cost FROM rt GROUP BY route")
def frontier_score(spark, d):
    return cost.frontier_scores(_routed(spark, d)).select("route", F.round("matches", 6).alias("matches"), *_nano("cost"))


@query(f"WITH {BASE_SQL} SELECT id, (least(1, value / 100) >= 0.01)::INTEGER + (least(1, value / 100) >= 0.05)::INTEGER + (least(1, value / 100) >= 0.1)::INTEGER + (least(1, value / 100) >= 0.3)::INTEGER AS band FROM b")
def sigma_bands(spark, d):
    return X.base(spark, d).select("id", cost.sigma_band(F.least(F.lit(1), F.col("value") / 100)).alias("band"))


@query(f"""WITH {REGIONS_SQL}, c AS (SELECT region, count(*) FILTER ({MIX_SQL}) AS c FROM rg JOIN b USING (id) GROUP BY region), t AS (SELECT sum(c) AS t, count(*) AS r, sum(c * c) AS s FROM c)
SELECT t::BIGINT AS matches, r AS regions, round((s / (t * t)::DOUBLE - 1 / r) / (1 - 1 / r), 6) AS rho FROM t""")
def concentration(spark, d):
    b = X.base(spark, d)
    return X.shown(cost.concentration(X.region_map(spark, d), b, MIX.condition()), "rho")


@query(f"{WR} {COST_SQL}, f AS (SELECT route, sum(sel * n) / sum(CASE route WHEN 'flood' THEN flood ELSE best_first END) AS score FROM rt GROUP BY route) SELECT CASE WHEN coalesce((SELECT score FROM f WHERE route = 'best_first'), 0) > coalesce((SELECT score FROM f WHERE route = 'flood'), 0) THEN 'best_first' ELSE 'flood' END AS route")
def frontier_decision(spark, d):
    return cost.frontier_decision(_routed(spark, d))


@query(f"""WITH {REGIONS_SQL}, {_ATT}, k AS (SELECT greatest(0, least({X.BUCKETS - 1}, len(list_filter(es, lambda e: e <= 30)) - 1)) AS k FROM el),
c AS (SELECT region, count(*) FILTER (bucket <= k) AS c FROM att JOIN rg USING (id), k WHERE col = 'value' GROUP BY region), t AS (SELECT sum(c) AS t, count(*) AS r, sum(c * c) AS s FROM c)
SELECT t::BIGINT AS matches, r AS regions, round((s / (t * t)::DOUBLE - 1 / r) / (1 - 1 / r), 6) AS rho FROM t""")
def covered_concentration(spark, d):
    b = X.base(spark, d)
    return X.shown(cost.covered_concentration(stats.flat_stats(X.region_map(spark, d), b, stats.schema_of(b, ["value"], [], X.BUCKETS)), P.lt("value", 30)), "rho")


@query(f"""{WR} {COST_SQL} SELECT rt.region, route, empty, coalesce(m.n, 0) AS n, CASE WHEN empty THEN 0 ELSE coalesce(m.n, 0) END AS preds, CASE WHEN empty THEN 0 ELSE coalesce(m.k, 0) END AS dists
FROM rt LEFT JOIN (SELECT region, count(*) AS n, count(*) FILTER ({MIX_SQL}) AS k FROM rm JOIN b USING (id) GROUP BY region) m USING (region)""")
def search_trace(spark, d):
    s = _forest_stats(spark, d)[2]
    return search.trace(X.by_region(spark, d), s, _routed(spark, d), MIX)


# --- search over regions ----------------------------------------------------------------------------------------------


@query(ORACLE_SQL["knn_dnf_mix"])
def search_pruned(spark, d):
    b, _, s = _forest_stats(spark, d)
    return X.shown(search.search(X.by_region(spark, d), s, X.queries(b), MIX, K), "dist")


@query(ORACLE_SQL["knn_dnf_mix"])
def search_strategy_override(spark, d):
    b, _, s = _forest_stats(spark, d)
    return X.shown(search.search_with_routes(X.by_region(spark, d), s, search.routing_table(s, MIX, K, force="random"), X.queries(b), MIX, K), "dist")


@query(f"""{WR} {FOREST_SQL}, sg AS (SELECT hn.region, {X.eq_sql('label', 1)} AS s {X.SIGMA_FROM}), p AS (SELECT qid, b.id, {l2('q.qv', 'b.v')} AS d FROM q, b JOIN rm USING (id) JOIN sg USING (region) WHERE s >= 0.08 AND label = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id)::INTEGER AS rank FROM p) SELECT qid, rank, id, round(d, 6) + 0.0 AS dist FROM r WHERE rank <= {K}""")
def sigma_gate_scan(spark, d):
    b, _, s = _forest_stats(spark, d)
    return X.shown(search.sigma_gate(X.by_region(spark, d), s, X.queries(b), P.dnf((P.eq("label", 1),)), 0.08, K), "dist")


@query(f"""{WR} {REGIONS_SQL}, {EDGES_SQL}, ad AS MATERIALIZED (SELECT DISTINCT s.region AS a, t.region AS z FROM ed JOIN rg s ON s.id = ed.src JOIN rg t ON t.id = ed.dst WHERE s.region <> t.region),
em AS MATERIALIZED (SELECT region FROM rg JOIN b USING (id) GROUP BY region HAVING count(*) FILTER (value > 90) = 0), st AS (SELECT DISTINCT region FROM rg),
w(start, region) AS (SELECT region, region FROM st UNION SELECT w.start, ad.z FROM w JOIN ad ON ad.a = w.region WHERE w.region = w.start OR w.region IN (SELECT region FROM em))
SELECT start, region FROM w WHERE start <> region AND region NOT IN (SELECT region FROM em)""")
def transparent_frontier(spark, d):
    b = X.base(spark, d)
    rg = settle(X.region_map(spark, d))
    empty = settle(rg.join(b, "id").groupBy("region").agg(F.count_if(F.col("value") > 90).alias("n")).filter("n = 0").select("region"))
    adjacency = settle(regions.region_adjacency(X.edges(spark, d), rg))
    return regions.transparent_frontier(adjacency, empty, rg.select("region").distinct())


# --- maintenance ------------------------------------------------------------------------------------------------------

_NEW, _OLD = "level = 0 AND id % 5 = 0", "NOT (level = 0 AND id % 5 = 0)"


def _before_inserts(spark, d):
    """State over all rows but some of level 0, the forest over those, and the rows to come with their first candidates."""
    b = X.base(spark, d)
    n = X.nodes(spark, d)
    old = n.filter(_OLD)
    f = stats.forest(old)
    first = settle(b.join(old.select("id"), "id", "left_semi"))
    schema = X.schema(first)
    state = maintain.State(stats.forest_stats(f, first, schema), settle(maintain.trees_of(f)))
    points = settle(n.filter(_NEW).filter("father <> id").select("id", F.col("father").alias("c")))
    return state, f, points, b.join(points.select("id"), "id", "left_semi"), first


_INSERT = f"""{NODES_SQL}, {X.attributes_sql('(SELECT b.* FROM b JOIN nd USING (id) WHERE ' + _OLD.replace('id %', 'b.id %') + ')')}, {X.CANDIDATES_SQL}, {X.forest_sql('', _OLD)},
nw AS (SELECT id, father AS c FROM nd WHERE {_NEW} AND father <> id),
al AS (SELECT id, c FROM fc UNION ALL SELECT id, c FROM nw)"""


@query(f"""{WR} {_INSERT} SELECT att.col, cl.anc AS node, bucket, count(*) AS cnt FROM al JOIN cl USING (c) JOIN att USING (id) JOIN kp ON kp.col = att.col AND kp.c = cl.anc
WHERE att.col = 'value' OR EXISTS (SELECT 1 FROM fh WHERE fh.col = att.col AND fh.bucket = att.bucket) GROUP BY ALL""")
def delta_insert(spark, d):
    state, f, points, rows, _ = _before_inserts(spark, d)
    return maintain.insert(state, f, points, rows).stats.hist


@query(f"{WR} {_INSERT} SELECT cl.anc AS node, count(*) AS n FROM al JOIN cl USING (c) WHERE cl.anc IN (SELECT c FROM bd) GROUP BY ALL")
def delta_insert_sizes(spark, d):
    state, f, points, rows, _ = _before_inserts(spark, d)
    return maintain.insert(state, f, points, rows).stats.sizes


def _state(spark, d):
    b, f, s = _forest_stats(spark, d)
    return b, f, maintain.State(s, settle(maintain.trees_of(f)))


@query(f"""{WR} {FOREST_SQL}, dl AS (SELECT att.col, tr.tree AS node, bucket, count(*) AS k FROM fc JOIN tr USING (c) JOIN att USING (id) WHERE id % 7 = 0 GROUP BY ALL)
SELECT fh.col, fh.node, fh.bucket, greatest(0, fh.cnt - coalesce(dl.k, 0)) AS cnt FROM fh JOIN kp ON kp.col = fh.col AND kp.c = fh.node LEFT JOIN dl ON dl.col = fh.col AND dl.node = fh.node AND dl.bucket = fh.bucket""")
def delta_delete(spark, d):
    b, f, state = _state(spark, d)
    return maintain.delete(state, f, b.filter("id % 7 = 0").select("id"), b)[0].stats.hist


_TREES = "tn AS (SELECT tr.tree, count(*) AS n FROM fc JOIN tr USING (c) GROUP BY tr.tree)"


@query(f"""{WR} {FOREST_SQL}, {_TREES}, ch AS (SELECT tr.tree, count(*) AS k FROM fc JOIN tr USING (c) WHERE id % 2 = 0 OR id % 3 = 0 GROUP BY tr.tree)
SELECT tree, n, coalesce(k, 0) AS cnt_mod, coalesce(k, 0) >= greatest(16, floor(0.5 * n)) AS due FROM tn LEFT JOIN ch USING (tree)""")
def rebuild_trigger(spark, d):
    b, f, state = _state(spark, d)
    changes = b.filter("id % 2 = 0 or id % 3 = 0").select("id", F.lit("value").alias("col"), F.lit(0.0).alias("bucket"))
    after, due = maintain.update(state, f, changes)
    return after.trees.join(due.withColumn("due", F.lit(True)), "tree", "left").select("tree", "n", "cnt_mod", F.coalesce("due", F.lit(False)).alias("due"))


@query(f"""{WR} {FOREST_SQL}, {X.forest_sql('z', 'id % 3 = 0')}, {_TREES}, gone AS (SELECT tr.tree, count(*) AS k FROM fc JOIN tr USING (c) WHERE id % 3 <> 0 GROUP BY tr.tree),
due AS MATERIALIZED (SELECT tree FROM tn JOIN gone USING (tree) WHERE k >= greatest(16, floor(0.5 * (n - k)))),
ins AS MATERIALIZED (SELECT c FROM tr WHERE tree IN (SELECT tree FROM due)), rz AS (SELECT c AS node, n - coalesce(k, 0) AS n FROM bd JOIN fs ON fs.node = c LEFT JOIN gone ON gone.tree = c)
SELECT node, greatest(0, n) AS n FROM rz WHERE node NOT IN (SELECT c FROM ins) UNION ALL SELECT node, n FROM zfs WHERE node IN (SELECT c FROM ins) AND node IN (SELECT c FROM zbd)""")
def rebuild_tree(spark, d):
    b, f, state = _state(spark, d)
    after, due = maintain.delete(state, f, b.filter("id % 3 <> 0").select("id"), b)
    return maintain.rebuild(after, f, b.filter("id % 3 = 0"), settle(due)).stats.sizes


