"""The operators' registered queries: each applies one to its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_forest, bpe, chat, mixing, near_embeddings, quality, secret_scan, simhash, toxicity, url_rules
from ._shared import table

TOKENIZER = "byte_bpe_50k.tiktoken"
#: (host, path, verdict)
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: The conversation that op7 adds: its texts hold the template's control strings.
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann_forest.search(rows, rows.filter("vec_id % 100 = 0"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), train=~toxicity.held_out("id"))
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    taken = mixing.mix(docs, source=F.col("source"), lang=F.col("lang"), tokens=mixing.word_tokens(F.col("text")))
    return taken.select(F.col("row")["doc_id"].alias("doc_id"), "source", "lang", "topic", "tokens", F.round("p", 6).alias("probability"), *[(F.round(f"{s}_miss", 6) + F.lit(0.0)).alias(f"{s}_miss") for s in mixing.SIDES])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)], rows.schema)
    done = chat.format_conversations(rows.union(extra))
    read = chat.read_back(done.withColumn("conv_id", F.struct("conv_id", "formatted")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select(
        F.col("conv_id")["conv_id"].alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length(F.col("conv_id")["formatted"]).cast("long").alias("formatted_chars"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rules_frame(spark, URL_RULES))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), host=F.col("source"), path=F.col("lang"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_embedding_near_dedup, op3_nearest_neighbours, op4_toxicity, op5_mixing, op6_simhash, op7_chat, op8_secrets, op9_url_filters, op10_quality)}

_VECTORS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e,
  coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings)"""


def _op5_sql() -> str:
    """Raking as a chain of window steps over the cells, then the same sampling.

    What values can reach is found in closed form: in falling order of share over tokens, the values that are used up are a
    prefix, and of all prefixes the right one gives the others the largest scale."""
    rest = lambda s: ", ".join(x for x in mixing.SIDES if x != s)
    reach = ", ".join(f"""t_{s} AS MATERIALIZED (SELECT {s}, t, r / sum(r) OVER () AS share FROM (SELECT {s}, t, CASE WHEN t > 0 THEN pow(t / sum(t) OVER (), {mixing.TEMPER}) ELSE 0.0 END AS r FROM (SELECT {s}, sum(tokens)::DOUBLE AS t FROM c0 GROUP BY 1))),
x_{s} AS (SELECT *, coalesce(sum(t) OVER (ORDER BY share / t DESC, {s} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(share) OVER (ORDER BY share / t DESC, {s} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others FROM t_{s} WHERE share > 0),
w_{s} AS MATERIALIZED (SELECT {s}, share, CASE WHEN share > 0 THEN least(t, share * (SELECT max(((SELECT {mixing.FRACTION} * sum(tokens) FROM c0) - gone) / others) FROM x_{s})) ELSE 0.0 END AS want FROM t_{s})""" for s in mixing.SIDES)
    steps, last = [], "c0"
    for k in range(mixing.ROUNDS * len(mixing.SIDES)):
        s = mixing.SIDES[k % len(mixing.SIDES)]
        order = f"PARTITION BY {s} ORDER BY p DESC, {rest(s)} ROWS BETWEEN"
        steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, least(1.0, c.p * n.r) AS p FROM {last} c JOIN (SELECT {s}, coalesce(max((want - gone) / others) FILTER (others > 0), 0.0) AS r FROM
  (SELECT {s}, coalesce(sum(tokens) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(tokens * p) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS others FROM {last}) JOIN w_{s} USING ({s}) GROUP BY {s}) n USING ({s}))""")
        last = f"c{k + 1}"
    misses = ", ".join(f"m_{s} AS (SELECT {s}, round(sum(tokens * p) / (SELECT sum(tokens * p) FROM {last}) - any_value(share), 6) + 0.0 AS {s}_miss FROM {last} JOIN w_{s} USING ({s}) GROUP BY {s})" for s in mixing.SIDES)
    return f"""WITH w AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens FROM documents),
d AS MATERIALIZED (SELECT *, CASE WHEN tokens < 128 THEN 'short' WHEN tokens < 1024 THEN 'medium' ELSE 'long' END AS topic FROM w),
c0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, 1.0::DOUBLE AS p FROM d GROUP BY ALL),
{reach}, {', '.join(steps)}, {misses}
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(p.p, 6) AS probability, source_miss, lang_miss, topic_miss FROM d JOIN {last} p USING (source, lang, topic) JOIN m_source USING (source) JOIN m_lang USING (lang) JOIN m_topic USING (topic)
WHERE ('0x' || substr(md5('{mixing.SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::UBIGINT::DOUBLE / {2**52} < p.p"""


def _op7_sql() -> str:
    text = EXTRA_TEXT.replace("'", "''")
    longer = "length({0}) + len(regexp_extract_all({0}, '[\\\\#<]'))"
    return f"""WITH a AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{text}' UNION ALL SELECT -7, 1, 'assistant', '{text}'),
b AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM b),
d AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY k) IS DISTINCT FROM role AS starts FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({longer.format('text')} + 7 + CASE WHEN starts THEN 4 + {longer.format('role')} + len(regexp_extract_all(role, chr(10))) + 3 ELSE 0 END)::BIGINT AS formatted_chars
FROM d GROUP BY conv_id"""


def _op8_sql() -> str:
    """The base kinds: what stands before a match is the pieces and matches before it. DuckDB has no CRC-32, so tokens with a
    checksum, of which the tables have none, are left out."""
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    words = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    assign = f"""({words})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = (("assign", assign, f"length(regexp_extract(x, '{assign}', 2)) >= 12"), ("access", "AKIA[A-Z0-9]+", "length(x) >= 18"), ("hex", "[0-9a-f]{16,}", "true"))
    found = " UNION ALL ".join(f"SELECT row, '{kind}' AS kind, {k} AS place, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m FROM d WHERE regexp_matches(t, '{pattern}')" for k, (kind, pattern, _) in enumerate(kinds))
    good = " ".join(f"WHEN '{kind}' THEN {test}" for kind, _, test in kinds)
    size = lambda part: f"coalesce(list_sum(list_transform({part}, lambda y: length(y))), 0)"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS t FROM documents), f AS ({found}),
g AS (SELECT row, kind, place, p, m, unnest(range(1, len(m) + 1)) AS i FROM f),
h AS (SELECT row, kind, place, m[i] AS x, ({size('p[1:i]')} + {size('m[1:i - 1]')})::BIGINT AS a FROM g),
e AS (SELECT row, kind, place, a, a + length(x) AS b FROM h WHERE CASE kind {good} END),
s AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans FROM e GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, 0::BIGINT AS n_token, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (row)"""


def _op9_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""WITH r(h, p, v) AS (VALUES {rules}),
u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT q.page_id, max({{'size': length(h || p), 'rule': h || p, 'v': v}}) AS best FROM q JOIN r ON (q.host = r.h OR ends_with(q.host, '.' || r.h)) AND starts_with(q.path, r.p) GROUP BY q.page_id)
SELECT q.page_id, q.host, q.path, m.best.rule AS rule, coalesce(m.best.v, 'allow') AS verdict FROM q LEFT JOIN m USING (page_id)"""


ORACLE_SQL = {
    "op2_embedding_near_dedup": f"""WITH RECURSIVE {_VECTORS},
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.ok AND b.ok AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a""",
    "op3_nearest_neighbours": f"""WITH {_VECTORS},
p AS (SELECT q.vec_id AS query_id, x.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, x.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score FROM v q JOIN v x
  ON q.vec_id % 100 = 0 AND q.ok AND x.ok AND len(q.e) = len(x.e) AND q.vec_id <> x.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10""",
    "op5_mixing": _op5_sql(),
    "op7_chat": _op7_sql(),
    "op8_secrets": _op8_sql(),
    "op9_url_filters": _op9_sql(),
}
