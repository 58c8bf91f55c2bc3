"""Synthetic attribute columns: deterministic ones exactly, random ones from a hash of the id, so that they can be repeated."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import quad_words
from ..functions.vectors import l2_sqr
from ..session import settle
from .knn import nearest_centroid

ZIPF_SHAPE = 1.16


def uniform(node_id: Column, seed: int, stream: str = "") -> Column:
    """A number in (0, 1) from id, seed and stream."""
    h = F.pmod(F.xxhash64(node_id, F.lit(seed), F.lit(stream)), F.lit(1 << 52)).cast("double")
    return (h + 0.5) / F.lit(float(1 << 52))


def gaussian(node_id: Column, seed: int, stream: str = "") -> Column:
    a, b = uniform(node_id, seed, stream + "a"), uniform(node_id, seed, stream + "b")
    return F.sqrt(-2 * F.log(a)) * F.cos(2 * math.pi * b)


def global_centroid(base: DataFrame) -> DataFrame:
    """One row (c): the mean vector, from sums by component."""
    mean = base.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))


def anchor_dist(base: DataFrame) -> DataFrame:
    """(id, anchor_dist): squared distance to the global centroid."""
    return base.crossJoin(F.broadcast(global_centroid(base))).select("id", l2_sqr(F.col("v"), F.col("c")).alias("anchor_dist"))


def synthetic_columns(base: DataFrame, seed: int = 1234) -> DataFrame:
    """id, u_uniform (0 to 1), u_gauss, c_cat10 (0 to 9), anchor_dist."""
    i = F.col("id")
    rest = base.select("id", uniform(i, seed, "u").alias("u_uniform"), gaussian(i, seed, "g").alias("u_gauss"), F.floor(uniform(i, seed, "c") * 10).cast("double").alias("c_cat10"))
    return rest.join(anchor_dist(base), "id")


def extra_columns(base: DataFrame, seed: int = 5678) -> DataFrame:
    """id, u_zipf (Pareto), u_bimodal, u_uni2, u_gauss2, u_exp, u_uni3, by inverse distribution functions."""
    i = F.col("id")
    bimodal = F.when(uniform(i, seed, "side") < 0.5, -2.0).otherwise(2.0) + gaussian(i, seed, "bi") * 0.5
    return base.select(
        "id", F.pow(uniform(i, seed, "z"), F.lit(-1 / ZIPF_SHAPE)).alias("u_zipf"), bimodal.alias("u_bimodal"), uniform(i, seed, "u2").alias("u_uni2"),
        gaussian(i, seed, "g2").alias("u_gauss2"), (-F.log(uniform(i, seed, "e"))).alias("u_exp"), uniform(i, seed, "u3").alias("u_uni3"),
    )


def first_centroids(base: DataFrame, c: int, seed: int = 0) -> DataFrame:
    """(id, v): c rows chosen by a hash of the id, numbered in order of id."""
    chosen = base.select("id", "v").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(c)
    return chosen.select((F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))


def kmeans_step(base: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, v, n): one Lloyd step; a centroid without members stays where it is."""
    near = nearest_centroid(base, centroids).select("id", "cid")
    sums = base.join(near, "id").select("cid", F.posexplode("v").alias("pos", "x")).groupBy("cid", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    moved = sums.groupBy("cid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("moved"), F.max("n").alias("n"))
    return centroids.join(moved, centroids["id"] == moved["cid"], "left").select("id", F.coalesce("moved", "v").alias("v"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def kmeans(base: DataFrame, c: int, *, seed: int = 0, fit_sample: int = 20_000, iters: int = 6) -> tuple[DataFrame, DataFrame]:
    """(centroids, assignment(id, cid)): fitted on at most fit_sample rows (the first by hash), then all rows are assigned.

    A centroid that loses its members is moved to the row that lies farthest from its own centroid."""
    sample = settle(base.select("id", "v").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").limit(fit_sample))
    cents = settle(first_centroids(sample, c, seed))
    for _ in range(iters):
        moved = settle(kmeans_step(sample, cents))
        lost = [r["id"] for r in moved.filter("n = 0").select("id").orderBy("id").collect()]
        if lost:
            far = nearest_centroid(sample, moved.select("id", "v")).orderBy(F.desc("dist"), "id").limit(len(lost)).select(F.col("id").alias("far"), (F.row_number().over(Window.orderBy(F.desc("dist"), "id")) - 1).alias("k"))
            names = base.sparkSession.createDataFrame([(k, i) for k, i in enumerate(lost)], "k int, lost bigint")
            spots = far.join(names, "k").join(sample.select(F.col("id").alias("far"), F.col("v").cast("array<double>").alias("fv")), "far").select("lost", "fv")
            moved = moved.join(spots, moved["id"] == spots["lost"], "left").select("id", F.coalesce("fv", "v").alias("v"), "n")
        cents = settle(moved.select("id", "v"))
    return cents, nearest_centroid(base, cents).select("id", "cid")


def zipf_quotas(c: int, labels: int) -> list[int]:
    """Label of each of c places, in order: label l takes about 1 / (l + 1) of them, one at least while places last."""
    total = sum(1 / (k + 1) for k in range(labels))
    out, share = [], 0.0
    for k in range(labels):
        share += 1 / (k + 1) / total
        upto = c if k == labels - 1 else max(len(out) + 1, math.floor(share * c + 0.5))
        out += [k] * (min(upto, c) - len(out))
    return out


def zipf_label_map(clusters: DataFrame, c: int, labels: int, seed: int = 0) -> DataFrame:
    """(cid, label): clusters in an order shuffled by a hash take the quotas. There are as many rows as clusters."""
    order = Window.orderBy(F.pmod(F.col("cid") * F.lit(48271) + F.lit(seed), F.lit(2147483647)), "cid")
    quotas = F.array(*[F.lit(x) for x in zipf_quotas(c, labels)])
    return clusters.select("cid").withColumn("k", F.row_number().over(order)).select("cid", F.element_at(quotas, F.col("k")).alias("label"))


def compact_label_map(centroids: DataFrame, labels: int) -> dict[int, int]:
    """cluster -> label: each label takes a seed cluster and the free clusters nearest to it, by Zipf quotas. The seeds are
    the free clusters of the smallest number. centroids(id, v) is a small table: as many rows as clusters."""
    import numpy as np

    held = sorted((r["id"], r["v"]) for r in centroids.collect())
    x = np.array([v for _, v in held], float)
    c = len(held)
    total = sum(1 / (k + 1) for k in range(labels))
    room = [1] * labels
    spare = c - labels
    for k in range(labels):
        more = max(0, min(math.floor(c / (k + 1) / total + 0.5) - 1, spare))
        room[k], spare = room[k] + more, spare - more
    room[0] += max(0, spare)
    free, out = set(range(c)), {}
    for k in range(labels):
        if not free:
            break
        seed = min(free)
        near = sorted(free, key=lambda i: (float(((x[i] - x[seed]) ** 2).sum()), i))[: room[k]]
        out |= {held[i][0]: k for i in near}
        free -= set(near)
    return out


def graded_range(centroids: DataFrame, key: Column) -> DataFrame:
    """(cid, grade): rank of each centroid by key over the number of centroids less one, 0 to 1."""
    n = Window.orderBy(key, "id")
    total = F.count("*").over(Window.partitionBy(F.lit(1)))
    return centroids.select(F.col("id").alias("cid"), ((F.row_number().over(n) - 1) / F.greatest(F.lit(1), total - 1)).alias("grade"))


def cluster_columns(base: DataFrame, *, c: int = 64, labels: int = 10, gamma: float = 0.9, seed: int = 0, compact: bool = False, iters: int = 6) -> DataFrame:
    """id, cf_anti, cf_anti2, cf_quad, cf_cat, cf_range, cf_arange and the texts cf_text, cf_text_s, all tied to clusters."""
    i = F.col("id")
    spark = base.sparkSession

    def clusters(k: int) -> tuple[DataFrame, DataFrame]:
        cents, own = kmeans(base, c, seed=seed * 2 + k, iters=iters)
        return cents, own.withColumnRenamed("cid", f"k{k}")

    (c1, a1), (_, a7), (_, a2), (c3, a3), (c4, a4) = (clusters(k) for k in (1, 7, 2, 3, 4))
    known = lambda cents: cents.select(F.col("id").alias("cid"))
    map1 = spark.createDataFrame(list(compact_label_map(c1, labels).items()), "cid bigint, label int") if compact else zipf_label_map(known(c1), c, labels, seed * 2 + 11)
    out = base.select("id").join(a1, "id").join(a7, "id").join(a2, "id").join(a3, "id").join(a4, "id")
    add = lambda df, m, key, value, name: df.join(F.broadcast(m.select(F.col("cid").alias(key), F.col(value).cast("double").alias(name))), key, "left")
    out = out.withColumn("cf_quad", F.col("k1").cast("double"))
    out = add(out, map1, "k1", "label", "cf_anti")
    out = add(out, zipf_label_map(known(c1), c, 64, seed * 2 + 7778), "k7", "label", "cf_anti2")
    out = add(out, zipf_label_map(known(c1), c, labels, seed * 2 + 22), "k2", "label", "own_label")
    direction = F.transform("v", lambda x, k: x * gaussian(k.cast("long"), seed * 2 + 44))
    out = add(out, graded_range(c3, F.aggregate(direction, F.lit(0.0), lambda s, x: s + x)), "k3", "grade", "g3")
    anchor = c4.filter("id = 0").select(F.col("v").alias("av"))
    out = add(out, graded_range(c4.crossJoin(F.broadcast(anchor)), l2_sqr(F.col("v"), F.col("av"))), "k4", "grade", "cf_arange")
    out = out.withColumn("cf_cat", F.when(uniform(i, seed, "pick") < gamma, F.col("own_label")).otherwise(F.floor(uniform(i, seed, "free") * labels).cast("double")))
    out = out.withColumn("cf_range", gamma * F.col("g3") + (1 - gamma) * uniform(i, seed, "noise"))
    out = out.withColumn("cf_text", planted_text(i, F.col("cf_anti"), 40, seed, F.col("cf_anti2"), F.col("cf_quad"))).withColumn("cf_text_s", planted_text(i, F.col("cf_anti"), 12, seed + 1))
    return out.select("id", "cf_anti", "cf_anti2", "cf_quad", "cf_cat", "cf_range", "cf_arange", "cf_text", "cf_text_s")


def planted_text(node_id: Column, label: Column, words: int, seed: int, second: Column | None = None, cluster: Column | None = None) -> Column:
    """A text of words drawn by hash, with kwNNN for the label and, if given, qwNNN for the second and qdNNN for the cluster's four words."""
    tag = lambda name, value: F.concat(F.lit(name), F.lpad(value.cast("int").cast("string"), 3, "0"))
    filler = F.transform(F.sequence(F.lit(1), F.lit(words)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64(node_id, k, F.lit(seed)), F.lit(5000)).cast("string")))
    planted = [F.array(tag("kw", label))]
    if second is not None:
        planted.append(F.array(tag("qw", second)))
    if cluster is not None:
        planted.append(F.transform(quad_words(cluster), lambda w: tag("qd", w)))
    return F.array_join(F.concat(*planted, filler), " ")
