"""Results and indexes kept as Parquet under a key of all that they depend on."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import fingerprint
from ..functions.predicates import DNF
from ..operators.cost import Costs
from ..operators.knn import rank_fractions
from ..operators.synth import kmeans


def key(*parts: object) -> str:
    """A digest of the parts; a part of a new version or input makes a new key."""
    return hashlib.sha256("\x1f".join(map(repr, parts)).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, name: str, parts: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The table under folder for these parts; made and written first if it isn't there whole (with its _SUCCESS file)."""
    path = f"{folder.rstrip('/')}/{name}-{key(*parts)}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_costs(spark: SparkSession, folder: str, region_map: DataFrame, make: Callable[[], Costs]) -> Costs:
    """Calibrated costs, kept under a fingerprint of the regions that they were measured over."""
    parts = ("costs", *sorted(f.name for f in fields(Costs)), fingerprint(region_map, "id", "region"))
    row = cached(spark, folder, "costs", parts, lambda: spark.createDataFrame([(json.dumps(asdict(make())),)], "value string")).first()
    return Costs(**json.loads(row["value"]))


def cached_topk(spark: SparkSession, folder: str, base: DataFrame, queries: DataFrame, k: int, predicate: DNF, make: Callable[[], DataFrame]) -> DataFrame:
    """A ground truth (qid, rank, id, dist) kept under what it depends on. A hit must be of this k and these queries."""
    n = queries.count()
    out = cached(spark, folder, "topk", (k, n, predicate.canonical(), fingerprint(base, "id", "v"), fingerprint(queries, "qid", "qvec")), make)
    most, known = out.agg(F.coalesce(F.max("rank"), F.lit(0))).first()[0], out.join(queries, "qid", "left_anti").isEmpty()
    if most > k or not known:
        raise ValueError("a kept ground truth is of other queries or another k")
    return out


def cached_ranks(spark: SparkSession, folder: str, base: DataFrame, queries: DataFrame, label: str, k: int, n_quant: int) -> DataFrame:
    """rank_fractions(), kept under what it depends on."""
    parts = (label, k, n_quant, fingerprint(base, "id", "v", label), fingerprint(queries, "qid", "qvec"))
    return cached(spark, folder, "ranks", parts, lambda: rank_fractions(base, queries, label, k, n_quant))


def judging_partition(spark: SparkSession, folder: str, base: DataFrame, c: int, seed: int = 0) -> DataFrame:
    """(id, cid): the k-means partition that methods are judged by, fitted on 20,000 rows in six rounds, kept under the number
    of rows, the dimension, c, the seed and the values of every row."""
    n, dim = base.agg(F.count("*"), F.max(F.size("v"))).first()
    return cached(spark, folder, "partition", (n, dim, c, seed, fingerprint(base, "id", "v")), lambda: kmeans(base, c, seed=seed)[1])


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes an index: nodes, edges, regions, histograms and what else belongs to it."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in names}
