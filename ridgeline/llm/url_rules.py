"""URL filters: host suffixes and path prefixes of each URL against rules, joined by short hash prefixes.

Each URL is expanded into (host suffix, path prefix) expressions, for the path lengths that rules have. Expressions and
rules meet on the first 32 bits of their SHA-256 digest; equal whole digests confirm; the longest rule decides.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import settle

#: Bytes of rules up to which they are broadcast; beyond it both sides are shuffled by the hash prefix.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) with verdict allow or block."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.translate(host, UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: id, host, path, rule ("host" + "path" of the deciding rule, else null), verdict.

    A rule fits its host and all subdomains of it if the path starts with the rule's path. The longest host and path
    together wins; between rules of equal length the one with the longer host, then block before allow. Where none fits
    the verdict is default. Null URLs and those without :// have an empty host and path. Empty rule hosts fit nothing.
    Rows are kept as often as they occur, null ids too; columns other than the two named are left out.
    """
    keyed = rules.filter("host is not null and path is not null and host <> ''").select(
        F.concat(F.translate("host", UPPER, LOWER), F.lit("\x00"), F.col("path")).alias("expression"), F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict"
    )
    keyed = keyed.groupBy("expression", "r_host", "r_path").agg(F.max("verdict").alias("verdict"))  # block is the greater word
    keyed = keyed.select(F.sha2("expression", 256).alias("digest"), F.struct(F.length(F.concat("r_host", "r_path")).alias("size"), F.length("r_host").alias("host_size"), F.concat("r_host", "r_path").alias("rule"), "verdict").alias("found"))
    keyed = keyed.select(F.left("digest", F.lit(8)).alias("short"), "digest", "found")
    facts = rules.agg(F.sort_array(F.collect_set(F.length("path"))).alias("sizes"), F.sum(F.length("host") + F.length("path") + 100).alias("bytes")).first()
    sizes, small = [int(x) for x in facts["sizes"]], (facts["bytes"] or 0) <= BROADCAST_RULES

    host, path = F.col("__host"), F.col("__path")
    parts = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    lengths = F.filter(F.array(*[F.lit(x) for x in sizes]).cast("array<int>"), lambda n: n <= F.length(path))
    each = F.flatten(F.transform(F.filter(suffixes, lambda h: h != ""), lambda h: F.transform(lengths, lambda n: F.concat(h, F.lit("\x00"), F.substring(path, 1, n)))))
    rows = pages.select(F.col(id_col).alias("__id"), host_of(F.col(url_col)).alias("__host"), path_of(F.col(url_col)).alias("__path"))
    # Pages with the same host and the same leading parts of the path share their expressions: judge each kind once.
    longest = max(sizes, default=0)
    kinds = rows.select("__host", F.left("__path", F.lit(longest)).alias("__path")).distinct()
    asked = kinds.select("__host", "__path", F.explode(each).alias("expression")).withColumn("digest", F.sha2("expression", 256)).select("__host", "__path", "digest", F.left("digest", F.lit(8)).alias("short"))
    hits = asked.join(F.broadcast(keyed) if small else keyed.hint("merge"), "short").filter(asked["digest"] == keyed["digest"])
    best = hits.groupBy("__host", "__path").agg(F.max("found").alias("found")).select(F.col("__host").alias("b_host"), F.col("__path").alias("b_path"), "found")
    best = settle(best)  # so that the join below has a plain exchange on both sides, which can be split where a host is hot
    out = rows.join(best, (rows["__host"] == F.col("b_host")) & (F.left(rows["__path"], F.lit(longest)) == F.col("b_path")), "left")
    return out.select(F.col("__id").alias(id_col), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("found")["rule"].alias("rule"), F.coalesce(F.col("found")["verdict"], F.lit(default)).alias("verdict"))
