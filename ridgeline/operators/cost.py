"""Cost model of a search over regions: selectivities of a DNF, costs of scanning and of best-first search, and routes.

All constants are arguments: measured ones would make results depend on the machine.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import DNF, Atom
from .stats import Stats, atom_possible, dnf_empty, sigma_hats

FLOOD, BEST_FIRST = "flood", "best_first"
TINY = 1e-12
#: Selectivity bands of calibrated means (fixed values).
SIGMA_EDGES = (0.01, 0.05, 0.10, 0.30)


@dataclass(frozen=True)
class Costs:
    """Seconds for a predicate, a distance, an edge and a scanned row; links of a node; multipliers."""

    c_pred: float = 20e-9
    c_dist: float = 50e-9
    c_edge: float = 101e-9
    scan: float = 2e-9
    degree: int = 21
    lambda_pred: float = 1.0
    lambda_tradeoff: float = 1.0
    membership: bool = True
    all_phase: bool = True
    sel0_verify: bool = True
    skip_empty: bool = True


def theta(mean_visited: float, n: Column, costs: Costs, *, override: float | None = None, r3: bool = False, ratio: float | None = None) -> Column:
    """The selectivity below which a region of n rows is better scanned, from 0 to 1; 0 for an empty region."""
    if override is not None:
        return F.lit(float(override))
    r = costs.c_pred / costs.c_dist if ratio is None else ratio
    m = F.lit(float(mean_visited)) / n
    raw = m + (m - 1) * r if r3 else m - r
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def decide(sigma: Column, theta_n: Column) -> Column:
    return F.when(sigma < theta_n, F.lit(FLOOD)).otherwise(F.lit(BEST_FIRST))


def sigma_band(sigma: Column) -> Column:
    return reduce(lambda x, y: x + y, [F.when(sigma >= e, 1).otherwise(0) for e in SIGMA_EDGES])


def dnf_terms(predicate: DNF, column: str = "s") -> tuple[Column, Column]:
    """Selectivity under independence and expected evaluations with short circuits, over columns s0, s1, .. in order.

    A clause passes with the product of its atoms; it is reached if no earlier one passed; within it an atom is reached
    if all before it passed."""
    miss, evals, k = F.lit(1.0), F.lit(0.0), 0
    for clause in predicate.clauses:
        reach, own = F.lit(1.0), F.lit(0.0)
        for _ in clause:
            own = own + reach
            reach = reach * F.col(f"{column}{k}")
            k += 1
        evals = evals + miss * own
        miss = miss * (1 - reach)
    return 1 - miss, evals


def region_costs(stats: Stats, predicate: DNF, k: int, costs: Costs | None = None, *, found: int = 0, worst: float | None = None, entry: Column | None = None) -> DataFrame:
    """(region, n, sel, evals, empty, flood, best_first).

    sel is 0 where presence proves a region empty and at least TINY elsewhere if presence is known. flood: all rows are
    tested and the matches measured. best_first: as many rows as k matches need, each tested, measured and expanded.
    With k found already the share of rows nearer than the worst result counts, by the entry's distance."""
    costs = costs or Costs()
    atoms = [a for clause in predicate.clauses for a in clause]
    raw, evals = dnf_terms(predicate)
    rows = sigma_hats(stats, atoms).join(dnf_empty(stats, predicate), "region")
    sel = F.when(F.col("empty"), 0.0).when(raw <= 0, TINY if stats.presence is not None else 0.0).otherwise(raw)
    rows = rows.select("region", "n", sel.alias("sel"), evals.alias("evals"), "empty")
    n, s, e = F.col("n").cast("double"), F.col("sel"), F.col("evals")
    walk = F.lit(costs.scan if costs.membership else costs.degree * costs.c_edge) * n if costs.sel0_verify or costs.all_phase else F.lit(0.0)
    flood = F.when((s <= 0) & F.lit(costs.skip_empty), F.lit(0.0)).otherwise(n * costs.c_pred * e + s * n * costs.c_dist) + walk
    if found < k:
        steps = F.when(s > 0, F.least(n, F.lit(float(k - found)) / s)).otherwise(n)
    elif entry is None or worst is None:
        steps = n
    else:
        steps = F.when(entry >= worst, F.when(s <= 0, F.lit(1.0)).otherwise(n * F.least(F.lit(1.0), F.lit(worst) / entry))).otherwise(n * F.least(F.lit(1.0), F.lit(worst) / entry))
    edge = costs.degree * costs.c_edge if costs.sel0_verify or costs.all_phase else 0.0
    best = F.lit(costs.lambda_tradeoff) * steps * (costs.lambda_pred * costs.c_pred * e + edge + costs.c_dist)
    none = (s <= 0) & F.lit((not costs.sel0_verify) or found < k)
    return rows.select("*", flood.alias("flood"), F.when(none, F.lit(float("inf"))).otherwise(best).alias("best_first"))


def routes(region_costs: DataFrame, costs: Costs | None = None, *, force: str | None = None) -> DataFrame:
    """region_costs with route. The multiplier's extremes force one; else best-first must be strictly cheaper.

    force: flood, best_first or random (by a hash of the region)."""
    costs = costs or Costs()
    if force == "random":
        route = F.when(F.pmod(F.xxhash64("region"), F.lit(2)) == 0, FLOOD).otherwise(BEST_FIRST)
    elif force:
        route = F.lit(force)
    elif costs.lambda_tradeoff <= 0.01:
        route = F.lit(BEST_FIRST)
    elif costs.lambda_tradeoff >= 100:
        route = F.lit(FLOOD)
    else:
        route = F.when(F.col("best_first") < F.col("flood"), BEST_FIRST).otherwise(FLOOD)
    return region_costs.withColumn("route", route)


def frontier_scores(routed: DataFrame) -> DataFrame:
    """(route, matches, cost, score): expected matches for the cost of each frontier; no cost: infinite."""
    cost = F.when(F.col("route") == FLOOD, F.col("flood")).otherwise(F.col("best_first"))
    sums = routed.groupBy("route").agg(F.sum(F.col("sel") * F.col("n")).alias("matches"), F.sum(cost).alias("cost"))
    return sums.select("route", "matches", "cost", F.when(F.col("cost") <= 0, F.lit(float("inf"))).otherwise(F.col("matches") / F.col("cost")).alias("score"))


def frontier_decision(routed: DataFrame) -> DataFrame:
    """(route): the frontier of more expected matches for its cost, ties to the flood; a frontier without regions scores 0."""
    score = lambda route: F.coalesce(F.max(F.when(F.col("route") == route, F.col("score"))), F.lit(0.0))
    return frontier_scores(routed).agg(F.when(score(BEST_FIRST) > score(FLOOD), F.lit(BEST_FIRST)).otherwise(F.lit(FLOOD)).alias("route"))


def covered_concentration(stats: Stats, atom: Atom) -> DataFrame:
    """(matches, regions, rho) as concentration(), with each region's matches counted as the rows of all buckets that the atom
    touches, without interpolation: from flat statistics, no row is read."""
    possible = atom_possible(stats, atom)
    counts = stats.hist.groupBy(F.col("node").alias("region")).agg(F.sum(F.when(F.lit(True) if possible is None else possible, F.col("cnt")).otherwise(0)).alias("c"))
    return _herfindahl(stats.sizes.select(F.col("node").alias("region")).join(counts, "region", "left").na.fill(0))


def concentration(region_map: DataFrame, base: DataFrame, condition: Column) -> DataFrame:
    """(matches, regions, rho): normalised Herfindahl index of the matches over all regions; 0 for one region or no match."""
    rows = region_map.select("id", "region").join(base.select("id", condition.cast("int").alias("ok")), "id")
    return _herfindahl(rows.groupBy("region").agg(F.sum("ok").alias("c")))


def _herfindahl(per: DataFrame) -> DataFrame:
    total = per.agg(F.sum("c").alias("matches"), F.count("*").alias("regions"), F.sum(F.col("c").cast("double") * F.col("c")).alias("squares"))
    h, r = F.col("squares") / (F.col("matches").cast("double") * F.col("matches")), F.col("regions").cast("double")
    return total.select("matches", "regions", F.when((F.col("regions") <= 1) | (F.col("matches") == 0), F.lit(0.0)).otherwise((h - 1 / r) / (1 - 1 / r)).alias("rho"))


def calibrate(base: DataFrame, condition: Column, query: list[float], costs: Costs | None = None) -> Costs:
    """Costs with the seconds that a predicate and a distance take for a row here, from two timed scans.

    The figures depend on machine and load; results of routing do too, if they are used."""
    import time
    from dataclasses import replace

    from ..functions.vectors import l2_sqr

    rows = max(1, base.count())

    def seconds(df: DataFrame) -> float:
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    plain = seconds(base.select(F.xxhash64("id")))
    pred = seconds(base.select(condition))
    dist = seconds(base.select(l2_sqr(F.col("v"), F.array(*[F.lit(float(x)) for x in query]))))
    return replace(costs or Costs(), c_pred=max(1e-10, (pred - plain) / rows), c_dist=max(1e-10, (dist - plain) / rows))


def means_by_band(samples: DataFrame) -> DataFrame:
    """(band, mean_visited, n) of samples(sigma, visited, regions): rows visited for each region touched, by selectivity band."""
    per = samples.groupBy(sigma_band(F.col("sigma")).alias("band")).agg(F.sum("visited").alias("v"), F.sum("regions").alias("r"), F.count("*").alias("n"))
    return per.select("band", F.when(F.col("r") > 0, F.col("v") / F.col("r")).otherwise(0.0).alias("mean_visited"), "n")
