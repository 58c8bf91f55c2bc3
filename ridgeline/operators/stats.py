"""Statistics of regions: equi-depth buckets, histograms, the multi-layer forest of them, selectivities and presence.

Everything is a table: hist(col, node, bucket, cnt), sizes(node, n), hist_node(col, region, node), presence(col, region,
bucket). A categorical column's bucket is its code. Nodes and regions are named by candidates' ids.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import DNF, Atom
from ..session import settle
from .quantiles import order_statistics

BUCKETS = 32


def equi_depth_edges(df: DataFrame, column: str, buckets: int = BUCKETS) -> list[float]:
    """buckets + 1 edges: the values at ranks i * n / buckets (whole division), then the largest plus one. None for no rows.

    Nulls and NaN are no values."""
    df = df.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    n, most = df.agg(F.count("*"), F.max(column)).first()
    if not n:
        return []
    at = order_statistics(df, column, [i * n // buckets for i in range(buckets)])
    return [float(at[i * n // buckets]) for i in range(buckets)] + [float(most) + 1.0]


def bucket_number(edges: Sequence[float], x: float) -> int:
    return max(0, min(len(edges) - 2, bisect_right(edges, x) - 1))


def bucket_of(edges: Sequence[float], x: Column) -> Column:
    """Last edge not above x, so that equal edges give the last one; clamped to the ends. Null and NaN have none."""
    held = F.array(*[F.lit(float(e)) for e in edges])
    return F.when(x.isNotNull() & ~F.isnan(x.cast("double")), F.greatest(F.lit(0), F.least(F.lit(len(edges) - 2), F.size(F.filter(held, lambda e: e <= x)) - 1)))


@dataclass(frozen=True)
class Schema:
    """edges: of numeric columns; categorical: names of columns of codes."""

    edges: dict[str, list[float]]
    categorical: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        return [*self.edges, *self.categorical]

    @property
    def buckets(self) -> int:
        return max((len(e) - 1 for e in self.edges.values()), default=0)


def schema_of(base: DataFrame, numeric: Iterable[str], categorical: Iterable[str], buckets: int = BUCKETS) -> Schema:
    return Schema({c: equi_depth_edges(base, c, buckets) for c in numeric}, tuple(categorical))


def attributes(base: DataFrame, schema: Schema) -> DataFrame:
    """(id, col, bucket double), one row for each value; nulls, and NaN in numeric columns, are no values."""
    each = [F.struct(F.lit(c).alias("col"), bucket_of(e, F.col(c)).cast("double").alias("bucket")) for c, e in schema.edges.items() if e]
    each += [F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("bucket")) for c in schema.categorical]
    return base.select("id", F.inline(F.filter(F.array(*each), lambda x: x["bucket"].isNotNull())))


def flat_histogram(region_map: DataFrame, attrs: DataFrame) -> DataFrame:
    """(col, region, bucket, cnt)."""
    return attrs.join(region_map.select("id", "region"), "id").groupBy("col", "region", "bucket").agg(F.count("*").alias("cnt"))


# --- the multi-layer forest ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """candidates(c, level, parent, tree), fca(id, c): each point's first candidate; closure(c, anc, depth), itself at 0."""

    candidates: DataFrame
    fca: DataFrame
    closure: DataFrame
    lmin: int
    lmax: int


def top_layer(nodes: DataFrame, lmin: int) -> int:
    """The highest level that at least two nodes reach, lmin at least."""
    counts = {r["level"]: r["n"] for r in nodes.groupBy("level").agg(F.count("*").alias("n")).collect()}
    at = [level for level in range(lmin, max(counts, default=0) + 1) if sum(n for k, n in counts.items() if k >= level) >= 2]
    return max(at, default=lmin)


def forest(nodes: DataFrame, lmin: int = 1, lmax: int = -1) -> Forest:
    """Candidates are nodes of at least lmin. A candidate's parent is its father, unless it has level lmax or is a root."""
    lmax = max(lmin, top_layer(nodes, lmin) if lmax < 0 else lmax)
    hop = nodes.select(F.col("id").alias("at"), F.col("level").alias("at_level"), F.col("father").alias("at_father"))
    now = nodes.select("id", F.col("id").alias("at"))
    for _ in range(lmin):
        now = now.join(hop, "at").select("id", F.when((F.col("at_level") >= lmin) | (F.col("at_father") == F.col("at")), F.col("at")).otherwise(F.col("at_father")).alias("at"))
    fca = settle(now.join(hop, "at").filter(F.col("at_level") >= lmin).select("id", F.col("at").alias("c")))
    cands = nodes.filter(F.col("level") >= lmin).select(F.col("id").alias("c"), "level", F.when((F.col("level") < lmax) & (F.col("father") != F.col("id")), F.col("father")).alias("parent"))
    step = cands.select(F.col("c").alias("anc"), F.col("parent").alias("up"))
    front = cands.select("c", F.col("c").alias("anc"), F.lit(0).alias("depth"))
    layers = [front]
    for k in range(1, lmax - lmin + 1):
        front = front.join(step, "anc").filter("up is not null").select("c", F.col("up").alias("anc"), F.lit(k).alias("depth"))
        layers.append(front)
    closure = settle(reduce(DataFrame.union, layers))
    trees = closure.groupBy("c").agg(F.max_by("anc", "depth").alias("tree"))
    return Forest(settle(cands.join(trees, "c")), fca, closure, lmin, lmax)


def rollup(f: Forest, attrs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """hist(col, node, bucket, cnt) and sizes(node, n) of every candidate, over all points below it.

    Points are counted at their first candidate before the counts climb, so only counts are repeated along ancestors."""
    own = attrs.join(f.fca, "id").groupBy("col", "c", "bucket").agg(F.count("*").alias("k"))
    hist = own.join(f.closure, "c").groupBy("col", F.col("anc").alias("node"), "bucket").agg(F.sum("k").alias("cnt"))
    sizes = f.fca.groupBy("c").agg(F.count("*").alias("k")).join(f.closure, "c").groupBy(F.col("anc").alias("node")).agg(F.sum("k").alias("n"))
    return hist, sizes


def numeric_errors(f: Forest, hist: DataFrame, sizes: DataFrame, column: str, buckets: int, slack: float) -> DataFrame:
    """(c, err): largest gap between the distribution functions of a candidate and its parent, less the sampling slack."""
    h = hist.filter(F.col("col") == column)
    own = f.candidates.filter("parent is not null").select("c", "parent")
    n = sizes.select("node", F.col("n").cast("double").alias("n"))
    pairs = own.join(n.select(F.col("node").alias("c"), F.col("n").alias("nc")), "c", "left").join(n.select(F.col("node").alias("parent"), F.col("n").alias("np")), "parent", "left").na.fill(1.0)
    grid = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)).cast("array<double>")).alias("bucket"))
    grid = grid.join(h.select(F.col("node").alias("c"), "bucket", F.col("cnt").alias("rc")), ["c", "bucket"], "left").join(h.select(F.col("node").alias("parent"), "bucket", F.col("cnt").alias("rp")), ["parent", "bucket"], "left").na.fill(0, ["rc", "rp"])
    w = Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = F.abs(F.sum("rc").over(w) / F.col("nc") - F.sum("rp").over(w) / F.col("np")) - F.lit(slack) * F.sqrt(1 / F.col("nc") + 1 / F.col("np"))
    return grid.select("c", gap.alias("gap")).groupBy("c").agg(F.greatest(F.lit(0.0), F.max("gap")).alias("err"))


def categorical_errors(f: Forest, hist: DataFrame, sizes: DataFrame, column: str, slack: float) -> DataFrame:
    """(c, err): largest relative gap between a candidate's and its parent's share of a code that the candidate has."""
    h = hist.filter(F.col("col") == column)
    own = f.candidates.filter("parent is not null").select("c", "parent")
    n = sizes.select("node", F.col("n").cast("double").alias("n"))
    rows = own.join(h.select(F.col("node").alias("c"), "bucket", F.col("cnt").alias("rc")), "c").join(h.select(F.col("node").alias("parent"), "bucket", F.col("cnt").alias("rp")), ["parent", "bucket"], "left").na.fill(0, ["rp"])
    rows = rows.join(n.select(F.col("node").alias("c"), F.col("n").alias("nc")), "c").join(n.select(F.col("node").alias("parent"), F.col("n").alias("np")), "parent")
    fc, fp = F.col("rc") / F.col("nc"), F.col("rp") / F.col("np")
    noise = F.lit(slack) * F.sqrt(F.greatest(fc * (1 - fc), F.lit(1e-12)) * (1 / F.col("nc") + 1 / F.col("np")))
    return rows.select("c", (F.greatest(F.lit(0.0), F.abs(fp - fc) - noise) / fc).alias("gap")).groupBy("c").agg(F.max("gap").alias("err"))


def errors(f: Forest, hist: DataFrame, sizes: DataFrame, schema: Schema, slack: float) -> DataFrame:
    """(col, c, err) of all columns."""
    parts = [numeric_errors(f, hist, sizes, c, len(e) - 1, slack).select(F.lit(c).alias("col"), "c", "err") for c, e in schema.edges.items()]
    parts += [categorical_errors(f, hist, sizes, c, slack).select(F.lit(c).alias("col"), "c", "err") for c in schema.categorical]
    return reduce(DataFrame.union, parts)


def tree_budgets(f: Forest, budget: int) -> DataFrame:
    """(tree, n, bytes): the budget dealt by the points below each tree, whole bytes; the rest goes to the largest tree
    (of equal ones that of the smallest id). A budget of 0 is none: bytes are null."""
    n = f.fca.join(f.candidates.select("c", "tree"), "c").groupBy("tree").agg(F.count("*").alias("n"))
    n = settle(f.candidates.select("tree").distinct().join(n, "tree", "left").na.fill(0))
    if not budget:
        return n.withColumn("bytes", F.lit(None).cast("long"))
    whole = f.fca.count()
    share = F.floor(F.lit(float(budget)) * F.col("n") / F.lit(float(max(1, whole)))).cast("long")
    left, first = n.agg(F.lit(budget) - F.sum(share), F.max(F.struct("n", (-F.col("tree")).alias("t")))).first()
    return n.select("tree", "n", (share + F.when(F.col("tree") == -first["t"], F.lit(max(0, left))).otherwise(0)).alias("bytes"))


def keep(f: Forest, errs: DataFrame, schema: Schema, widths: dict[str, int], *, delta_range: float = 0.05, eps_point: float = 0.10, budget: int = 0) -> DataFrame:
    """(col, c): histograms kept: the roots' and those whose error is above their threshold, as the tree's budget allows:
    in order of falling error (then column, then id) each is kept that still fits."""
    cols = F.array(*[F.lit(c) for c in schema.columns])
    roots = f.candidates.filter("parent is null").select(F.explode(cols).alias("col"), "c")
    limit = F.when(F.col("col").isin(list(schema.edges)), F.lit(delta_range)).otherwise(F.lit(eps_point))
    able = errs.filter(F.col("err") > limit)
    if not budget:
        return roots.union(able.select("col", "c"))
    row_bytes = F.element_at(F.create_map(*[F.lit(x) for c in schema.columns for x in (c, 4 * widths[c])]), F.col("col"))
    base = sum(4 * widths[c] for c in schema.columns)
    rows = able.join(f.candidates.select("c", "tree"), "c").join(tree_budgets(f, budget).select("tree", "bytes"), "tree").select("tree", "bytes", "col", "c", "err", row_bytes.alias("size"))

    # What a column's next histogram doesn't fit, none after it does: of each column only as many matter as the budget holds.
    place = F.row_number().over(Window.partitionBy("tree", "col").orderBy(F.desc("err"), "c"))
    rows = rows.withColumn("place", place).filter(F.col("place") * F.col("size") <= F.col("bytes")).drop("place")

    def greedy(pdf):
        pdf = pdf.sort_values(["err", "col", "c"], ascending=[False, True, True])
        used, most, take = base, int(pdf["bytes"].iloc[0]), []
        for size in pdf["size"]:
            fits = used + size <= most
            used += size if fits else 0
            take.append(fits)
        return pdf.loc[take, ["col", "c"]]

    return roots.union(rows.groupBy("tree").applyInPandas(greedy, "col string, c bigint"))


@dataclass(frozen=True)
class Stats:
    """What planning needs. region_map(id, region) names each point's finest region; sizes count all points below a node;
    degraded: categorical columns that have met codes which the histograms don't know, though presence does."""

    schema: Schema
    region_map: DataFrame
    sizes: DataFrame
    hist: DataFrame
    hist_node: DataFrame
    presence: DataFrame | None
    degraded: frozenset[str] = frozenset()


def flat_stats(region_map: DataFrame, base: DataFrame, schema: Schema) -> Stats:
    """One histogram for each region; presence isn't kept in this mode."""
    hist = settle(flat_histogram(region_map, attributes(base, schema)).withColumnRenamed("region", "node"))
    sizes = settle(region_map.groupBy(F.col("region").alias("node")).agg(F.count("*").alias("n")))
    cols = F.array(*[F.lit(c) for c in schema.columns])
    return Stats(schema, region_map.select("id", "region"), sizes, hist, sizes.select(F.explode(cols).alias("col"), F.col("node").alias("region"), "node"), None)


def forest_stats(f: Forest, base: DataFrame, schema: Schema, *, slack: float = 1.0, delta_range: float = 0.05, eps_point: float = 0.10, budget: int = 0) -> Stats:
    attrs = settle(attributes(base, schema))
    hist, sizes = (settle(x) for x in rollup(f, attrs))
    widths = {c: len(e) - 1 for c, e in schema.edges.items()} | {c: 0 for c in schema.categorical}
    if budget:
        widths |= {r["col"]: r["n"] for r in hist.filter(F.col("col").isin(list(schema.categorical))).groupBy("col").agg(F.count_distinct("bucket").alias("n")).collect()}
    kept = settle(keep(f, errors(f, hist, sizes, schema, slack), schema, widths, delta_range=delta_range, eps_point=eps_point, budget=budget))
    return bound(f, kept, hist, sizes, base.select("id"), attrs, schema)


def bound(f: Forest, kept: DataFrame, hist: DataFrame, sizes: DataFrame, points: DataFrame, attrs: DataFrame, schema: Schema) -> Stats:
    """Regions are the candidates kept for any column; each of points(id) belongs to its finest one (without any: the first region)."""
    regions = kept.select("c").distinct()
    up = f.closure.join(regions.select(F.col("c").alias("anc")), "anc")
    finest = up.groupBy("c").agg(F.min_by("anc", "depth").alias("region"))
    first = regions.agg(F.min("c")).first()[0]
    points = points.join(f.fca, "id", "left").join(finest, "c", "left")
    region_map = settle(points.select("id", F.coalesce("region", F.lit(first)).alias("region")))
    holders = f.closure.join(kept.select("col", F.col("c").alias("anc")), "anc").join(regions, "c").groupBy("col", "c").agg(F.min_by("anc", "depth").alias("node"))
    held = hist.join(kept.select("col", F.col("c").alias("node")), ["col", "node"])
    sizes = sizes.join(regions.select(F.col("c").alias("node")), "node").select("node", "n")
    return Stats(schema, region_map, sizes, held.select("col", "node", "bucket", "cnt"), holders.select("col", F.col("c").alias("region"), "node"), presence(region_map, attrs))


def presence(region_map: DataFrame, attrs: DataFrame) -> DataFrame:
    """(col, region, bucket) that occur: by finest region, so that regions part the rows."""
    return attrs.join(region_map.select("id", "region"), "id").select("col", "region", "bucket").distinct()


def presence_bitmaps(presence: DataFrame) -> DataFrame:
    """(col, region, bitmap) for buckets that are small whole numbers."""
    bit = F.col("bucket").cast("long")
    return presence.groupBy("col", "region").agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit + 1)).alias("bitmap"))


def cover(edges: Sequence[float], x: float) -> list[float]:
    """Share of each bucket that lies below x, by linear interpolation; a bucket of no width counts once x reaches it."""
    out = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        out.append((1.0 if x >= hi else 0.0) if hi <= lo else min(1.0, max(0.0, (x - lo) / (hi - lo))))
    return out


def _weights(stats: Stats, atom: Atom) -> list[float] | None:
    """Weights of buckets in sigma = sum(cnt * weight) / n; None: the atom's code is the only one that counts."""
    column, cat = atom.proxy or atom.column, stats.schema.categorical
    if atom.form in ("eq", "contains"):
        return None
    if column in cat or column not in stats.schema.edges:
        return []
    e = stats.schema.edges[column]
    if atom.form == "lt":
        return cover(e, atom.a)
    if atom.form == "gt":
        return [1.0 - c for c in cover(e, atom.a)]  # nulls are in no bucket and satisfy nothing
    return [b - a for a, b in zip(cover(e, atom.a), cover(e, atom.b), strict=True)]


def sigma_hats(stats: Stats, atoms: Sequence[Atom]) -> DataFrame:
    """(region, n, s0, s1, ..): each atom's estimated selectivity in each region, from the histogram and size of the node
    that supplies it. Equality on a numeric column and ranges on a categorical one estimate 0, as lookups fail there. In a
    degraded column no code is estimated below one row, as its histograms may not count it."""
    sizes = stats.sizes.withColumnRenamed("n", "held")
    rows = stats.hist_node.join(sizes, "node", "left").join(stats.hist, ["col", "node"], "left")
    sums = []
    for k, atom in enumerate(atoms):
        weights = _weights(stats, atom)
        column = atom.proxy or atom.column
        if weights is None:
            code = atom.code if atom.form == "contains" else atom.a
            w = F.when(F.col("bucket") == F.lit(float(code)), 1.0).otherwise(0.0) if column in stats.schema.categorical else F.lit(0.0)
        elif not weights:
            w = F.lit(0.0)
        else:
            w = F.coalesce(F.get(F.array(*[F.lit(x) for x in weights]), F.col("bucket").cast("int")), F.lit(0.0))
        part = F.sum(F.when((F.col("col") == column) & (F.col("held") > 0), F.col("cnt") * w / F.col("held")).otherwise(0.0))
        value = F.greatest(F.lit(0.0), part)
        sums.append(value.alias(f"s{k}"))
    found = rows.groupBy("region").agg(*sums)
    least = {k for k, a in enumerate(atoms) if a.form in ("eq", "contains") and (a.proxy or a.column) in stats.degraded}
    s = [F.greatest(f"s{k}", F.coalesce(F.try_divide(F.lit(1.0), F.col("n")), F.lit(0.0))).alias(f"s{k}") if k in least else F.col(f"s{k}") for k in range(len(atoms))]
    return found.join(stats.sizes.select(F.col("node").alias("region"), "n"), "region").select("region", "n", *s)


def cdf(stats: Stats, column: str, x: float) -> DataFrame:
    """(region, cdf)."""
    return sigma_hats(stats, [Atom("lt", column, float(x))]).select("region", F.col("s0").alias("cdf"))


def atom_possible(stats: Stats, atom: Atom) -> Column | None:
    """Condition on presence rows (col, bucket) of buckets that could hold a row of the atom; None: nothing can be proven."""
    if atom.form in ("contains", "function"):
        return None
    col, b = F.col("col") == atom.column, F.col("bucket")
    if atom.column in stats.schema.categorical:
        return col & (b == F.lit(atom.a)) if atom.form == "eq" else None
    if atom.column not in stats.schema.edges:
        return None
    at = lambda x: F.lit(float(bucket_number(stats.schema.edges[atom.column], x)))
    match atom.form:
        case "lt":
            return col & (b <= at(atom.a))
        case "gt":
            return col & (b >= at(atom.a))
        case "interval":
            return col & (b >= at(atom.a)) & (b <= at(atom.b))
    return col & (b == at(atom.a))


def empty_atoms(stats: Stats, atoms: Sequence[Atom]) -> DataFrame:
    """(region, e0, e1, ..): whether no row of the region can satisfy the atom."""
    if stats.presence is None:
        return stats.sizes.select(F.col("node").alias("region"), *[F.lit(False).alias(f"e{k}") for k in range(len(atoms))])
    tests = []
    for k, atom in enumerate(atoms):
        possible = atom_possible(stats, atom)
        tests.append((F.lit(False) if possible is None else ~F.coalesce(F.bool_or(possible), F.lit(False))).alias(f"e{k}"))
    found = stats.presence.groupBy("region").agg(F.count("*").alias("rows"), *tests)
    every = stats.sizes.select(F.col("node").alias("region")).join(found, "region", "left")
    # A region without rows of its own holds nothing, so each provable atom is empty there.
    proven = [atom_possible(stats, a) is not None for a in atoms]
    return every.select("region", *[F.coalesce(f"e{k}", F.lit(p)).alias(f"e{k}") for k, p in enumerate(proven)])


def dnf_empty(stats: Stats, predicate: DNF) -> DataFrame:
    """(region, empty): every clause has an atom that is empty there. No clause, or no presence: false."""
    atoms = [a for clause in predicate.clauses for a in clause]
    found, k, clauses = empty_atoms(stats, atoms), 0, []
    for clause in predicate.clauses:
        clauses.append(reduce(lambda x, y: x | y, [F.col(f"e{k + i}") for i in range(len(clause))], F.lit(False)))
        k += len(clause)
    empty = reduce(lambda x, y: x & y, clauses) if clauses and stats.presence is not None else F.lit(False)
    return found.select("region", empty.alias("empty"))


def storage_bytes(stats: Stats) -> DataFrame:
    """(col, rows, bytes): four bytes for each bucket of each kept histogram."""
    nodes = stats.hist_node.select("col", "node").distinct().groupBy("col").agg(F.count("*").alias("rows"))
    widths = stats.hist.filter(F.col("col").isin(list(stats.schema.categorical))).groupBy("col").agg(F.count_distinct("bucket").alias("w"))
    fixed = F.element_at(F.create_map(F.lit(""), F.lit(0), *[F.lit(x) for c, e in stats.schema.edges.items() for x in (c, len(e) - 1)]), F.col("col"))
    return nodes.join(widths, "col", "left").select("col", "rows", (F.col("rows") * F.coalesce(F.col("w"), fixed) * 4).cast("long").alias("bytes"))
