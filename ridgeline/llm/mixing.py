"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Tokens are summed by (source, language, topic), and each cell has a probability, at first 1. The marginals are raked in
turn: of each value of a side, the probabilities are multiplied by the one number for which its expected tokens are its
target, with none above 1. Targets are shares of the wanted fraction of all tokens; where a value has fewer tokens than
its share, its target is all it has and the other values take the rest in proportion. What the marginals then miss is
reported beside them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import settle

SIDES = ("source", "lang", "topic")
#: Rounds over the sides; steps of finding a value's number where cells are too many for the driver.
ROUNDS, STEPS = 25, 4
#: Wanted fraction of all tokens.
FRACTION = 0.5
#: Cells up to which the driver rakes them and their factors are broadcast (about 100 bytes each); beyond it Spark does.
LOCAL_CELLS = 20_000
#: Targets are shares to this power, made to sum to one, where none are given.
TEMPER = 0.5
SEED = "mix-1"
SPACE = " \t\n\x0b\x0c\r"


def word_tokens(text: F.Column) -> F.Column:
    """Number of words between ASCII white space; null: 0."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+", -1))).cast("long")


def length_topic(tokens: F.Column) -> F.Column:
    """The topic of documents that have none: a band of length."""
    return F.when(tokens < 128, "short").when(tokens < 1024, "medium").otherwise("long")


def uniform(id_col: F.Column) -> F.Column:
    """A number in [0, 1) from the id alone: 52 bits of an MD5."""
    text = F.concat(F.lit(SEED + ":"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def tempered(cells: list[dict], side: str) -> dict[str, float]:
    sums: dict[str, float] = {}
    for c in cells:
        sums[c[side]] = sums.get(c[side], 0.0) + c["tokens"]
    whole = sum(sums.values())
    raised = {k: (v / whole) ** TEMPER if v > 0 else 0.0 for k, v in sums.items()} if whole else dict.fromkeys(sums, 1.0)
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def reachable(have: np.ndarray, share: np.ndarray, total: float) -> np.ndarray:
    """Tokens wanted of each value: its share of total, at most what it has, the rest shared among the others in proportion."""
    out, free = np.zeros(len(have)), share > 0
    while free.any():
        want = share * max(0.0, total - out[~free].sum()) / share[free].sum()
        over = free & (want >= have)
        if not over.any():
            out[free] = want[free]
            break
        out[over] = have[over]
        free &= ~over
    return out


def rake(cells: list[dict], targets: dict[str, dict[str, float]], fraction: float = FRACTION, rounds: int = ROUNDS) -> tuple[list[float], dict[str, dict[str, float]]]:
    """Probability of each cell, and for each side the miss of each value: the share reached less the one wanted.

    Values without a target, or of share zero, get probability zero."""
    t = np.array([c["tokens"] for c in cells], float)
    p, sides = np.ones(len(cells)), {}
    for s in SIDES:
        names, code = np.unique([str(c[s]) for c in cells], return_inverse=True)
        sides[s] = [str(n) for n in names], code, np.bincount(code, t, len(names)), np.array([targets[s].get(str(n), 0.0) for n in names])
    total = min([fraction * t.sum(), *[have[share > 0].sum() for _, _, have, share in sides.values()]]) if len(t) else 0.0
    wanted = {s: reachable(have, share, total) for s, (_, _, have, share) in sides.items()}
    for _ in range(rounds):
        for s in SIDES:
            code = sides[s][1]
            p = np.minimum(1.0, p * _numbers(code, t, p, wanted[s])[code])
    got = (t * p).sum()
    misses = {s: dict(zip(names, (np.bincount(code, t * p, len(names)) / got - share if got else 0 * share).tolist(), strict=True)) for s, (names, code, _, share) in sides.items()}
    return p.tolist(), misses


def _numbers(code: np.ndarray, t: np.ndarray, p: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each value the number r for which the sum of t * min(1, p * r) is what is wanted.

    With cells in falling order of p, the first k count whole and the rest by p * r; of all k the right one gives the largest r."""
    if not len(code):
        return np.zeros(len(wanted))
    order = np.lexsort((-p, code))
    c, tokens, weight = code[order], t[order], (t * p)[order]
    begin = np.searchsorted(c, np.arange(len(wanted)))
    before = np.cumsum(tokens) - tokens
    before -= before[begin][c]
    upto = np.cumsum(weight)
    rest = (upto[np.append(begin[1:], len(c)) - 1])[c] - upto + weight
    out = np.zeros(len(wanted))
    np.maximum.at(out, c[rest > 0], (wanted[c] - before)[rest > 0] / rest[rest > 0])
    return out


def rake_wide(cells: DataFrame, targets: dict[str, DataFrame], fraction: float, rounds: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """rake() as grouped aggregates and joins, for more cells than a driver should hold; (cells with p, values with misses of each side).

    A value's number is found by steps that count the cells it fills as whole; later rounds go on from there."""
    whole = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    sums = {s: settle(cells.groupBy(s).agg(F.sum("tokens").cast("double").alias("has")).join(targets[s].select(s, "share"), s, "left").na.fill(0.0, ["share"])) for s in SIDES}
    total = min([fraction * whole, *[df.filter("share > 0").agg(F.coalesce(F.sum("has"), F.lit(0.0))).first()[0] for df in sums.values()]])
    wanted = {s: settle(_reachable_wide(df, total)) for s, df in sums.items()}
    cells = cells.withColumn("p", F.lit(1.0))
    for _ in range(rounds):
        for s in SIDES:
            now = cells.join(wanted[s].select(s, "want"), s).withColumn("r", F.lit(0.0))
            for _ in range(STEPS):
                full = F.col("p") * F.col("r") >= 1
                sides = now.groupBy(s).agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("filled"), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("p"))).alias("rest"))
                number = sides.select(s, "filled", "rest")
                now = now.join(number, s).withColumn("r", F.when(F.col("rest") > 0, F.greatest("r", (F.col("want") - F.col("filled")) / F.col("rest"))).otherwise(F.col("r"))).drop("filled", "rest")
            cells = settle(now.withColumn("p", F.least(F.lit(1.0), F.col("p") * F.col("r"))).drop("want", "r"))
    got = cells.agg(F.sum(F.col("tokens") * F.col("p"))).first()[0] or 0.0
    of = lambda s: cells.groupBy(s).agg(F.sum(F.col("tokens") * F.col("p")).alias("given"))
    misses = {s: sums[s].join(of(s), s).select(F.col(s).alias(f"m_{s}"), (F.col("given") / got - F.col("share") if got else F.lit(0.0)).alias(f"{s}_miss")) for s in SIDES}
    return cells, misses


def _reachable_wide(sums: DataFrame, total: float) -> DataFrame:
    now = settle(sums.withColumn("full", F.lit(False)))
    while True:
        taken, left = now.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("has"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("share"))), F.lit(0.0))).first()
        want = F.col("share") * (max(0.0, total - taken) / left if left > 0 else 0.0)
        new = settle(now.withColumn("full", F.col("full") | ((F.col("share") > 0) & (want >= F.col("has")))))
        if new.filter("full").count() == now.filter("full").count():
            return now.withColumn("want", F.when(F.col("full"), F.col("has")).otherwise(want))
        now = new


def _tempered_wide(cells: DataFrame, s: str) -> DataFrame:
    sums = cells.groupBy(s).agg(F.sum("tokens").cast("double").alias("t"))
    whole = sums.agg(F.sum("t")).first()[0] or 0.0
    raised = settle(sums.select(s, (F.when(F.col("t") > 0, F.pow(F.col("t") / whole, TEMPER)).otherwise(0.0) if whole else F.lit(1.0)).alias("r")))
    total = raised.agg(F.sum("r")).first()[0] or 1.0
    return raised.select(s, (F.col("r") / total).alias("share"))


def probabilities(docs: DataFrame, *, source: F.Column, lang: F.Column, topic: F.Column | None = None, tokens: F.Column, targets: dict[str, dict[str, float]] | None = None, fraction: float = FRACTION, rounds: int = ROUNDS) -> DataFrame:
    """row (a struct of the columns of docs), source, lang, topic, tokens, p, the probability of being taken, and source_miss,
    lang_miss and topic_miss: by how much the expected share of the row's value lies off the one wanted.

    targets: for each of source, lang and topic the wanted share of tokens by value; a side left out is tempered. Values
    that targets don't name get probability zero. Null sides are the empty string. fraction is the share of all tokens
    that is wanted; it is less where a side's targets name values with fewer tokens.
    """
    sides = {"source": F.coalesce(source.cast("string"), F.lit("")), "lang": F.coalesce(lang.cast("string"), F.lit(""))}
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in sides.items()], *([] if topic is None else [F.coalesce(topic.cast("string"), F.lit("")).alias("topic")]), tokens.alias("tokens"))
    if topic is None:
        rows = rows.withColumn("topic", length_topic(F.col("tokens")))
    cells = settle(rows.select(*SIDES, "tokens").groupBy(*SIDES).agg(F.sum("tokens").alias("tokens")))
    given, spark = targets or {}, docs.sparkSession
    given = {s: {k: v / sum(t.values()) for k, v in t.items()} for s, t in given.items()}
    small = cells.count() <= LOCAL_CELLS
    miss = [f"{s}_miss" for s in SIDES]
    if small:
        held = [r.asDict() for r in cells.orderBy(*SIDES).collect()]
        p, misses = rake(held, {s: given[s] if s in given else tempered(held, s) for s in SIDES}, fraction, rounds)
        known = spark.createDataFrame([(*[h[s] for s in SIDES], x, *[misses[s][h[s]] for s in SIDES]) for h, x in zip(held, p, strict=True)], "s_source string, s_lang string, s_topic string, p double, " + ", ".join(f"{m} double" for m in miss))
    else:
        wide, misses = rake_wide(cells, {s: spark.createDataFrame(list(given[s].items()), f"{s} string, share double") if s in given else _tempered_wide(cells, s) for s in SIDES}, fraction, rounds)
        for s in SIDES:
            wide = wide.join(misses[s], F.col(s) == F.col(f"m_{s}")).drop(f"m_{s}")
        known = settle(wide.select(*[F.col(s).alias(f"s_{s}") for s in SIDES], "p", *miss))
    same = [F.col(s) == F.col(f"s_{s}") for s in SIDES]
    return rows.join(F.broadcast(known) if small else known, same, "left").select("row", *SIDES, "tokens", "p", *miss)


def mix(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of probabilities() that the sample takes.

    Whether a row is taken follows from its id and probability only, so copies of an id are taken together; rows with a
    null id share one number. An empty table gives an empty one.
    """
    return probabilities(docs, **how).filter(uniform(F.col("row")[id_col]) < F.col("p"))
