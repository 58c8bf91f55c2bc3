"""Quality classifier by hierarchical empirical Bayes.

A logistic model on a document's shape gives its evidence. Over all documents, evidence is summed by host and by path
within the host; beta priors fitted by the method of moments shrink a path's rate towards its host's and a host's
towards the global one, the more the fewer documents it has. A document's score is its evidence with the global prior
replaced by the posterior of its site, from which its own evidence is taken out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_map, settle
from .toxicity import held_out

#: Bound of the fitted model: labelled rows (the first by hash).
LABELLED = 20_000
#: Sites up to which their posteriors are broadcast (about 60 bytes each); beyond it they are joined.
BROADCAST_SITES = 20_000
KEEP = 0.5
FEATURES = ("capitals", "symbols", "bangs", "bars", "letters", "digits", "distinct_words", "distinct_lines", "word_size", "log_words")
SYMBOLS = np.frombuffer(b"#$%&*<>=@^~{}[]\\", np.uint8)


def shape(text: str) -> list[float]:
    """Features of a whole text, each about 0 to 1. An empty text has all zero."""
    if not text:
        return [0.0] * len(FEATURES)
    n = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    small, capital, other = int(n[97:123].sum()), int(n[65:91].sum()), int(n[0xC0:].sum())
    chars, letters = len(text), max(1, small + capital + other)
    words, lines = text.split(), text.split("\n")
    k = max(1, len(words))
    return [
        capital / letters, float(n[SYMBOLS].sum()) / chars, int(n[33]) / chars, int(n[124]) / chars, letters / chars, float(n[48:58].sum()) / chars,
        len(set(words)) / k, len(set(lines)) / len(lines), min(1.0, chars / k / 16), float(np.log1p(k)) / 12,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features, their squares, and one

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality by shape alone, kept off 0 and 1."""
        z = np.clip(self.rows(x) @ self.weights, -8, 8)
        return 1 / (1 + np.exp(-z))

    def rows(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate((z, z * z, np.ones((len(x), 1))), axis=1)


def fit_rows(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
    """Ridge-penalised logistic regression by Newton steps. Of one class only, every document gets the same evidence; without rows, evidence that keeps it."""
    if not len(x):
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.append(np.zeros(2 * len(FEATURES)), 2.0))
    m = Model(x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3), np.zeros(2 * x.shape[1] + 1))
    z = m.rows(x)
    base = (y.sum() + 1) / (len(y) + 2)
    m.weights[-1] = np.log(base / (1 - base))
    if y.min() == y.max():
        return m
    keep = np.full(z.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ m.weights, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(keep), z.T @ (p - y) + keep * m.weights)
        m.weights -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return m


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on at most LABELLED labelled rows outside the held-out third. Of several labels of a document the worst counts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").filter(~held_out("id"))
    chosen = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")

    def make():
        return lambda cols: {"id": cols["id"], "y": cols["y"], "x": [shape(t or "") for t in cols["text"]]}

    kind = docs.schema[id_col].dataType.simpleString()
    got = sorted(arrow_map(rows, make, f"id {kind}, y int, x array<double>").collect())
    return fit_rows(np.array([r["x"] for r in got], float).reshape(-1, len(FEATURES)), np.array([r["y"] for r in got], float))


def with_evidence(docs: DataFrame, model: Model, *, text_col: str, carry: list[str], host: F.Column, path: F.Column) -> DataFrame:
    """Columns k0, k1 .. (carry), host, path, evidence."""
    names = [f"k{i}" for i in range(len(carry))]
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, carry, strict=True))
    rows = docs.select(*[F.col(c).alias(n) for n, c in zip(names, carry, strict=True)], F.col(text_col).alias("text"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))

    def make():
        def work(cols):
            cols["evidence"] = model.evidence(np.array([shape(t or "") for t in cols["text"]])).tolist()
            return cols

        return work

    return arrow_map(rows, make, f"{kinds}{', ' if kinds else ''}host string, path string, evidence double")


def sites(evidence: DataFrame) -> DataFrame:
    """s_host, s_path, n, good (sum of evidence), host_rate, strength, prior: what a document's posterior is made of."""
    cells = settle(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("good")))
    hosts = settle(cells.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood")))

    def moments(df: DataFrame, n: str, good: str) -> tuple[float, float]:
        """Mean rate and the strength of a beta prior, in documents, from the spread of the groups' rates."""
        r = df.agg(F.sum(n).alias("n"), F.sum(good).alias("g"), F.sum(F.col(good) * F.col(good) / F.col(n)).alias("q"), F.sum(F.col(n) * F.col(n)).alias("nn"), F.count("*").alias("k")).first()
        if not r["n"]:
            return 0.5, 10.0
        mean = r["g"] / r["n"]
        within = max(1e-9, mean * (1 - mean))
        size = max(1e-9, r["n"] - r["nn"] / r["n"])
        between = (r["q"] - r["n"] * mean * mean - (r["k"] - 1) * within) / size
        return mean, float(np.clip(within / between - 1, 2.0, 1e4)) if between > 0 else 1e4

    prior, of_host = moments(hosts, "hn", "hgood")
    _, of_path = moments(cells, "n", "good")
    hosts = hosts.select("host", ((F.col("hgood") + of_host * prior) / (F.col("hn") + of_host)).alias("host_rate"))
    return settle(cells.join(hosts, "host").select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), "n", "good", "host_rate", F.lit(of_path).alias("strength"), F.lit(prior).alias("prior")))


def posterior(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with site_rate and score."""
    small = known.count() <= BROADCAST_SITES
    out = rows.join(F.broadcast(known) if small else known, (F.col("host") == F.col("s_host")) & (F.col("path") == F.col("s_path")), "left")
    rate = (F.col("good") - F.col("evidence") + F.col("strength") * F.col("host_rate")) / (F.col("n") - 1 + F.col("strength"))
    logit = lambda p: F.log(F.greatest(F.least(p, F.lit(1 - 1e-4)), F.lit(1e-4)) / (1 - F.greatest(F.least(p, F.lit(1 - 1e-4)), F.lit(1e-4))))
    out = out.withColumn("site_rate", rate)
    z = logit(F.col("evidence")) + logit(F.col("site_rate")) - logit(F.col("prior"))
    return out.withColumn("score", 1 / (1 + F.exp(-z))).drop("s_host", "s_path", "n", "good", "host_rate", "strength", "prior")


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: F.Column, path: F.Column) -> DataFrame:
    """One row per row of docs: id, evidence, site_rate, score, kept (score of KEEP or more).

    Null hosts and paths are the empty one; null and empty texts have a shape of zeros; null ids and repeated rows keep a
    row each and count each. No labels: every document is kept.
    """
    rows = settle(with_evidence(docs, fit(docs, labels, id_col=id_col, text_col=text_col), text_col=text_col, carry=[id_col], host=host, path=path))
    out = posterior(rows, sites(rows))
    return out.select(F.col("k0").alias(id_col), "evidence", "site_rate", "score", (F.col("score") >= KEEP).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host: F.Column, path: F.Column) -> DataFrame:
    """The rows of docs that classify() would keep, with the columns of docs. Texts aren't shuffled; evidence is found twice."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    known = sites(with_evidence(docs, model, text_col=text_col, carry=[], host=host, path=path))
    rows = posterior(with_evidence(docs, model, text_col=text_col, carry=docs.columns, host=host, path=path), known)
    return rows.filter(F.col("score") >= KEEP).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
