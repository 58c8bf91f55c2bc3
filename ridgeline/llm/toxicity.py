"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with block-max inverted indexes.

Terms are lower-case words, their first four and five letters, and such beginnings that make up a certain share of a
text's words, as a stem that is harmless once may not be so in every line. Every term of every example is indexed; labels
choose none of them. Document frequencies are counted over all documents, and a text's norm takes in all its terms: one
that no example has weighs as a term of no document.

Examples lie in blocks of like ones. For every term and block the largest weight is known, which bounds the cosine that
the block can hold, so blocks are opened best bound first until no other can hold one of the nearest. Votes
weighted by nearness give a raw score, which a logistic curve, fitted on the examples' own scores with each left out,
turns into a probability.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow_map, key_crc, settle

#: Bounds of the fitted model: examples of each class, the first by hash.
TOXIC, CLEAN = 1500, 1500
#: Neighbours, examples of a block, neighbours shown as evidence, weight of the prior among the votes.
NEIGHBOURS, BLOCK, SHOWN, PRIOR = 150, 128, 3, 0.05
#: Examples round which the others are gathered, so that a block's are alike.
CENTRES = 12
#: A term that one example in so many has keeps its weights in a dense row rather than in postings.
DENSE_ROW = 16
#: Postings added up at once.
POSTINGS = 1 << 17
#: Terms unknown to the index that a worker remembers between texts.
REMEMBERED = 150_000
THRESHOLD = 0.7
WORDS = re.compile(r"[^\W\d_]+")
#: Letters of a beginning, and the shares of a text's words, in thousandths, from which on one that occurs more than once gives a term of its own.
STARTS, DENSE = (4, 5), (5, 10, 20, 40)


def terms_of(text: str) -> Counter:
    """Every term of a text and how often it occurs."""
    words = WORDS.findall(text.lower())
    out, starts = Counter(words), Counter()
    for w, n in out.items():
        for k in STARTS:
            if len(w) > k:
                starts[w[:k] + "*"] += n
    out.update(starts)
    for s, n in starts.items():
        out.update({f"{s}{k}": 1 for k in DENSE if n > 1 and 1000 * n >= k * len(words)})
    return out


_NONE = [-1] * (1 + len(DENSE))


class Terms(dict):
    """Numbers of known terms in many texts at once: the same as terms_of(), without making each term's string.

    As a dict it holds the row that a word has in self.words, which is made where the word is new."""

    def __init__(self, vocabulary: list[str]):
        super().__init__()
        self.known = {t: k for k, t in enumerate(vocabulary)}
        stems = {t[: t.index("*")] for t in vocabulary if "*" in t}
        self.of_start = {s: [self.known.get(f"{s}*{d}", -1) for d in ("", *DENSE)] for s in stems}
        self.begun: dict[str, int] = {}
        #: Of each word its term and the rows of its beginnings; of each beginning its terms; -1 where there is none.
        self.words, self.starts = array("i"), array("i")
        for t in vocabulary:
            if "*" not in t:
                self[t]
        self.first = dict(self), dict(self.begun), array("i", self.words), array("i", self.starts)

    def forget(self) -> None:
        """Forgets the words that no example has."""
        words, begun, *held = self.first
        self.clear()
        self.update(words)
        self.begun = dict(begun)
        self.words, self.starts = (array("i", x) for x in held)

    def __missing__(self, w: str) -> int:
        row = self[w] = len(self)
        begun, size, (short, long) = self.begun, len(w), STARTS
        a = b = -1
        if size > short:
            if (a := begun.get(s := w[:short], -1)) < 0:
                a = self._start(s)
            if size > long and (b := begun.get(s := w[:long], -1)) < 0:
                b = self._start(s)
        self.words.extend((self.known.get(w, -1), a, b))
        return row

    def _start(self, s: str) -> int:
        row = self.begun[s] = len(self.begun)
        self.starts.extend(self.of_start.get(s, _NONE))
        return row

    def entries(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, count) of every term of every text; term -1: not known."""
        if len(self) > len(self.first[0]) + REMEMBERED:
            self.forget()
        rows: list[int] = []
        counts: list[int] = []
        sizes, lengths = [], []
        for text in texts:
            words = WORDS.findall(text.lower())
            found = Counter(words)
            rows.extend(map(self.__getitem__, found))
            counts.extend(found.values())
            sizes.append(len(found))
            lengths.append(len(words))
        at, n = np.repeat(np.arange(len(texts)), sizes), np.array(counts, np.int64)
        held = np.array(self.words, np.int32).reshape(-1, 1 + len(STARTS))[np.array(rows, np.int64)]
        out = [(at, held[:, 0], n)]
        some = [held[:, k] >= 0 for k in range(1, 1 + len(STARTS))]
        key = np.concatenate([at[x] * len(self.begun) + held[x, k + 1] for k, x in enumerate(some)])
        if len(key):
            order = np.argsort(key)
            key, n = key[order], np.concatenate([n[x] for x in some])[order]
            first = np.nonzero(np.diff(key, prepend=-1))[0]
            n = np.add.reduceat(n, first)
            at, start = np.divmod(key[first], len(self.begun))
            terms, share = np.array(self.starts, np.int32).reshape(-1, 1 + len(DENSE))[start], np.array(lengths)[at]
            out.append((at, terms[:, 0], n))
            for k, d in enumerate(DENSE):
                x = np.nonzero((n > 1) & (1000 * n >= d * share))[0]
                out.append((at[x], terms[x, k + 1], np.ones(len(x), np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Index:
    """Examples as unit TF-IDF vectors over all their terms, in blocks, with each block's largest weight by term.

    vocabulary: every term of the examples; df: documents with each; docs: all documents; (at, term, n): terms of each
    example and how often it has them, in order of examples."""

    def __init__(self, vocabulary: list[str], df: np.ndarray, docs: float, at: np.ndarray, term: np.ndarray, n: np.ndarray, labels: np.ndarray, ids: np.ndarray, prior: float):
        self.vocabulary = vocabulary
        self.idf = np.log((1 + docs) / (1 + np.minimum(df, docs))) + 1
        self.unknown = np.log(1 + docs) + 1
        self.prior, self.curve = prior, (0.0, 1.0)
        weight = self.weights(at, term, n, len(labels))
        order = self._alike(at, term, weight, len(labels))
        self.labels, self.ids = labels[order], ids[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place = rank[at]
        order = np.argsort(place, kind="stable")
        place, term, weight = place[order], term[order], weight[order]
        self._store(place, term, weight)
        if len(labels):
            toxic = self.labels.sum()
            share = np.array([(1 - prior) / max(1, len(labels) - toxic), prior / max(1, toxic)])  # undoes the unlike bounds of the classes
            self.calibrate(place, term, weight, share[self.labels] * len(labels))

    def weights(self, at: np.ndarray, term: np.ndarray, n: np.ndarray, texts: int, strange: np.ndarray | float = 0.0) -> np.ndarray:
        """Unit TF-IDF weights of entries of known terms; strange: what strangers() gives of each text's others."""
        w = (1 + np.log(n)) * self.idf[term]
        size = np.sqrt(np.bincount(at, w * w, texts) + self.unknown**2 * strange)
        return w / np.where(size > 0, size, 1)[at]

    def _alike(self, at, term, weight, n: int) -> np.ndarray:
        """Order of examples in which alike ones follow each other: by nearest of a few centres that are unlike each other."""
        best, near = np.full(n, -1.0), np.zeros(n, np.int64)
        begin = np.searchsorted(at, np.arange(n + 1))
        for c in range(CENTRES if n else 0):
            centre = int(np.argmin(best))
            row = np.zeros(len(self.idf))
            row[term[begin[centre] : begin[centre + 1]]] = weight[begin[centre] : begin[centre + 1]]
            cos = np.bincount(at, weight * row[term], n)
            near, best = np.where(cos > best, c, near), np.maximum(cos, best)
        return np.lexsort((np.arange(n), -best, near))

    def _store(self, place, term, weight) -> None:
        v, n = len(self.idf), len(self.labels)
        self.blocks = -(-n // BLOCK)
        common = np.bincount(term, minlength=v) * DENSE_ROW > n
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        thick = common[term]
        self.dense = np.zeros((int(common.sum()), n))
        self.dense[self.row[term[thick]], place[thick]] = weight[thick]
        edges = np.arange(0, n, BLOCK)
        self.most = np.maximum.reduceat(self.dense, edges, axis=1) if n else np.zeros((0, 0))
        place, term, weight = place[~thick], term[~thick], weight[~thick]
        order = np.lexsort((place, term))
        self.place, self.weight = place[order].astype(np.int32), weight[order]
        self.cut = np.searchsorted(term[order], np.arange(v + 1))

    def cosines(self, at: np.ndarray, term: np.ndarray, weight: np.ndarray, texts: int, k: int) -> np.ndarray:
        """Cosines of texts to examples; -1 where the example's block was left closed, as it can't hold one of the k nearest.

        Postings of the rarer terms are added up first. What they give in a block at most and the largest weights of the
        common terms there bound the block; each text opens the better half of its blocks first, then those whose bound still
        reaches its k-th cosine."""
        n = len(self.labels)
        out = np.full((texts, n), -1.0)
        if not len(at) or not n:
            return out
        thick = self.row[term] >= 0
        asked = np.zeros((texts, len(self.dense)))
        asked[at[thick], self.row[term[thick]]] = weight[thick]
        at, term, weight = at[~thick], term[~thick], weight[~thick]
        begin, size = self.cut[term], self.cut[term + 1] - self.cut[term]
        rare, upto, x = np.zeros((texts, n)), np.cumsum(size), 0
        while x < len(at):
            y = max(x + 1, int(np.searchsorted(upto, upto[x] - size[x] + POSTINGS, "right")))
            part, first = slice(x, y), at[x]
            flat = np.arange(size[part].sum()) + np.repeat(begin[part] - (upto[part] - size[part] - (upto[x] - size[x])), size[part])
            some = rare[first : at[y - 1] + 1]
            some += np.bincount(np.repeat((at[part] - first) * n, size[part]) + self.place[flat], self.weight[flat] * np.repeat(weight[part], size[part]), some.size).reshape(some.shape)
            x = y
        bound = (np.maximum.reduceat(rare, np.arange(0, n, BLOCK), axis=1) + asked @ self.most) * (1 + 1e-9)
        able = bound > 0
        order = np.argsort(np.where(able, -bound, 1), axis=1, kind="stable")
        first = np.zeros_like(able)
        np.put_along_axis(first, order, np.arange(self.blocks) < -(-able.sum(axis=1)[:, None] // 2), axis=1)
        self._open(first, rare, asked, out)
        kth = np.partition(out, n - k, axis=1)[:, n - k] if n > k else np.full(texts, -1.0)
        self._open(able & ~first & (bound >= kth[:, None]), rare, asked, out)
        return out

    def _open(self, turn: np.ndarray, rare: np.ndarray, asked: np.ndarray, out: np.ndarray) -> None:
        for b in np.nonzero(turn.any(axis=0))[0]:
            some, part = np.nonzero(turn[:, b])[0], slice(b * BLOCK, (b + 1) * BLOCK)
            out[some, part] = rare[some, part] + asked[some] @ self.dense[:, part]

    def nearest(self, at, term, weight, texts: int, *, k: int = NEIGHBOURS, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the k examples of greatest cosine above zero and one more, ties to the first but for those with the last: (numbers, cosines), 0 where there are no more.

        leave: an example that each text leaves out."""
        take = min(len(self.labels), k + 1)
        cos = self.cosines(at, term, weight, texts, k + 1 + (leave is not None))
        if leave is not None:
            cos[np.arange(texts), leave] = -1
        if not take:
            return np.zeros((texts, 0), np.int64), np.zeros((texts, 0))
        # Sums of the same products differ in the last digits by the order of summing.
        cos = np.round(np.maximum(cos, 0), 12)
        best = np.sort(np.argpartition(-cos, take - 1, axis=1)[:, :take], axis=1) if take < cos.shape[1] else np.broadcast_to(np.arange(take), cos.shape)
        near = np.take_along_axis(cos, best, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        return np.take_along_axis(best, order, 1), np.take_along_axis(near, order, 1)

    def vote(self, best: np.ndarray, cos: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Share of toxic examples among the k nearest, weighted by how much nearer each is than the next one after them."""
        rest = cos[:, k] if cos.shape[1] > k else np.zeros(len(cos))
        w = np.maximum(cos[:, :k] - rest[:, None], 0)
        base = self.labels.mean() if len(self.labels) else 0.5
        return ((w * self.labels[best[:, :k]]).sum(axis=1) + PRIOR * base) / (w.sum(axis=1) + PRIOR)

    def calibrate(self, at: np.ndarray, term: np.ndarray, weight: np.ndarray, shares: np.ndarray) -> None:
        """Fits the logistic curve to the raw scores of the examples, each left out, by weighted Newton steps.

        (at, term, weight): the examples' unit vectors, in order; shares: what each example counts for."""
        raw = np.zeros(len(self.labels))
        for first in range(0, len(raw), BLOCK):
            last = min(len(raw), first + BLOCK)
            some = slice(*np.searchsorted(at, (first, last)))
            raw[first:last] = self.vote(*self.nearest(at[some] - first, term[some], weight[some], last - first, leave=np.arange(first, last)))
        x, y, (a, b) = raw - 0.5, self.labels.astype(float), (0.0, 4.0)
        for _ in range(60):
            p = 1 / (1 + np.exp(-(a + b * x)))
            g = np.array([(shares * (p - y)).sum(), (shares * (p - y) * x).sum() + 1e-2 * b])
            v = shares * p * (1 - p)
            h = np.array([[v.sum() + 1e-6, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-2]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -2, 2), max(0.0, b - np.clip(step[1], -2, 2))
        self.curve = (float(a), float(b))

    def without_vocabulary(self) -> Index:
        """The same for texts whose terms have their numbers already."""
        out = copy(self)
        out.vocabulary = []
        return out

    def score(self, best: np.ndarray, cos: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a + b * (self.vote(best, cos) - 0.5))))

    def judge(self, at: np.ndarray, term: np.ndarray, n: np.ndarray, strange: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of len(strange) texts, their nearest examples and cosines, of entries in order of texts."""
        texts = len(strange)
        best, cos = self.nearest(at, term, self.weights(at, term, n, texts, strange), texts)
        return self.score(best, cos), best, cos


def strangers(at: np.ndarray, n: np.ndarray, texts: int) -> np.ndarray:
    """Sum of the squared term frequencies' weights of each text's unknown terms, which add to its norm."""
    return np.bincount(at, (1 + np.log(n)) ** 2, texts)


def packed(term: np.ndarray, n: np.ndarray) -> bytes:
    """Terms in ascending order and their counts as one value: gaps of two bytes and counts of one where these suffice."""
    gaps = np.diff(term, prepend=0)
    small, few = int(gaps.max(initial=0)) < 1 << 16, int(n.max(initial=0)) < 256
    return bytes((small, few)) + gaps.astype(np.uint16 if small else np.int32).tobytes() + n.astype(np.uint8 if few else np.int32).tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    gap, count = np.dtype(np.uint16 if blob[0] else np.int32), np.dtype(np.uint8 if blob[1] else np.int32)
    k = (len(blob) - 2) // (gap.itemsize + count.itemsize)
    return np.cumsum(np.frombuffer(blob, gap, k, 2), dtype=np.int64), np.frombuffer(blob, count, k, 2 + k * gap.itemsize)


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of packed texts."""
    parts = [unpacked(x) for x in blobs]
    at = np.repeat(np.arange(len(parts)), [len(t) for t, _ in parts])
    return at, np.concatenate([t for t, _ in parts]), np.concatenate([n.astype(np.int64) for _, n in parts])


def term_rows(docs: DataFrame, vocabulary: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, terms, strange): each row's packed terms of the vocabulary and its strangers(). Texts are read whole, null as empty."""
    held = docs.sparkSession.sparkContext.broadcast("\n".join(vocabulary))

    def make():
        terms = Terms(held.value.split("\n") if held.value else [])

        def work(cols):
            texts = [x or "" for x in cols["text"]]
            at, term, n = terms.entries(texts)
            order = np.lexsort((term, at))
            at, term, n = at[order], term[order], n[order]
            known = term >= 0
            strange = strangers(at[~known], n[~known], len(texts))
            cut = np.searchsorted(at[known], np.arange(len(texts) + 1))
            term, n = term[known], n[known]
            return {"id": cols["id"], "terms": [packed(term[a:b], n[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], "strange": strange}

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(rows, make, f"id {kind}, terms binary, strange double")


def fit(docs: DataFrame, labels: DataFrame, **how) -> Index:
    """Fits an index on labelled documents; see fitted()."""
    return fitted(docs, labels, **how)[0]


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train: F.Column | None = None, toxic: int = TOXIC, clean: int = CLEAN) -> tuple[Index, DataFrame]:
    """An index on at most so many labelled documents of each class for which train holds (none given: all), and the
    term_rows() of docs, written once: documents are counted and later scored from them.

    A document labelled more than once counts as toxic if one of its labels says so; of several texts of an id the least
    one is the example. Without labelled documents the index is empty and every score is one half.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    if train is not None:
        known = known.filter(train)
    known = settle(known.groupBy("id").agg(F.max("y").alias("y")))
    total = known.agg(F.count("*").alias("n"), F.sum("y").alias("t")).first()
    pick = lambda y, n: known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    chosen = pick(1, toxic).union(pick(0, clean))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    examples = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))

    def look():
        def work(cols):
            found = [terms_of(x) for x in cols["text"]]
            return {"id": cols["id"], "y": cols["y"], "terms": ["\n".join(f) for f in found], "n": [np.array(list(f.values()), np.int32).tobytes() for f in found]}

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    got = sorted(arrow_map(examples, look, f"id {kind}, y int, terms string, n binary").collect(), key=lambda r: r["id"])
    names: set[str] = set()
    for r in got:
        names.update(r["terms"].split("\n") if r["terms"] else ())
    vocabulary = sorted(names)
    of_docs = settle(term_rows(docs, vocabulary, id_col=id_col, text_col=text_col))
    size = len(vocabulary)

    def count(batches):
        n = np.zeros(size + 1, np.int64)
        for batch in batches:
            n[-1] += batch.num_rows
            for blob in batch.column(0):
                n[unpacked(blob.as_py())[0]] += 1
        some = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["term", "n"])

    counted = of_docs.select("terms").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(size + 1)
    df[counted["term"].to_numpy()] = counted["n"].to_numpy()
    number = {t: k for k, t in enumerate(vocabulary)}
    n = [np.frombuffer(r["n"], np.int32) for r in got]
    at = np.repeat(np.arange(len(got), dtype=np.int32), [len(x) for x in n])
    term = np.fromiter((number[t] for r in got if r["terms"] for t in r["terms"].split("\n")), np.int32, len(at))
    y, ids = np.array([r["y"] for r in got], int), np.array([r["id"] for r in got])
    prior = (total["t"] or 0) / total["n"] if total["n"] else 0.5
    return Index(vocabulary, df[:-1], df[-1], at, term, np.concatenate([*n, np.zeros(0, np.int32)]), y, ids, prior), of_docs


def score(docs: DataFrame, index: Index, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, score (0 to 1), evidence (nearest examples: doc_id, similarity, toxic).

    Null and empty texts, and those that share no term with an example, get the score of the prior and no evidence. Rows
    are kept as often as they occur, null ids too; texts are read whole.
    """
    return score_rows(term_rows(docs, index.vocabulary, id_col=id_col, text_col=text_col), index).withColumnRenamed("id", id_col)


def score_rows(rows: DataFrame, index: Index) -> DataFrame:
    """id, score and evidence of term_rows()."""
    held = rows.sparkSession.sparkContext.broadcast(index.without_vocabulary())
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        index = held.value

        def work(cols):
            scores, best, cos = index.judge(*_joined(cols["terms"]), np.array(cols["strange"]))
            shown = [[{"doc_id": index.ids[i].item(), "similarity": c, "toxic": int(index.labels[i])} for i, c in zip(b, cs, strict=True) if c > 0] for b, cs in zip(best[:, :SHOWN], cos[:, :SHOWN].tolist(), strict=True)]
            return {"id": cols["id"], "score": scores, "evidence": shown}

        return work

    return arrow_map(rows, make, f"id {kind}, score double, evidence array<struct<doc_id: {kind}, similarity: double, toxic: int>>")


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """score() of docs by an index fitted on them, without reading the texts a second time."""
    index, rows = fitted(docs, labels, id_col=id_col, **how)
    return score_rows(rows, index).withColumnRenamed("id", id_col)


def held_out(col: str) -> F.Column:
    """Rows kept from fitting: those whose id as text has a CRC-32 of remainder 1 by 3."""
    return F.coalesce(F.pmod(key_crc(col), F.lit(3)) == 1, F.lit(False))
