"""Toxicity: nearest labelled examples by exact TF-IDF cosine over block-max inverted indexes.

Fit. A bounded sample of labelled rows (`examples_per_class`, taken by hash order) gives the
examples. Terms are whole words and word beginnings of three to six letters; those whose document frequency differs
between the classes beyond chance (log-likelihood ratio), in favour of either, make up the vocabulary. No more terms are
possible than the examples hold, and none that pass are left out. All words together are one more term, so that a mention
in a long text weighs less than in a short one. Inverse document frequencies count all documents. Score. For each document
the k examples of greatest cosine vote, weighted by their closeness, against a prior; a logistic curve, fitted on
leave-one-out votes of the examples and weighted back to the classes' true shares,
makes the vote a probability. The nearest examples and the terms shared are the evidence.

The search is exact. Postings (example, weight) of a term are sparse and cut by blocks of examples; each cut knows its largest
weight. Sums of these bound a block's cosines; blocks are read by descending bound, in growing groups, until no bound
can reach the k-th cosine. Equal cosines go to the smaller example number.

Nulls: a null text counts as empty; an empty text, or one without vocabulary terms,
gets the score of examples without terms. Rows with null labels or ids don't train; a repeated id trains once, by its
smallest text, as toxic if any of its labels is 1. With no example of label 1, or none of label 0, every score is 0. Repeated rows
score alike. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, arrow_rows, collected

WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6)
#: Weight of term 0 for each unit of the logarithm of the number of words.
OTHER = 1.5
BLOCK = 64


def terms_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges start..end in a row, and the range that each belongs to."""
    size = ends - starts
    own = np.repeat(np.arange(len(size)), size)
    return np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + starts[own], own


@dataclass
class Rows:
    """Sparse rows: terms (ascending) and weights of row i are those from first[i] to first[i + 1]."""

    first: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        lengths = [len(t) for t, _ in rows]
        join = lambda k, kind: np.concatenate([r[k] for r in rows]).astype(kind) if rows else np.empty(0, dtype=kind)
        return Rows(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), join(0, np.int64), join(1, np.float64))

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.terms[self.first[i] : self.first[i + 1]], self.weights[self.first[i] : self.first[i + 1]]

    def dense(self, width: int) -> np.ndarray:
        out = np.zeros((len(self.first) - 1, width))
        out[np.repeat(np.arange(len(out)), np.diff(self.first)), self.terms] = self.weights
        return out


@dataclass
class Model:
    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray  # of the examples, as given
    labels: np.ndarray
    rows: Rows  # examples x terms, of length 1
    k: int
    prior: float
    curve: np.ndarray  # of the logistic: intercept, vote, vote of the nearest


class Index:
    """Exact k-nearest search over the examples."""

    def __init__(self, model: Model):
        self.m = model
        self.n = len(model.labels)
        self.blocks = -(-self.n // BLOCK)
        example = np.repeat(np.arange(self.n), np.diff(model.rows.first))
        order = np.lexsort((example, model.rows.terms))
        self.who, self.weight, term = example[order], model.rows.weights[order], model.rows.terms[order]
        key = term * max(1, self.blocks) + self.who // BLOCK
        # cuts: the postings of one term in one block
        self.cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
        self.cut_end = np.r_[self.cut[1:], len(key)].astype(np.int64)
        self.cut_block = self.who[self.cut] // BLOCK
        self.cut_max = np.maximum.reduceat(self.weight, self.cut) if len(key) else np.empty(0)
        self.term_cuts = np.searchsorted(term[self.cut], np.arange(len(model.vocabulary) + 2))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Example numbers and cosines, nearest first; only cosines above 0."""
        cuts, own = spread(self.term_cuts[terms], self.term_cuts[terms + 1])
        blocks, share = self.cut_block[cuts], weights[own]
        bounds = np.bincount(blocks, self.cut_max[cuts] * share, minlength=self.blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        who, cos, worst, at, group = np.empty(0, dtype=np.int64), np.empty(0), 0.0, 0, 2
        taken = np.zeros(self.blocks, dtype=bool)
        while at < len(order):
            now = order[at : at + group]
            if len(who) == k:
                now = now[bounds[now] >= worst - 1e-12]
            if not len(now):
                break
            at, group = at + group, group * 4
            taken[:] = False
            taken[now] = True
            read = np.flatnonzero(taken[blocks])
            places, cut = spread(self.cut[cuts[read]], self.cut_end[cuts[read]])
            s = np.bincount(self.who[places], self.weight[places] * share[read][cut], minlength=self.n)
            hit = np.flatnonzero(s > 0)
            hit = hit[hit != skip]
            who, cos = np.concatenate([who, hit]), np.concatenate([cos, s[hit]])
            if len(who) > k:
                keep = np.lexsort((who, -np.round(cos, 12)))[:k]
                who, cos = who[keep], cos[keep]
            worst = cos.min() if len(who) == k else 0.0
        keep = np.lexsort((who, -np.round(cos, 12)))
        return who[keep], cos[keep]

    def shared(self, terms: np.ndarray, weights: np.ndarray, who: np.ndarray) -> np.ndarray:
        """What each term adds to the cosines with these examples."""
        rows = self.m.rows
        places, _ = spread(rows.first[who], rows.first[who + 1])
        at = np.searchsorted(terms, rows.terms[places])
        same = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == rows.terms[places])
        return weights * np.bincount(at[same], rows.weights[places[same]], minlength=len(terms))

    def vote(self, who: np.ndarray, cos: np.ndarray) -> np.ndarray:
        """The features of the curve: 1, and the shares of label 1 by closeness, against the prior, of all and of the nearest five."""
        w = cos**4 / (0.02 + np.maximum(0, 1 - cos))
        y = self.m.labels[who]
        near = slice(0, 5)
        share = lambda at: (w[at] @ y[at] + 3 * self.m.prior) / (w[at].sum() + 3)
        return np.array([1.0, share(slice(None)), share(near)])


class Vectors:
    """Turns texts into weighted terms; words are looked up once. Term 0 stands for all words, so that a mention in a long text weighs less than in a short one."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.memo = vocabulary, {}

    def counts(self, text: str) -> dict[int, int]:
        memo, out = self.memo, {}
        words = WORD.findall(text.lower())
        out[0] = len(words)
        for w in words:
            t = memo.get(w)
            if t is None:
                if len(memo) > 300_000:
                    memo.clear()
                t = memo[w] = tuple(self.vocabulary[x] for x in terms_of(w) if x in self.vocabulary)
            for x in t:
                out[x] = out.get(x, 0) + 1
        return out


def weigh(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms = np.fromiter(counts, dtype=np.int64, count=len(counts))
    terms.sort()
    w = np.array([1.0 + math.log(counts[t]) if t else OTHER * math.log1p(counts[0]) for t in terms.tolist()]) * idf[terms]
    norm = np.sqrt(w @ w)
    return terms, w / norm if norm else w


def logistic(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method on the weighted, penalised log-likelihood."""
    beta = np.zeros(features.shape[1])
    penalty = ridge * np.eye(len(beta))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        grad = features.T @ (weights * (labels - p)) - penalty @ beta
        hess = (features * (weights * p * (1 - p))[:, None]).T @ features + penalty
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        beta += step if size < 5 else step * 5 / size
        if size < 1e-9:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "toxic", examples_per_class: int = 1500, k: int = 21, min_ratio: float = 12.0) -> Model | None:
    """A model from the labelled rows; None without both classes.

    At most examples_per_class rows of each class are used, those first by crc32 of their ids; this bound
    proves the size of what is broadcast to the scan of docs and of what comes back.
    """
    spark = docs.sparkSession
    pool = labels.select(id_col, F.col(label_col).alias("y")).where(F.col(id_col).isNotNull() & F.col("y").isin(0, 1))
    pool = pool.groupBy(id_col).agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in pool.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return None
    order = [F.crc32(F.concat(F.lit("example"), F.col(id_col).cast("string"))), F.col(id_col)]
    chosen = pool.where("y = 1").orderBy(*order).limit(examples_per_class).unionByName(pool.where("y = 0").orderBy(*order).limit(examples_per_class))
    # 2 x examples_per_class rows of two numbers
    sample = docs.select(id_col, "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), id_col).groupBy(id_col, "y").agg(F.min("text").alias("text")).select(id_col, "text", "y")
    staged = Staged(sample, "toxic-examples")
    sample = staged.df

    def first():
        def step(batch):
            ids, terms, ys = [], [], []
            for i, text, y in zip(*(batch.column(c).to_pylist() for c in range(3))):
                seen = {t for w in set(WORD.findall(text.lower())) for t in terms_of(w)}
                ids += [i] * len(seen)
                ys += [y] * len(seen)
                terms += seen
            return {"term": terms, "y": ys}

        return step

    seen = arrow_rows(sample, first, "term string, y int").groupBy("term").agg(F.sum("y").alias("a"), F.sum(F.lit(1) - F.col("y")).alias("b"))
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(n.get(1, 0)), float(n.get(0, 0))
    if not n1 or not n0:
        staged.drop()
        return None
    a, b, t = F.col("a").cast("double"), F.col("b").cast("double"), (F.col("a") + F.col("b")).cast("double")
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    ratio = 2 * (part(a, t * n1 / (n1 + n0)) + part(b, t * n0 / (n1 + n0)) + part(n1 - a, n1 - t * n1 / (n1 + n0)) + part(n0 - b, n0 - t * n0 / (n1 + n0)))
    one_sided = ((a * n0 > b * n1 * 3) & (a >= 2)) | ((b * n1 > a * n0 * 3) & (b >= 2))
    best = seen.where(one_sided).withColumn("g", F.round(ratio, 9)).where(F.col("g") >= min_ratio).orderBy(F.desc("g"), "term")
    vocabulary = {r["term"]: i for i, r in enumerate(collected(best.select("term")), 1)}  # terms of the examples only
    total, df = document_frequencies(docs, vocabulary)
    idf = np.log((1 + total) / (1 + df)) + 1.0
    idf[0] = 1.0

    def second():
        vectors = Vectors(vocabulary)

        def step(batch):
            at, w = [], []
            for text in batch.column(1).to_pylist():
                terms, weights = weigh(vectors.counts(text), idf)
                at.append(terms)
                w.append(weights)
            return {"id": batch.column(0), "y": batch.column(2), "terms": at, "weights": w}

        return step

    kind = dict(sample.dtypes)[id_col]
    rows = sorted(collected(arrow_rows(sample, second, f"id {kind}, y int, terms array<long>, weights array<double>")), key=lambda r: r["id"])
    staged.drop()
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    ids = np.array([r["id"] for r in rows])
    vectors = [(np.array(r["terms"], dtype=np.int64), np.array(r["weights"])) for r in rows]
    used = [i for i, (t, _) in enumerate(vectors) if len(t)]
    # examples without terms are no neighbours of anything; they count in the curve below. Examples that share
    # their main term, and weigh all words alike, share blocks, so that bounds are tight
    main = lambda t, w: int(t[t > 0][np.argmax(w[t > 0])]) if (t > 0).any() else 0
    order_ = sorted(used, key=lambda i: (main(*vectors[i]), vectors[i][1][0] if vectors[i][0][0] == 0 else 0.0, i))
    share = sizes[1] / (sizes[0] + sizes[1])
    model = Model(vocabulary, idf, ids[order_], y[order_], Rows.of([vectors[i] for i in order_]), k, share, np.zeros(3))
    index = Index(model)
    place = {e: i for i, e in enumerate(order_)}
    none = (np.empty(0, dtype=np.int64), np.empty(0))
    features = [index.vote(*(index.nearest(t, w, k, place[i]) if len(t) else none)) for i, (t, w) in enumerate(vectors)]
    weights = np.where(y == 1, sizes[1] / n1, sizes[0] / n0)
    model.curve = logistic(np.array(features), y, weights * len(y) / weights.sum())
    return model


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[int, np.ndarray]:
    """Number of all documents, and of those with each term. Each task returns a row for each term that it met."""
    n = len(vocabulary) + 1

    def make():
        vectors = Vectors(vocabulary)
        df = np.zeros(n + 1, dtype=np.int64)

        def step(batch):
            texts = batch.column(0).to_pylist()
            df[n] += len(texts)
            for text in texts:
                if text:
                    df[list(vectors.counts(text))] += 1

        def finish():
            met = np.flatnonzero(df)
            return {"term": met, "n": df[met]}

        step.finish = finish
        return step

    rows = collected(arrow_rows(docs.select("text"), make, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")))  # a row a term at most
    df = np.zeros(n + 1)
    for r in rows:
        df[r["term"]] = r["n"]
    return int(df[n]), df[:n]


def decider(m: Model | None):
    """A function from a text to its score, the nearest examples, their cosines and the shared terms of most weight."""
    if m is None:
        return lambda text: (0.0, [], [], [])
    index, vectors, names = Index(m), Vectors(m.vocabulary), ["", *m.vocabulary]
    plain = index.nearest(np.zeros(1, dtype=np.int64), np.ones(1), m.k)  # of any text without vocabulary terms
    none = (np.empty(0, dtype=np.int64), np.empty(0))

    def decide(text: str | None):
        counts = vectors.counts(text) if text else {}
        terms, weights = weigh(counts, m.idf) if counts else (None, None)
        who, cos = (index.nearest(terms, weights, m.k) if len(counts) > 1 else plain) if counts and counts[0] else none
        p = float(1 / (1 + np.exp(-np.clip(index.vote(who, cos) @ m.curve, -30, 30))))
        shared = index.shared(terms, weights, who) if len(who) else np.empty(0)
        evidence = [names[terms[t]] for t in np.argsort(-shared, kind="stable")[:6] if shared[t] > 0 and terms[t]]
        return p, m.ids[who[:5]], cos[:5], evidence

    return decide


def score(docs: DataFrame, model: Model | None, *, id_col: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """Per row of docs: id, score, predicted, the nearest examples, their cosines and the shared terms of most weight."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, score double, predicted int, neighbours array<{kind}>, cosines array<double>, evidence array<string>"
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit's parameters

    def make():
        decide = decider(held.value)

        def step(batch):
            found = [decide(text) for text in batch.column(1).to_pylist()]
            return {
                id_col: batch.column(0),
                "score": [p for p, *_ in found],
                "predicted": [int(p >= threshold) for p, *_ in found],
                "neighbours": [x for _, x, _, _ in found],
                "cosines": [x for _, _, x, _ in found],
                "evidence": [x for _, _, _, x in found],
            }

        return step

    return arrow_rows(docs.select(id_col, "text"), make, schema)


def without_toxic(docs: DataFrame, model: Model | None, *, threshold: float = 0.7) -> DataFrame:
    """The rows of docs (all columns, in order) whose text scores below the threshold; decided row by row, without a join. They wait in the shared folder."""
    columns = docs.columns
    at = columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        decide = decider(held.value)

        def step(batch):
            keep = [i for i, text in enumerate(batch.column(at).to_pylist()) if decide(text)[0] < threshold]
            kept = batch.take(pa.array(keep, type=pa.int64()))
            return {c: kept.column(k) for k, c in enumerate(columns)}

        return step

    return Staged(arrow_rows(docs, make, docs.schema), "clean").df


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """Learns from the labels that aren't held out, and scores every row of docs."""
    model = fit(docs, labels.where(~held_out()), **params)
    return score(docs, model).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
