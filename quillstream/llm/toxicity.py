"""Toxicity by non-negative positive-unlabelled learning (operator 4).

A text is its set of distinct lower-case words; a word's features are itself and its prefixes of
MIN_PREFIX to MAX_PREFIX letters. A linear classifier over the features that confirmed toxic texts
have more often than unlabelled ones is trained in numpy with the non-negative PU risk

    prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])

with the sigmoid loss, so the toxic texts among the unlabelled ones are not learnt as clean. The
class prior is the share of toxic texts among the labelled training rows. A text's score adds up
word scores, so scoring is one dictionary look-up for each distinct word and never cuts a text.

The classifier is fitted on bounded samples: the POSITIVES confirmed texts and the UNLABELLED among all documents with the
least hashed ids, each read whole. Features are counted and chosen where the texts are; the driver gets at most
FEATURES of them and the sample's sparse rows over these. All else covers every row.

Defined results: null and empty texts have no words and score as the bias alone; texts of any length are read whole;
without a confirmed toxic text nothing is toxic (score 0); repeated rows stay; an empty table gives an empty
result. Only `text` is an input of a score; further columns are ignored (reject_toxic passes them through), whatever
their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fold, materialize, sample_ids, tidy, whole_text

POSITIVES, UNLABELLED = 2000, 5000
MIN_PREFIX, MAX_PREFIX = 3, 8
FEATURES = 1024
LEAST_TEXTS = 3  # positive texts that have a feature
SAMPLE_FILES = 8
EVIDENCE = 4.0  # standard errors by which a feature must be more frequent in toxic texts
STEPS, RATE = 400, 0.1
DECAY = 0.02  # of the weights, divided by the number of positive texts
WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(word: str) -> list[str]:
    """The word (marked with =) and its prefixes (marked with ^)."""
    return ["=" + word] + ["^" + word[:k] for k in range(MIN_PREFIX, min(MAX_PREFIX, len(word)) + 1)]


@dataclass(frozen=True)
class Classifier:
    weights: dict[str, float]
    bias: float

    def word_score(self, word: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features(word))

    def scores(self, texts: list[str], known: dict[str, float]) -> np.ndarray:
        """Probabilities; `known` keeps the scores of words."""
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            total = self.bias
            for w in words(text):
                s = known.get(w)
                if s is None:
                    if len(known) > 1 << 17:
                        known.clear()
                    s = known[w] = self.word_score(w)
                total += s
            out[i] = total
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


#: Rejects everything's being toxic: what is fitted where no text is confirmed.
NOTHING = Classifier({}, -500.0)


@dataclass(frozen=True)
class Sparse:
    """A matrix by its entries; the last column is the constant one."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, counts: list[dict[int, int]], width: int) -> Sparse:
        lengths = [len(c) + 1 for c in counts]
        columns = np.array([j for c in counts for j in (*c, width)], np.int64)
        values = np.array([v for c in counts for v in (*c.values(), 1)], np.float64)
        return cls(np.repeat(np.arange(len(counts)), lengths), columns, values, (len(counts), width + 1))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.columns], self.shape[0])

    def mean_by_column(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * per_row[self.rows], self.shape[1]) / max(1, self.shape[0])


def feature_counts(text: str, index: dict[str, int]) -> dict[int, int]:
    """How many distinct words of the text have each of the indexed features."""
    out: Counter = Counter()
    for w in words(text):
        out.update(j for f in features(w) if (j := index.get(f)) is not None)
    return dict(sorted(out.items()))


def select_features(positive: list[str], unlabelled: list[str]) -> list[str]:
    """The features with the strongest evidence of being more frequent in positive texts, of texts at hand."""
    in_p: Counter = Counter()
    for text in positive:
        in_p.update({f for w in words(text) for f in features(w)})
    in_u: Counter = Counter()
    for text in unlabelled:
        in_u.update({f for w in words(text) for f in features(w)} & in_p.keys())
    chosen = []
    for f, n in in_p.items():
        if n < LEAST_TEXTS:
            continue
        p, u = n / len(positive), in_u[f] / max(1, len(unlabelled))
        pooled = (n + in_u[f] + 1) / (len(positive) + len(unlabelled) + 2)
        z = (p - u) / np.sqrt(pooled * (1 - pooled) * (1 / len(positive) + 1 / max(1, len(unlabelled))))
        if z >= EVIDENCE and p >= 2 * u:
            chosen.append((-z, f))
    return [f for _, f in sorted(chosen)[:FEATURES]]


def _chosen_features(texts: DataFrame, n_positive: int, n_unlabelled: int) -> list[str]:
    """select_features() of a table (p, text): p is 1 for positive texts, 0 for unlabelled ones."""

    def of(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: list({f for w in words(x) for f in features(w)}))

    each = texts.select("p", F.explode(F.pandas_udf(tidy(of), "array<string>")(F.col("text"))).alias("feature"))
    found = each.groupBy("feature").agg(F.sum("p").cast("double").alias("n"), F.sum(1 - F.col("p")).cast("double").alias("m")).where(F.col("n") >= LEAST_TEXTS)
    several = float(max(1, n_unlabelled))
    p, u = F.col("n") / float(n_positive), F.col("m") / several
    pooled = (F.col("n") + F.col("m") + 1.0) / float(n_positive + n_unlabelled + 2)
    z = (p - u) / F.sqrt(pooled * (1.0 - pooled) * (1 / n_positive + 1 / several))
    found = found.select("feature", z.alias("z"), (p >= 2 * u).alias("more")).where((F.col("z") >= EVIDENCE) & F.col("more"))
    return [r.feature for r in found.orderBy(F.desc("z"), "feature").limit(FEATURES).collect()]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def risk(w: np.ndarray, positive: Sparse, unlabelled: Sparse, prior: float) -> tuple[float, float]:
    """The positive and the negative part of the PU risk; loss(g) is sigmoid(-g). The second may come out below zero."""
    sp, su = _sigmoid(positive.times(w)), _sigmoid(unlabelled.times(w))
    return prior * (1 - sp).mean(), (su.mean() if len(su) else 0.0) - prior * sp.mean()


def risk_gradient(w: np.ndarray, positive: Sparse, unlabelled: Sparse, prior: float) -> np.ndarray:
    """The direction to go down from: the gradient of both parts, or where the negative part is below zero
    that of its opposite, which undoes the overfit."""
    sp, su = _sigmoid(positive.times(w)), _sigmoid(unlabelled.times(w))
    # The derivative of sigmoid(-g) is -s(1-s), that of sigmoid(g) is s(1-s).
    slope_p, slope_u = positive.mean_by_column(sp * (1 - sp)), unlabelled.mean_by_column(su * (1 - su))
    if (su.mean() if len(su) else 0.0) - prior * sp.mean() >= 0:
        return -prior * slope_p + slope_u - prior * slope_p
    return prior * slope_p - slope_u


def nnpu(positive: Sparse, unlabelled: Sparse, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk, by Adam on the full sample."""
    d = positive.shape[1]
    w = np.zeros(d)
    w[-1] = -1.0
    first, second = np.zeros(d), np.zeros(d)
    for t in range(1, STEPS + 1):
        gradient = risk_gradient(w, positive, unlabelled, prior)
        gradient[:-1] += DECAY / positive.shape[0] * w[:-1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _trained(chosen: list[str], positive: list[dict[int, int]], unlabelled: list[dict[int, int]], prior: float) -> Classifier:
    if not chosen:
        return NOTHING
    weights, bias = nnpu(Sparse.of(positive, len(chosen)), Sparse.of(unlabelled, len(chosen)), prior)
    return Classifier({f: float(w) for f, w in zip(chosen, weights, strict=True) if abs(w) > 1e-6}, bias)


def fit_texts(positive: list[str], unlabelled: list[str], prior: float) -> Classifier:
    """Train on texts at hand. prior: the share of toxic texts among the unlabelled."""
    if not positive:
        return NOTHING
    chosen = select_features(positive, unlabelled)
    index = {f: i for i, f in enumerate(chosen)}
    return _trained(chosen, [feature_counts(x, index) for x in positive], [feature_counts(x, index) for x in unlabelled], prior)


def sample(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[DataFrame, float]:
    """The rows to fit on, (doc_id, p, text), and the class prior; rows that share an id count once.

    Several labels of one document count as toxic if any does; null labels count as none.
    """
    toxic = labels.where("toxic is not null and doc_id is not null").where(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = toxic.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    chosen = sample_ids(toxic.where("toxic = 1"), POSITIVES).withColumn("p", F.lit(1))
    # A sample of all texts: among them the prior is the same as among the labelled ones.
    unlabelled = sample_ids(docs.select("doc_id").where(learn), UNLABELLED).withColumn("p", F.lit(0))
    # Both samples are bounded, so this side is broadcast.
    ids = F.broadcast(chosen.union(unlabelled))
    found = docs.select("doc_id", whole_text().alias("text")).join(ids, "doc_id").groupBy("doc_id", "p").agg(F.min("text").alias("text"))
    return found, float((counts.toxic or 0) / max(1, counts.n))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Classifier:
    """Train on docs (doc_id, text) and labels (doc_id, toxic); only rows where `learn` holds are used."""
    bound_batches(docs.sparkSession)
    texts, prior = sample(docs, labels, fold(F.col("doc_id")) != 0 if learn is None else learn)
    if not prior:
        return NOTHING
    texts = materialize(texts, "sample", SAMPLE_FILES)
    size = {r.p: r["count"] for r in texts.groupBy("p").count().collect()}
    if not size.get(1):
        return NOTHING
    chosen = _chosen_features(texts, size[1], size.get(0, 0))
    index = {f: i for i, f in enumerate(chosen)}

    def counted(batch: pd.Series) -> pd.DataFrame:
        rows = [feature_counts(x, index) for x in batch]
        return pd.DataFrame({"columns": [list(r) for r in rows], "counts": [list(r.values()) for r in rows]})

    entries = F.pandas_udf(tidy(counted), "columns array<int>, counts array<int>")(F.col("text"))
    rows = texts.select("doc_id", "p", entries.alias("x")).select("doc_id", "p", "x.*").orderBy("doc_id").collect()
    of = lambda p: [dict(zip(r["columns"], r.counts, strict=True)) for r in rows if r.p == p]
    return _trained(chosen, of(1), of(0), prior)


def probability(text: Column, classifier: Classifier) -> Column:
    """0 to 1, above a half for toxic."""
    known: dict[str, float] = {}

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(classifier.scores(list(texts), known))

    return F.pandas_udf(tidy(score), "double")(text)


def score_documents(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    bound_batches(docs.sparkSession)
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), probability(whole_text(), classifier).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """docs without the texts that score a half or more."""
    bound_batches(docs.sparkSession)
    return docs.where(probability(whole_text(), classifier) < 0.5)
