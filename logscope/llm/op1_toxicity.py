"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models on the presence of
words and word beginnings; each later model also sees the probabilities of the
categories before it.  In training those probabilities are out of fold: a row's value
comes from a model that did not see the row, so later models learn from values as good as
those they get when scoring.  The decision threshold of the last category is chosen on
its out-of-fold probabilities.

The models are fitted on at most ``sample`` labelled rows (the least by a hash of the id),
whose hashed terms reach the driver as integers; every document is scored on its whole
text, where it lies, without a shuffle.

Nulls: a null text counts as empty; a row with a null label or id is left out of training
but scored.  Without labelled rows, or with one class only, a category's probability is that
class's share (0 without rows).  Repeated rows are scored alike.  An empty table gives an
empty result.  ``reject`` keeps all columns of the documents as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed terms, folds, letters of a word beginning, and most terms a model uses.
BUCKETS, FOLDS, PREFIX, TERMS = 1 << 20, 3, 5, 3000
#: Most labelled rows that the models are fitted on.
SAMPLE = 8_000
#: Penalties of the fit, and its steps.
L1, L2, STEPS = 2e-4, 1e-5, 250
LETTERS = re.compile(r"[^\W\d_]+")


class _Buckets(dict):
    """Buckets of a word and of its beginning, remembered; the same for short words."""

    def __missing__(self, word: str) -> tuple[int, int]:
        from xxhash import xxh3_64_intdigest

        one = xxh3_64_intdigest(word) % BUCKETS
        got = (one, xxh3_64_intdigest("^" + word[:PREFIX]) % BUCKETS if len(word) > PREFIX else one)
        if len(self) > 300_000:
            self.clear()
        if len(word) < 64:
            self[word] = got
        return got


@lru_cache(maxsize=1)
def _buckets() -> _Buckets:
    return _Buckets()


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the terms of a text."""
    words = set(LETTERS.findall((text or "").lower()))
    both = np.array(list(map(_buckets().__getitem__, words)), np.int32)
    return np.unique(both) if len(words) else np.zeros(0, np.int32)


class Rows:
    """Sets of buckets as one sparse 0/1 matrix, with columns for earlier probabilities."""

    def __init__(self, sets: list[np.ndarray], extra: np.ndarray):
        self.at = np.concatenate([np.concatenate(sets), np.zeros(0, np.int32)]) if sets else np.zeros(0, np.int32)
        self.row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        self.n, self.extra = len(sets), extra

    def times(self, slot: np.ndarray, w: np.ndarray, we: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[slot[self.at]], self.n) + self.extra @ we


@dataclass
class Model:
    """A fitted link: weights by bucket, weights of the earlier probabilities, offset."""

    at: np.ndarray
    weight: np.ndarray
    earlier: np.ndarray
    offset: float

    def dense(self) -> np.ndarray:
        w = np.zeros(BUCKETS, np.float32)
        w[self.at] = self.weight
        return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: Rows, y: np.ndarray) -> Model:
    """Logistic regression with small L1 and L2 penalties, by accelerated gradient steps.

    Terms are screened first: the ``TERMS`` with the largest chi-square against the label,
    among those in at least three rows.
    """
    width = rows.extra.shape[1]
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(0, np.int32), np.zeros(0), np.zeros(width), 40.0 if share else -40.0)
    n1 = np.bincount(rows.at, y[rows.row], BUCKETS)
    n = np.bincount(rows.at, minlength=BUCKETS).astype(float)
    gap = n1 - n * share
    chi = np.where(n >= 3, gap * gap / np.maximum(n * share * (1 - share), 1e-9), 0)
    at = np.sort(np.argsort(-chi, kind="stable")[:TERMS])
    at = at[chi[at] > 0]
    slot = np.full(BUCKETS, -1)
    slot[at] = np.arange(len(at))
    keep = slot[rows.at] >= 0
    col, row, m = slot[rows.at[keep]], rows.row[keep], rows.n
    x = rows.extra

    def forward(w, e, b):
        return np.bincount(row, w[col], m) + x @ e + b

    # the largest curvature, by power iteration on X'X
    w, e, b = np.ones(len(at)), np.ones(width), 1.0
    for _ in range(12):
        z = forward(w, e, b)
        w, e, b = np.bincount(col, z[row], len(at)), x.T @ z, z.sum()
        size = np.sqrt((w * w).sum() + (e * e).sum() + b * b)
        w, e, b = w / size, e / size, b / size
    step = 1 / (0.25 * size / m * 1.05 + L2)
    w, e, b = np.zeros(len(at)), np.zeros(width), float(np.log(share / (1 - share)))
    pw, pe, pb, t = w, e, b, 1.0
    for _ in range(STEPS):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        k = (t - 1) / t2
        vw, ve, vb = w + k * (w - pw), e + k * (e - pe), b + k * (b - pb)
        r = (sigmoid(forward(vw, ve, vb)) - y) / m
        pw, pe, pb, t = w, e, b, t2
        w = vw - step * (np.bincount(col, r[row], len(at)) + L2 * vw)
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
        e = ve - step * (x.T @ r + L2 * ve)
        b = vb - step * r.sum()
    return Model(at[w != 0].astype(np.int32), w[w != 0], e, float(b))


@dataclass
class Chain:
    """Fitted models in the order of the categories, and the last one's threshold."""

    categories: list[str]
    models: list[Model] = field(default_factory=list)
    threshold: float = 0.5

    def scorer(self):
        """Probabilities of one text, category by category."""
        tables = np.stack([m.dense() for m in self.models], axis=1)

        def score(text: str | None) -> list[float]:
            sums, out = tables[terms(text)].sum(axis=0, dtype=np.float64), []
            for k, m in enumerate(self.models):
                out.append(float(sigmoid(sums[k] + m.offset + float(np.dot(m.earlier, out[:k])))))
            return out

        return score


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold from 0.05 to 0.95 with the best F1; the middle of equal ones."""
    cuts = np.arange(10, 191) / 200
    f1 = np.array([2 * (y * (p >= c)).sum() / max((p >= c).sum() + y.sum(), 1) for c in cuts])
    return float(np.median(cuts[f1 >= f1.max() - 1e-9]))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit the chain; ``categories`` name 0/1 columns computed from ``labels``, in order."""
    names = list(categories)
    known = labels.select(F.col(id_col).alias("id"), *(c.cast("double").alias(n) for n, c in categories.items())).dropna().distinct()
    known = known.orderBy(F.xxhash64("id"), *names).limit(sample)

    @F.pandas_udf("array<int>")
    def buckets(texts: pd.Series) -> pd.Series:
        return pd.Series([terms(t) for t in texts])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    rows = rows.select(F.xxhash64(F.lit("fold"), "id").alias("draw"), buckets("text").alias("terms"), *names)
    # within the bound even if ids repeat in the documents
    got = rows.orderBy("draw", *names).limit(sample).toArrow()
    fold = got.column("draw").to_numpy() % FOLDS
    sets = [np.array(x.values.to_numpy(zero_copy_only=False), np.int32) for x in got.column("terms")]
    answers = {name: got.column(name).to_numpy().astype(float) for name in names}
    del got
    chain, extra = Chain(names), np.zeros((len(sets), 0))
    for name in names:
        y = answers[name]
        held = np.zeros(len(y))
        for f in range(FOLDS):
            inside, outside = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            m = fit(Rows([sets[i] for i in outside], extra[outside]), y[outside])
            held[inside] = sigmoid(Rows([sets[i] for i in inside], extra[inside]).times(np.arange(BUCKETS), m.dense(), m.earlier) + m.offset)
        chain.models.append(fit(Rows(sets, extra), y))
        extra = np.hstack([extra, held[:, None]])
    if len(sets):
        chain.threshold = best_threshold(extra[:, -1], y)
    return chain


def probabilities(docs: DataFrame, chain: Chain, text_col: str = "text") -> Column:
    """Array of the categories' probabilities for the text of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        one = shared.value.scorer()
        return pd.Series([one(t) for t in texts])

    return score(F.col(text_col))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, p_<category> for each category, and the last category's decision."""
    rows = docs.select(F.col(id_col).alias("id"), probabilities(docs, chain, text_col).alias("p"))
    last = len(chain.categories) - 1
    return rows.select(F.col("id").alias(id_col), *(F.col("p")[k].alias(f"p_{n}") for k, n in enumerate(chain.categories)), (F.col("p")[last] >= chain.threshold).alias(chain.categories[-1]))


def reject(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with their columns, that the last category does not hit."""
    return docs.where(probabilities(docs, chain, text_col)[len(chain.categories) - 1] < chain.threshold)


def label_categories() -> dict[str, Column]:
    """Low quality first, then toxicity, as 0/1 columns of the labels table."""
    return {"low_quality": F.lit(1) - F.col("quality"), "toxic": F.col("toxic")}
