"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; a later model sees, besides the words of a
text, the probabilities of the categories before it.  In training those come from
out-of-fold models, so that a later model learns from probabilities of the quality it
will meet.  The models are logistic regressions on the presence of words and
of word beginnings, with a vocabulary of those most associated with a category.

The label table has two flags, so the chain of the query is low quality, then toxicity;
:func:`train` takes any list of label columns.

Training uses at most ``max_labelled`` labelled ids (those with the lowest hash) and as
many rows of them, a bound that also makes the broadcast of the ids safe; what comes to the driver is
at most that many lists of at most ``vocabulary`` word numbers.  Scoring reads every
text once, where it lies.

Defined results: a null text has no words; label rows with a null id or category don't
count, of repeated ones the highest value of each category counts; a category without
both values gets its constant share, and nothing is called positive in it without
positive labels; repeated rows and null ids are scored like any row; other columns are
kept by :func:`score` and not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import checkpoint, text_or_empty

#: Characters of a word that stand for its stem.
STEMS = (5,)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """Lower-case words and, for the many forms of one stem, their first characters marked by ``^``."""
    words = set(_WORD.findall((text or "").lower()))
    return words.union(*({"^" + w[:n] for w in words if len(w) > n} for n in STEMS))


@dataclass
class Chain:
    """Fitted models: weights[c] over the vocabulary, links[c] over earlier probabilities, and cutoffs."""

    categories: tuple[str, ...]
    vocabulary: dict[str, int]
    weights: np.ndarray
    links: list[np.ndarray]
    biases: np.ndarray
    cutoffs: np.ndarray

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """One row a text, one column a category: a sparse product with the weights, then the links in order."""
        known = self.vocabulary
        at = [[known[w] for w in known.keys() & words_of(t)] for t in texts]
        rows = np.repeat(np.arange(len(at)), [len(x) for x in at])
        cols = np.array([k for x in at for k in x], dtype=np.int64)
        out = np.zeros((len(at), len(self.categories)))
        for c in range(len(self.categories)):
            z = np.bincount(rows, weights=self.weights[c][cols], minlength=len(at)) + self.biases[c] + out[:, :c] @ self.links[c]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit_logistic(rows: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, n_cols: int, ridge: float = 1.0, steps: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of binary features (rows, cols), of the dense columns ``extra``, and a bias, by accelerated descent."""
    n, k = extra.shape
    share = (y.sum() + 0.5) / (n + 1)
    bias = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return np.zeros(n_cols), np.zeros(k), bias
    # steps are scaled by each feature's curvature; a row shares its curvature among its features
    many = np.bincount(rows, minlength=n) + (extra**2).sum(axis=1) + 1.0
    scale = 1 / np.concatenate([np.bincount(cols, weights=many[rows], minlength=n_cols) / 4 + ridge, ((extra**2) * many[:, None]).sum(axis=0) / 4 + ridge, [many.sum() / 4]])
    w = np.concatenate([np.zeros(n_cols + k), [bias]])
    ahead = w
    for t in range(steps):
        z = np.bincount(rows, weights=ahead[cols], minlength=n) + extra @ ahead[n_cols : n_cols + k] + ahead[-1]
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        slope = np.concatenate([np.bincount(cols, weights=off[rows], minlength=n_cols), extra.T @ off, [off.sum()]])
        slope[:-1] += ridge * ahead[:-1]
        new = ahead - scale * slope
        ahead = new + t / (t + 3) * (new - w)
        w = new
    return w[:n_cols], w[n_cols : n_cols + k], float(w[-1])


def _best_cutoff(p: np.ndarray, y: np.ndarray) -> float:
    """The cutoff with the best F1 on out-of-fold probabilities; over 1 without positives."""
    if not y.any():
        return 2.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[order][1:] != p[order][:-1], True)
    at = int(np.argmax(np.where(last, f1, -1)))
    after = p[order][at + 1] if at + 1 < len(y) else 0.0
    return float((p[order][at] + after) / 2)


def _association(n: Column, pos: Column, total: Column, all_pos: Column) -> Column:
    share = all_pos / F.greatest(F.lit(1.0), total)
    expected = n * share
    return F.abs(pos - expected) / F.sqrt(expected * (1 - share) + 0.5)


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000, vocabulary: int = 1024, folds: int = 3) -> Chain:
    """Fits the chain on a bounded sample of the labelled rows."""
    c_all = range(len(categories))
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (id_col, *categories)])
    one = labels.where(ok).groupBy(F.col(id_col).alias("of_id")).agg(*(F.max(F.col(c).cast("int")).alias(f"y{i}") for i, c in enumerate(categories)))
    sample = one.orderBy(F.xxhash64("of_id"), "of_id").limit(max_labelled)
    text = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(words_of(t)))

    fold = F.pmod(F.xxhash64(F.col("id"), F.lit("fold")), F.lit(folds)).cast("int").alias("fold")
    # documents may repeat an id, so the rows are bounded too
    matched = text.join(F.broadcast(sample), F.col("id") == F.col("of_id")).orderBy(F.xxhash64("id", "text"), "id").limit(max_labelled)
    known = checkpoint(matched.select(fold, *(f"y{i}" for i in c_all), terms("text").alias("terms")))
    totals = known.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(f"y{i}").alias(f"y{i}") for i in c_all)).collect()
    n_f = {r["fold"]: r["n"] for r in totals}
    y_f = {(r["fold"], i): r[f"y{i}"] for r in totals for i in c_all}
    if not totals:
        return Chain(tuple(categories), {}, np.zeros((len(categories), 0)), [np.zeros(i) for i in c_all], np.full(len(categories), -30.0), np.full(len(categories), 2.0))
    # associations of every word on the rows outside each fold, and on all rows (fold -1)
    by = known.select("fold", *(f"y{i}" for i in c_all), F.explode("terms").alias("term"))
    hit = lambda f, x: F.sum(F.when(F.col("fold") != f, x).otherwise(0))
    views = [*range(folds), -1]
    counted = by.groupBy("term").agg(*(hit(f, F.lit(1)).alias(f"n_{f + 1}") for f in views), *(hit(f, F.col(f"y{i}")).alias(f"p_{f + 1}_{i}") for f in views for i in c_all)).where("n_0 >= 3")
    z = [
        F.round(_association(F.col(f"n_{f + 1}"), F.col(f"p_{f + 1}_{i}"), F.lit(float(sum(n for g, n in n_f.items() if g != f))), F.lit(float(sum(y_f[g, i] for g in n_f if g != f)))), 6).alias(f"z_{f + 1}_{i}")
        for f in views
        for i in c_all
    ]
    scored = counted.select("term", *z)
    best = reduce(F.greatest, [F.col(c) for c in scored.columns[1:]]) if len(z) > 1 else F.col(scored.columns[1])
    chosen = scored.orderBy(best.desc(), "term").limit(2 * vocabulary).collect()
    vocab = {r["term"]: k for k, r in enumerate(chosen)}

    @F.pandas_udf("array<int>")
    def numbers(lists: pd.Series) -> pd.Series:
        return lists.map(lambda ts: [vocab[t] for t in ts if t in vocab])

    held = known.select("fold", *(f"y{i}" for i in c_all), numbers("terms").alias("at")).collect()
    of_fold = np.array([r["fold"] for r in held])
    lists = [r["at"] for r in held]
    rows = np.repeat(np.arange(len(held)), [len(x) for x in lists])
    cols = np.array([k for x in lists for k in x], dtype=np.int64)
    ys = np.array([[r[f"y{i}"] for i in c_all] for r in held], dtype=float)

    def usable(f: int, i: int) -> np.ndarray:
        s = np.array([r[f"z_{f + 1}_{i}"] for r in chosen])
        keep = np.zeros(len(chosen), dtype=bool)
        keep[np.argsort(-s, kind="stable")[:vocabulary]] = True
        return keep & (s > 3)

    def fit(f: int, i: int, extra: np.ndarray):
        rows_in = of_fold != f
        place = np.cumsum(rows_in) - 1
        on = rows_in[rows] & usable(f, i)[cols]
        return fit_logistic(place[rows[on]], cols[on], extra[rows_in], ys[rows_in, i], len(vocab))

    oof = np.zeros((len(held), len(categories)))
    weights, links, biases, cutoffs = [], [], [], []
    for i in c_all:
        earlier = oof[:, :i]
        for f in range(folds):
            own = of_fold == f
            if own.any() and not own.all():
                w, v, b = fit(f, i, earlier)
                sums = np.bincount(rows, weights=w[cols], minlength=len(held)) + earlier @ v + b
                oof[own, i] = 1 / (1 + np.exp(-np.clip(sums[own], -30, 30)))
        w, v, b = fit(-1, i, earlier)
        weights.append(w)
        links.append(v)
        biases.append(b)
        cutoffs.append(_best_cutoff(oof[:, i], ys[:, i]))
    stacked = np.array(weights).reshape(len(categories), -1)
    used = np.nonzero(np.abs(stacked).max(axis=0) > 1e-9)[0] if stacked.size else []
    words = list(vocab)
    return Chain(tuple(categories), {words[k]: n for n, k in enumerate(used)}, stacked[:, used], links, np.array(biases), np.array(cutoffs))


def score(docs: DataFrame, chain: Chain, text_col: str = "text", to: str = "probabilities") -> DataFrame:
    """Adds the array of the categories' probabilities as column ``to``."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(chain.probabilities(texts.tolist()).round(9).tolist(), index=texts.index, dtype=object)

    return docs.withColumn(to, run(text_or_empty(text_col)))


def is_positive(chain: Chain, category: str, scores: str = "probabilities") -> Column:
    i = chain.categories.index(category)
    return F.get(F.col(scores), F.lit(i)) > float(chain.cutoffs[i])


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text", category: str = "toxic") -> DataFrame:
    """The rows of ``docs`` not called toxic, with their own columns."""
    to = "__toxicity_scores"
    return score(docs, chain, text_col, to).where(~is_positive(chain, category, to)).select(*docs.columns)
