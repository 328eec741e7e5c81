"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other, each by a logistic regression
whose inputs are a document's words, the stems of its words (their first
letters, which inflected languages share) and the probabilities of the earlier
categories.  In training these probabilities are out-of-fold predictions, so
that a later model sees them as noisy as they will be in use.  Which words and
stems count is decided by chi-square on the rows a model is fitted to, for each
fold anew; every one that is significant is used, weaker ones with smaller
inputs, so that they do not drown the strong ones.

Labels tell only whether a document is toxic.  The earlier categories are weak
labels found in the labelled rows: the indicative word or stem that most toxic
documents of no category yet have, with those that mostly occur beside it, makes
a category, and a toxic document that has one of these belongs to it.  Such
clusters follow the languages and manners of abuse; they have no names.  For
the out-of-fold predictions they are found anew without the documents of the
fold, so a document's own label has no part in its prediction, and matched to
those of all rows by the documents they share.  A kind of fewer than
``MIN_DOCS`` toxic documents makes no category: where fewer kinds are found than
the chain has places, the rest are constants, and later models do not use them.
All documents of a category are toxic, so an earlier category that would speak
against a later one is taken out of that model.

Training fits on a bounded sample of labelled documents (``max_rows``, taken by
a hash of the id).  What reaches the driver is the counts of words and stems of
``MIN_DOCS`` documents or more, and for each document the numbers of the
significant ones.  The models are small and are applied to every whole text.

Edge cases: a null or empty text has no words and gets the base rates; with no
labelled rows, or labels of one kind only, a category's probability is that
constant share (0 if there are no rows), null labels are no labels, and of a
document labelled twice the toxic label counts; of documents that share an id
the first text in order is the labelled one; a very long text counts as the set
of all its words; a probability of exactly the threshold is toxic; repeated rows
and equal texts get equal results; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle

WORDS = re.compile(r"\w+")
#: Lengths of stems; a stem is written with a star behind it.
STEMS = (4, 5, 6, 7)
CATEGORIES = ("category_1", "category_2", "category_3", "category_4")
FINAL = "toxic"
MAX_ROWS = 6000
FOLDS = 5
RIDGE = 0.05
MIN_DOCS = 5
#: Chi-square from which a word counts (one in a hundred unrelated ones reaches it).
LEAST_CHI2 = 6.63
#: Share of a word's toxic documents that must have a category's first word for it to join.
BESIDE = 0.3
THRESHOLD = 0.5


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


def features_of(text: str | None) -> set[str]:
    """The words of a text and their stems."""
    words = words_of(text)
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in STEMS))


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, dense: np.ndarray, y: np.ndarray, used: np.ndarray, ridge: float = RIDGE, rounds: int = 150, memory: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the words, and of the dense inputs with the intercept last, by L-BFGS with a ridge penalty on all but the intercept.

    Row rows[k] has word cols[k], whose input is scale[cols[k]]; only rows of ``used`` count.
    """
    n, d = len(y), len(scale)
    keep = used[rows]
    rows, cols = rows[keep], cols[keep]
    dense = np.hstack([dense, np.ones((n, 1))])
    pen = np.full(d + dense.shape[1], ridge)
    pen[-1] = 1e-6

    def value(w):
        z = np.bincount(rows, (w[:d] * scale)[cols], n) + dense @ w[d:]
        g = (sigmoid(z) - y) * used
        loss = ((np.logaddexp(0, z) - y * z) * used).sum() + (pen * w * w).sum() / 2
        return loss, np.concatenate([np.bincount(cols, g[rows], d) * scale, dense.T @ g]) + pen * w

    w, past = np.zeros(len(pen)), []
    f, g = value(w)
    for _ in range(rounds):
        q, backs = g.copy(), []
        for s, t in reversed(past):
            backs.append(s @ q / (s @ t))
            q -= backs[-1] * t
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(np.linalg.norm(g), 1)
        for (s, t), a in zip(past, reversed(backs), strict=True):
            q += s * (a - t @ q / (s @ t))
        step = 1.0
        w2, (f2, g2) = w - q, value(w - q)
        while f2 > f - 1e-4 * step * (q @ g) and step > 1e-6:
            step /= 2
            w2, (f2, g2) = w - step * q, value(w - step * q)
        if f2 > f:
            break
        if (g2 - g) @ (w2 - w) > 1e-12:
            past = [*past, (w2 - w, g2 - g)][-memory:]
        done = f - f2 < 1e-6 * abs(f)
        w, f, g = w2, f2, g2
        if done:
            break
    return w[:d] * scale, w[d:]


@dataclass(frozen=True)
class Chain:
    """Models of the categories in order: a weight of each feature, weights of the earlier categories, intercepts."""

    categories: tuple[str, ...]
    features: tuple[str, ...]
    weights: np.ndarray
    earlier: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]

    def indexed(self) -> Indexed:
        return Indexed(self)


class Indexed:
    """The chain with its features at hand by kind."""

    def __init__(self, chain: Chain):
        self.chain, self.words, self.stems = chain, {}, {k: {} for k in STEMS}
        for i, f in enumerate(chain.features):
            if f.endswith("*"):
                self.stems[len(f) - 1][f[:-1]] = i
            else:
                self.words[f] = i

    def predict(self, text: str | None) -> list[float]:
        words = words_of(text)
        found = [self.words[w] for w in words & self.words.keys()]
        for k, stems in self.stems.items():
            found += [stems[s] for s in {w[:k] for w in words if len(w) > k} & stems.keys()]
        margins = self.chain.weights[sorted(found)].sum(axis=0)
        out: list[float] = []
        for m, earlier, intercept in zip(margins, self.chain.earlier, self.chain.intercepts, strict=True):
            out.append(float(sigmoid(np.float64(m + intercept + sum(a * p for a, p in zip(earlier, out, strict=True))))))
        return out


def chi_square(df: np.ndarray, pos: np.ndarray, n: float, p: float) -> np.ndarray:
    """Of features in df of n rows, pos of them among the p rows of the class."""
    e = df * p / max(n, 1)
    return (pos - e) ** 2 / np.maximum(e * (1 - df / max(n, 1)) * (1 - p / max(n, 1)), 1e-9) * (p > 0) * (p < n)


class Bags:
    """Documents as the numbers of their features."""

    def __init__(self, found: list[np.ndarray], size: int):
        self.n, self.size = len(found), size
        self.row = np.repeat(np.arange(self.n), [len(x) for x in found])
        self.col = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """For each feature how many of the rows (a mask) have it."""
        return np.bincount(self.col[rows[self.row]], minlength=self.size).astype(float)

    def having(self, features: np.ndarray) -> np.ndarray:
        """Documents with any of the features (a mask)."""
        out = np.zeros(self.n, bool)
        out[self.row[features[self.col]]] = True
        return out

    def scale(self, y: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Input of each feature for a model fitted to the rows used: 0 unless significant there, 1 if beyond what chance gives."""
        chi = chi_square(self.counts(used), self.counts(used & (y > 0)), used.sum(), y[used].sum())
        level = 2 * float(np.log(max(self.size, 2)))
        return np.where(chi >= LEAST_CHI2, np.minimum(1, chi / level) ** 2, 0.0)


def weak_categories(bags: Bags, toxic: np.ndarray, how_many: int, used: np.ndarray) -> list[np.ndarray]:
    """Weak labels of the categories that the toxic documents among those used fall into, the largest first; all 0 where there are no more."""
    hit, n = (toxic > 0) & used, used.sum()
    df, pos = bags.counts(used), bags.counts(hit)
    chi = chi_square(df, pos, n, hit.sum())
    indicative = (chi > 2 * np.log(max(bags.size, 2))) & (pos * max(n, 1) > df * hit.sum())
    out, open_ = [], hit.copy()
    for _ in range(how_many):
        covers = np.where(indicative, bags.counts(open_), 0)
        if not covers.size or covers.max() < MIN_DOCS:
            out.append(np.zeros(bags.n))
            continue
        first = np.arange(bags.size) == np.lexsort((np.arange(bags.size), -chi, -covers))[0]
        beside = bags.counts(hit & bags.having(first))
        label = hit & bags.having(indicative & (beside >= BESIDE * np.maximum(pos, 1)))
        out.append(label.astype(float))
        open_ &= ~label
    return out


def matched(found: list[np.ndarray], to: list[np.ndarray]) -> list[np.ndarray]:
    """The categories found, in the order of those that they share most documents with."""
    left, out = list(found), []
    for y in to:
        best = max(range(len(left)), key=lambda k: (float(left[k] @ y), -k))
        out.append(left.pop(best))
    return out


def fit_chain(features: list[str], bags: Bags, labels: dict[str, np.ndarray], folds: np.ndarray, without: dict[int, dict[str, np.ndarray]] | None = None) -> Chain:
    """Fit the models in the order of ``labels``; ``folds`` numbers each row's fold, ``without`` has the labels found without a fold."""
    weights, before, intercepts, earlier = [], [], [], np.zeros((bags.n, 0))
    for name, y in labels.items():
        if not bags.n or y.all() or not y.any():
            base = float(np.clip(y.mean() if bags.n else 0.0, 1e-9, 1 - 1e-9))
            weights.append(np.zeros(bags.size))
            before.append((0.0,) * earlier.shape[1])
            intercepts.append(float(np.log(base / (1 - base))))
            earlier = np.hstack([earlier, np.full((bags.n, 1), base)])
            continue

        def fit(used: np.ndarray, y: np.ndarray, earlier: np.ndarray = earlier) -> tuple[np.ndarray, np.ndarray]:
            scale, own = bags.scale(y, used), np.flatnonzero(np.ptp(earlier, axis=0) > 0) if bags.n else np.zeros(0, int)
            while True:
                w, v = fit_logistic(bags.row, bags.col, scale, earlier[:, own], y, used)
                if (v[:-1] >= 0).all():
                    break
                own = own[v[:-1] >= 0]
            whole = np.zeros(earlier.shape[1] + 1)
            whole[own], whole[-1] = v[:-1], v[-1]
            return w, whole

        oof = np.zeros(bags.n)
        for f in np.unique(folds):
            out, rest = folds == f, folds != f
            own = (without or {}).get(int(f), {}).get(name, y)
            if rest.any() and 0 < own[rest].sum() < rest.sum():
                w, v = fit(rest, own)
                oof[out] = sigmoid(np.bincount(bags.row, w[bags.col], bags.n) + earlier @ v[:-1] + v[-1])[out]
            else:
                oof[out] = own[rest].mean() if rest.any() else y.mean()
        w, v = fit(np.ones(bags.n, bool), y)
        weights.append(w)
        before.append(tuple(map(float, v[:-1])))
        intercepts.append(float(v[-1]))
        earlier = np.hstack([earlier, oof[:, None]])
    used = np.flatnonzero(np.any(weights, axis=0)) if bags.size else np.zeros(0, np.int64)
    matrix = np.array(weights).T[used] if bags.size else np.zeros((0, len(labels)))
    return Chain(tuple(labels), tuple(features[i] for i in used), matrix, tuple(before), tuple(intercepts))


def feature_counts(rows: DataFrame, folds: int) -> pd.DataFrame:
    """feature, and for each fold and label how many documents have it; features of MIN_DOCS documents or more."""
    cells = 2 * folds

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = {}
        for f in frames:
            for text, cell in zip(f["text"], f["cell"], strict=True):
                for x in features_of(text):
                    if (c := held.get(x)) is None:
                        c = held[x] = [0] * cells
                    c[cell] += 1
        keys = list(held)
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            table = np.array([held[k] for k in part], np.int32)
            yield pd.DataFrame({"feature": part} | {f"c{j}": table[:, j] for j in range(cells)})

    names = [f"c{j}" for j in range(cells)]
    each = rows.select("text", (F.col("fold") * 2 + F.col("toxic")).cast("int").alias("cell")).mapInPandas(count, "feature string, " + ", ".join(f"{n} int" for n in names))
    total = each.groupBy("feature").agg(*[F.sum(n).cast("int").alias(n) for n in names])
    return total.where(sum((F.col(n) for n in names), F.lit(0)) >= MIN_DOCS).toPandas()


def significant(counts: pd.DataFrame, sizes: np.ndarray, folds: int) -> list[str]:
    """Features whose chi-square counts on all rows, or on those outside of some fold; in order."""
    c = counts.drop(columns="feature").to_numpy(dtype=float).reshape(len(counts), folds, 2)
    best = chi_square(c.sum((1, 2)), c[:, :, 1].sum(1), sizes.sum(), sizes[:, 1].sum())
    for f in range(folds):
        rest = np.arange(folds) != f
        best = np.maximum(best, chi_square(c[:, rest].sum((1, 2)), c[:, rest, 1].sum(1), sizes[rest].sum(), sizes[rest, 1].sum()))
    return sorted(counts["feature"][best >= LEAST_CHI2])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, folds: int = FOLDS, categories: tuple[str, ...] = CATEGORIES) -> Chain:
    """Fit the chain on at most ``max_rows`` labelled documents, the first by a hash of the id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows narrow rows
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = settle(rows.withColumn("fold", F.pmod(F.col("doc_id"), F.lit(folds)).cast("int")), "labelled")
    sizes = np.zeros((folds, 2))
    for r in rows.groupBy("fold", "toxic").count().collect():  # a row a fold and label
        sizes[r.fold, r.toxic] = r["count"]
    features = significant(feature_counts(rows, folds), sizes, folds)
    number = {f: i for i, f in enumerate(features)}

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [np.sort(np.fromiter((number[x] for x in features_of(t) & number.keys()), np.int32)).tobytes() for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "toxic": f["toxic"], "fold": f["fold"], "found": found})

    got = rows.mapInPandas(find, "doc_id long, toxic int, fold int, found binary").toPandas().sort_values("doc_id", kind="stable")
    bags = Bags([np.frombuffer(x, np.int32) for x in got["found"]], len(features))
    toxic = got["toxic"].to_numpy(dtype=float)
    fold = got["fold"].to_numpy(dtype=np.int64)
    kinds = weak_categories(bags, toxic, len(categories), np.ones(bags.n, bool))
    without = {}
    for f in np.unique(fold).tolist():
        without[f] = dict(zip(categories, matched(weak_categories(bags, toxic, len(categories), fold != f), kinds), strict=True))
    return fit_chain(features, bags, dict(zip(categories, kinds, strict=True)) | {FINAL: toxic}, fold, without)


def predictor(chain: Chain):
    """A column function: text -> struct of a probability for each category."""
    names = list(chain.categories)

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = chain.indexed()
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=names, dtype=float)

    return predict


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a probability for each category, and is_toxic for the last one."""
    got = docs.select("doc_id", predictor(chain)(F.col("text")).alias("p")).select("doc_id", "p.*")
    return got.withColumn("is_toxic", F.col(chain.categories[-1]) >= threshold)
