"""Operator 9: quality classifier, a regularised quadratic discriminant.

Document statistics are transformed towards symmetry, each class gets a mean and
a covariance shrunk towards the pooled one and towards its own diagonal, and the
score is the logistic of the difference of the two log densities, each a
Mahalanobis distance through a Cholesky factor that is computed once.

The fit covers every labelled row it is given: counts, sums and products are one
map-side combined aggregate per class (a few dozen numbers, whatever the number
of rows); only these reach the driver.

Defined results: a null or empty text has statistics zero and is scored like any
other; null ids and null labels never train but are scored; repeated rows are
scored each, and train each; a label given twice trains twice. Without any
labelled row, or with one class only, the score is the smoothed class share
(0.5 without labels). Empty tables give empty results. Only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import Column, DataFrame, F, held_out, pa, text_bytes, written
from .stats import NAMES, measure

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "bangs", "punct",
            "variety", "runs")
_I = {n: i for i, n in enumerate(NAMES)}


def transform(m: np.ndarray) -> np.ndarray:
    """Measurements (rows x NAMES) to features (rows x FEATURES)."""
    m = np.asarray(m, float).reshape(-1, len(NAMES))
    at = lambda n: m[:, _I[n]]
    words, lines = np.maximum(at("n_words"), 1.0), np.maximum(at("n_lines"), 1.0)
    letters = np.maximum(at("n_upper") + at("n_lower"), 1.0)
    return np.column_stack((
        np.log1p(at("n_words")),
        at("word_chars") / words,
        np.log1p(100 * at("n_symbols") / words),
        np.sqrt(at("n_dup_lines") / lines),
        np.sqrt(at("n_repeat_words") / words),
        np.sqrt(at("n_upper") / letters),
        np.log1p(100 * at("n_bangs") / words),
        np.sqrt(at("n_punct") / words),
        np.log1p(at("n_distinct_words")) / np.log1p(words),
        np.sqrt(at("n_adjacent_same") / words),
    ))


_D = len(FEATURES)


@arrow_udf(T.ArrayType(T.DoubleType()))
def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        x = transform(np.array([measure(t or b"") for t in texts.to_pylist()], float))
        offsets = np.arange(0, x.size + 1, _D, dtype=np.int32)
        yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))


def features(text: Column | str) -> Column:
    """The transformed statistics of a text (one Python pass)."""
    return _features(text_bytes(text))


@dataclass(frozen=True)
class Model:
    """Per class: log prior, mean, inverse Cholesky factor, log determinant."""
    prior: float
    means: tuple[np.ndarray, np.ndarray] | None = None
    whiten: tuple[np.ndarray, np.ndarray] | None = None
    log_det: tuple[float, float] | None = None
    log_odds: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.prior)
        part = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.whiten[k].T
            part.append(-0.5 * ((z * z).sum(1) + self.log_det[k]))
        gap = np.clip(part[1] - part[0] + self.log_odds, -500, 500)
        return np.round(1 / (1 + np.exp(-gap)), 6)


def fit(labelled: DataFrame, feature_col: str = "features", label_col: str = "quality",
        pooled: float = 0.2, diagonal: float = 0.1, floor: float = 0.01) -> Model:
    """``labelled`` has features and a 0/1 label (other labels do not count).

    ``pooled`` and ``diagonal`` are the shares taken from the pooled covariance
    and from the diagonal; ``floor`` is added to every variance, so that a
    statistic that never varies within a class cannot decide alone."""
    f = F.col(feature_col)
    pairs = [(i, j) for i in range(_D) for j in range(i, _D)]
    sums = (labelled.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int").alias("k"))
            .agg(F.count(F.lit(1)).alias("n"), *[F.sum(f[i]).alias(f"s{i}") for i in range(_D)],
                 *[F.sum(f[i] * f[j]).alias(f"p{i}_{j}") for i, j in pairs])).collect()
    got = {r["k"]: r for r in sums}
    n = [got[k]["n"] if k in got else 0 for k in (0, 1)]
    share = (n[1] + 1) / (n[0] + n[1] + 2)
    if min(n) < 2:
        return Model(prior=round(share, 6))
    means, covs = [], []
    for k in (0, 1):
        mean = np.array([got[k][f"s{i}"] for i in range(_D)]) / n[k]
        cov = np.empty((_D, _D))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = got[k][f"p{i}_{j}"] / n[k] - mean[i] * mean[j]
        means.append(mean)
        covs.append(cov)
    common = (n[0] * covs[0] + n[1] * covs[1]) / (n[0] + n[1])
    whiten, log_det = [], []
    for cov in covs:
        mixed = (1 - pooled) * cov + pooled * common
        mixed = (1 - diagonal) * mixed + diagonal * np.diag(np.diag(mixed)) + floor * np.eye(_D)
        chol = np.linalg.cholesky(mixed)
        whiten.append(np.linalg.inv(chol))
        log_det.append(2 * float(np.log(np.diag(chol)).sum()))
    return Model(round(share, 6), tuple(means), tuple(whiten), tuple(log_det), float(np.log(n[1] / n[0])))


def scorer(model: Model) -> Callable[[Column], Column]:
    """Features column to score column; the factors travel with the function."""

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            flat = np.asarray(x.flatten(), float).reshape(-1, _D)
            yield pa.array(model.score(flat))

    return score


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> tuple[Model, DataFrame]:
    """Fit on every labelled document outside the held-out part; also returns
    (id, features) of all documents, written once and read by fit and scoring."""
    feats = written(docs.select(F.col(id_col).alias("id"), features(F.col(text_col)).alias("features")),
                    "quality-features")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    return fit(feats.join(known, "id"), "features", "label"), feats


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **names) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model, feats = train(docs, labels, **names)
    score = scorer(model)(F.col("features"))
    x = feats.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), score.alias("score"))
    return x.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def filter_documents(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents the model accepts, with all their columns."""
    score = scorer(model)(features(F.col(text_col)))
    return docs.filter(score >= threshold)
