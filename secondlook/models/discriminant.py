"""Linear and quadratic discriminant analysis (ML-10..12).

One pass over an array of the features yields counts, means and covariances of all classes: each task adds up blocks
of products, and what tasks send is merged about the means. The p x p algebra runs on the driver. A classifier of few
products is a column expression, a wider one works on batches of the array.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondlook.models.merging import Moments, tasks_of

MAX_CLASSES = 1_000
MAX_PRODUCTS = 4_000_000  # classes x pairs of features: numbers that a task sends
PRODUCTS_IN_COLUMN = 500  # of a quadratic classifier that is written out as an expression


class SingularCovariance(ValueError):
    """The predictors of a class are linearly dependent."""


@dataclass
class ClassMoments:
    label: object
    n: int
    mean: np.ndarray
    cov: np.ndarray


def _array(features: list[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features])


def class_moments(df: DataFrame, label: str, features: list[str]) -> list[ClassMoments]:
    """Count, mean and covariance per class; rows with a missing value are left out.

    The table is read once for the classes and once for all products of features.
    """
    rows = df.select(label, *features).dropna("any")
    classes = sorted(r[0] for r in rows.select(label).distinct().limit(MAX_CLASSES + 1).collect())
    p = len(features)
    if len(classes) > MAX_CLASSES or len(classes) * p * (p + 1) // 2 > MAX_PRODUCTS:
        raise ValueError(f"too many classes or features: {len(classes)} and {p}")
    if not classes:
        return []
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    encoded = rows.select(code.cast("int").alias("code"), _array(features).alias("x"))
    counts, means, products = Moments(len(classes), p, full=True).over(encoded, tasks_of(encoded))
    with np.errstate(divide="ignore", invalid="ignore"):  # a class of one row has no covariance
        return [ClassMoments(c, int(n), m, s / (n - 1) if n > 1 else np.full((p, p), np.nan))
                for c, n, m, s in zip(classes, counts, means, products)]


def _inverse(cov: np.ndarray, what: str) -> np.ndarray:
    spread = np.sqrt(np.clip(np.diag(cov), 0, None))
    if not np.isfinite(cov).all() or (spread == 0).any():
        raise SingularCovariance(f"{what}: a predictor is constant")
    if np.linalg.matrix_rank(cov / np.outer(spread, spread)) < len(cov):
        raise SingularCovariance(f"{what}: rank deficiency among the predictors")
    return np.linalg.inv(cov)


def _dot(features: list[str], weights) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f) * F.lit(float(w)) for f, w in zip(features, weights)])


def _argmax(scores: list[tuple[object, Column]]) -> Column:
    """Label with the highest score; the first label wins ties. NULL if any score is missing."""
    options = [F.struct(s.alias("score"), F.lit(-i).alias("rank"), F.lit(v).alias("label"))
               for i, (v, s) in enumerate(scores)]
    complete = reduce(lambda a, b: a & b, [s.isNotNull() for _, s in scores])
    return F.when(complete, F.array_max(F.array(*options))["label"])


@dataclass
class LinearDiscriminant:
    features: list[str]
    classes: list[ClassMoments]
    pooled: np.ndarray
    inverse: np.ndarray

    @property
    def priors(self) -> np.ndarray:
        n = np.array([c.n for c in self.classes], dtype=float)
        return n / n.sum()

    def scores(self) -> list[tuple[object, Column]]:
        out = []
        for prior, c in zip(self.priors, self.classes):
            w = self.inverse @ c.mean
            constant = float(np.log(prior) - c.mean @ w / 2)
            out.append((c.label, _dot(self.features, w) + F.lit(constant)))
        return out

    def classify(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        return df.withColumn(name, _argmax(self.scores()))

    def directions(self) -> np.ndarray:
        """Columns spanning the class means, unit within-class variance, best first.

        The first non-zero entry of each is positive.
        """
        values, vectors = np.linalg.eigh(self.inverse)
        half = vectors @ np.diag(np.sqrt(values)) @ vectors.T
        means = np.stack([c.mean for c in self.classes])
        centred = (means - self.priors @ means) * np.sqrt(self.priors)[:, None]
        _, size, axes = np.linalg.svd(centred @ half, full_matrices=False)
        keep = min(len(self.classes) - 1, len(self.features), int((size > 1e-12 * size[0]).sum()))
        scaling = (half @ axes.T)[:, :keep]
        sign = [np.sign(c[np.flatnonzero(np.abs(c) > 0)[0]]) for c in scaling.T]
        return scaling * np.array(sign)

    def project(self, df: DataFrame, name: str = "ld") -> DataFrame:
        """Discriminant scores ``ld1, ld2, ...``, centred on the overall mean (EDA-6)."""
        centre = self.priors @ np.stack([c.mean for c in self.classes])
        return df.withColumns({
            f"{name}{i}": _dot(self.features, w) - F.lit(float(centre @ w))
            for i, w in enumerate(self.directions().T, 1)})


def fit_lda(df: DataFrame, label: str, features: list[str]) -> LinearDiscriminant:
    """Priors, class means and pooled covariance with n - classes in the denominator (ML-10)."""
    classes = class_moments(df, label, features)
    free = sum(c.n for c in classes) - len(classes)
    pooled = sum((c.n - 1) * np.nan_to_num(c.cov) for c in classes) / free
    return LinearDiscriminant(features, classes, pooled, _inverse(pooled, "pooled covariance"))


@dataclass
class QuadraticDiscriminant:
    features: list[str]
    classes: list[ClassMoments]
    inverses: list[np.ndarray]

    def scores(self) -> list[tuple[object, Column]]:
        total = sum(c.n for c in self.classes)
        out = []
        for c, inverse in zip(self.classes, self.inverses):
            gap = [F.col(f) - F.lit(float(m)) for f, m in zip(self.features, c.mean)]
            form = reduce(lambda a, b: a + b, [
                gap[i] * gap[j] * F.lit(float(inverse[i, j]) * (1 if i == j else 2))
                for i in range(len(gap)) for j in range(i, len(gap))])
            constant = float(np.log(c.n / total) - np.linalg.slogdet(c.cov)[1] / 2)
            out.append((c.label, F.lit(constant) - form / 2))
        return out

    def classify(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        width = len(self.features)
        if len(self.classes) * width * (width + 1) // 2 <= PRODUCTS_IN_COLUMN:
            return df.withColumn(name, _argmax(self.scores()))
        total = sum(c.n for c in self.classes)
        constants = [float(np.log(c.n / total) - np.linalg.slogdet(c.cov)[1] / 2) for c in self.classes]
        means, halves = [c.mean for c in self.classes], [np.linalg.cholesky(i) for i in self.inverses]

        @F.pandas_udf("int")
        def best(x: pd.Series) -> pd.Series:
            known = x.notna().to_numpy()
            points = np.stack(x[known].to_numpy()).astype(float) if known.any() else np.zeros((0, width))
            scores = np.stack([k - (((points - m) @ h) ** 2).sum(axis=1) / 2 for k, m, h in zip(constants, means, halves)])
            out = np.zeros(len(x), np.int32)  # a first score wins ties; NaN, from a missing value, wins over all
            out[known] = np.where(np.isnan(scores).any(axis=0), 0, scores.argmax(axis=0) + 1)
            return pd.Series(out)

        labels = F.array(*[F.lit(c.label) for c in self.classes])
        place = best(_array(self.features))
        return df.withColumn(name, F.when(place > 0, F.get(labels, place - 1)))


def fit_qda(df: DataFrame, label: str, features: list[str]) -> QuadraticDiscriminant:
    """A covariance per class; raises ``SingularCovariance`` on rank deficiency (ML-12)."""
    classes = class_moments(df, label, features)
    return QuadraticDiscriminant(features, classes,
                                 [_inverse(c.cov, f"class {c.label}") for c in classes])


def moments_table(df: DataFrame, classes: list[ClassMoments], features: list[str]) -> DataFrame:
    """Priors and class means as rows (the printed form of a fit)."""
    total = sum(c.n for c in classes)
    rows = [(str(c.label), c.n, c.n / total, f, float(m))
            for c in classes for f, m in zip(features, c.mean)]
    return df.sparkSession.createDataFrame(
        rows, "class string, n long, prior double, feature string, mean double")
