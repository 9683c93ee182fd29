"""Logistic regression from a formula, its tables and its validation (ML-1..5, ML-15..19)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import RFormula, StandardScaler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.functions.predicates import complete_cases
from secondlook.functions.scalars import class_at
from secondlook.models import fisher
from secondlook.models.evaluate import auc, roc_points, sensitivity_specificity
from secondlook.session import stage

TOLERANCE = 1e-10
MAX_ITERATIONS = 50


def design(formula: str, invalid: str = "error", features: str = "features") -> RFormula:
    """Formula to feature vector; strings become indicators against the level that
    sorts first (ML-1). ``invalid`` is error, skip or keep for unseen levels and NULLs."""
    return RFormula(formula=formula, featuresCol=features, labelCol="label",
                    stringIndexerOrderType="alphabetDesc", handleInvalid=invalid)


def logistic(features: str = "features") -> GeneralizedLinearRegression:
    return GeneralizedLinearRegression(family="binomial", link="logit", featuresCol=features,
                                       labelCol="label", predictionCol="probability",
                                       maxIter=MAX_ITERATIONS, tol=TOLERANCE)


def fit_glm(train: DataFrame, formula: str, scale: bool = False,
            invalid: str = "skip") -> PipelineModel:
    """Fit ``outcome ~ predictors`` without penalty (ML-2).

    Rows with a missing value are skipped, as complete-case fitting does;
    ``scale`` centres and scales the predictors inside the fit (ML-15).
    """
    if not scale:
        return Pipeline(stages=[design(formula, invalid), logistic()]).fit(train)
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="features")
    return Pipeline(stages=[design(formula, invalid, "raw"), scaler, logistic()]).fit(train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Probabilities beside the input columns (ML-4, ML-5)."""
    scored = model.transform(df)
    return scored.drop(*[c for c in ("features", "raw", "label")
                         if c in scored.columns and c not in df.columns])


def classify(scored: DataFrame, threshold: float = 0.5, name: str = "predicted") -> DataFrame:
    return scored.withColumn(name, class_at("probability", threshold))


def _feature_names(model: PipelineModel, df: DataFrame) -> list[str]:
    column = "raw" if "raw" in model.transform(df.limit(0)).columns else "features"
    groups = model.transform(df.limit(0)).schema[column].metadata["ml_attr"]["attrs"]
    return [a["name"] for a in sorted((a for g in groups.values() for a in g), key=lambda a: a["idx"])]


def coefficient_table(model: PipelineModel, df: DataFrame) -> DataFrame:
    """One row per term: estimate, standard error, z and p (ML-3). Intercept last."""
    glm = model.stages[-1]
    s = glm.summary
    rows = zip([*_feature_names(model, df), "(Intercept)"],
               [*glm.coefficients.toArray().tolist(), glm.intercept],
               s.coefficientStandardErrors, s.tValues, s.pValues)
    return df.sparkSession.createDataFrame(
        [(t, *map(float, numbers)) for t, *numbers in rows],
        "term string, estimate double, std_error double, z_value double, p_value double")


def deviance_table(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Null and residual deviance with their degrees of freedom, and AIC (ML-3)."""
    s = model.stages[-1].summary
    return df.sparkSession.createDataFrame(
        [("null_deviance", float(s.nullDeviance), int(s.residualDegreeOfFreedomNull)),
         ("residual_deviance", float(s.deviance), int(s.residualDegreeOfFreedom)),
         ("aic", float(s.aic), None)], "measure string, value double, df int")


def chi_square_tail(x: float, df: int) -> float:
    """P(chi-square with df degrees of freedom > x), by the recurrence in steps of two."""
    if df < 1 or x <= 0:
        return 1.0
    half = x / 2
    if df % 2:
        tail, a = math.erfc(math.sqrt(half)), 0.5
    else:
        tail, a = math.exp(-half), 1.0
    while a < df / 2:
        tail += math.exp(a * math.log(half) - half - math.lgamma(a + 1))
        a += 1
    return min(tail, 1.0)


def analysis_of_deviance(train: DataFrame, outcome: str, terms: Sequence[str]) -> DataFrame:
    """Add terms one at a time; drop in deviance, its df and chi-square p (ML-19).

    All models use the rows that are complete for the largest one and are fitted together.
    """
    rows = complete_cases(train.select(outcome, *terms))
    made = fisher.design(rows, terms)
    ready = fisher.encoded(rows, made, outcome, F.lit(0))
    uses = np.array([[t in terms[:i] for t, _ in made.columns] for i in range(len(terms) + 1)]).reshape(len(terms) + 1, -1)
    fits = fisher.fit(ready, np.ones((len(terms) + 1, 1), bool), uses)
    resid_df, resid_dev = (fits.rows - fits.rank).astype(int).tolist(), (2 * fits.loss).tolist()
    out = [("NULL", None, None, resid_df[0], resid_dev[0], None)]
    for i, term in enumerate(terms, 1):
        steps, drop = resid_df[i - 1] - resid_df[i], resid_dev[i - 1] - resid_dev[i]
        out.append((term, steps, drop, resid_df[i], resid_dev[i], chi_square_tail(drop, steps)))
    return train.sparkSession.createDataFrame(
        out, "term string, df int, deviance double, resid_df int, resid_dev double, p_value double")


def fit_table(df: DataFrame, outcome: str, terms: Sequence[str], missing: str = "skip") -> DataFrame:
    """Coefficients of ``outcome ~ terms`` under a rule for missing predictors (FLT-10): term, estimate, std_error, z_value, p_value.

    ``error`` refuses missing values, ``skip`` leaves their rows out, ``pass`` keeps the rows: a missing number counts as 0
    beside an indicator ``<term>_missing``, a missing level is a level of its own. Rows without an outcome are always left out.
    """
    if missing not in fisher.MISSING:
        raise ValueError(f"missing is one of {', '.join(fisher.MISSING)}")
    rows = complete_cases(df.select(outcome, *terms), outcome)
    if missing == "skip":
        rows = complete_cases(rows)
    made = fisher.design(rows, terms, passed=True)
    if missing == "error" and made.missing:
        raise ValueError(f"missing values in {', '.join(made.missing)}")
    ready = fisher.encoded(rows, made, outcome, F.lit(0))
    fits = fisher.fit(ready, np.ones((1, 1), bool), np.ones((1, len(made.columns)), bool))
    out = []
    for term, b, e in zip(["(Intercept)", *made.names()], fits.raw()[0].tolist(), fits.errors()[0].tolist()):
        e = e if e == e else None  # a term that the rows don't determine
        out.append((term, b if e is not None else None, e, b / e if e else None, math.erfc(abs(b / e) / math.sqrt(2)) if e else None))
    return df.sparkSession.createDataFrame(out, "term string, estimate double, std_error double, z_value double, p_value double")


def fold_predictions(df: DataFrame, formula: str, outcome: str, folds: int = 10,
                     train_on: str = "fold", scale: bool = False, missing: str = "skip") -> DataFrame:
    """Fit on each fold's training part and score its validation part (ML-16, ML-18).

    Returns ``(fold, outcome, probability)``, written out once because evaluation reads
    it several times. The rows are encoded once; all folds advance together, one pass per Newton
    step (``fisher``). A validation row with a level that the training part lacks is left out.
    ``scale`` (ML-15) changes units, not probabilities: the fits always work on scaled columns. ``missing``
    is as in ``fit_table``.
    """
    if train_on not in ("fold", "rest"):
        raise ValueError("train_on is 'fold' or 'rest'")
    if missing not in fisher.MISSING:
        raise ValueError(f"missing is one of {', '.join(fisher.MISSING)}")
    predictors = formula.split("~")[1].strip()
    names = ([c for c in df.columns if c not in ("fold", outcome)] if predictors == "."
             else [t.strip() for t in predictors.split("+")])
    rows = complete_cases(df.select("fold", outcome, *names), "fold", outcome)
    if missing == "skip":
        rows = complete_cases(rows)
    made = fisher.design(rows, names, passed=missing != "skip")
    if missing == "error" and made.missing:
        raise ValueError(f"missing values in {', '.join(made.missing)}")
    ready = fisher.encoded(rows, made, outcome, F.col("fold") - 1)
    own = np.eye(folds, dtype=bool)
    trains, scores = (own, ~own) if train_on == "fold" else (~own, own)
    fits = fisher.fit(ready, trains, np.ones((folds, len(made.columns)), bool))
    scored = fisher.score(ready, fits, scores, made.blocks())
    return stage(scored.select((F.col("model") + 1).alias("fold"), F.col("label").cast("int").alias(outcome), "probability"), "fold-predictions")


def fold_auc(df: DataFrame, formula: str, outcome: str, folds: int = 10,
             train_on: str = "fold") -> DataFrame:
    """``(fold, auc)`` for every fold at once (ML-18, SET-3)."""
    scored = fold_predictions(df, formula, outcome, folds, train_on)
    return auc(scored, "probability", outcome, ["fold"])


def fold_roc(df: DataFrame, formula: str, outcome: str, folds: int = 10,
             train_on: str = "fold") -> DataFrame:
    scored = fold_predictions(df, formula, outcome, folds, train_on)
    return roc_points(scored, "probability", outcome, ["fold"])


def cross_validate(df: DataFrame, formula: str, outcome: str, folds: int = 10, event: int = 1,
                   missing: str = "skip") -> DataFrame:
    """ROC area, sensitivity and specificity of scaled GLM fits: mean and sd over folds (ML-16).

    Sensitivity is that of the class ``event``, specificity that of the other one.
    """
    scored = classify(fold_predictions(df, formula, outcome, folds, "rest", scale=True, missing=missing))
    per_fold = (auc(scored, "probability", outcome, ["fold"], "roc")
                .join(sensitivity_specificity(scored, "predicted", outcome, ["fold"], event), "fold"))
    names = ["roc", "sensitivity", "specificity"]
    long = per_fold.unpivot(["fold"], names, "measure", "value")
    return long.groupBy("measure").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
