"""Confusion tables, ROC curves, AUC and precision as DataFrame code (ML-6..9, ML-20).

Scores are first summed per distinct value, so equal scores (all of them, when the
score is a class) collapse before any shuffle and ties count half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secondlook.functions.scalars import records
from secondlook.operators.aggregates import contingency, union_by_name
from secondlook.operators.ranking import running_totals
from secondlook.session import stage


def confusion(df: DataFrame, predicted: str, actual: str, levels: tuple | None = (0, 1)) -> DataFrame:
    """Counts of every pair of classes (ML-6); with ``levels`` None, of the classes found."""
    return contingency(df, predicted, actual, levels and list(levels))


def _score_groups(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Positives and negatives per distinct score, written out: the scores, often a
    model's output, are computed once for the passes that follow."""
    scored = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return stage(scored.groupBy(*by, F.col(score).cast("double").alias("score"))
                 .agg(F.sum(F.col(label).cast("long")).alias("tp"),
                      F.sum(1 - F.col(label).cast("long")).alias("fp")), "score-groups")


def roc_points(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """One point per distinct score, falling, after the point (0, 0) (ML-7, WIN-9).

    The starting point has no score. Rates are missing when a class is absent.
    """
    by = by or []
    groups = _score_groups(df, score, label, by)
    curve = running_totals(groups, "score", {"cum_tp": "tp", "cum_fp": "fp"}, by, descending=True)
    totals = groups.groupBy(*by).agg(F.sum("tp").alias("positives"), F.sum("fp").alias("negatives"))
    start = totals.select(*by, F.lit(None).cast("double").alias("score"),
                          F.lit(0).cast("long").alias("cum_tp"), F.lit(0).cast("long").alias("cum_fp"))
    points = union_by_name(start, curve.select(*by, "score", "cum_tp", "cum_fp"))
    return (_with_totals(points, totals, by)
            .withColumns({"tpr": _ratio("cum_tp", "positives"), "fpr": _ratio("cum_fp", "negatives")})
            .select(*by, "score", "cum_tp", "cum_fp", "tpr", "fpr"))


def _with_totals(points: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Attach the class totals: a scalar without groups, else a join on the group."""
    if not by:
        both = totals.select(F.struct("positives", "negatives")).scalar()
        return (points.withColumn("__t", both)
                .withColumns({"positives": F.col("__t.positives"), "negatives": F.col("__t.negatives")})
                .drop("__t"))
    return points.join(totals, by)  # one row per group; Spark checks its size


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def auc(df: DataFrame, score: str, label: str, by: list[str] | None = None,
        name: str = "auc") -> DataFrame:
    """Exact area under the ROC curve, tied scores counting half (ML-8, ML-9).

    Scores are ordered as doubles are: minus infinity, numbers, infinity, then NaN, the highest and equal
    to itself. Rows without a score or a label are left out. Missing when a class is absent. Works for probabilities and for hard classes.
    """
    by = by or []
    curve = running_totals(_score_groups(df, score, label, by), "score",
                           {"cum_tp": "tp"}, by, descending=True)
    # tp before the group plus half the ties: cum_tp - tp / 2 positives score higher.
    area = F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2))
    pairs = F.sum("tp").cast("double") * F.sum("fp")  # whole numbers would overflow
    return curve.groupBy(*by).agg(F.when(pairs > 0, area / pairs).alias(name))


def precision(df: DataFrame, predicted: str, actual: str, name: str = "precision") -> DataFrame:
    """TP / (TP + FP); missing when nothing is predicted 1 (ML-20)."""
    hit = F.count_if((F.col(predicted) == 1) & (F.col(actual) == 1))
    called = F.count_if((F.col(predicted) == 1) & F.col(actual).isNotNull())
    return df.agg(F.when(called > 0, hit / called).alias(name))


def precision_report(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Precision of a model beside the baselines that call every row 1 or every row 0."""
    called = F.col("called")
    rules = records(["rule", "called"], ("model", F.col(predicted).cast("int")), ("all 1", 1), ("all 0", 0))
    rows = df.select(F.inline(rules), F.col(actual).alias("actual"))
    tp = F.count_if((called == 1) & (F.col("actual") == 1))
    positive = F.count_if((called == 1) & F.col("actual").isNotNull())
    return rows.groupBy("rule").agg(tp.alias("tp"), (positive - tp).alias("fp"),
                                    F.when(positive > 0, tp / positive).alias("precision"))


def sensitivity_specificity(df: DataFrame, predicted: str, actual: str,
                            by: list[str] | None = None, event: int = 1) -> DataFrame:
    """Share of the class ``event`` and of the other one that is called right, per group (ML-16)."""
    p, a = F.col(predicted), F.col(actual)
    return df.groupBy(*(by or [])).agg(
        F.avg(F.when(a == event, (p == event).cast("int"))).alias("sensitivity"),
        F.avg(F.when(a == 1 - event, (p == 1 - event).cast("int"))).alias("specificity"))
