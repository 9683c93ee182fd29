"""Nearest-neighbour classification for many k from one neighbour pass (ML-13, ML-14)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from secondlook.operators.joins import salted_join
from secondlook.operators.neighbours import nearest_by_id


def _vector(features: list[str]):
    return F.array(*[F.col(f).cast("double") for f in features])


def votes(train: DataFrame, test: DataFrame, features: list[str], label: str, ks: Sequence[int],
          **options) -> DataFrame:
    """Majority label per distinct test vector and k: ``(vec, k, predicted)``.

    Euclidean, unscaled. All rows tied at the k-th distance vote; equal votes go to
    the label that sorts first.
    """
    best, asked = _votes_by_id(train, test, features, label, ks, **options)
    return best.join(asked, "qid").select("vec", "k", "predicted")


def _votes_by_id(train: DataFrame, test: DataFrame, features: list[str], label: str, ks: Sequence[int],
                 **options) -> tuple[DataFrame, DataFrame]:
    known = train.select(_vector(features).alias("vec"), F.col(label).alias("__label"))
    asked = test.select(_vector(features).alias("vec"))
    near, asked = nearest_by_id(asked, known, max(ks), tag="__label", **options)
    # A distance level that starts after `before` rows counts for every larger k.
    per_k = (near.withColumn("k", F.explode(
                 F.filter(F.array(*[F.lit(int(k)) for k in ks]), lambda k: k > F.col("before"))))
             .groupBy("qid", "k", "tag").agg(F.sum("w").alias("n")))
    best = Window.partitionBy("qid", "k").orderBy(F.desc("n"), "__label")
    ranked = (per_k.withColumn("__label", F.col("tag").cast(train.schema[label].dataType))
              .withColumn("__rn", F.row_number().over(best)).filter("__rn = 1")
              .select("qid", "k", F.col("__label").alias("predicted")))
    return ranked, asked


def classify(train: DataFrame, test: DataFrame, features: list[str], label: str, k: int,
             **options) -> DataFrame:
    """Test rows with their predicted label (ML-13), NULL where a feature is missing."""
    best = votes(train, test, features, label, [k], **options).drop("k")
    return salted_join(test.withColumn("vec", _vector(features)), best, ["vec"], "left").drop("vec")


def accuracy_by_k(train: DataFrame, test: DataFrame, features: list[str], label: str,
                  max_k: int = 40, **options) -> DataFrame:
    """``(k, accuracy)`` for k = 1..max_k (ML-14, EDA-7, SCH-3).

    Test rows are counted per vector and label first, so copies cost one row. A row
    without a prediction, because a feature is missing, counts as wrong.
    """
    best, asked = _votes_by_id(train, test, features, label, range(1, max_k + 1), **options)
    tested = (test.groupBy(_vector(features).alias("vec"), F.col(label).alias("__actual"))
              .agg(F.count("*").alias("__n")).join(asked, "vec").drop("vec"))
    hit = F.when(F.col("__actual") == F.col("predicted"), F.col("__n")).otherwise(0)
    total = test.count()
    return (tested.join(best, "qid").groupBy("k")
            .agg((F.sum(hit) / F.lit(total)).alias("accuracy")))
