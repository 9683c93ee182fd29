"""Missing features, small shares and large counts: nothing is lost or invented without a word."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from secondlook.models.discriminant import _argmax
from secondlook.models.evaluate import auc
from secondlook.models.knn import accuracy_by_k, classify
from secondlook.models.smote import smote
from secondlook.sources.tables import read_text_extract


def test_neighbours_ignore_rows_with_missing_features(spark):
    clean = spark.range(60).selectExpr("id", "CAST(id AS DOUBLE) AS x", "CAST(id % 7 AS DOUBLE) AS y", "CAST(id >= 30 AS INT) AS c")
    holes = spark.range(20).selectExpr("id + 100 AS id", "CAST(NULL AS DOUBLE) AS x", "double('NaN') AS y", "1 AS c")
    test = clean.where("id % 3 = 0")
    want = {r.id: r.c_hat for r in classify(clean, test.drop("c"), ["x", "y"], "c", 3).withColumnRenamed("predicted", "c_hat").collect()}
    got = {r.id: r.predicted for r in classify(clean.union(holes), test.union(holes).drop("c"), ["x", "y"], "c", 3).collect()}
    assert {k: v for k, v in got.items() if k < 100} == want and None not in want.values()
    assert all(got[k] is None for k in range(100, 120))
    right = {r.k: r.accuracy for r in accuracy_by_k(clean, test, ["x", "y"], "c", 3).collect()}
    lower = {r.k: r.accuracy for r in accuracy_by_k(clean.union(holes), test.union(holes), ["x", "y"], "c", 3).collect()}
    assert all(lower[k] == pytest.approx(right[k] * 20 / 40) for k in right)


def test_no_class_without_every_score(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(_argmax([(0, F.col("a")), (1, F.col("b"))])).collect()] == [1, None, None]


@pytest.mark.parametrize("over,synthetic", [(50, 10), (100, 20), (200, 40)])
def test_smote_shares(spark, over, synthetic):
    df = spark.range(120).selectExpr("id", "CAST(id < 20 AS INT) AS t", "CAST(id * id % 17 AS DOUBLE) AS x")
    n = {r.origin: r["count"] for r in smote(df, "id", "t", ["x"], [], over, 200).groupBy("origin").count().collect()}
    assert n == {"observed": 20, "synthetic": synthetic, "resampled": 2 * synthetic}


def test_auc_of_very_many_pairs(spark, monkeypatch):
    from secondlook.models import evaluate
    monkeypatch.setattr(evaluate, "_score_groups", lambda df, *_: df)
    big = spark.createDataFrame([(0.1, 0, 4_000_000_000), (0.9, 4_000_000_000, 0)], "score double, tp long, fp long")
    assert auc(big, "score", "label").first().auc == 1.0


def test_swapped_header_is_an_error(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("B\tA\n1\t2\n")
    assert [tuple(r) for r in read_text_extract(spark, str(tmp_path / "x.tsv"), ["B", "A"]).collect()] == [("1", "2")]
    with pytest.raises((PySparkException, Py4JJavaError), match="header does not conform"):
        read_text_extract(spark, str(tmp_path / "x.tsv"), ["A", "B"]).collect()
