"""Evaluation and models against closed forms and Spark's own evaluators."""

import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from secondlook.models import discriminant, elasticnet, evaluate, glm, merging
from secondlook.operators import eda
from secondlook.operators.sampling import assign_folds, fold_parts
from secondlook.plans import studies


def scored(spark, n=400, seed=1, ties=True):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = rng.normal(size=n) + y * 0.7
    s = np.round(s, 1) + 0.0 if ties else s
    return spark.createDataFrame([(float(a), int(b), i % 3) for i, (a, b) in enumerate(zip(s, y))],
                                 "score double, label int, part int")


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, label int")
    assert evaluate.auc(df, "score", "label").first().auc == 0.5
    assert evaluate.auc(df.filter("label = 1"), "score", "label").first().auc is None


@pytest.mark.parametrize("ties", [True, False])
def test_auc_equals_evaluator(spark, ties):
    df = scored(spark, ties=ties).withColumn("raw", F.col("score"))
    want = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="label", numBins=0).evaluate(df)
    assert evaluate.auc(df, "score", "label").first().auc == pytest.approx(want, abs=1e-12)
    points = sorted((r.fpr, r.tpr) for r in evaluate.roc_points(df, "score", "label").collect())
    assert points[0] == (0, 0) and points[-1] == (1, 1)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(want, abs=1e-12)


def test_auc_by_part(spark):
    df = scored(spark)
    got = {r.part: r.auc for r in evaluate.auc(df, "score", "label", ["part"]).collect()}
    for part in range(3):
        assert got[part] == pytest.approx(
            evaluate.auc(df.filter(F.col("part") == part), "score", "label").first().auc)


def test_precision_of_nothing_is_missing(spark):
    df = spark.createDataFrame([(0, 1), (0, 0)], "p int, a int")
    assert evaluate.precision(df, "p", "a").first().precision is None
    table = spark.createDataFrame([(1, 1)] + [(1, 0)] * 4 + [(0, 1)] * 54 + [(0, 0)] * 371, "p int, a int")
    got = {r.rule: r.precision for r in evaluate.precision_report(table, "p", "a").collect()}
    assert got == {"model": pytest.approx(0.2), "all 1": pytest.approx(55 / 430), "all 0": None}


def test_sensitivity_specificity(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (0, 0), (0, 0), (1, 0)], "p int, a int")
    r = evaluate.sensitivity_specificity(df, "p", "a").first()
    assert (r.sensitivity, r.specificity) == pytest.approx((1 / 2, 2 / 3))


@pytest.mark.parametrize("x,df,want", [(3.841458821, 1, 0.05), (5.991464547, 2, 0.05), (7.814727903, 3, 0.05),
                                       (18.30703805, 10, 0.05), (10.0, 1, 0.001565402), (0.0, 3, 1.0)])
def test_chi_square_tail(x, df, want):
    assert glm.chi_square_tail(x, df) == pytest.approx(want, rel=1e-6)


def model_rows(spark, n=300):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=n), rng.normal(size=n) * 3
    g = rng.integers(0, 3, n)
    p = 1 / (1 + np.exp(-(0.8 * x - 0.2 * z + 0.5 * (g == 1) - 0.3)))
    y = (rng.random(n) < p).astype(int)
    return spark.createDataFrame([(i, int(a), float(b), float(c), "abc"[d]) for i, (a, b, c, d) in
                                  enumerate(zip(y, x, z, g))], "row_id int, y int, x double, z double, g string")


def test_glm_tables(spark):
    rows = model_rows(spark)
    model = glm.fit_glm(rows, "y ~ x + z + g")
    table = glm.coefficient_table(model, rows).collect()
    assert [r.term for r in table] == ["x", "z", "g_c", "g_b", "(Intercept)"]  # "a" is the base level
    deviances = {r.measure: (r.value, r.df) for r in glm.deviance_table(model, rows).collect()}
    assert deviances["residual_deviance"][1] == 295 and deviances["null_deviance"][1] == 299
    assert deviances["aic"][0] == pytest.approx(deviances["residual_deviance"][0] + 10)
    steps = glm.analysis_of_deviance(rows, "y", ["x", "z", "g"]).collect()
    assert [r.df for r in steps] == [None, 1, 1, 2]
    assert steps[0].resid_dev - sum(r.deviance for r in steps[1:]) == pytest.approx(
        deviances["residual_deviance"][0], abs=1e-6)
    assert sum(r.probability for r in glm.predict(model, rows).collect()) == pytest.approx(
        sum(r.y for r in rows.collect()), abs=1e-4)


def test_missing_rows_are_skipped(spark):
    rows = model_rows(spark)
    holes = rows.withColumn("x", F.when(F.col("row_id") % 10 != 0, F.col("x")))
    a = glm.fit_glm(holes, "y ~ x + z").stages[-1].coefficients
    b = glm.fit_glm(rows.filter("row_id % 10 <> 0"), "y ~ x + z").stages[-1].coefficients
    assert a.toArray() == pytest.approx(b.toArray())


def test_fold_predictions_and_scaling(spark):
    folded = assign_folds(model_rows(spark), "row_id", 4, 2)
    inside = glm.fold_predictions(folded, "y ~ x + z", "y", 4)
    assert inside.count() == 3 * 300  # trains on one fold, scores the other three
    plain = glm.fold_auc(folded, "y ~ x + z", "y", 4, "rest").orderBy("fold").collect()
    assert [r.fold for r in plain] == [1, 2, 3, 4]
    scaled = glm.fold_predictions(folded, "y ~ x + z", "y", 4, "rest", scale=True)
    got = {r.fold: r.auc for r in evaluate.auc(scaled, "probability", "y", ["fold"]).collect()}
    assert [got[r.fold] for r in plain] == pytest.approx([r.auc for r in plain], abs=1e-3)
    report = {r.measure: r.mean for r in glm.cross_validate(folded, "y ~ x + z", "y", 4).collect()}
    assert set(report) == {"roc", "sensitivity", "specificity"}
    assert report["roc"] == pytest.approx(np.mean([r.auc for r in plain]), abs=1e-3)


def test_lda_and_qda_match_numpy(spark):
    rows = model_rows(spark)
    data = rows.orderBy("row_id").toPandas()
    x, y = data[["x", "z"]].to_numpy(), data["y"].to_numpy()
    fit = discriminant.fit_lda(rows, "y", ["x", "z"])
    pooled = sum((np.cov(x[y == c].T) * ((y == c).sum() - 1)) for c in (0, 1)) / (len(y) - 2)
    assert fit.pooled == pytest.approx(pooled)
    w = fit.directions()
    assert w.T @ pooled @ w == pytest.approx(np.eye(1))
    score = np.stack([x @ np.linalg.solve(pooled, x[y == c].mean(0))
                      - x[y == c].mean(0) @ np.linalg.solve(pooled, x[y == c].mean(0)) / 2
                      + np.log((y == c).mean()) for c in (0, 1)])
    got = [r.predicted for r in fit.classify(rows).orderBy("row_id").collect()]
    assert got == score.argmax(axis=0).tolist()
    quadratic = []
    for c in (0, 1):
        part, cov = x[y == c], np.cov(x[y == c].T)
        gap = x - part.mean(0)
        quadratic.append(np.log((y == c).mean()) - np.linalg.slogdet(cov)[1] / 2
                         - np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) / 2)
    got = [r.predicted for r in discriminant.fit_qda(rows, "y", ["x", "z"]).classify(rows).orderBy("row_id").collect()]
    assert got == np.stack(quadratic).argmax(axis=0).tolist()


def test_moments_of_many_features(spark, monkeypatch):
    """Against numpy, far from 0, with a class of one row, missing values, and merging in two levels."""
    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 1, (500, 20)) @ np.diag(np.arange(1, 21))
    y = np.where(np.arange(500) == 7, "c", np.where(rng.random(500) < 0.3, "a", "b"))
    names = [f"f{i}" for i in range(20)]
    rows = spark.createDataFrame([(str(c), *map(float, r)) for c, r in zip(y, x)] + [("a", None, *[0.0] * 19), (None, *[0.0] * 20)],
                                 ", ".join(["y string", *[f"{f} double" for f in names]]))
    for direct in (64, 3):
        monkeypatch.setattr(merging, "DIRECT", direct)
        found = discriminant.class_moments(rows.repartition(9), "y", names)
        assert [(m.label, m.n) for m in found] == [(c, int((y == c).sum())) for c in "abc"]
        for m in found:
            assert m.mean == pytest.approx(x[y == m.label].mean(axis=0), rel=1e-12)
        for m in found[:2]:
            assert np.abs(m.cov - np.cov(x[y == m.label].T)).max() < 1e-6 * np.abs(m.cov).max()
        assert np.isnan(found[2].cov).all()
    assert discriminant.class_moments(rows.limit(0), "y", names) == []


def test_wide_quadratic_classes_equal_numpy(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 400)
    x = rng.normal(size=(400, 16)) * (1 + y[:, None]) + y[:, None] * 0.3
    names = [f"f{i}" for i in range(16)]
    rows = spark.createDataFrame([(i, int(c), *map(float, r)) for i, (c, r) in enumerate(zip(y, x))] + [(400, 0, None, *[0.0] * 15)],
                                 ", ".join(["id int", "y int", *[f"{f} double" for f in names]]))
    fit = discriminant.fit_qda(rows, "y", names)
    assert len(names) * (len(names) + 1) // 2 * 3 < discriminant.PRODUCTS_IN_COLUMN  # as an expression
    plain = [r.predicted for r in fit.classify(rows).orderBy("id").collect()]
    keep, discriminant.PRODUCTS_IN_COLUMN = discriminant.PRODUCTS_IN_COLUMN, 0
    try:
        wide = [r.predicted for r in fit.classify(rows).orderBy("id").collect()]
    finally:
        discriminant.PRODUCTS_IN_COLUMN = keep
    assert plain == wide and plain[-1] is None and set(plain[:-1]) == {0, 1, 2}


def test_batched_fits_equal_spark_ml(spark):
    """Folds either way round, a level that a training part lacks, missing values, a constant column and nested terms."""
    rows = model_rows(spark).withColumns({"g": F.when(F.col("row_id") == 5, "z").otherwise(F.col("g")), "one": F.lit(3.0),
                                          "z": F.when(F.col("row_id") % 50 != 0, F.col("z"))})
    folded = assign_folds(rows, "row_id", 4, 2).cache()
    for train_on in ("fold", "rest"):
        got = glm.fold_predictions(folded, "y ~ x + z + g + one", "y", 4, train_on).collect()
        for k in range(1, 5):
            train, rest = fold_parts(folded.drop("row_id"), k, train_on)
            model = glm.fit_glm(train, "y ~ x + z + g")
            levels = [r.g for r in train.dropna().select("g").distinct().collect()]
            want = sorted(r.probability for r in glm.predict(model, rest.dropna().where(F.col("g").isin(levels))).collect())
            assert sorted(r.probability for r in got if r.fold == k) == pytest.approx(want, abs=1e-6)
    steps = glm.analysis_of_deviance(rows.drop("row_id"), "y", ["x", "one", "g"]).collect()
    assert [r.df for r in steps] == [None, 1, 0, 3] and steps[2].deviance == pytest.approx(0, abs=1e-6) and steps[2].p_value == 1
    for k, terms in ((1, "x"), (3, "x + g")):
        summary = glm.fit_glm(rows, f"y ~ {terms}").stages[-1].summary
        assert steps[k].resid_dev == pytest.approx(summary.deviance, abs=1e-5) and steps[k].resid_df == summary.residualDegreeOfFreedom


def test_few_reads_whatever_the_folds(spark, monkeypatch):
    folded = assign_folds(model_rows(spark), "row_id", 10, 2)
    reads = []
    plain = merging.merged
    monkeypatch.setattr(merging, "merged", lambda *a, **k: reads.append(1) or plain(*a, **k))
    assert glm.fold_predictions(folded, "y ~ x + z + g", "y", 10, "rest").count() == 300
    assert len(reads) < 15  # of the encoded table, with the scores


def test_parted_classes_are_reported(spark):
    rows = spark.createDataFrame([(i, int(i >= 20), float(i)) for i in range(40)], "row_id int, y int, x double")
    with pytest.warns(RuntimeWarning, match="did not settle"):
        steps = glm.analysis_of_deviance(rows, "y", ["x"]).collect()
    assert steps[1].resid_dev == pytest.approx(0, abs=1e-3)
    empty = glm.fold_predictions(assign_folds(rows.limit(0), "row_id", 3), "y ~ x", "y", 3)
    assert empty.count() == 0


def test_missing_predictors_by_rule(spark):
    rows = model_rows(spark).withColumns({"x": F.when(F.col("row_id") % 10 != 0, F.col("x")), "g": F.when(F.col("row_id") % 7 != 0, F.col("g"))})
    with pytest.raises(ValueError, match="missing values in x, g"):
        glm.fit_table(rows, "y", ["x", "z", "g"], "error")
    with pytest.raises(ValueError):
        glm.fit_table(rows, "y", ["x"], "keep")
    model = glm.fit_glm(rows, "y ~ x + z + g")
    want = {r.term: r for r in glm.coefficient_table(model, rows.dropna()).collect()}
    for r in glm.fit_table(rows, "y", ["x", "z", "g"], "skip").collect():
        w = want[r.term]
        assert (r.estimate, r.std_error, r.z_value, r.p_value) == pytest.approx((w.estimate, w.std_error, w.z_value, w.p_value), abs=1e-5)
    # passed on: as Spark ML fits with hand-made indicators
    made = rows.withColumns({"x_missing": F.col("x").isNull().cast("double"), "x": F.coalesce("x", F.lit(0.0)),
                             "g": F.coalesce("g", F.lit("a0"))})  # sorts behind "a", the base level
    want = {r.term.replace("g_a0", "g_missing"): r.estimate for r in glm.coefficient_table(glm.fit_glm(made, "y ~ x + x_missing + z + g"), made).collect()}
    got = {r.term: r.estimate for r in glm.fit_table(rows, "y", ["x", "z", "g"], "pass").collect()}
    assert got == pytest.approx(want, abs=1e-5)
    assert len(glm.fit_table(rows.dropna(), "y", ["x", "z", "g"], "pass").collect()) == 5  # no indicator without need
    folded = assign_folds(rows, "row_id", 3)
    assert glm.fold_predictions(folded, "y ~ x + g", "y", 3, "rest", missing="pass").count() == 300
    assert glm.fold_predictions(folded, "y ~ x + g", "y", 3, "rest").count() == rows.select("x", "g").dropna().count()
    with pytest.raises(ValueError):
        glm.fold_predictions(folded, "y ~ x + g", "y", 3, missing="error")
    swapped = {r.measure: r.mean for r in glm.cross_validate(folded, "y ~ z", "y", 3, event=0).collect()}
    plain = {r.measure: r.mean for r in glm.cross_validate(folded, "y ~ z", "y", 3).collect()}
    assert swapped["sensitivity"] == plain["specificity"] and swapped["specificity"] == plain["sensitivity"]


def test_qda_reports_rank_deficiency(spark):
    rows = model_rows(spark).withColumn("twice", F.col("x") * 2)
    with pytest.raises(discriminant.SingularCovariance):
        discriminant.fit_qda(rows, "y", ["x", "twice"])
    with pytest.raises(discriminant.SingularCovariance):
        discriminant.fit_lda(rows.withColumn("one", F.lit(1.0)), "y", ["x", "one"])


def test_grid_models_equal_spark_ml(spark, monkeypatch):
    rows = assign_folds(model_rows(spark), "row_id", 3, 3)
    encoded = glm.design("y ~ x + z + g").fit(rows).transform(rows).select("features", "label", "fold")
    settings = [(0.0, 0.1), (0.5, 0.02), (1.0, 0.05), (1.0, 0.5)]
    coefficients, centre, spread = elasticnet.fold_coefficients(encoded, settings, 3)
    for i, (alpha, penalty) in enumerate(settings):
        model = elasticnet.logistic(alpha, penalty).fit(encoded.filter("fold <> 2"))
        slope = coefficients[i, 1, 1:] / spread
        assert slope == pytest.approx(model.coefficients.toArray(), abs=1e-5)
        assert coefficients[i, 1, 0] - slope @ centre == pytest.approx(model.intercept, abs=1e-5)
    monkeypatch.setattr(elasticnet, "SUMS_PER_PASS", 1)  # one setting per run
    again, _, _ = elasticnet.fold_coefficients(encoded, settings, 3)
    assert again == pytest.approx(coefficients, abs=1e-6)


def test_grid_accuracy_equals_spark_ml(spark):
    rows = assign_folds(model_rows(spark), "row_id", 3, 3)
    encoded = glm.design("y ~ x + z").fit(rows).transform(rows).select("features", "label", "fold").cache()
    settings = [(0.0, 0.1), (1.0, 0.05)]
    want = []
    for a, b in settings:
        shares = []
        for f in (1, 2, 3):
            out = elasticnet.logistic(a, b).fit(encoded.filter(F.col("fold") != f)).transform(
                encoded.filter(F.col("fold") == f))
            shares.append(out.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0])
        want.append(np.mean(shares))
    assert elasticnet.cross_validated_accuracy(encoded, settings, 3) == pytest.approx(want)


def test_sums_of_grid_models(spark, monkeypatch):
    """Sums of every model over its training rows, also where the odds are beyond a product; equal models are summed once."""
    rng = np.random.default_rng(5)
    x, label, fold = rng.normal(size=(700, 3)), rng.integers(0, 2, 700), rng.integers(0, 4, 700)
    ready = spark.createDataFrame([(int(f), float(y), v.tolist()) for f, y, v in zip(fold, label, x)], "fold int, label double, x array<double>")
    points = np.repeat(np.array([[0.0] * 4, [0.3, -1, 2, 0.5], [5, 90, -60, 40]]), 4, axis=0)
    counted, summed = [], elasticnet.summed
    monkeypatch.setattr(elasticnet, "summed", lambda *a: counted.append(summed(*a)) or counted[-1])
    for point, models in ((points, 12), (np.zeros((12, 4)), 4)):
        loss, slope, curve = elasticnet._sums(ready, point, 4, np.zeros(3), np.ones(3))
        assert counted[-1].size == (1 + 4 + 10) * models
        for m, b in enumerate(point):
            own = np.hstack([np.ones((700, 1)), x])[fold != m % 4]
            y, eta = label[fold != m % 4], own @ b
            p = 1 / (1 + np.exp(-eta))
            assert np.isclose(loss[m], (np.logaddexp(0, eta) - y * eta).sum(), rtol=1e-12)
            assert np.allclose(slope[m], own.T @ (p - y), rtol=1e-10, atol=1e-9)
            assert np.allclose(curve[m], (own * (p * (1 - p))[:, None]).T @ own, rtol=1e-10, atol=1e-9)


def test_parameter_grid(spark):
    grid = elasticnet.parameter_grid(spark.range(1)).drop("id")
    assert grid.distinct().count() == 140
    assert sorted({round(r["lambda"], 9) for r in grid.collect()}) == [round(v, 9) for v in elasticnet.lambdas()]


@pytest.mark.parametrize("balance", ["before", "train_only"])
def test_balanced_grid_study(spark, balance):
    rows = model_rows(spark).filter("y = 0 OR row_id % 3 = 0")
    fit, held = studies.balanced_grid_study(rows, "y", ["x", "z"], ["g"], 200, 200, balance, 3,
                                            (0.0, 1.0), [0.01, 0.2])
    assert fit.table.count() == 4 and (fit.alpha, fit.penalty) in {(0.0, 0.01), (0.0, 0.2), (1.0, 0.01), (1.0, 0.2)}
    got = held.collect()
    assert all(r.prob_0 + r.prob_1 == pytest.approx(1) and r.predicted == int(r.prob_1 > 0.5) for r in got)
    if balance == "train_only":
        assert all(r.balanced_id.startswith("o:") for r in got)


def test_density_integrates_to_one(spark):
    df = scored(spark, 300, ties=False)
    table = eda.kernel_density(df, "score", "label").toPandas()
    for _, part in table.groupby("label"):
        part = part.sort_values("x")
        area = ((part["density"].to_numpy()[1:] + part["density"].to_numpy()[:-1]) / 2 * np.diff(part["x"])).sum()
        assert 0.9 < area <= 1.01
    assert len(table) == 2 * eda.DENSITY_POINTS


def test_density_follows_the_formula(spark):
    df = scored(spark, 200, ties=False)
    data = df.toPandas()
    table = eda.kernel_density(df, "score", "label").toPandas()
    v = data[data["label"] == 1]["score"].to_numpy()
    q = np.quantile(v, [0.25, 0.75])
    h = 0.9 * min(v.std(ddof=1), (q[1] - q[0]) / 1.34) * len(v) ** -0.2
    part = table[table["label"] == 1].sort_values("x")
    want = np.exp(-((part["x"].to_numpy()[:, None] - v) / h) ** 2 / 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
    assert part["density"].to_numpy() == pytest.approx(want, abs=2e-3)


def test_bins_are_dense(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 2.45), ("b", None)], "g string, x double")
    got = {(r.g, r.x): r.n for r in eda.frequency_by_width(df, "x", "g").collect()}
    assert got == {("a", 1.0): 1, ("a", 2.0): 0, ("a", 3.0): 0, ("a", 4.0): 1,
                   ("b", 1.0): 0, ("b", 2.0): 1, ("b", 3.0): 0, ("b", 4.0): 0}
    bins = eda.frequency_by_bins(df, "x", "g").collect()
    assert len(bins) == 60 and sum(r.n for r in bins) == 3
    assert {(r.g, r.bin) for r in bins if r.n} == {("a", 1), ("a", 30), ("b", 15)}


def test_scores_may_be_infinite_or_nan(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0.1, 0), (0.5, 1), (inf, 1), (inf, 0), (-inf, 0), (-inf, 1), (nan, 1), (nan, 0), (None, 1), (0.3, None)] * 3
    df = spark.createDataFrame(rows, "score double, label int")
    key = lambda s: (s != s, 0 if s != s else s)
    ones = [key(s) for s, y in rows if y == 1 and s is not None]
    zeros = [key(s) for s, y in rows if y == 0]
    want = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / len(ones) / len(zeros)
    assert evaluate.auc(df, "score", "label").first().auc == pytest.approx(want)
    curve = evaluate.roc_points(df, "score", "label").orderBy("cum_tp", "cum_fp").collect()
    assert [(r.cum_tp, r.cum_fp) for r in curve] == [(0, 0), (3, 3), (6, 6), (9, 6), (9, 9), (12, 12)]
    assert curve[1].score != curve[1].score and curve[2].score == inf and curve[-1].score == -inf


def test_wide_ranges_fill_without_arrays(spark):
    """Bins 1 to 3e9: gaps are rows that tasks make; classes at either end; a class named NULL; the input is read once."""
    from collections import Counter
    rows = [(1.0, "a"), (7.0, "a"), (7.0, "a"), (3.0, "b"), (12.0, None)]
    df = spark.createDataFrame(rows, "x double, g string")
    counted = Counter((g, x) for x, g in rows)
    got = eda.frequency_by_width(df, "x", "g", 1.0).collect()
    assert sorted(((r.g, r.x, r.n) for r in got), key=repr) == sorted(
        ((g, float(x), counted[g, x]) for g in ("a", "b", None) for x in range(1, 13)), key=repr)
    wide = spark.createDataFrame([(1.0, "a"), (3e7, "a"), (5.0, "b")], "x double, g string")
    both = eda.frequency_by_width(wide, "x", "g", 1.0).groupBy("g").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).orderBy("g").collect()
    assert [tuple(r) for r in both] == [("a", 30_000_000, 2), ("b", 30_000_000, 1)]
    vast = eda.frequency_by_width(spark.createDataFrame([(1.0, "a"), (3e9, "a")], "x double, g string"), "x", "g", 1.0)
    assert vast.columns == ["g", "x", "n"] and len(vast.limit(5).collect()) == 5
    assert eda.frequency_by_width(df.limit(0), "x", "g", 1.0).count() == 0
    assert eda.frequency_by_bins(df, "x", "g", 4).count() == 12
