"""Evaluation, model and exploratory queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from secondlook.models import discriminant, evaluate, glm, knn, smote
from secondlook.operators import eda
from secondlook.operators import sampling as M
from secondlook.session import stage, stage_path
from secondlook.sources.tables import PublishedRuns
from secondlook.workload import standins as I
from secondlook.workload.newton import chi_square_tail, eliminated
from secondlook.workload.registry import query
from secondlook.workload.standins import hash_sql


def scored(spark, sf):
    return I.SCORED.frame(spark, sf)


def rounded(df, digits: int, *names: str):
    # Adding 0 turns -0.0 into 0.0.
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


# --- evaluation -----------------------------------------------------------------------------

_GROUPS = f"""(SELECT score, CAST(sum(label) AS BIGINT) AS tp, CAST(sum(1 - label) AS BIGINT) AS fp
  FROM {I.SCORED.sql} t GROUP BY score)"""


@query("ml6_confusion", f"""
  SELECT a.v AS called, b.v AS label, CAST(coalesce(n, 0) AS BIGINT) AS n
  FROM (VALUES (0), (1)) a(v) CROSS JOIN (VALUES (0), (1)) b(v)
  LEFT JOIN (SELECT called, label, count(*) AS n FROM {I.SCORED.sql} t GROUP BY 1, 2) c
    ON a.v = c.called AND b.v = c.label""")
def ml6(spark, sf):
    return evaluate.confusion(scored(spark, sf), "called", "label")


@query("ml7_roc_points", f"""
  WITH t AS (SELECT sum(tp) AS p, sum(fp) AS n FROM {_GROUPS} g),
  c AS (SELECT score, CAST(sum(tp) OVER w AS BIGINT) AS cum_tp, CAST(sum(fp) OVER w AS BIGINT) AS cum_fp
        FROM {_GROUPS} g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
  SELECT score, cum_tp, cum_fp, round(CAST(cum_tp AS DOUBLE) / p, 9) AS tpr,
    round(CAST(cum_fp AS DOUBLE) / n, 9) AS fpr FROM c, t
  UNION ALL SELECT CAST(NULL AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0e0, 0e0""")
def ml7(spark, sf):
    return rounded(evaluate.roc_points(scored(spark, sf), "score", "label"), 9, "tpr", "fpr")


@query("win9_running_totals_by_group", f"""
  SELECT part, score, CAST(sum(tp) OVER w AS BIGINT) AS cum_tp, CAST(sum(fp) OVER w AS BIGINT) AS cum_fp
  FROM (SELECT part, score, sum(label) AS tp, sum(1 - label) AS fp FROM {I.SCORED.sql} t GROUP BY part, score)
  WINDOW w AS (PARTITION BY part ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")
def win9(spark, sf):
    return (evaluate.roc_points(scored(spark, sf), "score", "label", ["part"]).filter("score IS NOT NULL")
            .select("part", "score", "cum_tp", "cum_fp"))


_PAIR_AUC = """sum(CAST(fp AS DOUBLE) * (cum_tp - tp / 2)) / (sum(tp) * sum(fp))"""


@query("ml8_auc", f"""
  SELECT round({_PAIR_AUC}, 9) AS auc FROM (SELECT *, sum(tp) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
    AS cum_tp FROM {_GROUPS} g)""")
def ml8(spark, sf):
    return rounded(evaluate.auc(scored(spark, sf), "score", "label"), 9, "auc")


@query("ml8_auc_by_group", f"""
  SELECT part, round({_PAIR_AUC}, 9) AS auc FROM (
    SELECT *, sum(tp) OVER (PARTITION BY part ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_tp FROM (
      SELECT part, score, sum(label) AS tp, sum(1 - label) AS fp FROM {I.SCORED.sql} t GROUP BY part, score))
  GROUP BY part""")
def ml8_by(spark, sf):
    return rounded(evaluate.auc(scored(spark, sf), "score", "label", ["part"]), 9, "auc")


@query("ml9_auc_of_class", f"""
  SELECT round((avg(CASE WHEN label = 1 THEN called END) + avg(CASE WHEN label = 0 THEN 1 - called END)) / 2, 9)
    AS auc FROM {I.SCORED.sql} t""")
def ml9(spark, sf):
    return rounded(evaluate.auc(scored(spark, sf), "called", "label"), 9, "auc")


@query("ml20_precision", f"""
  SELECT 'model' AS rule, count(*) FILTER (WHERE called = 1 AND label = 1) AS tp,
    count(*) FILTER (WHERE called = 1 AND label = 0) AS fp,
    round(avg(CASE WHEN called = 1 THEN label END), 9) AS precision FROM {I.SCORED.sql} t
  UNION ALL SELECT 'all 1', CAST(sum(label) AS BIGINT), CAST(sum(1 - label) AS BIGINT), round(avg(label), 9)
    FROM {I.SCORED.sql} t
  UNION ALL SELECT 'all 0', 0, 0, CAST(NULL AS DOUBLE)""")
def ml20(spark, sf):
    return rounded(evaluate.precision_report(scored(spark, sf), "called", "label"), 9, "precision")


# --- logistic regression on one binary predictor: closed form -------------------------------

_TWO = f"""(SELECT CAST(sum(called * label) AS DOUBLE) AS a, CAST(sum(called * (1 - label)) AS DOUBLE) AS b,
  CAST(sum((1 - called) * label) AS DOUBLE) AS c, CAST(sum((1 - called) * (1 - label)) AS DOUBLE) AS d
  FROM {I.SCORED.sql} t)"""
_DEV = "-2 * (a*ln(a/(a+b)) + b*ln(b/(a+b)) + c*ln(c/(c+d)) + d*ln(d/(c+d)))"
_NULL_DEV = "-2 * ((a+c)*ln((a+c)/(a+b+c+d)) + (b+d)*ln((b+d)/(a+b+c+d)))"


def _called_model(spark, sf):
    rows = scored(spark, sf).select("row_id", "label", F.col("called").cast("double").alias("called"))
    return glm.fit_glm(rows.withColumnRenamed("label", "hit"), "hit ~ called"), rows


@query("ml2_glm_closed_form", f"""
  SELECT 'called' AS term, round(ln(a*d/(b*c)), 6) AS estimate, round(sqrt(1/a+1/b+1/c+1/d), 6) AS std_error,
    round(ln(a*d/(b*c)) / sqrt(1/a+1/b+1/c+1/d), 5) AS z_value,
    round({chi_square_tail('pow(ln(a*d/(b*c)), 2) / (1/a+1/b+1/c+1/d)')}, 6) AS p_value FROM {_TWO} t
  UNION ALL SELECT '(Intercept)', round(ln(c/d), 6), round(sqrt(1/c+1/d), 6), round(ln(c/d)/sqrt(1/c+1/d), 5),
    round({chi_square_tail('pow(ln(c/d), 2) / (1/c+1/d)')}, 6)
  FROM {_TWO} t""")
def ml2(spark, sf):
    model, rows = _called_model(spark, sf)
    table = glm.coefficient_table(model, rows.withColumnRenamed("label", "hit"))
    return rounded(rounded(table, 6, "estimate", "std_error", "p_value"), 5, "z_value")


@query("ml3_deviances", f"""
  SELECT 'null_deviance' AS measure, round({_NULL_DEV}, 5) AS value, CAST(a+b+c+d-1 AS INTEGER) AS df FROM {_TWO} t
  UNION ALL SELECT 'residual_deviance', round({_DEV}, 5), CAST(a+b+c+d-2 AS INTEGER) FROM {_TWO} t
  UNION ALL SELECT 'aic', round({_DEV} + 4, 5), NULL FROM {_TWO} t""")
def ml3(spark, sf):
    model, rows = _called_model(spark, sf)
    return rounded(glm.deviance_table(model, rows), 5, "value")


@query("ml5_probabilities", f"""
  SELECT row_id, round(CASE WHEN called = 1 THEN p.a / (p.a + p.b) ELSE p.c / (p.c + p.d) END, 8) AS probability
  FROM {I.SCORED.sql} s, {_TWO} p""")
def ml5(spark, sf):
    model, rows = _called_model(spark, sf)
    return rounded(glm.predict(model, rows).select("row_id", "probability"), 8, "probability")


@query("ml5_held_out_probabilities", f"""
  WITH s AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(123, 'row_id')}, row_id)
    <= floor(0.8 * count(*) OVER ()) AS is_train FROM {I.SCORED.sql} t),
  p AS (SELECT called, avg(label) AS p FROM s WHERE is_train GROUP BY called)
  SELECT row_id, round(p, 8) AS probability, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted
  FROM s JOIN p USING (called) WHERE NOT is_train""")
def ml5_held_out(spark, sf):
    rows = scored(spark, sf).select("row_id", "label", F.col("called").cast("double").alias("called"))
    flagged = stage(M.exact_split(rows, "row_id", 0.8, 123))
    model = glm.fit_glm(flagged.filter("is_train").withColumnRenamed("label", "hit"), "hit ~ called")
    test = glm.classify(glm.predict(model, flagged.filter("NOT is_train")))
    return rounded(test.select("row_id", "probability", "predicted"), 8, "probability")


# With one binary predictor the area is the mean of sensitivity and specificity, or its
# complement when the fitted slope falls.
_FOLD_AUC = f"""WITH f AS (SELECT label, called, greatest(1, (10 * (i - 1) + n - 2) // (n - 1)) AS fold FROM (
    SELECT *, row_number() OVER (ORDER BY {hash_sql(2, 'row_id')}, row_id) AS i, count(*) OVER () AS n
    FROM {I.SCORED.sql} t)),
  k AS (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS k),
  t AS (SELECT k, avg(CASE WHEN called = 1 THEN label END) > avg(CASE WHEN called = 0 THEN label END) AS up
    FROM f JOIN k ON {{train}} GROUP BY k),
  v AS (SELECT k, (avg(CASE WHEN label = 1 THEN called END) + avg(CASE WHEN label = 0 THEN 1 - called END)) / 2 AS m
    FROM f JOIN k ON NOT ({{train}}) GROUP BY k),
  a AS (SELECT k, CASE WHEN up THEN m ELSE 1 - m END AS auc FROM t JOIN v USING (k))"""


def _folded(spark, sf):
    rows = scored(spark, sf).select("row_id", F.col("label").alias("hit"), F.col("called").cast("double").alias("called"))
    return stage(M.assign_folds(rows, "row_id", 10, 2))


@query("ml18_fold_auc", _FOLD_AUC.format(train="f.fold = k.k") + " SELECT k AS fold, round(auc, 9) AS auc FROM a")
def ml18(spark, sf):
    return rounded(glm.fold_auc(_folded(spark, sf), "hit ~ called", "hit"), 9, "auc")


# The class called is the one that half of the training rows or more of the same kind have.
@query("ml16_cross_validated_roc", _FOLD_AUC.format(train="f.fold <> k.k") + """,
  g AS (SELECT k, called, avg(label) >= 0.5 AS hit FROM f JOIN k ON f.fold <> k.k GROUP BY k, called),
  r AS (SELECT g.k, avg(CASE WHEN label = 1 THEN CAST(hit AS INTEGER) END) AS sens,
    avg(CASE WHEN label = 0 THEN CAST(NOT hit AS INTEGER) END) AS spec FROM f JOIN g ON f.fold = g.k AND f.called = g.called GROUP BY g.k),
  long AS (SELECT 'roc' AS measure, auc AS v FROM a UNION ALL SELECT 'sensitivity', sens FROM r
    UNION ALL SELECT 'specificity', spec FROM r)
  SELECT measure, round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS sd FROM long GROUP BY measure""")
def ml16(spark, sf):
    return rounded(glm.cross_validate(_folded(spark, sf), "hit ~ called", "hit"), 8, "mean", "sd")


@query("ml19_analysis_of_deviance", f"""
  SELECT 'NULL' AS term, CAST(NULL AS INTEGER) AS df, CAST(NULL AS DOUBLE) AS deviance,
    CAST(a+b+c+d-1 AS INTEGER) AS resid_df, round({_NULL_DEV}, 5) AS resid_dev FROM {_TWO} t
  UNION ALL SELECT 'called', 1, round({_NULL_DEV} - ({_DEV}), 5), CAST(a+b+c+d-2 AS INTEGER), round({_DEV}, 5)
  FROM {_TWO} t""")
def ml19(spark, sf):
    rows = scored(spark, sf).select(F.col("label").alias("hit"), F.col("called").cast("double").alias("called"))
    return rounded(glm.analysis_of_deviance(rows, "hit", ["called"]).drop("p_value"), 5, "deviance", "resid_dev")


# One binary predictor that may be missing: three groups, so the fit that passes missing values on is their logits.
_HOLES = """(SELECT label, CASE WHEN part <> '5-LOW' THEN called END AS called FROM {0} t)""".format(I.SCORED.sql)
_LOGITS = f"""(SELECT ln(avg(label) FILTER (WHERE called = 0) / avg(1 - label) FILTER (WHERE called = 0)) AS zero,
  ln(avg(label) FILTER (WHERE called = 1) / avg(1 - label) FILTER (WHERE called = 1)) AS one,
  ln(avg(label) FILTER (WHERE called IS NULL) / avg(1 - label) FILTER (WHERE called IS NULL)) AS hole FROM {_HOLES} h)"""


@query("flt10_missing_predictors", f"""
  SELECT 'pass' AS missing, '(Intercept)' AS term, round(zero, 6) AS estimate FROM {_LOGITS} t
  UNION ALL SELECT 'pass', 'called', round(one - zero, 6) FROM {_LOGITS} t
  UNION ALL SELECT 'pass', 'called_missing', round(hole - zero, 6) FROM {_LOGITS} t
  UNION ALL SELECT 'skip', '(Intercept)', round(zero, 6) FROM {_LOGITS} t
  UNION ALL SELECT 'skip', 'called', round(one - zero, 6) FROM {_LOGITS} t""")
def flt10(spark, sf):
    rows = scored(spark, sf).select("label", F.when(F.col("part") != "5-LOW", F.col("called")).cast("double").alias("called"))
    tables = [glm.fit_table(rows, "label", ["called"], m).select(F.lit(m).alias("missing"), "term", "estimate") for m in ("pass", "skip")]
    return rounded(tables[0].union(tables[1]), 6, "estimate")


@query("ml15_centre_and_scale", """
  SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 8) AS scaled
  FROM customer""")
def ml15(spark, sf):
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    rows = VectorAssembler(inputCols=["c_acctbal"], outputCol="raw").transform(I.read(spark, sf, "customer"))
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="scaled").fit(rows)
    done = scaler.transform(rows).select("c_custkey", vector_to_array("scaled")[0].alias("scaled"))
    return rounded(done, 8, "scaled")


@query("ml1_design_matrix", """
  SELECT l.doc_id, n_chars::DOUBLE AS n_chars, (lang = 'en')::INTEGER::DOUBLE AS lang_en,
    (lang = 'es')::INTEGER::DOUBLE AS lang_es, (lang = 'fr')::INTEGER::DOUBLE AS lang_fr
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def ml1(spark, sf):
    from pyspark.ml.functions import vector_to_array
    rows = I.read(spark, sf, "labels").join(I.read(spark, sf, "documents").drop("text"), "doc_id")
    made = glm.design("quality ~ n_chars + lang").fit(rows).transform(rows)
    x = vector_to_array("features")
    # Levels after the first (de) in falling order: fr, es, en.
    return made.select("doc_id", x[0].alias("n_chars"), x[1].alias("lang_fr"), x[2].alias("lang_es"),
                       x[3].alias("lang_en"))


# --- discriminants --------------------------------------------------------------------------

DIMENSIONS = [f"x{i}" for i in range(1, 65)]


def points(spark, sf):
    return I.read(spark, sf, "embeddings").select(
        "vec_id", F.when(F.col("label") < 5, 0).otherwise(1).alias("y"), "label",
        *[F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(DIMENSIONS)])


# All 64 components: class means, sums of products about them, and matrices solved by elimination.
_CLASSES = """p AS (SELECT vec_id, CASE WHEN label < 5 THEN 0 ELSE 1 END AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
  j AS (SELECT unnest(range(1, 65)) AS j),
  means AS (SELECT y, max(n) AS n, list(m ORDER BY j) AS m FROM (SELECT y, j, avg(x[j]) AS m, count(*) AS n FROM p, j GROUP BY y, j) GROUP BY y),
  z AS (SELECT vec_id, p.y, list_transform(range(1, 65), lambda k: x[k] - m[k]) AS z FROM p JOIN means ON p.y = means.y),
  cells AS (SELECT y, a.j AS i, b.j AS j, sum(z[a.j] * z[b.j]) AS s FROM z, j a, j b GROUP BY ALL),
  total AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM means)"""
_LINEAR = f"""{_CLASSES},
  pooled AS (SELECT i, list(s ORDER BY j) AS r FROM (SELECT i, j, sum(s) / (max(total) - 2) AS s FROM cells, total GROUP BY i, j) GROUP BY i),
  sides AS (SELECT list(r || [a.m[i], b.m[i]] ORDER BY i) AS m FROM pooled, means a, means b WHERE a.y = 0 AND b.y = 1),
  solved AS (SELECT {eliminated('m', 64)} AS s FROM sides),
  weights AS (SELECT y, n, m, list_transform(range(1, 65), lambda k: s[k][65 + y] / s[k][k]) AS w FROM means, solved)"""
_QUADRATIC = f"""{_CLASSES},
  own AS (SELECT y, i, list(s / (n - 1) ORDER BY j) || list_transform(range(1, 65), lambda k: CAST(k = i AS INTEGER)::DOUBLE) AS r
    FROM cells JOIN means USING (y) GROUP BY y, i),
  sides AS (SELECT y, list(r ORDER BY i) AS m FROM own GROUP BY y),
  solved AS (SELECT y, {eliminated('m', 64)} AS s FROM sides),
  inverse AS (SELECT y, list_transform(s, lambda r, i: list_transform(r[65:128], lambda v: v / r[i])) AS inv,
    list_sum(list_transform(s, lambda r, i: ln(r[i]))) AS logdet FROM solved)"""


@query("ml10_lda_moments", f"""WITH {_CLASSES}
  SELECT CAST(y AS VARCHAR) AS class, n, round(n / total, 9) AS prior, concat('x', j) AS feature, round(m[j], 9) AS mean FROM means, j, total""")
def ml10(spark, sf):
    rows = points(spark, sf)
    fit = discriminant.fit_lda(rows, "y", DIMENSIONS)
    return rounded(discriminant.moments_table(rows, fit.classes, fit.features), 9, "prior", "mean")


@query("ml11_lda_class", f"""WITH {_LINEAR}
  SELECT vec_id, predicted FROM (SELECT vec_id, w.y AS predicted, row_number() OVER (PARTITION BY vec_id
    ORDER BY ln(n / total) + list_dot_product(x, w) - list_dot_product(m, w) / 2 DESC, w.y) AS place FROM p, weights w, total) WHERE place = 1""")
def ml11(spark, sf):
    rows = points(spark, sf)
    return discriminant.fit_lda(rows, "y", DIMENSIONS).classify(rows).select("vec_id", "predicted")


@query("ml12_qda_class", f"""WITH {_QUADRATIC},
  gaps AS (SELECT vec_id, c.y, n, list_transform(range(1, 65), lambda k: x[k] - m[k]) AS z FROM p, means c)
  SELECT vec_id, predicted FROM (SELECT vec_id, g.y AS predicted, row_number() OVER (PARTITION BY vec_id
    ORDER BY ln(n / total) - logdet / 2 - list_dot_product(z, list_transform(inv, lambda r: list_dot_product(r, z))) / 2 DESC, g.y) AS place
    FROM gaps g JOIN inverse ON g.y = inverse.y, total) WHERE place = 1""")
def ml12(spark, sf):
    rows = points(spark, sf)
    return discriminant.fit_qda(rows, "y", DIMENSIONS).classify(rows).select("vec_id", "predicted")


@query("eda6_discriminant_histogram", f"""WITH {_LINEAR},
  way AS (SELECT list_transform(range(1, 65), lambda k: b.w[k] - a.w[k]) AS u, list_transform(range(1, 65), lambda k: b.m[k] - a.m[k]) AS gap,
    list_transform(range(1, 65), lambda k: (a.n * a.m[k] + b.n * b.m[k]) / total) AS centre FROM weights a, weights b, total WHERE a.y = 0 AND b.y = 1),
  v AS (SELECT y, sign(u[1]) * (list_dot_product(x, u) - list_dot_product(centre, u)) / sqrt(list_dot_product(u, gap)) AS ld1 FROM p, way),
  c AS (SELECT y, CAST(floor(ld1/0.5+0.5) AS BIGINT) AS bin, count(*) AS n FROM v GROUP BY 1, 2),
  g AS (SELECT y, bin FROM (SELECT DISTINCT y FROM c),
      (SELECT unnest(generate_series(min(bin), max(bin))) AS bin FROM c))
  SELECT g.y, g.bin * 0.5e0 AS x, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM g LEFT JOIN c USING (y, bin)""")
def eda6(spark, sf):
    rows = points(spark, sf)
    placed = discriminant.fit_lda(rows, "y", DIMENSIONS).project(rows)
    return eda.frequency_by_width(placed, "ld1", "y", 0.5)


# --- nearest neighbours ---------------------------------------------------------------------

def knn_split(spark, sf):
    rows = I.read(spark, sf, "embeddings").select(
        "vec_id", "label", *[F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(DIMENSIONS)])
    flagged = stage(M.exact_split(rows, "vec_id", 0.8, 123), "knn-split")
    return flagged.filter("is_train"), flagged.filter("NOT is_train")


_KNN = f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(123, 'vec_id')}, vec_id)
    <= floor(0.8 * count(*) OVER ()) AS is_train
    FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
  d AS (SELECT a.vec_id, a.label AS actual, b.label,
      list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1]-z[2])*(z[1]-z[2]))) AS d2
    FROM s a JOIN s b ON NOT a.is_train AND b.is_train),
  r AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY d2) AS rk FROM d),
  v AS (SELECT k, vec_id, actual, label, count(*) AS n FROM r
    JOIN (SELECT unnest(range(1, 41)) AS k) k ON rk <= k GROUP BY ALL),
  p AS (SELECT k, vec_id, actual, label AS predicted,
    row_number() OVER (PARTITION BY k, vec_id ORDER BY n DESC, label) AS o FROM v)"""


@query("ml13_knn_class", f"{_KNN} SELECT vec_id, predicted FROM p WHERE o = 1 AND k = 7")
def ml13(spark, sf):
    train, test = knn_split(spark, sf)
    return knn.classify(train, test, DIMENSIONS, "label", 7).select("vec_id", "predicted")


@query("ml14_accuracy_by_k", f"""{_KNN} SELECT CAST(k AS INTEGER) AS k,
  round(avg(CASE WHEN actual = predicted THEN 1 ELSE 0 END), 9) AS accuracy FROM p WHERE o = 1 GROUP BY k""")
def ml14(spark, sf):
    train, test = knn_split(spark, sf)
    return rounded(knn.accuracy_by_k(train, test, DIMENSIONS, "label", 40), 9, "accuracy")


@query("jn9_nearest_64_dimensions", """
  WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  d AS (SELECT a.vec_id, b.vec_id AS near_id, b.label, list_sum(list_transform(list_zip(a.v, b.v),
      lambda z: (z[1]-z[2])*(z[1]-z[2]))) AS d2 FROM e a JOIN e b ON true),
  r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, near_id) AS rk FROM d)
  SELECT vec_id, round(max(d2), 6) AS kth, CAST(sum(label) AS BIGINT) AS label_sum FROM r WHERE rk <= 10 GROUP BY vec_id""")
def jn9(spark, sf):
    from secondlook.operators.neighbours import nearest
    e = I.read(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))
    near = nearest(e, e, 10, tag="label")
    return (e.select("vec_id", "vec").join(near, "vec").groupBy("vec_id")
            .agg(F.round(F.max("dist2"), 6).alias("kth"),
                 F.sum(F.col("tag").cast("long") * F.col("w")).alias("label_sum")))


# --- balancing ------------------------------------------------------------------------------

def labelled(spark, sf):
    return (I.read(spark, sf, "labels").join(I.read(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
            .select(F.col("doc_id").alias("row_id"), (1 - F.col("quality")).alias("low"),
                    F.col("n_chars").cast("double").alias("n_chars"), F.col("toxic").cast("double").alias("toxic"),
                    "lang"))


_LABELLED = """(SELECT l.doc_id AS row_id, 1 - quality AS low, n_chars::DOUBLE AS n_chars, toxic::DOUBLE AS toxic, lang
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


@query("ml22_smote_class_counts", f"""
  WITH m AS (SELECT count(*) AS m FROM {_LABELLED} t WHERE low = 1)
  SELECT 'observed' AS origin, 1 AS low, m AS n FROM m UNION ALL SELECT 'synthetic', 1, 2 * m FROM m
  UNION ALL SELECT 'resampled', 0, 4 * m FROM m""")
def ml22_counts(spark, sf):
    rows = smote.smote(labelled(spark, sf), "row_id", "low", ["n_chars", "toxic"], ["lang"], 200, 200)
    return rows.groupBy("origin", "low").agg(F.count("*").alias("n"))


def _h(*parts: str) -> str:
    text = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST('0x' || substr(md5(concat_ws(':', '1', {text})), 1, 15) AS BIGINT)"


@query("ml22_smote_rows", f"""
  WITH f AS (SELECT * FROM {_LABELLED} t WHERE low = 1),
  g AS (SELECT max(n_chars)-min(n_chars) AS rn, max(toxic)-min(toxic) AS rt FROM f),
  d AS (SELECT a.row_id, b.n_chars AS n2, b.toxic AS t2, b.lang AS l2,
      pow((a.n_chars-b.n_chars)/rn, 2) + CASE WHEN rt > 0 THEN pow((a.toxic-b.toxic)/rt, 2) ELSE 0 END
      + CASE WHEN a.lang = b.lang THEN 0 ELSE 1 END AS d2
    FROM f a JOIN f b ON a.row_id <> b.row_id CROSS JOIN g),
  r AS (SELECT *, row_number() OVER (PARTITION BY row_id
    ORDER BY round(d2, 12), n2, t2, l2 DESC) AS slot FROM d),
  c AS (SELECT f.*, copy, {_h("'slot'", "row_id", "copy")} % 5 + 1 AS slot,
      {_h("'gap'", "row_id", "copy")} / 1152921504606846976e0 AS gap, {_h("'lang'", "row_id", "copy")} % 2 AS toss
    FROM f CROSS JOIN (SELECT unnest([1, 2]) AS copy) k)
  SELECT c.row_id AS parent, CAST(copy AS INTEGER) AS copy, round(n_chars + gap * (n2 - n_chars), 6) AS n_chars,
    round(toxic + gap * (t2 - toxic), 6) AS toxic, CASE WHEN toss = 0 THEN lang ELSE l2 END AS lang
  FROM c JOIN r ON c.row_id = r.row_id AND c.slot = r.slot""")
def ml22_rows(spark, sf):
    few = labelled(spark, sf).filter("low = 1")
    return rounded(smote.synthesize(few, "row_id", ["n_chars", "toxic"], ["lang"], 2), 6, "n_chars", "toxic")


@query("ml22_resampled_majority", f"""
  WITH m AS (SELECT count(*) FILTER (WHERE low = 1) AS few, count(*) FILTER (WHERE low = 0) AS many FROM {_LABELLED} t),
  i AS (SELECT *, row_number() OVER (ORDER BY row_id) AS idx FROM {_LABELLED} t WHERE low = 0),
  p AS (SELECT draw, {_h("'draw'", "draw")} % many + 1 AS idx FROM (SELECT unnest(range(1, 4 * few + 1)) AS draw, many FROM m))
  SELECT CAST(draw AS BIGINT) AS draw, row_id, lang FROM p JOIN i USING (idx)""")
def ml22_resampled(spark, sf):
    rows = labelled(spark, sf)
    draws = rows.filter("low = 1").count() * 4
    return smote.resample(rows.filter("low = 0"), "row_id", draws).select("draw", "row_id", "lang")


# --- exploratory tables ---------------------------------------------------------------------

@query("eda1_kernel_density", """
  WITH x AS (SELECT c_mktsegment AS s, c_acctbal AS x FROM customer),
  g AS (SELECT min(x) AS lo, (max(x)-min(x))/511 AS step FROM x),
  b AS (SELECT s, count(*) AS n, 0.9 * CASE WHEN quantile_cont(x,0.75) > quantile_cont(x,0.25)
      AND (quantile_cont(x,0.75)-quantile_cont(x,0.25))/1.34 < stddev_samp(x)
      THEN (quantile_cont(x,0.75)-quantile_cont(x,0.25))/1.34 ELSE stddev_samp(x) END * pow(count(*), -0.2) AS h
      FROM x GROUP BY s),
  p AS (SELECT s, (x-lo)/step AS pos, least(floor((x-lo)/step), 510) AS c FROM x, g),
  w AS (SELECT s, c, sum(w) AS w FROM (SELECT s, c, 1-(pos-c) AS w FROM p UNION ALL SELECT s, c+1, pos-c FROM p)
      GROUP BY s, c)
  SELECT w.s AS c_mktsegment, CAST(k AS INTEGER) AS point, round(max(lo + k*step), 6) AS x,
    round(sum(w * exp(-0.5*pow((k-c)*step/h, 2)) / (h*sqrt(2*pi()))) / max(n), 12) AS density
  FROM w JOIN b ON w.s = b.s, g, (SELECT unnest(range(0, 512)) AS k) GROUP BY w.s, k""")
def eda1(spark, sf):
    table = eda.kernel_density(I.read(spark, sf, "customer"), "c_acctbal", "c_mktsegment")
    return rounded(rounded(table, 6, "x"), 12, "density")


@query("eda2_frequency_by_width", """
  WITH c AS (SELECT p_brand, CAST(floor(p_size + 0.5) AS BIGINT) AS bin, count(*) AS n FROM part GROUP BY 1, 2),
  g AS (SELECT p_brand, bin FROM (SELECT DISTINCT p_brand FROM c),
    (SELECT unnest(generate_series(min(bin), max(bin))) AS bin FROM c))
  SELECT g.p_brand, CAST(g.bin AS DOUBLE) AS x, CAST(coalesce(n, 0) AS BIGINT) AS n
  FROM g LEFT JOIN c ON g.p_brand = c.p_brand AND g.bin = c.bin""")
def eda2(spark, sf):
    return eda.frequency_by_width(I.read(spark, sf, "part"), "p_size", "p_brand")


@query("eda3_frequency_by_bins", """
  WITH g AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer),
  c AS (SELECT c_mktsegment, least(CAST(floor((c_acctbal-lo)/((hi-lo)/30)) AS BIGINT)+1, 30) AS bin, count(*) AS n
    FROM customer, g GROUP BY 1, 2),
  f AS (SELECT c_mktsegment, bin FROM (SELECT DISTINCT c_mktsegment FROM c), (SELECT unnest(range(1, 31)) AS bin))
  SELECT f.c_mktsegment, CAST(f.bin AS BIGINT) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS n
  FROM f LEFT JOIN c ON f.c_mktsegment = c.c_mktsegment AND f.bin = c.bin""")
def eda3(spark, sf):
    return eda.frequency_by_bins(I.read(spark, sf, "customer"), "c_acctbal", "c_mktsegment")


@query("eda4_cell_counts", """
  SELECT p_type, CAST(floor(p_size / 5.0) AS BIGINT) AS x_cell, CAST(floor(p_retailprice / 100) AS BIGINT) AS y_cell,
    count(*) AS n FROM part GROUP BY ALL""")
def eda4(spark, sf):
    return eda.cell_counts(I.read(spark, sf, "part"), "p_size", "p_retailprice", "p_type", 5.0, 100.0)


@query("eda5_correlations", """
  SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 8) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 8) FROM lineitem""")
def eda5(spark, sf):
    table = eda.correlations(I.read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(table, 8, "r")


# --- the tables behind the plots, published as one run ---------------------------------------

def _published(spark, sf):
    customers, parts = I.read(spark, sf, "customer"), I.read(spark, sf, "part")
    runs = PublishedRuns(spark, stage_path(spark, "eda-runs"))
    runs.publish("first", {
        "density": eda.kernel_density(customers, "c_acctbal", "c_mktsegment"), "by_width": eda.frequency_by_width(parts, "p_size", "p_brand"),
        "by_bins": eda.frequency_by_bins(customers, "c_acctbal", "c_mktsegment"),
        "cells": eda.cell_counts(parts, "p_size", "p_retailprice", "p_type", 5.0, 100.0)})
    return runs


@query("snk3_published_tables", """
  SELECT 'density' AS "table", 512 * count(DISTINCT c_mktsegment) AS rows, 4 AS n_columns FROM customer
  UNION ALL SELECT 'by_width', count(DISTINCT p_brand) * (max(p_size) - min(p_size) + 1), 3 FROM part
  UNION ALL SELECT 'by_bins', 30 * count(DISTINCT c_mktsegment), 3 FROM customer
  UNION ALL SELECT 'cells', count(*), 4 FROM (SELECT DISTINCT p_type, floor(p_size / 5.0), floor(p_retailprice / 100) FROM part)""")
def snk3_tables(spark, sf):
    fields = F.size(F.from_json(F.get_json_object("columns", "$.fields"), "array<string>"))
    return _published(spark, sf).manifest("first").select("table", "rows", fields.alias("n_columns"))


@query("snk3_read_back", """
  SELECT p_type, CAST(floor(p_size / 5.0) AS BIGINT) AS x_cell, CAST(floor(p_retailprice / 100) AS BIGINT) AS y_cell,
    count(*) AS n FROM part GROUP BY ALL""")
def snk3_back(spark, sf):
    return _published(spark, sf).read("first", "cells")
