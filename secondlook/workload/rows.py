"""Scalar functions, row numbers, splits, folds and the modelling sets Q1, Q4, Q5."""

from __future__ import annotations

from pyspark.sql import functions as F

from secondlook.functions import scalars as S
from secondlook.models import elasticnet
from secondlook.operators import ranking as R
from secondlook.operators import sampling as M
from secondlook.plans import cards, unified
from secondlook.session import stage
from secondlook.workload import standins as I
from secondlook.workload.registry import query
from secondlook.workload.standins import hash_sql
from secondlook.workload.tables import CARDS_SQL, REJECTED_SQL, all_cards, rejected

_INT = "TRY_CAST(trunc(TRY_CAST({0} AS DOUBLE)) AS INTEGER)"
_OLD = "TRY_CAST('2015-' || Data_Mth || '-01' AS DATE)"
_NEW = "TRY_CAST(substr(Month, 1, 4) || '-' || substr(Month, 5, 2) || '-01' AS DATE)"


@query("fn_extract_parsing", f"""
  SELECT row_id, strftime({_OLD}, '%Y-%m-%d') AS Old_Date, strftime({_NEW}, '%Y-%m-%d') AS New_Date,
    CASE WHEN Product_CC_PL_RL LIKE '%VRL%' THEN 'RL' ELSE 'CC' END AS Old_Product,
    CAST(12 * (year({_NEW}) - year({_OLD})) + month({_NEW}) - month({_OLD}) AS INTEGER) AS Diff_Month,
    {_INT.format('AGE')} AS AGE, TRY_CAST(Monthly_Salary AS DOUBLE) AS Monthly_Salary
  FROM {I.EXTRACT.sql} t""")
def fn_extract(spark, sf):
    df = cards.parsed_extract(I.EXTRACT.frame(spark, sf))
    return df.select("row_id", F.date_format("Old_Date", "yyyy-MM-dd").alias("Old_Date"),
                     F.date_format("New_Date", "yyyy-MM-dd").alias("New_Date"), "Old_Product",
                     "Diff_Month", "AGE", "Monthly_Salary")


@query("fn_flags", f"""
  SELECT row_id, CASE WHEN Result IS NULL THEN NULL WHEN Result = 'A' THEN 1 ELSE 0 END AS approved,
    CAST((Result = 'A') AND (Product IN ('CC', 'PROUD')) AS INTEGER) AS target,
    CASE WHEN Result_Description IN ('D01','D02','D09','D10','D11','D21','D22','D23','D24') THEN 1 ELSE 0 END AS declined,
    CASE WHEN Doc_Waive IS NULL THEN 0 ELSE 1 END AS waived, coalesce(Doc_Waive, 'N') AS Doc_Waive,
    substr(Zipcode, 1, 2) AS zip2, CAST(Doc_Waive <> Product AS INTEGER) AS changed,
    regexp_matches(coalesce(Product, ''), '^[A-Z]{{2}}O')::INTEGER AS starts,
    strftime(TRY_CAST(substr(Appl_In_Date, 7, 4) || '-' || substr(Appl_In_Date, 4, 2) || '-'
      || substr(Appl_In_Date, 1, 2) AS DATE), '%Y-%m-%d') AS applied, Monthly_Salary - spending AS gap
  FROM {CARDS_SQL} t""")
def fn_flags(spark, sf):
    return all_cards(spark, sf).select(
        "row_id", S.approval_flag("Result").alias("approved"),
        S.approval_target("Result", "Product").alias("target"),
        S.decline_flag("Result_Description").alias("declined"), S.present_flag("Doc_Waive").alias("waived"),
        S.default_if_missing("Doc_Waive", S.WAIVER_DEFAULT).alias("Doc_Waive"),
        S.left_chars("Zipcode", 2).alias("zip2"), S.change_flag("Doc_Waive", "Product").alias("changed"),
        S.matches("Product", "^[A-Z]{2}O").cast("int").alias("starts"),
        F.date_format(S.day_first_date("Appl_In_Date"), "yyyy-MM-dd").alias("applied"),
        S.difference("Monthly_Salary", "spending").alias("gap"))


@query("fn13_label_numbers", "SELECT vec_id, CAST(label AS DOUBLE) AS label FROM embeddings")
def fn13(spark, sf):
    labels = I.read(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    return labels.withColumn("label", S.label_number("label"))


@query("fn24_share_of_group", """
  SELECT o_orderpriority, CAST(floor(0.8e0 * count(*)) AS BIGINT) AS size FROM orders GROUP BY o_orderpriority""")
def fn24(spark, sf):
    counts = I.read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return counts.select("o_orderpriority", S.share_of(0.8, "n").alias("size"))


@query("fn25_sequences", """
  SELECT p_partkey, CAST(unnest(range(1, p_size + 1)) AS INTEGER) AS i FROM part""")
def fn25(spark, sf):
    return I.read(spark, sf, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), "p_size")).alias("i"))


@query("fn14_level_numbers", """
  SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS level FROM orders""")
def fn14(spark, sf):
    # Levels sort alphabetically and are numbered from 1; StringIndexer counts from 0.
    from pyspark.ml.feature import StringIndexer
    df = I.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    index = StringIndexer(inputCol="o_orderpriority", outputCol="__i", stringOrderType="alphabetAsc")
    return index.fit(df).transform(df).select("o_orderkey", (F.col("__i") + 1).cast("int").alias("level"))


@query("fn23_class_at_threshold", f"""
  SELECT row_id, CASE WHEN score / 400000 >= 0.5 THEN 1 ELSE 0 END AS predicted FROM {I.SCORED.sql} t""")
def fn23(spark, sf):
    return I.SCORED.frame(spark, sf).select("row_id", S.class_at(F.col("score") / 400000).alias("predicted"))


@query("jn8_parameter_grid_by_segment", """
  SELECT c.c_mktsegment, a.alpha, round(0.01 + i.i * (0.2 - 0.01) / 19, 9) AS lambda
  FROM (SELECT DISTINCT c_mktsegment FROM customer) c
  CROSS JOIN (VALUES (0.0::DOUBLE), (0.1), (0.2), (0.4), (0.6), (0.8), (1.0)) a(alpha)
  CROSS JOIN (SELECT unnest(range(0, 20)) AS i) i""")
def jn8(spark, sf):
    # One grid per market segment of the data: 140 settings each.
    segments = I.read(spark, sf, "customer").select("c_mktsegment").distinct()
    return elasticnet.parameter_grid(segments).withColumn("lambda", F.round("lambda", 9))


@query("win7_global_row_number", """
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS idx FROM orders""")
def win7(spark, sf):
    df = I.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return R.global_row_number(df, "o_orderpriority", "o_orderkey").drop("o_orderpriority")


@query("win8_fold_of_position", """
  SELECT o_orderkey, CAST(greatest(1, (10 * (i - 1) + n - 2) // (n - 1)) AS INTEGER) AS fold FROM (
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders)""")
def win8(spark, sf):
    df = R.global_row_number(I.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    n = df.agg(F.count("*")).scalar()
    return df.select("o_orderkey", R.fold_of_position(F.col("idx"), n, 10).alias("fold"))


@query("smp1_exact_split", f"""
  SELECT o_orderkey, CAST(row_number() OVER (ORDER BY {hash_sql(123, 'o_orderkey')}, o_orderkey)
    <= floor(0.8 * count(*) OVER ()) AS INTEGER) AS is_train FROM orders""")
def smp1(spark, sf):
    df = M.exact_split(I.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.8, 123)
    return df.withColumn("is_train", F.col("is_train").cast("int"))


@query("smp3_shuffled", f"""
  SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql(2, 'o_orderkey')}, o_orderkey) AS position FROM orders""")
def smp3(spark, sf):
    return M.shuffled(I.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 2, "position")


@query("smp4_folds", f"""
  SELECT l_id, CAST(greatest(1, (10 * (i - 1) + n - 2) // (n - 1)) AS INTEGER) AS fold FROM (
    SELECT l_id, row_number() OVER (ORDER BY {hash_sql(2, 'l_id')}, l_id) AS i, count(*) OVER () AS n
    FROM (SELECT row_id AS l_id FROM {I.PL15.sql} a UNION ALL SELECT row_id FROM {I.PL16.sql} b))""")
def smp4(spark, sf):
    ids = I.PL15.frame(spark, sf).select("row_id").union(I.PL16.frame(spark, sf).select("row_id"))
    return M.assign_folds(ids.withColumnRenamed("row_id", "l_id"), "l_id", 10, 2)


@query("smp5_fold_rows", f"""
  WITH f AS (SELECT o_orderkey, greatest(1, (10 * (i - 1) + n - 2) // (n - 1)) AS fold FROM (
    SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql(2, 'o_orderkey')}, o_orderkey) AS i,
    count(*) OVER () AS n FROM orders))
  SELECT k.k AS fold, CAST(count(*) FILTER (WHERE f.fold = k.k) AS BIGINT) AS train_rows,
    CAST(count(*) FILTER (WHERE f.fold <> k.k) AS BIGINT) AS validation_rows,
    CAST(sum(CASE WHEN f.fold = k.k THEN o_orderkey ELSE 0 END) AS BIGINT) AS train_key_sum
  FROM f CROSS JOIN (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS k) k GROUP BY k.k""")
def smp5(spark, sf):
    folded = stage(M.assign_folds(I.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 10, 2))
    tables = []
    for i in range(1, 11):
        train, rest = M.fold_parts(folded, i)
        tables.append(train.select(F.lit(i).alias("fold"), "o_orderkey", F.lit(1).alias("t"))
                      .union(rest.select(F.lit(i), "o_orderkey", F.lit(0))))
    both = tables[0]
    for other in tables[1:]:
        both = both.union(other)
    return both.groupBy("fold").agg(
        F.sum(F.col("t").cast("long")).alias("train_rows"), F.count_if(F.col("t") == 0).alias("validation_rows"),
        F.sum(F.when(F.col("t") == 1, F.col("o_orderkey")).otherwise(0)).alias("train_key_sum"))


@query("smp6_stratified_split", f"""
  SELECT row_id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY {hash_sql(1, 'row_id')}, row_id)
    <= ceil(0.8 * count(*) OVER (PARTITION BY label)) AS INTEGER) AS is_train FROM {I.SCORED.sql} t""")
def smp6(spark, sf):
    df = I.SCORED.frame(spark, sf).select("row_id", "label")
    return M.stratified_split(df, "row_id", "label", 0.8, 1).withColumn("is_train", F.col("is_train").cast("int"))


@query("smp8_append_rare_level", f"""
  WITH x AS (SELECT row_id, Occupation_Code, row_number() OVER (ORDER BY {hash_sql(123, 'row_id')}, row_id)
    <= floor(0.8 * count(*) OVER ()) AS is_train FROM {I.EXTRACT.sql} t)
  SELECT row_id, Occupation_Code FROM x WHERE is_train
  UNION ALL SELECT row_id, Occupation_Code FROM x WHERE Occupation_Code = '05'""")
def smp8(spark, sf):
    df = I.EXTRACT.frame(spark, sf).select("row_id", "Occupation_Code")
    train = M.exact_split(df, "row_id", 0.8, 123).filter("is_train").drop("is_train")
    return M.append_level(train, df, "Occupation_Code", "05", "row_id")


MODELLING_SQL = f"""(SELECT row_id, Old_Reason_Desc,
    CASE WHEN Product_CC_PL_RL LIKE '%VRL%' THEN 'RL' ELSE 'CC' END AS Old_Product, Occupation_Code,
    coalesce(Doc_Waive, 'N') AS Doc_Waive, {_INT.format('AGE')} AS AGE, {_INT.format('Appr')} AS Appr,
    CAST(12 * (year({_NEW}) - year({_OLD})) + month({_NEW}) - month({_OLD}) AS INTEGER) AS Diff_Month,
    TRY_CAST(Monthly_Salary AS DOUBLE) AS Monthly_Salary
  FROM (SELECT *, count(*) OVER (PARTITION BY Person) AS copies FROM {I.EXTRACT.sql} t WHERE Product = 'CC')
  WHERE copies = 1 AND TRY_CAST(Monthly_Salary AS DOUBLE) < 125000 AND TRY_CAST(Monthly_Salary AS DOUBLE) > 1000)"""


@query("q1_modelling_set", f"SELECT * FROM {MODELLING_SQL} m")
def q1(spark, sf):
    return cards.modelling_set(I.EXTRACT.frame(spark, sf))


def pairs(spark, sf):
    return cards.before_after(I.CC15.frame(spark, sf), I.CC16.frame(spark, sf),
                              I.OCCUPATION.frame(spark, sf), I.PROVINCE.frame(spark, sf),
                              expect=["F3", "F4", "F5", "F6", "F7", "F8", "F9"])


def _side(source: str, order: str) -> str:
    return f"""(SELECT c.*, o.Code AS OccupationCode, p.City_Type_Code FROM (SELECT * FROM (SELECT *,
      row_number() OVER (PARTITION BY ID ORDER BY ApproveDate {order} NULLS LAST, row_id) AS rn
      FROM {source}) WHERE rn = 1) c
      LEFT JOIN {I.OCCUPATION.sql} o ON c.Occupation IS NOT DISTINCT FROM o.Description
      LEFT JOIN {I.PROVINCE.sql} p ON substr(c.Zipcode, 1, 2) = p.Left2_Zipcode)"""


_CARDS_REJ = f"(SELECT * FROM (SELECT * FROM {I.CC15.sql} a UNION ALL SELECT * FROM {I.CC16.sql} b) WHERE Branch_Code = 'REJ')"
PAIRS_SQL = f"""(SELECT x.ID, x.row_id AS row_id_x, y.row_id AS row_id_y, x.Result AS Result_x, y.Age AS Age_y,
  strftime(CAST(x.ApproveDate AS DATE), '%Y-%m-%d') AS ApproveDate_x,
  substr(y.Appl_In_Date, 7, 4) || '-' || substr(y.Appl_In_Date, 4, 2) || '-' || substr(y.Appl_In_Date, 1, 2) AS Appl_In_Date_y,
  x.City_Type_Code AS City_Type_Code_x,
  x.Monthly_Salary - y.Monthly_Salary AS Monthly_Salary_diff,
  CAST(x.OccupationCode <> y.OccupationCode AS INTEGER) AS OccupationCode_diff_flag,
  CAST(x.Zipcode <> y.Zipcode AS INTEGER) AS ZipCode_diff_flag,
  CASE WHEN y.Doc_Waive IS NULL THEN 0 ELSE 1 END AS Doc_Waive_y_flag
  FROM {_side(_CARDS_REJ, 'DESC')} x JOIN {_side(I.CC15.sql, 'ASC')} y ON x.ID IS NOT DISTINCT FROM y.ID
  WHERE x.OccupationCode IS NOT NULL AND y.OccupationCode IS NOT NULL)"""


@query("q4_before_after", f"SELECT * FROM {PAIRS_SQL} p")
def q4(spark, sf):
    both = pairs(spark, sf)
    dates = {c: F.date_format(c, "yyyy-MM-dd") for c in ("ApproveDate_x", "Appl_In_Date_y")}
    return both.withColumns(dates).select(
        "ID", "row_id_x", "row_id_y", "Result_x", "Age_y", "ApproveDate_x", "Appl_In_Date_y",
        "City_Type_Code_x", "Monthly_Salary_diff", "OccupationCode_diff_flag", "ZipCode_diff_flag",
        "Doc_Waive_y_flag")


def targets(spark, sf):
    return unified.target_set(rejected(spark, sf), I.OCCUPATION.frame(spark, sf), I.PROVINCE.frame(spark, sf),
                              expect=["ID", "ApproveDate", "F3", "F4", "F5", "F6", "F7", "F8", "F9", "F11", "F12"])


TARGET_SQL = f"""(SELECT r.row_id, r.Age, r.Monthly_Salary, p.City_Type_Code, r.Appl_In_Date,
    CAST((Result = 'A') AND (Product IN ('CC', 'PROUD')) AS INTEGER) AS Target,
    CASE WHEN Result_Description IN ('D01','D02','D09','D10','D11','D21','D22','D23','D24') THEN 1 ELSE 0 END AS Decline_Cash
  FROM {REJECTED_SQL} r LEFT JOIN {I.OCCUPATION.sql} o ON r.Occupation IS NOT DISTINCT FROM o.Description
  LEFT JOIN {I.PROVINCE.sql} p ON substr(r.Zipcode, 1, 2) = p.Left2_Zipcode
  WHERE Product <> 'FIX' AND (Monthly_Salary > 10000 OR Monthly_Salary IS NULL) AND Age IS NOT NULL)"""


@query("q5_target_set", f"SELECT * FROM {TARGET_SQL} t")
def q5(spark, sf):
    return targets(spark, sf)


@query("q5_summary", f"""
  SELECT Target, Decline_Cash, count(*) AS n, round(avg(Monthly_Salary), 4) AS mean_salary
  FROM {TARGET_SQL} t GROUP BY Target, Decline_Cash""")
def q5_summary(spark, sf):
    return unified.summary(targets(spark, sf)).withColumn("mean_salary", F.round("mean_salary", 4))
