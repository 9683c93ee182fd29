"""Sources, sinks, schema, projection and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from secondlook.functions import predicates as P
from secondlook.functions import scalars as S
from secondlook.operators import aggregates as A
from secondlook.operators import schema as C
from secondlook.sources import tables as IO
from secondlook.plans import cards, leads, unified
from secondlook.session import stage_path
from secondlook.workload import standins as I
from secondlook.workload.registry import query

CARDS_SQL = f"(SELECT * FROM {I.CC15.sql} a UNION ALL SELECT * FROM {I.CC16.sql} b)"


def all_cards(spark, sf):
    return A.union_by_name(I.CC15.frame(spark, sf), I.CC16.frame(spark, sf))


EXTRACT_COLUMNS = ["row id", "Data.Mth", "Product(CC/PL/RL)", "Month", "AGE", "Monthly Salary", "Product",
                   "Person", "Old_Reason_Desc", "Occupation_Code", "Doc_Waive", "Appr"]


@query("src1_text_extract", f"""
  SELECT CAST(row_id AS VARCHAR) AS row_id, Data_Mth, Product_CC_PL_RL AS Product_CC_PL_RL_, Month, AGE,
         TRY_CAST(Monthly_Salary AS DOUBLE) AS Monthly_Salary,
         Product, Person, Old_Reason_Desc, Occupation_Code, Doc_Waive, Appr
  FROM {I.EXTRACT.sql} x""")
def src1(spark, sf):
    path = stage_path(spark, "extract")
    frame = I.EXTRACT.frame(spark, sf).selectExpr(
        *[f"CAST({c} AS STRING) AS {c}" if c == "row_id"
          else f"CASE WHEN {c} IS NULL THEN ' ' ELSE concat(' ', {c}, '  ') END AS {c}"
          for c in I.EXTRACT.frame(spark, sf).columns])
    IO.write_text_extract(frame.toDF(*EXTRACT_COLUMNS), path)
    # The two engines write a number's digits differently, so this one text is compared as a number.
    return IO.read_text_extract(spark, path, EXTRACT_COLUMNS).withColumn(
        "Monthly_Salary", S.text_to_double("Monthly_Salary"))


@query("src2_catalog", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def src2(spark, sf):
    catalog = IO.Catalog(spark, {
        "nation": (f"{sf}/nation.parquet", "n_nationkey int, n_name string, n_regionkey int"),
        "region": (f"{sf}/region.parquet", "r_regionkey int, r_name string")})
    nation, region = catalog.read("nation"), catalog.read("region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("src3_saved_stage", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def src3(spark, sf):
    frame = I.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    path = stage_path(spark, "saved")
    IO.save_stage(frame, path)
    return IO.load_stage(spark, path, frame.schema)


@query("snk1_lead_metrics", f"""
  WITH lead AS (SELECT * FROM {I.LEAD.sql} t WHERE ID IS NOT NULL)
  SELECT 'total' AS metric, CAST(count(*) AS DOUBLE) AS value FROM lead
  UNION ALL SELECT 'distinct', CAST(count(DISTINCT ID) AS DOUBLE) FROM lead
  UNION ALL SELECT 'repeats', CAST(count(*) - count(DISTINCT ID) AS DOUBLE) FROM lead""")
def snk1(spark, sf):
    return leads.lead_counts(I.LEAD.frame(spark, sf))


@query("snk2_partitioned_sink", "SELECT o_orderpriority AS part, o_orderkey, o_totalprice FROM orders")
def snk2(spark, sf):
    frame = I.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("part"), "o_orderkey",
                                               "o_totalprice")
    path = stage_path(spark, "parts")
    IO.write_parts(frame, path, "part")
    return IO.load_stage(spark, path, "o_orderkey long, o_totalprice double, part string")


@query("sch1_clean_names", """
  SELECT o_orderkey AS Order_Key, o_orderpriority AS X1st_Priority, o_totalprice AS Price__THB_ FROM orders""")
def sch1(spark, sf):
    raw = I.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return C.clean_names(raw.toDF("Order Key", "1st.Priority", "Price (THB)"))


_LOANS = f"(SELECT * FROM {I.PL15.sql} a UNION ALL SELECT * FROM {I.PL16.sql} b)"


@query("sch2_rename", f"""
  SELECT row_id, LoanType AS SubType, Income AS Monthly_Salary, DrawDown AS firstUsedAmt FROM {_LOANS} t""")
def sch2(spark, sf):
    loans = A.union_by_name(I.PL15.frame(spark, sf), I.PL16.frame(spark, sf))
    return C.rename(loans, SubType="LoanType", Monthly_Salary="Income", firstUsedAmt="DrawDown").select(
        "row_id", "SubType", "Monthly_Salary", "firstUsedAmt")


_COMMON = [c.split(" AS ")[-1] for c in I._CARD]
_AS_COMMON = ", ".join({"spending": "spending AS firstUsedAmt"}.get(c, c) for c in _COMMON)
_LOAN_NAMES = {"SubType": "LoanType AS SubType", "Monthly_Salary": "Income AS Monthly_Salary",
               "spending": "DrawDown AS firstUsedAmt"}
_LOAN_AS_COMMON = ", ".join(_LOAN_NAMES.get(c, c) for c in _COMMON)
# Cards and loans on their common columns, rejected branch only.
REJECTED_SQL = f"""(SELECT * FROM (
  SELECT {_AS_COMMON} FROM {I.CC15.sql} a UNION ALL SELECT {_LOAN_AS_COMMON} FROM {I.PL15.sql} b
  UNION ALL SELECT {_AS_COMMON} FROM {I.CC16.sql} c UNION ALL SELECT {_LOAN_AS_COMMON} FROM {I.PL16.sql} d
  ) u WHERE Branch_Code = 'REJ')"""


def rejected(spark, sf):
    return unified.rejected_applications([I.CC15.frame(spark, sf), I.CC16.frame(spark, sf)],
                                         [I.PL15.frame(spark, sf), I.PL16.frame(spark, sf)])


@query("sch4_common_columns", f"""
  SELECT ID, firstUsedAmt, Monthly_Salary, SubType, Product, row_id FROM {REJECTED_SQL} r""")
def sch4(spark, sf):
    return rejected(spark, sf).select("ID", "firstUsedAmt", "Monthly_Salary", "SubType", "Product", "row_id")


@query("sch6_suffixed_join", f"""
  SELECT a.row_id AS row_id_x, b.row_id AS row_id_y, a.Monthly_Salary AS Monthly_Salary_x,
         b.Monthly_Salary AS Monthly_Salary_y, a.ID
  FROM {I.CC15.sql} a LEFT JOIN {I.CC16.sql} b ON a.ID IS NOT DISTINCT FROM b.ID""")
def sch6(spark, sf):
    from secondlook.operators.joins import left_join
    names = ["ID", "row_id", "Monthly_Salary"]
    return left_join(I.CC15.frame(spark, sf).select(*names), I.CC16.frame(spark, sf).select(*names), ["ID"])


@query("prj2_drop_names", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def prj2(spark, sf):
    return C.drop_names(I.read(spark, sf, "orders"), "o_orderstatus", "o_orderdate", "o_orderpriority",
                        "o_orderstatus")


@query("prj3_drop_positions", "SELECT l_orderkey, l_partkey, l_shipdate FROM lineitem")
def prj3(spark, sf):
    return C.drop_positions(I.read(spark, sf, "lineitem"), (3, 10), expect=[
        "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus"])


@query("prj7_same_function", """
  SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS first_date,
         strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS second_date FROM orders""")
def prj7(spark, sf):
    df = I.read(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("first_date"),
                                            F.col("o_orderdate").alias("second_date"))
    df = C.apply_to(df, ["first_date", "second_date"], S.to_date_only)
    return C.apply_to(df, ["first_date", "second_date"], lambda c: F.date_format(c, "yyyy-MM-dd"))


@query("flt1_equals", f"SELECT row_id FROM {CARDS_SQL} t WHERE Branch_Code = 'REJ'")
def flt1(spark, sf):
    return all_cards(spark, sf).filter(P.equals("Branch_Code", cards.REJECT_BRANCH)).select("row_id")


@query("flt2_differs", f"SELECT row_id, Product FROM {CARDS_SQL} t WHERE Product <> 'FIX'")
def flt2(spark, sf):
    return all_cards(spark, sf).filter(P.differs("Product", "FIX")).select("row_id", "Product")


@query("flt3_strict_range", f"""
  SELECT row_id FROM {I.EXTRACT.sql} t
  WHERE TRY_CAST(Monthly_Salary AS DOUBLE) < 125000 AND TRY_CAST(Monthly_Salary AS DOUBLE) > 1000""")
def flt3(spark, sf):
    df = I.EXTRACT.frame(spark, sf).withColumn("Monthly_Salary", S.text_to_double("Monthly_Salary"))
    return df.filter(P.strictly_between("Monthly_Salary", cards.SALARY_LOW, cards.SALARY_HIGH)).select("row_id")


@query("flt4_above_or_missing", f"""
  SELECT row_id, Monthly_Salary FROM {CARDS_SQL} t WHERE Monthly_Salary > 10000 OR Monthly_Salary IS NULL""")
def flt4(spark, sf):
    return (all_cards(spark, sf).filter(P.above_or_missing("Monthly_Salary", unified.SALARY_FLOOR))
            .select("row_id", "Monthly_Salary"))


@query("flt5_known", f"SELECT row_id, Age, ID FROM {CARDS_SQL} t WHERE Age IS NOT NULL AND ID IS NOT NULL")
def flt5(spark, sf):
    return all_cards(spark, sf).filter(P.known("Age", "ID")).select("row_id", "Age", "ID")


@query("flt7_not_loan", f"""
  SELECT row_id, Product_CC_PL_RL FROM {I.LEAD.sql} t
  WHERE Product_CC_PL_RL IS NULL OR NOT regexp_matches(Product_CC_PL_RL, '^[A-Z]{{2}}L')""")
def flt7(spark, sf):
    return I.LEAD.frame(spark, sf).filter(P.not_loan("Product_CC_PL_RL")).select("row_id", "Product_CC_PL_RL")


_CODES = "('D01','D02','D09','D10','D11','D21','D22','D23','D24')"


@query("flt8_listed", f"SELECT row_id, Result_Description FROM {CARDS_SQL} t WHERE Result_Description IN {_CODES}")
def flt8(spark, sf):
    return (all_cards(spark, sf).filter(P.listed("Result_Description", S.CASH_AND_DEBT_DECLINES))
            .select("row_id", "Result_Description"))


@query("agg9_not_listed", f"""
  SELECT Product, count(*) FILTER (WHERE Result_Description IS NULL OR Result_Description NOT IN {_CODES}) AS n FROM {CARDS_SQL} t
  GROUP BY Product""")
def agg9(spark, sf):
    return A.count_not_listed(all_cards(spark, sf), "Result_Description", S.CASH_AND_DEBT_DECLINES, "Product")


@query("flt9_complete_cases", f"""
  SELECT row_id, ID, Age, Monthly_Salary, Doc_Waive FROM {CARDS_SQL} t
  WHERE ID IS NOT NULL AND Age IS NOT NULL AND Monthly_Salary IS NOT NULL AND Doc_Waive IS NOT NULL""")
def flt9(spark, sf):
    df = all_cards(spark, sf).select("row_id", "ID", "Age", "Monthly_Salary", "Doc_Waive")
    return P.complete_cases(df)


@query("flt11_group_size", f"SELECT ID, count(*) AS n FROM {REJECTED_SQL} t GROUP BY ID HAVING count(*) > 1")
def flt11(spark, sf):
    from secondlook.operators.keyed import key_counts
    return key_counts(rejected(spark, sf), "ID").filter("n > 1")


@query("flt12_rare_level", f"SELECT row_id FROM {I.EXTRACT.sql} t WHERE Occupation_Code = '05'")
def flt12(spark, sf):
    return I.EXTRACT.frame(spark, sf).filter(P.equals("Occupation_Code", "05")).select("row_id")
