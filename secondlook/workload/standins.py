"""The analysed tables, made from the given ones.

Each stand-in is a list of expressions that Spark and DuckDB read alike, over a
whole given table. The given tables hold no NULL, so NULLs are made with
``nullif`` or a CASE without ELSE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


class StandIn:
    """Expressions over one given table, usable from both engines."""

    def __init__(self, table: str, columns: list[str], where: str | None = None):
        self.table, self.columns, self.where = table, columns, where

    def frame(self, spark: SparkSession, sf: str) -> DataFrame:
        df = read(spark, sf, self.table)
        return (df.filter(self.where) if self.where else df).selectExpr(*self.columns)

    @property
    def sql(self) -> str:
        tail = f" WHERE {self.where}" if self.where else ""
        return f"(SELECT {', '.join(self.columns)} FROM {self.table}{tail})"


LEAD = StandIn("orders", [
    "o_orderkey AS row_id",
    "nullif(o_custkey, 7) AS ID",
    "CAST(nullif(month(o_orderdate), 12) AS BIGINT) AS Data_Mth",
    "nullif(o_orderpriority, '4-NOT SPECIFIED') AS AGENT_SOURCE_CODE",
    "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'RDL2'"
    " WHEN o_orderstatus = 'F' THEN 'VRL1' WHEN o_orderstatus = 'O' THEN 'CC' END AS Product_CC_PL_RL",
])

# The approval rule gives models something to find: it rises with the amount.
_APPROVED = "o_totalprice / 500000e0 + ((o_orderkey * 7919) % 1000) / 1000e0"

EXTRACT = StandIn("orders", [
    "o_orderkey AS row_id",
    "CASE WHEN o_orderpriority = '5-LOW' AND month(o_orderdate) = 11 THEN '13'"
    " ELSE nullif(CAST(month(o_orderdate) AS STRING), '12') END AS Data_Mth",
    "CASE o_orderstatus WHEN 'F' THEN 'VRL1' WHEN 'O' THEN 'CC' END AS Product_CC_PL_RL",
    "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING) AS Month",
    "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'abc'"
    " WHEN o_orderpriority = '1-URGENT' THEN concat(CAST(20 + o_custkey % 45 AS STRING), '.7')"
    " ELSE CAST(20 + o_custkey % 45 AS STRING) END AS AGE",
    "CAST(o_totalprice / 3 AS STRING) AS Monthly_Salary",
    "CASE o_orderpriority WHEN '3-MEDIUM' THEN 'PL' ELSE 'CC' END AS Product",
    "nullif(concat(CAST(o_custkey AS STRING), ':', CAST(year(o_orderdate) AS STRING)), '7:1997') AS Person",
    "concat('R', CAST(day(o_orderdate) % 3 AS STRING)) AS Old_Reason_Desc",
    "lpad(CAST(o_custkey % 12 AS STRING), 2, '0') AS Occupation_Code",
    "CASE o_orderpriority WHEN '2-HIGH' THEN 'Y' WHEN '1-URGENT' THEN 'W' END AS Doc_Waive",
    f"CASE WHEN {_APPROVED} + CASE o_orderpriority WHEN '2-HIGH' THEN 0.1e0 ELSE 0e0 END > 1.2e0"
    " THEN '1' ELSE '0' END AS Appr",
])

_CARD = [
    "nullif(o_custkey, 7) AS ID",
    "nullif(o_orderdate, CAST('1997-05-28' AS DATE)) AS ApproveDate",
    "o_orderstatus AS F3", "o_orderpriority AS F4", "o_orderstatus AS F5", "o_orderpriority AS F6",
    "o_orderstatus AS F7", "o_orderpriority AS F8", "o_orderstatus AS F9",
    "CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' THEN NULL"
    " ELSE o_totalprice / 4 END AS Monthly_Salary",
    "o_orderstatus AS F11", "o_orderpriority AS F12",
    "CASE o_orderstatus WHEN 'F' THEN 'REJ' WHEN 'O' THEN 'HQ' END AS Branch_Code",
    "concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/',"
    " lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING)) AS Appl_In_Date",
    "o_orderdate AS DOB",
    "nullif(concat('NATION_', CAST(o_orderkey % 26 AS STRING)), 'NATION_3') AS Occupation",
    "concat('0', CAST(o_orderkey % 6 AS STRING), lpad(CAST(o_custkey % 1000 AS STRING), 3, '0')) AS Zipcode",
    "CASE o_orderpriority WHEN '2-HIGH' THEN 'Y' WHEN '1-URGENT' THEN 'W' END AS Doc_Waive",
    "nullif(20 + CAST(o_custkey % 45 AS BIGINT), 33) AS Age",
    f"CASE WHEN {_APPROVED} > 1.2e0 THEN 'A' WHEN {_APPROVED} > 0.8e0 THEN 'D'"
    f" WHEN {_APPROVED} > 0.2e0 THEN 'R' END AS Result",
    "o_totalprice / 100 AS spending",
    "o_orderpriority AS Work_Place", "o_orderstatus AS Income_Range", "o_orderpriority AS Channel",
    "o_orderstatus AS Channel_Group",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'CC' WHEN '2-HIGH' THEN 'PROUD' WHEN '3-MEDIUM' THEN 'FIX'"
    " WHEN '5-LOW' THEN 'OTHER' END AS Product",
    "concat('D', lpad(CAST(nullif(o_orderkey % 25, 9) AS STRING), 2, '0')) AS Result_Description",
    "o_orderstatus AS SubType", "o_orderpriority AS Criteria_Code", "o_orderstatus AS Flag_Test",
    "o_orderstatus AS New_Exist", "o_totalprice / 10 AS LineLimit",
    "concat('c', CAST(o_orderkey AS STRING)) AS row_id",
]
_CARD_ONLY = ["o_orderstatus AS Spending_Range", "o_totalprice / 60 AS Spending60", "o_orderpriority AS QUEUE"]
_FIRST_YEARS = "o_orderdate < CAST('1998-05-01' AS DATE)"
CC15 = StandIn("orders", _CARD + _CARD_ONLY, _FIRST_YEARS)
CC16 = StandIn("orders", _CARD + _CARD_ONLY, "o_orderdate >= CAST('1998-05-01' AS DATE)")

_LOAN_APPROVED = "l_extendedprice / 100000e0 + ((l_orderkey * 7919) % 1000) / 1000e0"
_LOAN = [
    "l_orderkey AS ID", "l_shipdate AS ApproveDate",
    "l_returnflag AS F3", "l_linestatus AS F4", "l_returnflag AS F5", "l_linestatus AS F6",
    "l_returnflag AS F7", "l_linestatus AS F8", "l_returnflag AS F9",
    "CASE WHEN l_linenumber = 6 THEN NULL ELSE l_extendedprice END AS Income",
    "l_returnflag AS F11", "l_linestatus AS F12",
    "CASE l_returnflag WHEN 'R' THEN 'REJ' WHEN 'A' THEN 'HQ' END AS Branch_Code",
    "concat(CAST(day(l_shipdate) AS STRING), '/', CAST(month(l_shipdate) AS STRING), '/',"
    " CAST(year(l_shipdate) AS STRING)) AS Appl_In_Date",
    "l_shipdate AS DOB",
    "nullif(concat('NATION_', CAST(l_suppkey % 26 AS STRING)), 'NATION_3') AS Occupation",
    "concat('0', CAST(l_suppkey % 6 AS STRING), lpad(CAST(l_partkey % 1000 AS STRING), 3, '0')) AS Zipcode",
    "CASE l_linestatus WHEN 'O' THEN 'Y' END AS Doc_Waive",
    "nullif(20 + CAST(l_partkey % 45 AS BIGINT), 33) AS Age",
    f"CASE WHEN {_LOAN_APPROVED} > 1.2e0 THEN 'A' WHEN {_LOAN_APPROVED} > 0.8e0 THEN 'D'"
    f" WHEN {_LOAN_APPROVED} > 0.2e0 THEN 'R' END AS Result",
    "l_tax * 1000 AS DrawDown",
    "l_returnflag AS Work_Place", "l_linestatus AS Income_Range", "l_returnflag AS Channel",
    "l_linestatus AS Channel_Group",
    "CASE l_linenumber WHEN 1 THEN 'PROUD' WHEN 2 THEN 'FIX' WHEN 3 THEN 'CC' WHEN 4 THEN 'OTHER' END AS Product",
    "concat('D', lpad(CAST(nullif(l_partkey % 25, 9) AS STRING), 2, '0')) AS Result_Description",
    "l_linestatus AS LoanType", "l_returnflag AS Criteria_Code", "l_linestatus AS Flag_Test",
    "l_returnflag AS New_Exist", "l_extendedprice / 10 AS LineLimit",
    "concat_ws('-', 'l', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING),"
    " CAST(l_linenumber AS STRING)) AS row_id",
]
PL15 = StandIn("lineitem", _LOAN, "l_shipdate < CAST('1998-05-01' AS DATE)")
PL16 = StandIn("lineitem", _LOAN, "l_shipdate >= CAST('1998-05-01' AS DATE)")

OCCUPATION = StandIn("nation", [
    "nullif(n_name, 'NATION_3') AS Description", "concat('0', CAST(n_regionkey AS STRING)) AS Code"])

PROVINCE = StandIn("region", [
    "concat('0', CAST(r_regionkey AS STRING)) AS Left2_Zipcode",
    "r_name AS Province_Tha", "r_name AS Region_Tha", "r_name AS Province_Eng", "r_name AS Region_Eng",
    "r_name AS City_Type", "CAST(r_regionkey AS STRING) AS RefCode",
    "CAST(r_regionkey AS STRING) AS Income15_per_Head_per_Year",
    "concat('T', CAST(r_regionkey % 2 AS STRING)) AS City_Type_Code"])

# A numeric score against a binary label, for the evaluation tables.
SCORED = StandIn("orders", [
    "o_orderkey AS row_id", "o_totalprice AS score",
    "CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS label",
    "CASE WHEN o_totalprice >= 400000 THEN 1 ELSE 0 END AS called",
    "o_orderpriority AS part"])


def hash_sql(seed: int, key: str) -> str:
    return f"md5(concat_ws(':', '{seed}', CAST({key} AS VARCHAR)))"
