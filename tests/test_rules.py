"""Missing-value and edge-case rules on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from secondlook.functions import predicates as P
from secondlook.functions import scalars as S
from secondlook.operators import aggregates as A
from secondlook.operators import schema as C
from secondlook.operators.ordering import arrange


def column(spark, expr, rows, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in df.orderBy("i").select(expr.alias("v")).collect()]


def kept(spark, condition, rows, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[1] for r in df.filter(condition).orderBy("i").collect()]


def test_not_loan_keeps_missing(spark):
    assert kept(spark, P.not_loan("c"), [("RDL",), ("CC",), (None,), ("VRL9",)], "c string") == ["CC", None]


def test_product_family(spark):
    assert column(spark, S.product_family("c"), [("VRL1",), ("CC",), (None,)], "c string") == ["RL", "CC", "CC"]


def test_change_flag(spark):
    rows = [("x", "x"), ("x", "y"), ("x", None), (None, None)]
    assert column(spark, S.change_flag("a", "b"), rows, "a string, b string") == [0, 1, None, None]


def test_target(spark):
    rows = [("A", "CC"), ("A", "PROUD"), ("A", "OTHER"), ("D", "CC"), (None, "CC"), (None, "OTHER")]
    assert column(spark, S.approval_target("r", "p"), rows, "r string, p string") == [1, 1, 0, 0, None, 0]


def test_flags(spark):
    assert column(spark, S.decline_flag("c"), [("D01",), ("D03",), (None,)], "c string") == [1, 0, 0]
    assert column(spark, S.approval_flag("c"), [("A",), ("D",), (None,)], "c string") == [1, 0, None]
    assert column(spark, S.present_flag("c"), [("A",), (None,)], "c string") == [1, 0]
    assert column(spark, S.class_at("p"), [(0.5,), (0.49,), (None,)], "p double") == [1, 0, None]


def test_salary_rules(spark):
    rows = [(10000.0,), (10001.0,), (None,)]
    assert kept(spark, P.above_or_missing("s", 10000), rows, "s double") == [10001.0, None]
    rows = [(1000.0,), (1001.0,), (124999.0,), (125000.0,), (None,)]
    assert kept(spark, P.strictly_between("s", 1000, 125000), rows, "s double") == [1001.0, 124999.0]
    assert kept(spark, P.known("s"), [(0.0,), (40.0,), (None,)], "s double") == [0.0, 40.0]


def test_casts(spark):
    rows = [("35.7",), (" 35 ",), ("abc",), ("10000000000",), (None,), ("NaN",)]
    assert column(spark, S.text_to_int("t"), rows, "t string") == [35, 35, None, None, None, None]
    assert column(spark, S.text_to_double("t"), rows[:3], "t string") == [35.7, 35.0, None]


def test_dates(spark):
    june = dt.date(2015, 6, 1)
    rows = [("6",), ("06",), ("13",), (None,)]
    assert column(spark, S.month_start(2015, "m"), rows, "m string") == [june, june, None, None]
    assert column(spark, S.compact_month_start("m"), [("201602",), ("2016xx",)], "m string") == [
        dt.date(2016, 2, 1), None]
    assert column(spark, S.day_first_date("m"), [("31/01/2016",), ("1/2/2016",), ("31/02/2016",)],
                  "m string") == [dt.date(2016, 1, 31), dt.date(2016, 2, 1), None]
    assert column(spark, S.months_apart(F.lit("2016-02-01").cast("date"), F.lit("2015-06-01").cast("date")),
                  [(1,)], "m int") == [8]


def test_counts_with_missing(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", None)], "x string, y string")
    counts = {r.same: r.n for r in A.count_by(df, same=F.col("x") == F.col("y")).collect()}
    assert counts == {True: 1, False: 1, None: 1}
    ids = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert A.distinct_count(ids, "id").first().n == 2


def test_frequency_fills_levels(spark):
    df = spark.createDataFrame([(0,), (0,), (None,)], "c int")
    assert {tuple(r) for r in A.frequency(df, "c", [0, 1]).collect()} == {(0, 2), (1, 0)}


def test_contingency_is_dense_and_wide(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (None, 1)], "p int, a int")
    assert {tuple(r) for r in A.contingency(df, "p", "a", [0, 1]).collect()} == {
        (0, 0, 2), (0, 1, 0), (1, 0, 1), (1, 1, 0)}
    wide = A.contingency_wide(df, "p", "a", [0, 1]).orderBy("p")
    assert [r.asDict() for r in wide.collect()] == [{"p": 0, "a_0": 2, "a_1": 0}, {"p": 1, "a_0": 1, "a_1": 0}]


def test_levels_are_found_or_must_be_listed(spark):
    df = spark.createDataFrame([(0, 0), (2, 0), (None, 1)], "p int, a int")
    assert {tuple(r) for r in A.frequency(df, "p").collect()} == {(0, 1), (2, 1)}
    cells = {(r.p, r.a): r.n for r in A.contingency(df, "p", "a").collect()}
    assert len(cells) == 9 and sum(cells.values()) == 2 and cells[2, 0] == 1
    for short in (lambda: A.frequency(df, "p", [0, 1]), lambda: A.contingency(df, "p", "a", [0, 1])):
        with pytest.raises(Exception, match="unlisted level of p: 2"):
            short().collect()
    many = spark.range(A.MAX_LEVELS + 1)
    with pytest.raises(ValueError, match="more than"):
        A.frequency(many, "id")


def test_complete_cases(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "a int, b int")
    assert [tuple(r) for r in P.complete_cases(df).collect()] == [(1, 1)]


def test_sort_puts_missing_last(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "x int")
    assert [r.x for r in arrange(df, "x").collect()] == [1, 2, None]
    assert [r.x for r in arrange(df, "-x").collect()] == [2, 1, None]


def test_clean_names():
    assert C.safe_names(["Data.Mth", "1st", "_x", "a b", "ok"]) == ["Data_Mth", "X1st", "X_x", "a_b", "ok"]
    with pytest.raises(ValueError):
        C.safe_names(["a.b", "a b"])


def test_schema_operators(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    other = spark.createDataFrame([(1, 2)], "d int, b int")
    assert C.common_columns(df, other) == ["b", "d"]
    assert set(C.common_columns(other, df)) == set(C.common_columns(df, other))
    assert C.unmatched_count(df.columns, other.columns) == 2
    assert C.drop_positions(df, (1, 2), (4, 4)).columns == ["c"]
    assert C.drop_names(df, "a", "a").columns == ["b", "c", "d"]
    for broken in (lambda: C.project(df, ["a", "z"]), lambda: C.drop_names(df, "z"),
                   lambda: C.rename(df, new="z"), lambda: C.drop_positions(df, (3, 9)),
                   lambda: C.drop_positions(df, (1, 1), expect=["b"])):
        with pytest.raises(ValueError):
            broken()


def test_union_checks_types(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2,)], "k int")
    assert {tuple(r) for r in A.union_by_name(a, b).collect()} == {(1, "x"), (2, None)}
    with pytest.raises(ValueError):
        A.union_by_name(a, spark.createDataFrame([("2",)], "k string"))
