"""Row predicates with the missing-value rules of SURVEY §1.3 (FLT-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondlook.functions.scalars import LOAN_PATTERN, matches


def equals(x: str, value) -> Column:
    return F.col(x) == F.lit(value)  # FLT-1, FLT-12: NULL rows drop out


def differs(x: str, value) -> Column:
    return F.col(x) != F.lit(value)  # FLT-2: NULL rows drop out


def strictly_between(x: str, low: float, high: float) -> Column:
    """Both bounds excluded, unlike ``between`` (FLT-3)."""
    return (F.col(x) > F.lit(low)) & (F.col(x) < F.lit(high))


def above_or_missing(x: str, low: float) -> Column:
    return (F.col(x) > F.lit(low)) | F.col(x).isNull()  # FLT-4


def known(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])  # FLT-5, FLT-6


def not_loan(code: str) -> Column:
    """Not a loan code; rows with a missing code stay (FLT-7)."""
    return ~matches(code, LOAN_PATTERN)


def listed(x: str, values) -> Column:
    return F.coalesce(F.col(x).isin(*values), F.lit(False))  # FLT-8


def complete_cases(df: DataFrame, *names: str) -> DataFrame:
    return df.dropna("any", subset=list(names) or None)  # FLT-9
