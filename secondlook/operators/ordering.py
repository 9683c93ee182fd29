"""Sort keys with missing values last in both directions (SURVEY SRT-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_keys(*names: str) -> list[Column]:
    """``"-date"`` sorts falling, ``"date"`` rising; NULL is last either way."""
    return [F.col(n[1:]).desc_nulls_last() if n.startswith("-") else F.col(n).asc_nulls_last()
            for n in names]


def arrange(df: DataFrame, *names: str) -> DataFrame:
    return df.orderBy(*sort_keys(*names))  # SRT-1, SRT-2


def head(df: DataFrame, *names: str, n: int = 6) -> DataFrame:
    """First n rows of an order; runs as a top-n per task, not a full sort (SRT-3)."""
    return df.orderBy(*sort_keys(*names)).limit(n)


def top_frequencies(df: DataFrame, *keys: str, n: int = 6) -> DataFrame:
    """Most frequent key values, ties by key (SRT-4)."""
    return head(df.groupBy(*keys).agg(F.count("*").alias("n")), "-n", *keys, n=n)
