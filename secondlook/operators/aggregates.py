"""Counts and frequency tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondlook.functions.predicates import listed


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))  # AGG-1


def distinct_count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    """Distinct keys; a missing key counts as one value (AGG-2, SET-4)."""
    return df.select(*keys).distinct().agg(F.count("*").alias(name))


def count_by(df: DataFrame, **keys: Column) -> DataFrame:
    """Counts by computed keys, NULL as its own group (AGG-4, AGG-5)."""
    return df.groupBy(*[k.alias(n) for n, k in keys.items()]).agg(F.count("*").alias("n"))


def count_not_listed(df: DataFrame, x: str, values, by: str | None = None, name: str = "n") -> DataFrame:
    """Rows whose value is not among ``values``, a missing one included (AGG-9); with ``by``, per group."""
    return df.groupBy(*([by] if by else [])).agg(F.count_if(~listed(x, values)).alias(name))


MAX_LEVELS = 1_000  # levels of a factor; a column with more is refused


def found_levels(df: DataFrame, *names: str) -> list:
    """The known values of the columns, together and in order; more than ``MAX_LEVELS`` are an error."""
    values = [df.select(F.col(n).alias("level")) for n in names]
    known = reduce(DataFrame.union, values).filter("level IS NOT NULL").distinct()
    levels = sorted(r.level for r in known.limit(MAX_LEVELS + 1).collect())
    if len(levels) > MAX_LEVELS:
        raise ValueError(f"{names} have more than {MAX_LEVELS} levels")
    return levels


def _listed_only(counts: DataFrame, levels: list, *names: str) -> DataFrame:
    """The counts; a level that is not listed is an error, since its rows would be lost."""
    def checked(n: str) -> Column:
        unlisted = F.raise_error(F.concat(F.lit(f"unlisted level of {n}: "), F.col(n).cast("string")))
        return F.when(F.col(n).isin(levels), F.col(n)).otherwise(unlisted)
    return counts.withColumns({n: checked(n) for n in names})


def frequency(df: DataFrame, name: str, levels: list | None = None) -> DataFrame:
    """Count per level, absent levels 0, missing values left out (AGG-6).

    Without ``levels`` they are those of the data; a value not among given ones is an error.
    """
    levels = found_levels(df, name) if levels is None else levels
    grid = df.sparkSession.createDataFrame([(v,) for v in levels], df.select(name).schema)
    counts = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("__n"))
    return (grid.join(_listed_only(counts, levels, name), name, "left")
            .select(name, F.coalesce("__n", F.lit(0)).cast("long").alias("n")))


def contingency(df: DataFrame, rows: str, cols: str, levels: list | None = None) -> DataFrame:
    """Dense two-way table of two columns over the same levels (AGG-7, ML-6).

    Without ``levels`` they are those of the data; a value not among given ones is an error.
    """
    spark = df.sparkSession
    levels = found_levels(df, rows, cols) if levels is None else levels
    grid = spark.createDataFrame([(a, b) for a in levels for b in levels],
                                 df.select(rows, cols).schema)
    counts = (df.filter(F.col(rows).isNotNull() & F.col(cols).isNotNull())
              .groupBy(rows, cols).agg(F.count("*").alias("__n")))
    return (grid.join(_listed_only(counts, levels, rows, cols), [rows, cols], "left")
            .select(rows, cols, F.coalesce("__n", F.lit(0)).cast("long").alias("n")))


def contingency_wide(df: DataFrame, rows: str, cols: str, levels: list | None = None) -> DataFrame:
    """The same table with one column per level of ``cols``."""
    levels = found_levels(df, rows, cols) if levels is None else levels
    return (contingency(df, rows, cols, levels)
            .groupBy(rows).pivot(cols, levels).agg(F.first("n"))
            .withColumnsRenamed({str(v): f"{cols}_{v}" for v in levels}))


def share_equal(df: DataFrame, a: str, b: str, name: str = "accuracy") -> DataFrame:
    return df.agg(F.avg((F.col(a) == F.col(b)).cast("int")).alias(name))  # AGG-8


def metrics(df: DataFrame, **aggregates: Column) -> DataFrame:
    """One ``(metric, value)`` row per aggregate (SNK-1)."""
    wide = df.agg(*[a.cast("double").alias(n) for n, a in aggregates.items()])
    return wide.unpivot([], list(aggregates), "metric", "value")


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union all by name, absent columns filled with NULL (SET-1, SET-2).

    A column must have one type wherever it occurs.
    """
    types: dict[str, str] = {}
    for df in (first, *others):
        for name, kind in df.dtypes:
            if types.setdefault(name, kind) != kind:
                raise ValueError(f"{name} is {types[name]} and {kind}")
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first
