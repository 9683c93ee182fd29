"""Exact-size, reproducible splits and folds (SURVEY SMP-*).

Rows are ordered by md5 of seed and row id: stable over partitions, runs and
engines. A split needs no sort and no shuffle of rows: the row id that closes
each part is found from counts per hash prefix and a sort of the few prefixes
that hold a boundary, and every row is then compared with those boundaries.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secondlook.functions.scalars import hash_key
from secondlook.operators.aggregates import union_by_name
from secondlook.operators.joins import lookup_join
from secondlook.operators.ranking import global_row_number, last_position_of_fold
from secondlook.session import stage

# Hex digits of the hash that form a bucket: 16**4 buckets, so a boundary sort
# touches about n / 65,536 rows.
PREFIX_DIGITS = 4


def cut_points(df: DataFrame, row_id: str, seed: int, positions: Callable[[Column], Column],
               by: str | None = None, digits: int = PREFIX_DIGITS) -> DataFrame:
    """The (hash, row id) pair at each wanted position of the hash order.

    ``positions`` maps a row count to an array of positions in 1..n. The result has
    one row per value of ``by`` (one row in all without it): a struct ``__cut`` of the
    array ``cuts`` and the row count ``rows``.
    """
    bucketed = (df.select((F.col(by) if by else F.lit(0)).alias("__by"),
                          F.col(row_id).alias("__id"), hash_key(seed, row_id).alias("__hash"))
                .withColumn("__bucket", F.substring("__hash", 1, digits)))
    counts = bucketed.groupBy("__by", "__bucket").agg(F.count("*").alias("__n"))
    # At most 16**digits rows per group: safe for one window partition.
    group = Window.partitionBy("__by")
    before, last = F.col("__upto") - F.col("__n"), F.col("__upto")
    wanted = (counts.withColumns({"__upto": F.sum("__n").over(group.orderBy("__bucket")),
                                  "__all": F.sum("__n").over(group)})
              .withColumn("__places", F.transform(
                  F.filter(positions(F.col("__all")), lambda p: (p > before) & (p <= last)),
                  lambda p: p - before))
              .filter(F.size("__places") > 0)
              .select(F.col("__by").alias("__w_by"), F.col("__bucket").alias("__w_bucket"),
                      "__places", "__all"))
    # Without classes one row per position; with them Spark checks the size.
    held = F.col("__by").eqNullSafe(F.col("__w_by")) & (F.col("__bucket") == F.col("__w_bucket"))
    in_bucket = Window.partitionBy("__by", "__bucket").orderBy("__hash", "__id")
    ranked = bucketed.join(wanted if by else F.broadcast(wanted), held).withColumn("__rank", F.row_number().over(in_bucket))
    cut = F.struct(F.col("__hash").alias("hash"), F.col("__id").alias("id"))
    times = F.size(F.filter("__places", lambda p: p == F.col("__rank")))
    found = (ranked.filter(F.array_contains("__places", F.col("__rank").cast("long")))
             .select("__by", "__all", F.explode(F.array_repeat(cut, times)).alias("cut"))
             .groupBy("__by").agg(F.sort_array(F.collect_list("cut")).alias("cuts"),
                                  F.first("__all").alias("rows")))
    return found.select(F.struct("cuts", "rows").alias("__cut"),
                        *([F.col("__by").alias(by)] if by else []))


def part_number(df: DataFrame, row_id: str, seed: int, positions: Callable[[Column], Column],
                parts: int, name: str, by: str | None = None) -> DataFrame:
    """Number rows 0..parts-1 by the boundaries before them.

    Also adds ``<name>_of``, the row count of the group. There are ``parts - 1``
    positions, each at least 1.
    """
    cuts = cut_points(df, row_id, seed, positions, by)
    marked = (lookup_join(df, stage(cuts, "cuts"), {by: by}) if by
              else df.withColumn("__cut", cuts.scalar()))
    me = F.struct(hash_key(seed, row_id).alias("hash"), F.col(row_id).alias("id"))
    # Written out per boundary, so that the hash is computed once per row.
    passed = [(F.get("__cut.cuts", F.lit(i)) < me).cast("int") for i in range(parts - 1)]
    return marked.withColumns({
        name: reduce(lambda a, b: a + b, passed),
        f"{name}_of": F.col("__cut.rows"),
    }).drop("__cut")


def _split(df: DataFrame, row_id: str, seed: int, size: Callable[[Column], Column],
           by: str | None, name: str) -> DataFrame:
    # A boundary needs a row: a size of 0 uses the first row and is then ruled out.
    part = part_number(df, row_id, seed, lambda n: F.array(F.greatest(size(n), F.lit(1))), 2, "__part", by)
    return (part.withColumn(name, (F.col("__part") == 0) & (size(F.col("__part_of")) > 0))
            .drop("__part", "__part_of"))


def exact_split(df: DataFrame, row_id: str, p: float = 0.75, seed: int = 123,
                name: str = "is_train") -> DataFrame:
    """Flag exactly floor(p * n) rows, chosen by hash order (SMP-1, SMP-2)."""
    return _split(df, row_id, seed, lambda n: F.floor(F.lit(p) * n), None, name)


def stratified_split(df: DataFrame, row_id: str, label: str, p: float = 0.8, seed: int = 1,
                     name: str = "is_train") -> DataFrame:
    """Flag ceil(p * n) rows of each class, chosen by hash order (SMP-6)."""
    return _split(df, row_id, seed, lambda n: F.ceil(F.lit(p) * n), label, name)


def shuffled(df: DataFrame, row_id: str, seed: int = 2, position: str | None = None) -> DataFrame:
    """Rows in hash order (SMP-3): a distributed range sort. With ``position``, their numbers in that order."""
    keyed = df.withColumn("__hash", hash_key(seed, row_id))
    if position:
        return global_row_number(keyed, "__hash", row_id, name=position).drop("__hash")
    return keyed.orderBy("__hash", row_id).drop("__hash")


def assign_folds(df: DataFrame, row_id: str, folds: int = 10, seed: int = 2,
                 name: str = "fold") -> DataFrame:
    """Equal-width folds 1..folds of the hash order (SMP-3, SMP-4, WIN-8)."""
    if folds < 2:
        return df.withColumn(name, F.lit(1))

    def last_rows(n: Column) -> Column:
        # A single row is closed by every boundary and so falls in fold 1.
        return F.transform(
            F.sequence(F.lit(1), F.lit(folds - 1)),
            lambda f: F.greatest(last_position_of_fold(f, n, folds), F.lit(1)))
    return (part_number(df, row_id, seed, last_rows, folds, name)
            .withColumn(name, F.col(name) + 1).drop(f"{name}_of"))


def fold_parts(df: DataFrame, i: int, train_on: str = "fold",
               fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of fold i (SMP-5).

    ``"fold"`` trains on the fold and validates on the others, as the analysis
    does; ``"rest"`` is the usual way round.
    """
    if train_on not in ("fold", "rest"):
        raise ValueError("train_on is 'fold' or 'rest'")
    inside, outside = df.filter(F.col(fold) == i), df.filter(F.col(fold) != i)
    return (inside, outside) if train_on == "fold" else (outside, inside)


def append_level(train: DataFrame, rows: DataFrame, column: str, level: str,
                 row_id: str, exclude_test: bool = False) -> DataFrame:
    """Append every row of a rare level to the training rows (SMP-8, SET-2, FLT-12).

    As analysed, the appended rows may already be in training or belong to the
    test rows; ``exclude_test`` keeps only those that are already in training.
    """
    extra = rows.filter(F.col(column) == level)
    if exclude_test:
        extra = extra.join(train.select(row_id), row_id, "left_semi")
    return union_by_name(train, extra.select(*train.columns))
