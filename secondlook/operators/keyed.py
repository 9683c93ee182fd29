"""First, later, single and repeated rows of a key.

No function here sends a whole group through one task: a hot key may hold a
large part of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secondlook.operators.joins import HOT_MIN_ROWS, complement, salted_join, semi_join, suffixed
from secondlook.operators.ordering import sort_keys
from secondlook.session import stage


def first_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the first in ``order`` (WIN-2, WIN-5, WIN-6).

    ``order`` must end in a unique column. Spark keeps only the first row of each
    key in every map task before the shuffle, so a hot key shrinks early.
    """
    w = Window.partitionBy(key).orderBy(*sort_keys(*order))
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def latest_per_key(df: DataFrame, key: str, date: str, row_id: str) -> DataFrame:
    return first_per_key(df, key, f"-{date}", row_id)


def earliest_per_key(df: DataFrame, key: str, date: str, row_id: str) -> DataFrame:
    return first_per_key(df, key, date, row_id)


def later_rows(df: DataFrame, key: str, *order: str, row_id: str) -> DataFrame:
    """Every row but the first of its key (WIN-3).

    Found as the complement of the first rows on the unique row id, so the
    shuffle is on that id and a hot key spreads over all tasks.
    """
    narrow = df.select(*dict.fromkeys([key, *[o.lstrip("-") for o in order], row_id]))
    return complement(df, first_per_key(narrow, key, *order, row_id), row_id)


def single_rows(df: DataFrame, key: str, hot_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Rows whose key occurs exactly once; all copies of other keys go (WIN-1).

    Two 64-bit hashes stand for the key: their counts need two numbers per key and no sort of rows. The
    counts kept are those of single keys and of very frequent ones. Rows of the latter, fewer than ``1 / hot_rows`` of all
    rows in number, leave before the shuffle; of the rest those of a single key are fetched. Two different keys with 128 equal bits
    would be taken for copies.
    """
    value = F.col(key)
    if isinstance(df.schema[key].dataType, (T.ArrayType, T.MapType, T.StructType)):  # a hash passes over missing members
        value = F.when(value.isNotNull(), F.to_json(F.struct(key), {"ignoreNullFields": "false"}))
    one = F.xxhash64(value, value.isNull())
    other = F.xxhash64(F.lit(key), value.isNull(), value)
    hashed = df.withColumns({"__h1": one, "__h2": other})
    counts = hashed.groupBy("__h1", "__h2").agg(F.count("*").alias("__n"))
    counts = stage(counts.where((F.col("__n") == 1) | (F.col("__n") > hot_rows)), "key-digests")
    frequent = counts.where("__n > 1").select("__h1", "__h2")
    if not frequent.isEmpty():
        hashed = hashed.join(F.broadcast(frequent), ["__h1", "__h2"], "left_anti")
    return hashed.join(counts.where("__n = 1").select("__h1", "__h2"), ["__h1", "__h2"], "left_semi").select(*df.columns)


def key_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))  # AGG-3


def repeated_rows(df: DataFrame, key: str, **hot) -> DataFrame:
    """All rows of every key that occurs more than once (WIN-4)."""
    return semi_join(df, key_counts(df, key).filter("n > 1"), [key], **hot)


def pair_with_first(df: DataFrame, key: str, *order: str, row_id: str, **hot) -> DataFrame:
    """The first row of each key (``_x``) beside every later row of it (``_y``) (JN-4).

    One row per later row. The first rows are unique per key, so the join is one
    shuffle of the table with hot keys split.
    """
    firsts = first_per_key(df, key, *order, row_id)
    x, y = suffixed(firsts, df, [key])
    paired = salted_join(y, x, [key], "inner", **hot)
    return (paired.filter(F.col(f"{row_id}_x") != F.col(f"{row_id}_y"))
            .select(key, *[c for c in x.columns if c != key], *[c for c in y.columns if c != key]))
