"""Joins that treat missing keys as equal and keep hot keys off a single task (JN-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secondlook.session import stage

# A key is hot above this share of all rows, so there are fewer than 1 / HOT_SHARE
# hot keys whatever the data: the list of them is safe to broadcast.
HOT_SHARE = 1e-4
# Below this many rows a key is never worth splitting.
HOT_MIN_ROWS = 1_000_000
# A lookup with at most this many rows and bytes is broadcast; a larger one is shuffled.
SMALL_LOOKUP_ROWS = 100_000
SMALL_LOOKUP_BYTES = 64 << 20


def same_keys(pairs: list[tuple[str, str]]) -> Column:
    """Null-safe equality on pairs of key names."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])


def hot_keys(df: DataFrame, keys: list[str], min_rows: int = HOT_MIN_ROWS,
             share: float = HOT_SHARE) -> DataFrame:
    """Keys too frequent for one task, each with the number of pieces to cut it into.

    Fewer than ``1 / share`` rows: each key holds more than that share of the table.
    The table is read once, for the keys' counts and its own; counts up to ``min_rows`` are not kept.
    """
    counts = df.select(*keys).groupingSets([keys, []], *keys).agg(
        F.grouping_id().alias("__whole"), F.count("*").alias("__n"))
    kept = stage(counts.filter((F.col("__whole") > 0) | (F.col("__n") > min_rows)), "key-counts")
    whole = kept.filter("__whole > 0").first()
    limit = float(max(min_rows, 1, share * whole["__n"] if whole else 0))
    return (kept.filter((F.col("__whole") == 0) & (F.col("__n") > limit))
            .select(*[F.col(k).alias(f"__hot_{i}") for i, k in enumerate(keys)],
                    F.ceil(F.col("__n") / limit).cast("int").alias("__pieces")))


def _any_hot(df: DataFrame, keys: list[str], min_rows: int, share: float) -> DataFrame | None:
    """The hot keys; None if there are none, so that the join stays a plain one."""
    hot = hot_keys(df, keys, min_rows, share)
    return None if hot.isEmpty() else hot


def _with_pieces(df: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    pairs = [(k, f"__hot_{i}") for i, k in enumerate(keys)]
    return df.join(F.broadcast(hot), same_keys(pairs), "left").drop(*[h for _, h in pairs])


def spread(df: DataFrame, keys: list[str], hot: DataFrame | None, name: str) -> DataFrame:
    """Add a piece number: rows of a hot key take its pieces in turn, equal rows too.

    The numbers are written, as they would differ if a lost task were run again.
    """
    if hot is None:
        return df.withColumn(name, F.lit(0))
    turn = F.pmod(F.monotonically_increasing_id(), F.col("__pieces").cast("long")).cast("int")
    marked = _with_pieces(df, keys, hot).withColumn(name, F.coalesce(turn, F.lit(0))).drop("__pieces")
    return stage(marked, "pieces")


def _repeat(df: DataFrame, keys: list[str], hot: DataFrame | None, name: str) -> DataFrame:
    """Repeat each row for all pieces of its key on the other side."""
    if hot is None:
        return df.withColumn(name, F.lit(0))
    every = F.sequence(F.lit(0), F.coalesce(F.col("__pieces"), F.lit(1)) - 1)
    return _with_pieces(df, keys, hot).withColumn(name, F.explode(every)).drop("__pieces")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left",
                min_rows: int = HOT_MIN_ROWS, share: float = HOT_SHARE,
                left_hot: bool = True, right_hot: bool = False) -> DataFrame:
    """Null-safe equi-join that cuts every hot key into pieces.

    ``left_hot`` and ``right_hot`` say on which sides a key may have many rows.
    ``how`` may be inner, left, left_semi or left_anti, with ``right_hot`` inner or
    left. Non-key names must differ.
    """
    if right_hot and how not in ("inner", "left"):
        raise ValueError("right_hot needs an inner or left join")
    hot_left = _any_hot(left, on, min_rows, share) if left_hot else None
    hot_right = _any_hot(right, on, min_rows, share) if right_hot else None
    if hot_left is None and hot_right is None:
        rhs = right.withColumnsRenamed({k: f"__k_{k}" for k in on})
        return left.join(rhs, same_keys([(k, f"__k_{k}") for k in on]), how).drop(*[f"__k_{k}" for k in on])
    cut = spread(left, on, hot_left, "__l")
    if hot_right is None or how == "inner":
        return _join_pieces(cut, right, on, how, hot_left, hot_right)
    # A piece of a hot right key may be empty, so unmatched rows are found apart.
    matched = _join_pieces(cut, right, on, "inner", hot_left, hot_right)
    single = _join_pieces(cut, right.select(*on).distinct(), on, "left_anti", hot_left, None)
    return matched.unionByName(single, allowMissingColumns=True)


def _join_pieces(cut: DataFrame, right: DataFrame, on: list[str], how: str,
                 hot_left: DataFrame | None, hot_right: DataFrame | None) -> DataFrame:
    """Join by key and piece; ``cut`` is the left side with its piece numbers."""
    lhs = _repeat(cut, on, hot_right, "__r")
    rhs = _repeat(spread(right, on, hot_right, "__r_r"), on, hot_left, "__l_r")
    rhs = rhs.withColumnsRenamed({k: f"__k_{k}" for k in on})
    condition = same_keys([(k, f"__k_{k}") for k in on])
    condition &= (F.col("__l") == F.col("__l_r")) & (F.col("__r") == F.col("__r_r"))
    return (lhs.join(rhs, condition, how)
            .drop("__l", "__r", "__l_r", "__r_r", *[f"__k_{k}" for k in on]))


def is_small(df: DataFrame, rows: int = SMALL_LOOKUP_ROWS, size: int = SMALL_LOOKUP_BYTES) -> bool:
    """Whether a table has at most ``rows`` rows and ``size`` bytes as JSON; reads ``rows`` + 1 rows at most."""
    length = F.octet_length(F.to_json(F.struct("*")))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(length).alias("size")).first()
    return found["n"] <= rows and (found["size"] or 0) <= size


def lookup_join(left: DataFrame, lookup: DataFrame, on: dict[str, str],
                small_rows: int = SMALL_LOOKUP_ROWS, **hot) -> DataFrame:
    """Left join to a lookup whose keys may be named differently (JN-2).

    NULL matches NULL, and a lookup that repeats a key fans out. The lookup is
    broadcast only when its rows and bytes have been checked, else the join shuffles
    with hot keys split on both sides.
    """
    right = lookup.withColumnsRenamed({theirs: ours for ours, theirs in on.items()})
    clash = [c for c in right.columns if c in left.columns and c not in on]
    if clash:
        raise ValueError(f"lookup columns clash: {clash}")
    keys = list(on)
    if not is_small(lookup, small_rows):
        return salted_join(left, right, keys, "left", **{"right_hot": True, **hot})
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    joined = left.join(F.broadcast(right), same_keys([(k, f"__r_{k}") for k in keys]), "left")
    return joined.drop(*[f"__r_{k}" for k in keys])


def natural_lookup(left: DataFrame, lookup: DataFrame, **options) -> DataFrame:
    """Left join on every name the two tables share (JN-3)."""
    shared = [c for c in left.columns if c in lookup.columns]
    if not shared:
        raise ValueError("the tables share no column name")
    return lookup_join(left, lookup, {c: c for c in shared}, **options)


def suffixed(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Give clashing non-key names ``_x`` on the left and ``_y`` on the right (SCH-6)."""
    clash = [c for c in left.columns if c in right.columns and c not in on]
    return (left.withColumnsRenamed({c: f"{c}_x" for c in clash}),
            right.withColumnsRenamed({c: f"{c}_y" for c in clash}))


def left_join(left: DataFrame, right: DataFrame, on: list[str], unique: str | None = None,
              **hot) -> DataFrame:
    """Left join on shared keys with ``_x`` / ``_y`` suffixes (JN-1, JN-7).

    ``unique`` is "left", "right" or "both" when those sides have one row per key, so
    that none of their keys can be hot.
    """
    a, b = suffixed(left, right, on)
    return salted_join(a, b, on, "left", left_hot=unique not in ("left", "both"),
                       right_hot=unique not in ("right", "both"), **hot)


def semi_join(left: DataFrame, right: DataFrame, on: list[str], **hot) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``, NULL included (JN-5)."""
    return salted_join(left, right.select(*on).distinct(), on, "left_semi", **hot)


def complement(df: DataFrame, taken: DataFrame, row_id: str) -> DataFrame:
    """Rows not taken, by unique row id (JN-6, SET-5). Unique keys cannot be hot."""
    return df.join(taken.select(row_id), row_id, "left_anti")
