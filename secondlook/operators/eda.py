"""Tables behind the exploratory plots."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secondlook.functions.scalars import records
from secondlook.operators.ranking import exact_quantiles, global_row_number
from secondlook.session import stage

DENSITY_POINTS = 512  # fixed value: grid of a density estimate
DEFAULT_BINS = 30     # fixed value: bins when no width is given
GAP_PIECE = 65_536    # empty bins that one row stands for, at least, before they are written out


def kernel_density(df: DataFrame, x: str, by: str, points: int = DENSITY_POINTS) -> DataFrame:
    """Gaussian kernel density per class on one grid over the whole range (EDA-1).

    Bandwidth per class: 0.9 min(sd, IQR / 1.34) n^(-1/5). Values are first shared out
    linearly between their two nearest grid points, which leaves at most ``points``
    weights per class; the kernel sums run over those, not over rows.
    """
    rows = df.filter(F.col(x).isNotNull()).select(F.col(by).alias("__by"), F.col(x).cast("double").alias("__x"))
    span = rows.agg(F.struct(F.min("__x").alias("low"), F.max("__x").alias("high")).alias("s")).scalar()
    last = points - 1
    placed = (rows.withColumn("__s", span)
              .withColumn("__step", (F.col("__s.high") - F.col("__s.low")) / F.lit(last))
              .withColumn("__pos", F.when(F.col("__step") > 0,
                                          (F.col("__x") - F.col("__s.low")) / F.col("__step")).otherwise(0.0))
              .withColumn("__lo", F.least(F.floor("__pos"), F.lit(last - 1)))
              .withColumn("__share", F.col("__pos") - F.col("__lo")))
    halves = records(["cell", "weight"], (F.col("__lo"), 1 - F.col("__share")),
                     (F.col("__lo") + 1, F.col("__share")))
    grid = (placed.select("__by", F.inline(halves)).groupBy("__by", "cell")
            .agg(F.sum("weight").alias("weight")))
    spread = (rows.groupBy("__by").agg(F.count("*").alias("n"), F.stddev_samp("__x").alias("sd"))
              .join(exact_quantiles(rows, "__x", "__by", [0.25, 0.75])
                    .withColumnRenamed("__by", "__q"), F.col("__by").eqNullSafe(F.col("__q"))))
    iqr = (F.col("q1") - F.col("q0")) / F.lit(1.34)
    width = (F.lit(0.9) * F.when((iqr > 0) & (iqr < F.col("sd")), iqr).otherwise(F.col("sd"))
             * F.pow("n", F.lit(-0.2)))
    bandwidths = spread.select(F.col("__by").alias("__b"), "n", width.alias("bandwidth"))
    at = (grid.join(bandwidths, F.col("__by").eqNullSafe(F.col("__b")))
          .withColumn("__s", span)
          .withColumn("__step", (F.col("__s.high") - F.col("__s.low")) / F.lit(last))
          .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(last)))))
    z = (F.col("point") - F.col("cell")) * F.col("__step") / F.col("bandwidth")
    kernel = F.exp(-z * z / 2) / (F.col("bandwidth") * F.lit((2 * 3.141592653589793) ** 0.5))
    return (at.groupBy("__by", "point")
            .agg(F.max(F.col("__s.low") + F.col("point") * F.col("__step")).alias("x"),
                 (F.sum(F.col("weight") * kernel) / F.max("n")).alias("density"))
            .withColumnRenamed("__by", by))


def _dense(counts: DataFrame, by: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Every class with every bin from ``low`` to ``high`` (by default, of all counts), absent ones 0.

    The counts are written once; what follows reads them, not the rows. Numbered in order of class and bin, each count sees the
    next one by a join on the numbers, and the gap between them, or up to the range's ends, becomes
    rows of its own: first as pieces of at most the square root of the range, then bin by bin.
    No array holds the range, and the rows that fill it are not shuffled.
    """
    counts = stage(counts.select(by, "bin", "n"), "bin-counts")
    edge = counts.agg(F.min("bin").alias("low"), F.max("bin").alias("high")).first()
    low, high = edge["low"] if low is None else low, edge["high"] if high is None else high
    if low is None:
        return counts
    piece = max(GAP_PIECE, math.isqrt(high - low + 1))
    ordered = stage(global_row_number(counts.select(F.col(by).alias("__by"), "bin"), "__by", "bin", name="__idx"), "bins-in-order")
    following = ordered.select((F.col("__idx") - 1).alias("__idx"), F.col("__by").alias("__next"), F.col("bin").alias("__next_bin"),
                               F.lit(True).alias("__any"))
    pairs = ordered.join(following, "__idx", "left")
    same = F.coalesce(F.col("__any"), F.lit(False)) & F.col("__by").eqNullSafe(F.col("__next"))
    start, end = F.lit(low).cast("long"), F.lit(high).cast("long")
    gaps = records(["__class", "first", "last"],
                   (F.col("__by"), F.col("bin") + 1, F.when(same, F.col("__next_bin") - 1).otherwise(end)),
                   (F.col("__next"), start, F.when(F.col("__any") & ~same, F.col("__next_bin") - 1).otherwise(start - 1)),
                   (F.col("__by"), start, F.when(F.col("__idx") == 1, F.col("bin") - 1).otherwise(start - 1)))
    pieces = (pairs.select(F.inline(gaps)).where("first <= last")
              .withColumn("first", F.explode(F.sequence("first", "last", F.lit(piece))))
              .withColumn("last", F.least(F.col("last"), F.col("first") + piece - 1))
              .repartition("__class", "first"))
    filled = pieces.select(F.col("__class").alias(by), F.explode(F.sequence("first", "last")).alias("bin"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(filled)


def frequency_by_width(df: DataFrame, x: str, by: str, width: float = 1.0) -> DataFrame:
    """Counts per class in bins centred on multiples of ``width``, empty bins shown (EDA-2). The rows are read once."""
    counts = (df.filter(F.col(x).isNotNull())
              .groupBy(by, F.floor(F.col(x) / F.lit(width) + F.lit(0.5)).alias("bin"))
              .agg(F.count("*").alias("n")))
    return (_dense(counts, by)
            .select(by, (F.col("bin") * F.lit(width)).alias("x"), "n"))


def frequency_by_bins(df: DataFrame, x: str, by: str, bins: int = DEFAULT_BINS) -> DataFrame:
    """Counts per class in equal bins 1..bins from minimum to maximum (EDA-3)."""
    rows = df.filter(F.col(x).isNotNull()).select(by, F.col(x).cast("double").alias("__x"))
    span = rows.agg(F.struct(F.min("__x").alias("low"), F.max("__x").alias("high")).alias("s")).scalar()
    place = F.floor((F.col("__x") - F.col("__s.low")) / ((F.col("__s.high") - F.col("__s.low")) / F.lit(bins))) + 1
    counts = (rows.withColumn("__s", span)
              .withColumn("bin", F.when(F.col("__s.high") > F.col("__s.low"), F.least(place, F.lit(bins)))
                          .otherwise(F.lit(1).cast("long")))
              .groupBy(by, "bin").agg(F.count("*").alias("n")))
    return _dense(counts, by, 1, bins)


def cell_counts(df: DataFrame, x: str, y: str, by: str, x_width: float, y_width: float) -> DataFrame:
    """Scatter of two columns by class as counts per cell (EDA-4)."""
    return (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
            .groupBy(by, F.floor(F.col(x) / F.lit(x_width)).alias("x_cell"),
                     F.floor(F.col(y) / F.lit(y_width)).alias("y_cell"))
            .agg(F.count("*").alias("n")))


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, in one pass (EDA-5).

    A pair uses the rows where both are known.
    """
    pairs = list(combinations(names, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = records(["a", "b", "r"], *[(a, b, F.col(f"c{i}")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))
