"""Global row numbers, folds and running totals without a single-task window (WIN-7..9)."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secondlook.operators.joins import lookup_join
from secondlook.operators.ordering import sort_keys
from secondlook.session import shuffle_partitions, stage


def global_row_number(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """Add row numbers 1..n in ``order``, which must end in a unique column (WIN-7).

    Rows are range-partitioned on all order columns, so equal leading values still
    spread over tasks. Each row's partition and place in it are written out with
    the row; a second pass over the staged table adds the rows of the partitions
    before it. The table of offsets has one row per partition.
    """
    keys = sort_keys(*order)
    parts = shuffle_partitions(df.sparkSession)
    placed = (df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
              .withColumn("__place", F.monotonically_increasing_id()))
    # The id holds the partition in its upper bits and the place in the lower 33.
    placed = stage(placed, "row-number").withColumns({
        "__part": F.shiftright("__place", 33),
        "__place": F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)),
    })
    totals = placed.groupBy("__part").agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    return (placed.join(F.broadcast(offsets), "__part")
            .withColumn(name, F.col("__before") + F.col("__place") + 1)
            .drop("__part", "__place", "__rows", "__before"))


def fold_of_position(i: Column | str, n: Column | str, folds: int) -> Column:
    """Equal-width fold 1..folds of position i among n (WIN-8, SMP-4).

    The ceiling of folds * (i - 1) / (n - 1), at least 1. ``ntile`` places its
    longer folds first and does not agree.
    """
    i = F.col(i) if isinstance(i, str) else i
    n = F.col(n) if isinstance(n, str) else n
    steps = F.lit(folds) * (i - 1)
    return F.when(n < 2, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.ceil(steps / F.when(n > 1, n - 1)).cast("int")))


def last_position_of_fold(fold: Column, n: Column, folds: int) -> Column:
    """The last position that falls in a fold: the inverse of ``fold_of_position``."""
    return F.floor(fold * (n - 1) / F.lit(folds)) + 1


def running_totals(df: DataFrame, order: str, sums: dict[str, str], by: list[str] | None = None,
                   descending: bool = False) -> DataFrame:
    """Running sums along a numeric column whose values are unique within ``by`` (WIN-9).

    ``sums`` maps each new column to the column it accumulates. Value ranges cut
    from approximate quantiles keep every window partition to a fraction of the
    rows; the sums of earlier ranges (ranges x groups rows) are then added. The
    range is a function of the value alone, so retried tasks agree. Infinite values lie in the
    outermost ranges; NaN, which sorts above all numbers, in a range of its own.
    """
    by = by or []
    parts = shuffle_partitions(df.sparkSession)
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.5 / parts)
    inner = sorted({c for c in cuts if c is not None and math.isfinite(c)})
    edges = [float("-inf"), *inner, float("inf")]
    ranged = (Bucketizer(splits=edges, inputCol="__order", outputCol="__range", handleInvalid="keep")
              .transform(df.withColumn("__order", F.col(order).cast("double"))).drop("__order"))
    ahead = -F.col("__range") if descending else F.col("__range")
    key = F.col(order).desc() if descending else F.col(order).asc()

    local = Window.partitionBy(*by, "__range").orderBy(key).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = ranged.withColumns({f"__in_{new}": F.sum(old).over(local) for new, old in sums.items()})

    earlier = Window.partitionBy(*by).orderBy(ahead).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(*by, "__range")
               .agg(*[F.sum(old).alias(f"__t_{new}") for new, old in sums.items()])
               .select(*[F.col(b).alias(f"__b_{b}") for b in by], F.col("__range").alias("__b_range"),
                       *[F.coalesce(F.sum(f"__t_{new}").over(earlier), F.lit(0)).alias(f"__b4_{new}")
                         for new in sums]))
    match = F.col("__range") == F.col("__b_range")
    for b in by:
        match &= F.col(b).eqNullSafe(F.col(f"__b_{b}"))
    # Without groups there is one offset per range; with them Spark checks the size.
    return (rows.join(offsets if by else F.broadcast(offsets), match)
            .withColumns({new: F.col(f"__in_{new}") + F.col(f"__b4_{new}") for new in sums})
            .select(*df.columns, *sums))


def exact_quantiles(df: DataFrame, x: str, by: str, probabilities: list[float]) -> DataFrame:
    """Quantiles per class by linear interpolation between ranks: ``(by, q0, q1, ...)``.

    Values are counted once each and ranked by running totals, so no class is held
    in one task as an exact percentile aggregate would.
    """
    counts = stage(df.filter(F.col(x).isNotNull())
                   .groupBy(F.col(by).alias("__by"), F.col(x).cast("double").alias("__x"))
                   .agg(F.count("*").alias("__n")), "value-counts")
    ranked = running_totals(counts, "__x", {"__upto": "__n"}, ["__by"])
    totals = counts.groupBy("__by").agg(F.sum("__n").alias("__all"))
    ranked = lookup_join(ranked, totals, {"__by": "__by"})

    def at(index: Column) -> Column:
        inside = (index >= F.col("__upto") - F.col("__n")) & (index < F.col("__upto"))
        return F.max(F.when(inside, F.col("__x")))

    def quantile(p: float) -> Column:
        place = (F.col("__all") - 1) * F.lit(p)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * F.max(place - F.floor(place))

    return (ranked.groupBy("__by")
            .agg(*[quantile(p).alias(f"q{i}") for i, p in enumerate(probabilities)])
            .withColumnRenamed("__by", by))
