"""Splits, folds, row numbers and running totals."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import values
from secondlook.operators import ranking as R
from secondlook.operators import sampling as M


def ids(spark, n, partitions=4):
    return spark.range(n).withColumn("c", F.col("id") % 3).repartition(partitions)


def hash_order(n, seed):
    return sorted(range(n), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("n,p", [(0, 0.8), (1, 0.8), (4, 0.2), (25, 0.8), (333, 0.75)])
def test_exact_split(spark, n, p):
    got = M.exact_split(ids(spark, n), "id", p, 7).filter("is_train")
    assert {r.id for r in got.collect()} == set(hash_order(n, 7)[:math.floor(p * n)])


def test_split_does_not_depend_on_partitions(spark):
    results = [values(M.exact_split(ids(spark, 200, n), "id", 0.8)) for n in (1, 4, 16)]
    assert results[0] == results[1] == results[2]


def test_stratified_split_sizes(spark):
    rows = spark.range(100).withColumn("c", F.when(F.col("id") < 11, "few").when(F.col("id") < 98, "many"))
    got = M.stratified_split(rows, "id", "c", 0.8).groupBy("c").agg(F.count_if("is_train").alias("n"))
    assert {r.c: r.n for r in got.collect()} == {"few": 9, "many": 70, None: 2}


def test_fold_sizes(spark):
    folds = M.assign_folds(ids(spark, 25), "id", 10, 2)
    sizes = {r.fold: r["count"] for r in folds.groupBy("fold").count().collect()}
    assert [sizes[i] for i in range(1, 11)] == [3, 2, 3, 2, 3, 2, 2, 3, 2, 3]


@pytest.mark.parametrize("n", [1, 2, 5, 9, 10, 11, 57])
def test_folds_follow_the_position_rule(spark, n):
    order = hash_order(n, 2)
    want = {row: max(1, (10 * i + n - 2) // (n - 1)) if n > 1 else 1 for i, row in enumerate(order)}
    got = {r.id: r.fold for r in M.assign_folds(spark.range(n), "id", 10, 2).collect()}
    assert got == want
    numbered = spark.range(1, n + 1).select("id", R.fold_of_position("id", F.lit(n), 10).alias("fold"))
    assert [r.fold for r in numbered.orderBy("id").collect()] == [want[r] for r in order]


def test_fold_parts(spark):
    folded = M.assign_folds(ids(spark, 50), "id", 5, 2)
    inside, outside = M.fold_parts(folded, 2)
    assert inside.count() + outside.count() == 50
    rest, fold = M.fold_parts(folded, 2, "rest")
    assert values(rest) == values(outside) and values(fold) == values(inside)
    with pytest.raises(ValueError):
        M.fold_parts(folded, 1, "other")


def test_append_level(spark):
    rows = ids(spark, 40)
    flagged = M.exact_split(rows, "id", 0.5)
    train = flagged.filter("is_train").drop("is_train")
    level = F.col("c") == 1
    plain = M.append_level(train, rows, "c", 1, "id")
    assert plain.count() == 20 + rows.filter(level).count()
    safe = M.append_level(train, rows, "c", 1, "id", exclude_test=True)
    assert safe.count() == 20 + train.filter(level).count()


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_global_row_number(spark, partitions):
    df = spark.range(500).withColumn("k", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 5 != 0, 2))
    got = R.global_row_number(df.repartition(partitions), "k", "id").collect()
    order = sorted(range(500), key=lambda i: (1 if i % 3 == 0 else 2 if i % 5 else 3, i))
    assert {r.id: r.idx for r in got} == {row: i for i, row in enumerate(order, 1)}


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rows = [(g, float(v), v % 4 + 1) for g in "ab" for v in range(60)]
    df = spark.createDataFrame(rows, "g string, x double, n int").repartition(5)
    got = {(r.g, r.x): r.upto for r in R.running_totals(df, "x", {"upto": "n"}, ["g"], descending).collect()}
    for g in "ab":
        total = 0
        for v in sorted(range(60), reverse=descending):
            total += v % 4 + 1
            assert got[g, float(v)] == total


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    data = {c: np.round(rng.normal(size=n), 2) for c, n in (("a", 101), ("b", 40), ("c", 1))}
    df = spark.createDataFrame([(c, float(v)) for c, vs in data.items() for v in vs], "c string, x double")
    for r in R.exact_quantiles(df, "x", "c", [0.25, 0.75]).collect():
        assert (r.q0, r.q1) == pytest.approx(tuple(np.quantile(data[r.c], [0.25, 0.75])))


def test_row_numbers_need_no_single_task(spark):
    plan = M.exact_split(ids(spark, 50), "id", 0.8)._jdf.queryExecution().executedPlan().toString()
    # Only the counts per hash prefix meet in one place, never rows.
    assert "RangePartitioning" not in plan
