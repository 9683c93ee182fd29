"""Keyed rows and joins, with hot and missing keys."""

import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from conftest import values
from secondlook.operators import joins as J
from secondlook.operators import keyed as K
from secondlook.plans import leads

# A key counts as hot above 5 rows here, so the fixtures exercise the split path.
HOT = {"min_rows": 5, "share": 0.0}


def skewed(spark, partitions=4):
    """Key 'h' holds a third of the rows, NULL another part; the rest are rare."""
    rows = [(i, "h" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 40}", i % 5) for i in range(300)]
    return spark.createDataFrame(rows, "row_id int, k string, m int").repartition(partitions)


def expected_first(df):
    best = {}
    for r in df.collect():
        if r.k not in best or (r.m, r.row_id) < best[r.k]:
            best[r.k] = (r.m, r.row_id)
    return best


def test_first_latest_earliest(spark):
    day = dt.date(2016, 1, 1)
    df = spark.createDataFrame([(1, None, 1), (1, day, 2), (1, day, 3)], "id int, d date, row_id int")
    assert [r.row_id for r in K.latest_per_key(df, "id", "d", "row_id").collect()] == [2]
    assert [r.row_id for r in K.earliest_per_key(df, "id", "d", "row_id").collect()] == [2]


def test_first_keeps_one_row_per_map_task(spark):
    plan = K.first_per_key(skewed(spark), "k", "m", "row_id")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_single_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    assert values(K.single_rows(df, "k")) == sorted([("b", 3), (None, 4)], key=repr)
    both = df.union(spark.createDataFrame([(None, 5)], "k string, v int"))
    assert values(K.single_rows(both, "k")) == [("b", 3)]


def test_later_and_repeated_rows(spark):
    df = skewed(spark)
    first = {rid for _, rid in expected_first(df).values()}
    later = {r.row_id for r in K.later_rows(df, "k", "m", row_id="row_id").collect()}
    assert later == set(range(300)) - first
    sizes = Counter(r.k for r in df.collect())
    repeated = {r.row_id for r in K.repeated_rows(df, "k", **HOT).collect()}
    assert repeated == {r.row_id for r in df.collect() if sizes[r.k] > 1}


def test_pairs_with_first(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 4)], "k int, m int, row_id int")
    pairs = K.pair_with_first(df, "k", "m", row_id="row_id").select("m_x", "m_y")
    assert values(pairs) == [(1, 2), (1, 3)]
    hot = skewed(spark)
    first = expected_first(hot)
    got = K.pair_with_first(hot, "k", "m", row_id="row_id", **HOT).collect()
    assert len(got) == 300 - len(first)
    assert all(first[r.k] == (r.m_x, r.row_id_x) for r in got)


def test_salted_join_equals_plain_join(spark):
    left = skewed(spark)
    right = spark.createDataFrame([("h", 1), ("h", 2), (None, 3), ("k1", 4), ("zz", 5)], "k string, v int")
    condition = F.col("k").eqNullSafe(F.col("k2"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right.withColumnRenamed("k", "k2"), condition, how).drop("k2")
        assert values(J.salted_join(left, right, ["k"], how, **HOT)) == values(plain), how


def test_both_sides_may_be_hot(spark):
    left = skewed(spark)
    right = left.select("k", F.col("row_id").alias("v")).unionByName(
        spark.createDataFrame([("only right", 1)], "k string, v int"))
    left = left.unionByName(spark.createDataFrame([(900, "only left", 0)], "row_id int, k string, m int"))
    for how in ("inner", "left"):
        plain = left.join(right.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")), how).drop("k2")
        assert values(J.salted_join(left, right, ["k"], how, right_hot=True, **HOT)) == values(plain)
    assert values(J.left_join(left, right, ["k"], **HOT)) == values(plain)


def test_left_join_of_unique_sides(spark):
    a = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, v int")
    b = spark.createDataFrame([("a", 5), (None, 6)], "k string, v int")
    want = sorted([("a", 1, 5), (None, 2, 6), ("c", 3, None)], key=repr)
    for unique in ("both", "left", "right", None):
        assert values(J.left_join(a, b, ["k"], unique)) == want


def test_salted_join_spreads_the_hot_key(spark):
    left = skewed(spark)
    hot = J.hot_keys(left, ["k"], **HOT).collect()
    pieces = {r["__hot_0"]: r["__pieces"] for r in hot}
    assert pieces["h"] == 20 and None in pieces


def test_equal_rows_of_a_hot_key_use_all_pieces(spark):
    left = spark.createDataFrame([("h", 1)] * 1000 + [("c", 2)], "k string, v int")
    hot = J.hot_keys(left, ["k"], min_rows=100, share=0.0)
    cut = J.spread(left, ["k"], hot, "piece")
    sizes = [r["count"] for r in cut.filter("k = 'h'").groupBy("piece").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 150
    assert cut.filter("k = 'c'").collect() == [("c", 2, 0)]


def test_no_hot_key_no_pieces(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([(None, 5), ("b", 6)], "k string, w int")
    joined = J.salted_join(left, right, ["k"], "left", right_hot=True)
    assert values(joined) == sorted([("a", 1, None), (None, 2, 5)], key=repr)
    assert "explode" not in joined._jdf.queryExecution().toString()


def test_small_lookups_by_rows_and_bytes(spark):
    wide = spark.createDataFrame([("x" * 1000,)] * 10, "s string")
    assert J.is_small(wide, 10) and not J.is_small(wide, 9) and not J.is_small(wide, 10, size=5_000)
    assert J.is_small(wide.limit(0), 0)


def test_hot_keys_are_few(spark):
    # Above a share of the rows there cannot be more than 1 / share keys.
    assert J.hot_keys(skewed(spark), ["k"], min_rows=0, share=0.1).count() < 10


def test_lookup_on_missing_key_and_fan_out(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    lookup = spark.createDataFrame([(None, "n"), ("a", "x"), ("a", "y")], "d string, code string")
    want = sorted([(None, 1, "n"), ("a", 2, "x"), ("a", 2, "y"), ("b", 3, None)], key=repr)
    assert values(J.lookup_join(left, lookup, {"k": "d"})) == want
    # The same result when the lookup is too large to broadcast.
    assert values(J.lookup_join(left, lookup, {"k": "d"}, small_rows=1, min_rows=0, share=0.0)) == want


def test_natural_lookup_needs_a_shared_name(spark):
    import pytest
    with pytest.raises(ValueError):
        J.natural_lookup(spark.range(1).toDF("a"), spark.range(1).toDF("b"))


def test_results_do_not_depend_on_partitions(spark):
    results = [values(K.pair_with_first(skewed(spark, n), "k", "m", row_id="row_id", **HOT)) for n in (1, 4, 16)]
    assert results[0] == results[1] == results[2]


def lead_fixture(spark):
    rows = [(i, None if i % 11 == 0 else i % 30, i % 6 or None, f"s{i % 3}", None if i % 8 == 0 else f"p{i % 2}")
            for i in range(200)]
    return spark.createDataFrame(
        rows, "row_id int, ID int, Data_Mth int, AGENT_SOURCE_CODE string, Product_CC_PL_RL string")


def test_profile_identities(spark):
    lead = lead_fixture(spark)
    counts = {r.metric: r.value for r in leads.lead_counts(lead).collect()}
    profile = leads.duplicate_profile(lead).collect()
    assert counts["repeats"] == counts["total"] - counts["distinct"]
    for comparison in ("month", "source", "product", "source_product"):
        assert sum(r.n for r in profile if r.comparison == comparison) == counts["repeats"]
    pairs = leads.repeat_pairs(lead, **HOT)
    cells = pairs.select(*[flag.alias(name) for name, flag in leads.same_flags(pairs).items()]).collect()
    assert Counter(r.same_month for r in cells) == {
        r.first_flag: r.n for r in profile if r.comparison == "month"}
    assert Counter((r.same_source, r.same_product) for r in cells) == {
        (r.first_flag, r.second_flag): r.n for r in profile if r.comparison == "source_product"}
    by_source = Counter()
    for r in profile:
        if r.comparison == "source_product":
            by_source[r.first_flag] += r.n
    assert dict(by_source) == {r.first_flag: r.n for r in profile if r.comparison == "source"}


def test_single_rows_without_sorting_rows(spark):
    """Frequent keys leave before the shuffle; counts are hash aggregates; any type may be a key."""
    rows = [("hot", i) for i in range(300)] + [("b", 1), ("c", 2), ("c", 3), (None, 4), ("", 5)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    for hot in (10, 10 ** 6):
        assert values(K.single_rows(df, "k", hot)) == sorted([("b", 1), (None, 4), ("", 5)], key=repr)
    plan = K.single_rows(df, "k")._jdf.queryExecution().toString()
    assert "SortAggregate" not in plan
    twice = df.union(df)
    assert K.single_rows(twice, "k").count() == 0 and K.single_rows(df.limit(0), "k").count() == 0
    odd = spark.createDataFrame([([1], 1), ([1], 2), ([], 3), (None, 4), ([None], 5)], "k array<int>, v int")
    assert [r.v for r in K.single_rows(odd, "k").orderBy("v").collect()] == [3, 4, 5]
    zeros = spark.createDataFrame([(0.0, 1), (-0.0, 2), (float("nan"), 3), (float("nan"), 4), (1.0, 5)], "k double, v int")
    assert [r.v for r in K.single_rows(zeros, "k").collect()] == [5]
