"""Comparison by digests of ranges against the plain join."""

import random

import pytest
from pyspark.sql import functions as F

from framelake.operators import compare


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("digests", [1, 7, 1_024])
@pytest.mark.parametrize("kinds", [("k long, s string, v int", "k long, s string, v int"), ("k long, s string, v int", "k int, s string, v long"), ("k int, s string, v double", "k int, s string, v double")])
def test_equals_the_plain_join(spark, digests, kinds):
    """Rows of one side, values within and beyond the tolerance, nulls in keys and values, columns of two types."""
    rng = random.Random(digests)
    number = float if "double" in kinds[0] else int
    left = [(k, rng.choice("ab"), number(rng.randint(0, 9))) for k in range(400)]
    right = [(k, s, number(v + rng.choice([0] * 30 + [1, 2, -5]))) for k, s, v in left if rng.random() < 0.98] + [(900, "a", number(1)), (None, "a", number(3)), (901, None, number(3)), (902, "b", None)]
    left += [(None, "a", number(3)), (902, "b", None), (903, "b", None), (904, "b", number(1))]
    right += [(903, "b", number(2)), (904, "b", None)]
    a, b = spark.createDataFrame(left, kinds[0]), spark.createDataFrame(right, kinds[1])
    for tol in (0, 1, 100):
        plain = rows(compare.compare_tables(a, b, keys=["k", "s"], value="v", tol=tol, digests=0))
        assert rows(compare.compare_tables(a, b, keys=["k", "s"], value="v", tol=tol, digests=digests)) == plain and len(plain) > 5


def test_equal_tables_shuffle_digests_alone(spark):
    a = spark.range(300_000).selectExpr("id k", "id % 1000 v")
    b = spark.range(299_999, -1, -1).selectExpr("id k", "id % 1000 v")
    found = compare.compare_tables(a, b, keys=["k"], value="v")
    assert found.collect() == []
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "EmptyRelation" in final and "Join" not in final  # no range differs, so nothing is joined
    changed = b.withColumn("v", F.when(F.col("k") == 77, F.col("v") + 5).otherwise(F.col("v")))
    assert rows(compare.compare_tables(a, changed, keys=["k"], value="v")) == [(77, 77, 82)]
    ranges = compare.differing_ranges(*(x.select(F.pmod(F.xxhash64("k"), F.lit(64)).alias("range"), F.struct("k", "v").alias("row")) for x in (a, changed)), 64)
    assert ranges.count() == 1


def test_swapped_values_and_repeated_rows_are_seen(spark):
    """What leaves sums, or an exclusive or, as they were."""
    a = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, v int")
    assert len(rows(compare.compare_tables(a, spark.createDataFrame([(1, 20), (2, 10), (3, 30)], "k int, v int"), keys=["k"], value="v", digests=1))) == 2
    assert len(rows(compare.compare_tables(a, a.limit(0), keys=["k"], value="v"))) == 3 and compare.compare_tables(a.limit(0), a.limit(0), keys=["k"], value="v").count() == 0
