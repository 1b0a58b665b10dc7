"""Broadcast budget helpers: width estimate, proven bounds, counted small sides."""

from pyspark.sql import types as T

from runready import schemas
from runready.functions import joins


def test_row_width_and_budget(spark):
    two_longs = T.StructType([T.StructField("k", T.LongType()), T.StructField("m", T.LongType())])
    assert joins.row_width(two_longs) == joins.ROW_OVERHEAD + 16
    assert joins.row_width(schemas.STATE) == joins.ROW_OVERHEAD + 4 * joins.VARIABLE_WIDTH + 3 * 8
    df = spark.createDataFrame([], two_longs)
    fit = joins.MAX_BROADCAST_BYTES // joins.row_width(two_longs)
    assert joins.fits_broadcast(fit, df) and not joins.fits_broadcast(fit + 1, df)
    assert not joins.fits_broadcast(None, df)


def test_broadcast_hints_follow_the_bound(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    big_side = spark.range(1000).withColumnRenamed("id", "k")

    def plan(right):
        return big_side.join(right, "k")._jdf.queryExecution().optimizedPlan().toString()

    assert "broadcast" in plan(joins.broadcast_within(small, 10)).lower()
    assert "broadcast" not in plan(joins.broadcast_within(small, None)).lower()
    assert "broadcast" in plan(joins.broadcast_if_small(small)).lower()


def test_lookup_without_hot_keys_is_one_join(spark):
    """Without a hot key the left side is gone through once: no split, no union."""
    left = spark.createDataFrame([(i, f"k{i % 5}" if i % 3 else None) for i in range(40)], "i int, name string")
    right = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3)], "rk string, v int")
    got = joins.lookup_join(left, right, left["name"], "rk", right_rows=None, hot_rows=100)
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    split = joins.lookup_join(left, right, left["name"], "rk", right_rows=None, hot_rows=5)
    assert got.columns == split.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, split.collect()))
