"""Join helpers: broadcast only behind a size check, with a shuffle join beyond it.

A table is broadcast when (row count) x (estimated row width) fits ``MAX_BROADCAST_BYTES``.
The row count is either a proven bound the caller knows (the definition count bounds every
per-job table) or a count taken on the small side itself.  The width comes from the
schema, counting strings and other variable-size values conservatively.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Budget for one broadcast table, in bytes (it is shipped to every executor).
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
# Width assumed for a string / binary value, in bytes.
VARIABLE_WIDTH = 64
# Per-row overhead of a hashed relation, in bytes.
ROW_OVERHEAD = 16
# Rows counted before giving up on broadcasting a table of unknown size.
MAX_COUNTED_ROWS = 4_000_000


def row_width(schema: T.StructType) -> int:
    """Estimated bytes per row of ``schema``."""
    def width(t: T.DataType) -> int:
        if isinstance(t, (T.StringType, T.BinaryType)):
            return VARIABLE_WIDTH
        if isinstance(t, T.StructType):
            return sum(width(f.dataType) for f in t.fields)
        if isinstance(t, (T.ArrayType, T.MapType)):
            return 4 * VARIABLE_WIDTH
        if isinstance(t, (T.IntegerType, T.FloatType, T.DateType)):
            return 4
        if isinstance(t, (T.ShortType,)):
            return 2
        if isinstance(t, (T.ByteType, T.BooleanType, T.NullType)):
            return 1
        if isinstance(t, T.DecimalType):
            return 16
        return 8                                   # long, double, timestamps, intervals
    return ROW_OVERHEAD + sum(width(f.dataType) for f in schema.fields)


def fits_broadcast(n_rows: int | None, df: DataFrame) -> bool:
    """Whether ``n_rows`` rows of ``df``'s schema fit the broadcast budget (None: unknown, no)."""
    return n_rows is not None and n_rows * row_width(df.schema) <= MAX_BROADCAST_BYTES


def broadcast_within(df: DataFrame, n_rows: int | None) -> DataFrame:
    """``broadcast(df)`` when ``n_rows`` (a proven bound on its rows) fits the budget, else ``df``."""
    return F.broadcast(df) if fits_broadcast(n_rows, df) else df


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Count the small side (reading at most a bounded number of rows) and broadcast it if it fits."""
    limit = min(MAX_COUNTED_ROWS, MAX_BROADCAST_BYTES // row_width(df.schema))
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


# Rows per key from which a lookup key counts as hot (its rows would crowd one task).
HOT_KEY_ROWS = 100_000


def lookup_join(left: DataFrame, right: DataFrame, left_key, right_key: str, right_rows: int | None = None,
                hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """``left`` left-outer-joined to ``right`` on ``left_key = right[right_key]``, skew-safe.

    * ``right`` fits the broadcast budget (``right_rows``, a known row count): one broadcast
      join, no shuffle, no hot task.
    * otherwise the keys of ``left`` are counted (a partial aggregate).  Rows whose key
      reaches ``hot_rows`` join a broadcast of just the matching ``right`` rows (bounded by
      the number of hot keys); the remaining rows take an ordinary shuffle join, which has no
      hot key left.  Without a hot key all rows take it.  Null keys never match, as in a plain join.
    """
    lk = left.withColumn("_lk", left_key)
    cond_col = F.col("_lk") == F.col(right_key)
    if fits_broadcast(right_rows, right):
        return lk.join(F.broadcast(right), cond_col, "left").drop("_lk")
    hot = (lk.groupBy("_lk").count().where(F.col("count") >= hot_rows)
           .select(F.col("_lk").alias("_hk")).where(F.col("_hk").isNotNull()))
    if not hot.limit(1).count():         # no key to split off: one shuffle join, and ``left`` is not gone through again
        return lk.join(right, cond_col, "left").drop("_lk")
    hot = broadcast_if_small(hot)
    hot_left = lk.join(hot, F.col("_lk") == F.col("_hk"), "left_semi")
    cold_left = lk.join(hot, F.col("_lk") == F.col("_hk"), "left_anti")
    right_hot = broadcast_if_small(right.join(hot, F.col(right_key) == F.col("_hk"), "left_semi"))
    hot_part = hot_left.join(right_hot, cond_col, "left")
    cold_part = cold_left.join(right, cond_col, "left")
    return hot_part.unionByName(cold_part).drop("_lk")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` over all cores, however few files or row groups it was read from."""
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)
