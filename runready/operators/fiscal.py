"""O3 fiscal_bounds: fiscal period / quarter bounds for any number of as-of instants.

For an instant, take its date in the calendar's zone and that date's calendar row:

* period start / quarter start = the row's period / quarter begin date;
* the period (quarter) index is moved back by one on days 1 and 2, and the "first
  Monday" bound is the date of day 3 of that period (quarter) — so on days 1-2 the
  bound is the previous period's day 3;

each bound is local midnight in the calendar zone, as epoch seconds.  The calendar is a
dimension (one row per day, ~366 per year), so both lookups are broadcast joins behind a
row-count check and the instants are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.joins import broadcast_if_small


def local_midnight_epoch(date_col, tz: str) -> "F.Column":
    """Epoch seconds of 00:00 local time in ``tz`` on a date (exact across DST)."""
    return F.unix_seconds(F.to_utc_timestamp(F.col(date_col).cast("timestamp"), F.lit(tz)))


def fiscal_bounds(calendar: DataFrame, as_of: DataFrame, as_of_col: str = "as_of",
                  tz: str = vocab.FISCAL_TZ, check_size: bool = True) -> DataFrame:
    """(as_of, fcl_per_start_time, fcl_per_first_mon, fcl_qtr_start_time, fcl_qtr_first_mon), one row per distinct instant.

    ``check_size=False`` skips the broadcast size checks (for a handful of instants, where
    the planner's own choice is as good).
    """
    first = vocab.FISCAL_FIRST_MONDAY_DAY
    bcast = broadcast_if_small if check_size else (lambda df: df)
    days = bcast(calendar.select(
        F.col("CLDR_DT").alias("_d"),
        F.when(F.col("FCL_DAY_OF_PER_C") < first, F.col("FCL_PER_INDEX") - 1).otherwise(F.col("FCL_PER_INDEX")).alias("_pi"),
        F.when(F.col("FCL_DAY_OF_QTR_C") < first, F.col("FCL_QTR_INDEX") - 1).otherwise(F.col("FCL_QTR_INDEX")).alias("_qi"),
        F.col("FCL_PER_BGN_DT").alias("_pb"), F.col("FCL_QTR_BGN_DT").alias("_qb"),
    ))
    per_day3 = bcast(calendar.where(F.col("FCL_DAY_OF_PER_C") == first)
                                  .groupBy(F.col("FCL_PER_INDEX").alias("_pi")).agg(F.min("CLDR_DT").alias("_pm")))
    qtr_day3 = bcast(calendar.where(F.col("FCL_DAY_OF_QTR_C") == first)
                                  .groupBy(F.col("FCL_QTR_INDEX").alias("_qi")).agg(F.min("CLDR_DT").alias("_qm")))
    inst = (as_of.select(F.col(as_of_col).cast("long").alias("as_of")).distinct()
            .withColumn("_d", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("as_of"), F.lit(tz)))))
    j = (inst.join(days, "_d", "left")
         .join(per_day3, "_pi", "left")
         .join(qtr_day3, "_qi", "left"))
    return j.select(
        "as_of",
        local_midnight_epoch("_pb", tz).alias("fcl_per_start_time"),
        local_midnight_epoch("_pm", tz).alias("fcl_per_first_mon"),
        local_midnight_epoch("_qb", tz).alias("fcl_qtr_start_time"),
        local_midnight_epoch("_qm", tz).alias("fcl_qtr_first_mon"),
    )


def fiscal_bounds_at(calendar: DataFrame, as_of: int, tz: str = vocab.FISCAL_TZ) -> dict:
    """The four bounds of one instant as a dict (a one-row result; used to attach constants)."""
    spark = calendar.sparkSession
    instant = spark.range(1).select(F.lit(int(as_of)).cast("long").alias("as_of"))
    row = fiscal_bounds(calendar, instant, tz=tz, check_size=False).collect()[0]
    return {k: row[k] for k in ("fcl_per_start_time", "fcl_per_first_mon", "fcl_qtr_start_time", "fcl_qtr_first_mon")}
