"""The run log laid out for the reads of a pass: a folder a start date, files in job order with bloom filters.

* ``land_runs`` merges new records into the days they fall on, so the log holds each run's current state; other days
  keep their files.
* ``select_landed`` is the run selection over such a log.  The high-water mark and the carry-over bound become conditions
  on folders, the look at each carried job's recorded run prunes folders by the recorded dates at run time, and jobs
  whose recorded run is missing are sought by their ids in files whose statistics and bloom filters tell who is in them.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.joins import broadcast_if_small
from ..session import ensure_checkpoint_dir, path_exists
from .runs import _latest_per_job, carry_over_jobs, is_terminal

DAY = "start_date"
SCHEMA = T.StructType([*schemas.RAW_RUN.fields, T.StructField(DAY, T.DateType())])
# Runs without a start lie under this date.
NO_START = "1970-01-01"
# Missing jobs are sought by a list of ids up to this number, by a join beyond it: the same rows either way.
MAX_IDS = 1000
# A column with a whole dictionary gets no bloom filter, so job_id has none.
FILE_OPTIONS = {"compression": "zstd", "parquet.bloom.filter.enabled#job_id": "true",
                "parquet.bloom.filter.expected.ndv#job_id": "100000", "parquet.enable.dictionary#job_id": "false"}


def _day(ms: Column) -> Column:
    return F.coalesce(F.to_date(F.timestamp_millis(ms)), F.lit(NO_START).cast("date"))


def _from_day(ms: int) -> Column:
    return F.col(DAY) >= F.lit(datetime.fromtimestamp(ms // 1000, UTC).date())


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """The landed log: ``schemas.RAW_RUN`` and ``start_date``."""
    return spark.read.schema(SCHEMA).parquet(path)


def land_runs(records: DataFrame, path: str) -> None:
    """Merge ``records`` (``schemas.RAW_RUN``) into the log: only the days they fall on are read and rewritten.

    Of a run's records those of this landing win, then a terminal one, then the later end.  A run is known by its id and start date;
    rows without an id stay as they are, once each.  A landing that is repeated changes nothing.  One landing at a
    time; a pass that reads a day while it is replaced fails on a missing file and is run again.
    """
    spark = records.sparkSession
    ensure_checkpoint_dir(spark)
    new = records.select(*schemas.RAW_RUN.fieldNames(), _day(F.col("start_time")).alias(DAY), F.lit(1).alias("landing"))
    every = new
    if path_exists(spark, path):
        days = broadcast_if_small(new.select(DAY).distinct())
        every = new.unionByName(read_run_log(spark, path).join(days, DAY, "left_semi").withColumn("landing", F.lit(0)))
    record = F.struct("landing", F.coalesce(is_terminal(F.col("state.life_cycle_state")), F.lit(False)).alias("terminal"),
                      "end_time", "start_time", "job_id", "state")
    no_id = F.when(F.col("run_id").isNull(), F.xxhash64("job_id", "state", "start_time", "end_time"))
    merged = (every.groupBy(DAY, "run_id", no_id.alias("no_id")).agg(F.max(record).alias("r"))
              .select("run_id", "r.job_id", "r.state", "r.start_time", "r.end_time", DAY).select(*SCHEMA.fieldNames()))
    # the days are overwritten, so what is written must not be read from them; a hot job's day is cut by run id
    (merged.checkpoint().repartitionByRange(DAY, "job_id", "run_id").sortWithinPartitions(DAY, "job_id", "start_time")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).options(**FILE_OPTIONS)
     .parquet(path))


def select_landed(log: DataFrame, old_state: DataFrame | None = None, hwm_ms: int | None = None,
                  carry_over: str = "reference", jobs_bound: int | None = None) -> DataFrame:
    """O5 over a landed log: the rows of ``runs.select_runs``, without ``start_date``."""
    columns = [c for c in log.columns if c != DAY]
    if hwm_ms is None:
        return _latest_per_job(log.select(*columns), jobs_bound)
    recent = log.where(_from_day(int(hwm_ms)) & (F.col("start_time") >= F.lit(int(hwm_ms)))).select(*columns)
    if old_state is None:
        return recent.distinct()
    carry = broadcast_if_small(carry_over_jobs(old_state, carry_over).withColumn("bound_day", F.to_date(F.timestamp_millis("bound_ms"))))
    low = carry.agg(F.min("bound_ms").alias("m")).collect()[0]["m"]
    parts, lost = [recent], carry.select("job_id")
    if low is not None:
        # the recorded start is in whole seconds, so the run lies on the same day
        found = broadcast_if_small(
            log.join(carry.withColumnRenamed("job_id", "_job"), (F.col("job_id") == F.col("_job")) & (F.col(DAY) == F.col("bound_day"))
                     & (F.col("start_time") >= F.col("bound_ms")) & (F.col("start_time") < F.col("bound_ms") + 1000))
            .select(F.col("_job"), "bound_ms").distinct())
        since = log.where(_from_day(int(low)) & (F.col("start_time") >= F.lit(int(low)))).select(*columns)
        at_or_after = (F.col("job_id") == F.col("_job")) & (F.col("start_time") >= F.col("bound_ms"))
        parts.append(_latest_per_job(since.join(found, at_or_after, "left_semi"), jobs_bound))
        lost = lost.join(found.select(F.col("_job").alias("job_id")), "job_id", "left_anti")
    ids = [r.job_id for r in lost.limit(MAX_IDS + 1).collect()]
    if ids:
        history = log.select(*columns)
        history = (history.where(F.col("job_id").isin(ids)) if len(ids) <= MAX_IDS
                   else history.join(broadcast_if_small(lost), "job_id", "left_semi"))
        parts.append(_latest_per_job(history, jobs_bound))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


__all__ = ["land_runs", "read_run_log", "select_landed", "SCHEMA", "DAY"]
