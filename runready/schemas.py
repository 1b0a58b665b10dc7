"""Declared schemas of every table the engine reads or writes (no inference)."""

from pyspark.sql.types import (BooleanType, DateType, IntegerType, LongType, StringType,
                               StructField, StructType)

TAGS = StructType([
    StructField("state", StringType()),
    StructField("cron", StringType()),
    StructField("tz", StringType()),
    StructField("tdep", StringType()),
    StructField("tdep2", StringType()),
    StructField("sdep", StringType()),
    StructField("sdep2", StringType()),
    StructField("cdep", StringType()),
    StructField("cdep2", StringType()),
    StructField("spec", StringType()),
    StructField("onfail", StringType()),
])

# Raw job definition, as listed by the job service (one JSON object per job).
DEFINITION = StructType([
    StructField("created_time", LongType()),          # epoch ms
    StructField("creator_user_name", StringType()),
    StructField("job_id", LongType()),
    StructField("settings", StructType([
        StructField("name", StringType()),
        StructField("email_notifications", StructType([
            StructField("no_alert_for_skipped_runs", BooleanType())])),
        StructField("timeout_seconds", LongType()),
        StructField("max_concurrent_runs", LongType()),
        StructField("tags", TAGS),
        StructField("format", StringType()),
    ])),
])

# Raw run record (one JSON object per run); result_state is absent while a run is active.
RAW_RUN = StructType([
    StructField("run_id", LongType()),
    StructField("job_id", LongType()),
    StructField("state", StructType([
        StructField("life_cycle_state", StringType()),
        StructField("result_state", StringType()),
    ])),
    StructField("start_time", LongType()),            # epoch ms
    StructField("end_time", LongType()),              # epoch ms
])

# Normalised run (epoch seconds) with its pipeline name and source.
RUN = StructType([
    StructField("job_id", LongType()),
    StructField("source", StringType()),
    StructField("state", StringType()),
    StructField("status", StringType()),
    StructField("pipeline", StringType()),
    StructField("start_time", LongType()),
    StructField("end_time", LongType()),
])

# Pipeline state: latest known run per (pipeline, source); lock is "0"/"1".
STATE = StructType([
    StructField("job_id", LongType()),
    StructField("source", StringType()),
    StructField("lock", StringType()),
    StructField("status", StringType()),
    StructField("pipeline", StringType()),
    StructField("start_time", LongType()),            # epoch s
    StructField("end_time", LongType()),              # epoch s
])
STATE_COLUMNS = [f.name for f in STATE.fields]

# Fiscal calendar (one row per day).
CALENDAR = StructType([
    StructField("CLDR_DT", DateType()),
    StructField("FCL_PER_INDEX", IntegerType()),
    StructField("FCL_DAY_OF_PER_C", IntegerType()),
    StructField("FCL_PER_BGN_DT", DateType()),
    StructField("FCL_QTR_INDEX", IntegerType()),
    StructField("FCL_DAY_OF_QTR_C", IntegerType()),
    StructField("FCL_QTR_BGN_DT", DateType()),
])

# One line per started job (written by the dispatcher).
INVOCATION = StructType([
    StructField("start_time", LongType()),            # epoch ms
    StructField("end_time", LongType()),              # epoch ms
    StructField("conductor_job_id", StringType()),
    StructField("conductor_job_run_id", StringType()),
    StructField("job_type", StringType()),
    StructField("job_name", StringType()),
    StructField("job_run_id", StringType()),
    StructField("wait_on_completion", StringType()),
    StructField("parameters", StringType()),
])
INVOCATION_COLUMNS = [f.name for f in INVOCATION.fields]

# Flattened definitions (output of flatten_definitions).
DEFINITION_COLUMNS = ["job_id", "created_time", "pipeline", "state", "max_concurrent_runs", "cron", "tz",
                      "spec", "onfail", "sdep", "tdep", "cdep"]

# Decision rows: one row per own-state row and per dependency edge of every (job, instant).
DECISION_COLUMNS = [
    "as_of", "job_id", "pipeline", "state", "row_kind", "lock_flag", "pipeline_status", "tz", "spec", "onfail",
    "last_start_time", "last_end_time", "prev_min_exec_time", "next_min_exec_time",
    "prev_fcl_per_start_time", "prev_fcl_per_first_mon", "prev_fcl_qtr_start_time", "prev_fcl_qtr_first_mon",
    "dependency", "source", "dep_start_time", "dep_end_time", "dep_status", "readiness",
]

# Wide decision rows: one per combination of a job's own, trigger, status and completed state rows.
PRODUCT_COLUMNS = [
    "as_of", "job_id", "pipeline", "state", "lock_flag", "pipeline_status", "tz", "spec", "onfail",
    "last_start_time", "last_end_time", "prev_min_exec_time", "next_min_exec_time",
    "prev_fcl_per_start_time", "prev_fcl_per_first_mon", "prev_fcl_qtr_start_time", "prev_fcl_qtr_first_mon",
    "trigger_dependency", "tdep_start_time", "tdep_end_time", "tdep_status", "status_dependency", "sdep_status",
    "completed_dependency", "cdep_start_time", "cdep_end_time", "readiness",
]
