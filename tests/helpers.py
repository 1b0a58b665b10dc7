"""Builders for literal inputs in the reference's shapes."""

from pyspark.sql import functions as F

from runready import schemas

TAG_NAMES = [f.name for f in schemas.TAGS.fields]


def raw_defs(spark, jobs):
    """jobs: list of dicts with job_id, name, created_time, mcr and any tag keys."""
    data = []
    for j in jobs:
        tags = tuple(j.get(t) for t in TAG_NAMES)
        data.append((j.get("created_time", 1_700_000_000_000), "u", j["job_id"],
                     (j.get("name"), (False,), 0, j.get("mcr", 1), tags, "MULTI_TASK")))
    return spark.createDataFrame(data, schemas.DEFINITION)


def raw_runs(spark, runs):
    """runs: list of (run_id, job_id, life_cycle_state, result_state, start_ms, end_ms)."""
    data = [(r[0], r[1], (r[2], r[3]), r[4], r[5]) for r in runs]
    return spark.createDataFrame(data, schemas.RAW_RUN)


def state_df(spark, rows_):
    """rows_: list of (job_id, source, lock, status, pipeline, start_s, end_s)."""
    return spark.createDataFrame(rows_, schemas.STATE)


def norm_runs(spark, rows_):
    """rows_: list of (job_id, source, state, status, pipeline, start_s, end_s)."""
    return spark.createDataFrame(rows_, schemas.RUN)


def flat_runs(df):
    return df.select("run_id", "job_id", F.col("state.life_cycle_state").alias("lc"),
                     F.col("state.result_state").alias("rs"), "start_time", "end_time")
