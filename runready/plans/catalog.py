"""Registered queries: each operator applied to inputs derived from the supplied tables.

Every function takes ``(spark, sf_dir)`` and returns a DataFrame.  They read whole
tables; nothing is sampled or capped.  The matching DuckDB SQL lives in
``runready.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import definitions, dependencies, fiscal, log_files, logs, outcome, product, readiness, run_log, runs, schedule, state
from ..session import list_dirs, shared_path
from ..sources import fixtures as fx
from ..sources import feed, quarantine

RAW_RUN_FLAT = ["run_id", "job_id", "life_cycle_state", "result_state", "start_time", "end_time"]


def _flat_runs(df: DataFrame) -> DataFrame:
    return df.select("run_id", "job_id", F.col("state.life_cycle_state").alias("life_cycle_state"),
                     F.col("state.result_state").alias("result_state"), "start_time", "end_time")


def q_flatten_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """O1 over every customer as a job definition."""
    return definitions.flatten_definitions(fx.fx_defs(spark, sf))


def _defs(spark, sf):
    return definitions.flatten_definitions(fx.fx_defs(spark, sf))


def q_normalize_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a run, normalised and joined to the definitions."""
    return runs.normalize_runs(fx.fx_runs(spark, sf), _defs(spark, sf))


def q_select_runs_full(spark: SparkSession, sf: str) -> DataFrame:
    """O5 full load: the latest run of every job in the run log."""
    return _flat_runs(runs.select_runs(fx.fx_runs(spark, sf)))


def q_select_runs_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """O5 incremental: runs since the high-water mark plus the latest run of carried jobs."""
    return _flat_runs(runs.select_runs(fx.fx_runs(spark, sf), fx.fx_state_old(spark, sf), hwm_ms=fx.HWM_MS))


# Fixed value: 2024-01-25 00:00 UTC, before the fixture's high-water mark.
LANDED_AGAIN_MS = 1_706_140_800_000


def q_run_log_selection(spark: SparkSession, sf: str) -> DataFrame:
    """O5 incremental over a landed log: the late days landed first as still running, then as they ended."""
    path = shared_path(spark, "run_log")
    log, late = fx.fx_runs(spark, sf), F.col("start_time") >= F.lit(LANDED_AGAIN_MS)
    running = F.struct(F.lit("RUNNING").alias("life_cycle_state"), F.lit(None).cast("string").alias("result_state"))
    run_log.land_runs(log.withColumn("state", F.when(late, running).otherwise(F.col("state"))), path)
    run_log.land_runs(log.where(late), path)
    return _flat_runs(run_log.select_landed(run_log.read_run_log(spark, path), fx.fx_state_old(spark, sf), fx.HWM_MS))


def q_open_slots(spark: SparkSession, sf: str) -> DataFrame:
    """Free concurrent slots of multi-slot jobs with active runs."""
    return runs.open_slots(fx.fx_runs(spark, sf), _defs(spark, sf)).select(
        "job_id", "max_concurrent_runs", "jobs_open")


# Fixed value: half a day after the fixture's high-water mark, with active runs on both sides.
ACTIVE_MARK_MS = fx.HWM_MS + 43_200_000


def q_refresh_active_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The active set kept by one pass and refreshed by the next, from the runs since its mark."""
    log = fx.fx_runs(spark, sf)
    first = runs.refresh_active_runs(log.where(F.col("start_time") < F.lit(ACTIVE_MARK_MS)))
    return _flat_runs(runs.refresh_active_runs(log, first, ACTIVE_MARK_MS, late_ms=0))


def q_latest_run(spark: SparkSession, sf: str) -> DataFrame:
    """O7 over all normalised runs (definition count as the per-job bound)."""
    defs = _defs(spark, sf)
    n = defs.count()
    return runs.latest_run(runs.normalize_runs(fx.fx_runs(spark, sf), defs, jobs_bound=n), jobs_bound=n)


def q_lock_status(spark: SparkSession, sf: str) -> DataFrame:
    """Lock and status of every job's latest runs, with open-slot release."""
    defs = _defs(spark, sf)
    raw = fx.fx_runs(spark, sf)
    latest = runs.latest_run(runs.normalize_runs(raw, defs))
    return runs.lock_status(latest, runs.open_slots(raw, defs))


def q_normalize_external(spark: SparkSession, sf: str) -> DataFrame:
    """The supplier feed as state rows."""
    return state.normalize_external(fx.fx_external(spark, sf))


def q_combine_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Platform state rows and external rows, UNION ALL."""
    return state.combine_runs(q_lock_status(spark, sf), q_normalize_external(spark, sf))


def pass_new_rows(spark: SparkSession, sf: str) -> DataFrame:
    """State rows of one incremental pass: selected runs -> latest -> lock/status, plus the external feed."""
    from .readiness_pass import new_state_rows
    return new_state_rows(fx.fx_defs(spark, sf), fx.fx_runs(spark, sf), fx.fx_state_old(spark, sf), fx.HWM_MS,
                          external=fx.fx_external(spark, sf))


def q_merge_state(spark: SparkSession, sf: str) -> DataFrame:
    """The old state merged with one incremental pass's rows."""
    return state.merge_state(fx.fx_state_old(spark, sf), pass_new_rows(spark, sf))


def q_state_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """The state after three versions in buckets: the feed's rows, then the platform's, then the same again."""
    from .readiness_pass import new_state_rows
    root = shared_path(spark, "state_buckets")
    state.write_state(fx.fx_state_old(spark, sf), root, 0, hwm_ms=fx.HWM_MS)
    platform = new_state_rows(fx.fx_defs(spark, sf), fx.fx_runs(spark, sf), fx.fx_state_old(spark, sf), fx.HWM_MS).checkpoint()
    for version, new in enumerate([q_normalize_external(spark, sf).checkpoint(), platform, platform], 1):
        attempt = state.new_attempt()
        state.rewrite_state(state.read_state(spark, root), new, root, version, version - 1, attempt)
        state.commit_attempt(spark, root, version, attempt, fx.AS_OF * 1000)
    return state.read_state(spark, root)


def q_feed_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The state after two versions fed from landed files: the orders' runs, then the suppliers', of which alone are read."""
    base = shared_path(spark, "feed")
    root, runs_of = f"{base}/state", fx.fx_external(spark, sf)
    state.write_state(fx.fx_state_old(spark, sf), root, 0, hwm_ms=fx.HWM_MS)
    for version, source in enumerate(["order_feed", "supplier_feed"], 1):
        runs_of.where(F.col("source") == source).write.mode("append").parquet(f"{base}/landed")
        attempt = state.new_attempt()
        new = feed.advance_feed(spark, f"{base}/landed", root, version, version - 1, attempt)
        state.rewrite_state(state.read_state(spark, root), new, root, version, version - 1, attempt)
        state.commit_attempt(spark, root, version, attempt, fx.AS_OF * 1000)
    return state.read_state(spark, root)


def q_cron_fires(spark: SparkSession, sf: str) -> DataFrame:
    """Previous / next scheduled fire of each job at the start of each of its runs, at instants of the seasons
    in which clocks change, and of schedules that do not parse."""
    return schedule.cron_fires(fx.fx_cron_requests(spark, sf))


def q_fiscal_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Fiscal period / quarter bounds at noon UTC of every order date."""
    return fiscal.fiscal_bounds(fx.fx_calendar(spark), fx.fx_order_instants(spark, sf))


def pass_state(spark: SparkSession, sf: str) -> DataFrame:
    """State after one incremental pass, written as a state version and read back (as the pass does)."""
    root = shared_path(spark, "state")
    state.write_state(q_merge_state(spark, sf), root, 1, hwm_ms=fx.AS_OF * 1000)
    return state.read_state(spark, root, 1)


def pass_itinerary(spark: SparkSession, sf: str) -> DataFrame:
    """Every orchestrated job with its schedule and fiscal bounds at the fixture instant."""
    from .readiness_pass import build_itinerary
    defs = _defs(spark, sf)
    return build_itinerary(defs, fx.fx_calendar(spark), fx.AS_OF, jobs_bound=defs.count())


def q_dependency_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every non-blank dependency item joined to its upstream's state rows."""
    st = pass_state(spark, sf)
    edges = dependencies.dependency_edges(_defs(spark, sf), st, st.count())
    return edges.select("job_id", "kind", "dependency", "source", "dep_start_time", "dep_end_time", "dep_status")


def q_readiness_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Decision rows of every job at the fixture instant."""
    st = pass_state(spark, sf)
    return readiness.readiness_rows(pass_itinerary(spark, sf), st, st.count())


def q_ready_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The jobs whose decision rows all pass."""
    return readiness.ready_jobs(q_readiness_rows(spark, sf))


def q_decision_log(spark: SparkSession, sf: str) -> DataFrame:
    """Decision rows written as the pass's log partition and read back."""
    path = shared_path(spark, "decision_log")
    logs.write_decision_log(q_readiness_rows(spark, sf), path, fx.AS_OF)
    return logs.read_decision_log(spark, path)


def q_readiness_product(spark: SparkSession, sf: str) -> DataFrame:
    """O13 in product form: every combination of each job's dependencies, through the pass's wide log."""
    st = pass_state(spark, sf)
    path = shared_path(spark, "product_log")
    logs.write_decision_log(product.readiness_product(pass_itinerary(spark, sf), st, st.count()), path, fx.AS_OF,
                            shape="product")
    return logs.read_decision_log(spark, path, shape="product")


# Fixed value: days from a run to the instant at which its job is decided again.
LATER_DAYS = 20


def q_decide_at(spark: SparkSession, sf: str) -> DataFrame:
    """Decision rows and failed ones of each job at noon UTC, some days after each of its runs, all decided in one job."""
    from .readiness_pass import decide_at
    noon = (F.floor(F.col("start_time") / 86_400_000) + LATER_DAYS) * 86_400 + 43_200
    requests = fx.fx_runs(spark, sf).select("job_id", noon.cast("long").alias("as_of")).distinct()
    rows = decide_at(spark, fx.fx_defs(spark, sf), fx.fx_calendar(spark), pass_state(spark, sf), requests)
    return rows.groupBy("job_id", "as_of").agg(F.count("*").alias("decision_rows"), F.sum("readiness").alias("failed_rows"))


def q_invocation_log(spark: SparkSession, sf: str) -> DataFrame:
    """One invocation line per run, appended to the monthly log and read back."""
    path = shared_path(spark, "invocation_log")
    logs.write_invocation_log(fx.fx_invocations(spark, sf), path)
    return logs.read_invocation_log(spark, path)


def q_invocation_compaction(spark: SparkSession, sf: str) -> DataFrame:
    """Invocation lines appended in four batches, compacted after the third and after the fourth, old batches deleted."""
    path = shared_path(spark, "invocation_months")
    lines, day = fx.fx_invocations(spark, sf), F.dayofmonth(F.timestamp_millis(F.col("start_time")))
    for k, batch in enumerate([day <= 8, (day > 8) & (day <= 16), (day > 16) & (day <= 24), day > 24], 1):
        logs.write_invocation_log(lines.where(batch), path, f"batch {k}")
        if k >= 3:
            logs.compact_invocation_log(spark, path, settle_ms=0)
    log_files.vacuum(spark, path, keep_ms=0)
    return logs.read_invocation_log(spark, path)


def q_expire_files(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of the daily files that a retention by modification time keeps; a file is last written as its day ends."""
    path = shared_path(spark, "run_files")
    (fx.fx_runs_flat(spark, sf).select("run_id", "job_id", "start_time", F.date_format(
        F.timestamp_millis(F.col("start_time")), "yyyy-MM-dd").alias("day"))
     .repartition("day").write.partitionBy("day").parquet(path))
    _stamp_files(spark, path, lambda folder: _day_end_ms(folder.split("=")[1]))
    log_files.drop_expired_files(spark, path, fx.AS_OF, FIXTURE_RETENTION_MS)
    return spark.read.schema("run_id long, job_id long, start_time long, day string").parquet(path)


def _day_end_ms(day: str) -> int:
    from datetime import UTC, datetime
    return int(datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp() + 86_400) * 1000


def _stamp_files(spark: SparkSession, path: str, time_of) -> None:
    """Give the files of each sub-folder the modification time ``time_of(folder name)``: test input only."""
    jvm = spark.sparkContext._jvm
    for name in list_dirs(spark, path):
        if "=" in name:
            hpath = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            for st in fs.listStatus(hpath):
                fs.setTimes(st.getPath(), time_of(name), -1)


# Retention used by the expire_log fixture query (10 days in ms).
FIXTURE_RETENTION_MS = 10 * 86400 * 1000


def q_expire_log(spark: SparkSession, sf: str) -> DataFrame:
    """Run-log lines kept by a 10-day retention at the fixture instant."""
    lines = fx.fx_runs_flat(spark, sf).select(
        "run_id", "job_id", F.floor(F.col("start_time") / 1000).cast("long").alias("log_time"))
    return logs.expire_log(lines, fx.AS_OF, FIXTURE_RETENTION_MS)


def q_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Every run of a landed file with broken lines: the good ones by run id, the bad ones by line and reason."""
    from .. import schemas
    base = shared_path(spark, "landed_runs")
    fx.fx_run_lines(spark, sf).write.text(f"{base}/runs")
    split = quarantine.read_checked(spark, f"{base}/runs", schemas.RAW_RUN, required=("run_id", "job_id"))
    quarantine.write_quarantine(split, f"{base}/bad", "runs", fx.AS_OF)
    good = quarantine.good_rows(split).select(
        "run_id", "job_id", "start_time", F.lit(None).cast("string").alias("line"), F.lit("good").alias("reason"))
    none = F.lit(None).cast("long")
    bad = quarantine.read_quarantine(spark, f"{base}/bad").select(
        none.alias("run_id"), none.alias("job_id"), none.alias("start_time"), "line", "reason")
    return good.unionByName(bad)


def q_classify_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Outcome of every platform run and of every external pipeline run (in factory words)."""
    db = fx.fx_runs_flat(spark, sf).select(
        F.lit("db").alias("system"), F.col("run_id").cast("string").alias("run_key"),
        F.col("life_cycle_state").alias("state"), F.col("result_state").alias("result"))
    adf = fx.fx_external(spark, sf).selectExpr(
        "'ADF' as system", "pipeline as run_key",
        """case when lock = 1 then 'InProgress' when status = 'FAILED' then 'Failed'
                when status = 'SUCCESS' then 'Succeeded' else 'Cancelled' end as state""",
        "cast(null as string) as result")
    return outcome.classify_outcome(db.unionByName(adf))


def stage_run_files(spark: SparkSession, sf: str, path: str, unit: str = "week") -> list[str]:
    """Write the run log as one JSON file per ``unit`` of start time, oldest first.

    The file source replays files in modification order, so each unit's files get an
    explicit modification time, one second apart in unit order; this staging is test input
    only (the stream itself reads any layout).
    """
    start = F.date_trunc(unit, F.timestamp_millis(F.col("start_time")))
    # one task and one file per unit, all in one write
    (fx.fx_runs(spark, sf).withColumn("unit", F.date_format(start, "yyyy-MM-dd")).repartition("unit")
     .write.mode("overwrite").partitionBy("unit").json(path))
    out = []
    jvm = spark.sparkContext._jvm
    base_ms = 1_000_000_000_000
    for i, name in enumerate(n for n in list_dirs(spark, path) if n.startswith("unit=")):
        target = f"{path}/{name}"
        hpath = jvm.org.apache.hadoop.fs.Path(target)
        fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for st in fs.listStatus(hpath):
            fs.setTimes(st.getPath(), base_ms + i * 1000, -1)
        out.append(target)
    return out


def q_readiness_stream(spark: SparkSession, sf: str) -> DataFrame:
    """State table after streaming the weekly run files through the pass (one batch per file)."""
    from ..streaming.stream import readiness_stream
    base = shared_path(spark, "readiness_stream")
    stage_run_files(spark, sf, f"{base}/runs")
    q = readiness_stream(spark, f"{base}/runs/*", fx.fx_defs(spark, sf), fx.fx_calendar(spark),
                         f"{base}/state", f"{base}/log", f"{base}/checkpoint",
                         external=fx.fx_external(spark, sf), max_files_per_trigger=1)
    q.awaitTermination()
    return state.read_state(spark, f"{base}/state")


def q_readiness_pass(spark: SparkSession, sf: str) -> DataFrame:
    """The composed pass end to end: state v0 (old state + high-water mark) -> v1 -> log -> ready jobs."""
    from .readiness_pass import readiness_pass
    base = shared_path(spark, "pass")
    state.write_state(fx.fx_state_old(spark, sf), f"{base}/state", 0, hwm_ms=fx.HWM_MS)
    result = readiness_pass(spark, fx.fx_defs(spark, sf), fx.fx_runs(spark, sf), fx.fx_calendar(spark),
                            f"{base}/state", f"{base}/log", fx.AS_OF, external=fx.fx_external(spark, sf))
    return result.ready
