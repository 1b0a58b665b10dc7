"""Plan shape: no Python evaluation, no cartesian products, filters reach the scan, no window on job_id."""

import tempfile

from helpers import raw_runs

from runready.operators import runs
from runready.plans import catalog
from runready.sources import readers

SMOKE = "/root/testdata/sf0.001"
SCALE = "/root/testdata/sf0.1"
BAD = ["BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_readiness_plans_stay_in_the_jvm(spark):
    """SURVEY 5.5: at sf0.1, no Python evaluation and no cartesian product in any readiness plan."""
    for q in (catalog.q_readiness_rows, catalog.q_cron_fires, catalog.q_merge_state, catalog.q_fiscal_bounds,
              catalog.q_readiness_pass):
        plan = _plan(q(spark, SCALE))
        for bad in BAD:
            assert bad not in plan, (q.__name__, bad)


def test_latest_run_uses_aggregates_not_windows(spark):
    plan = _plan(catalog.q_latest_run(spark, SMOKE))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_high_water_mark_is_pushed_to_the_scan(spark):
    path = tempfile.mkdtemp(prefix="rr-runs-")
    raw_runs(spark, [(1, 1, "TERMINATED", "SUCCESS", 1000, 2000)]).write.mode("overwrite").parquet(path)
    df = runs.select_runs(readers.read_runs(spark, path, fmt="parquet"), hwm_ms=5000)
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(start_time), GreaterThanOrEqual(start_time,5000)]" in plan


def test_active_run_filter_is_pushed_to_the_scan(spark):
    from helpers import raw_defs
    from runready.operators import definitions
    path = tempfile.mkdtemp(prefix="rr-runs-")
    raw_runs(spark, [(1, 1, "RUNNING", None, 1000, None)]).write.mode("overwrite").parquet(path)
    defs = definitions.flatten_definitions(raw_defs(spark, [{"job_id": 1, "name": "a", "state": "active", "mcr": 2}]))
    plan = _plan(runs.open_slots(readers.read_runs(spark, path, fmt="parquet"), defs))
    assert "Or(IsNull(state.life_cycle_state),Not(In(state.life_cycle_state" in plan


def test_damaged_checkpoint_is_an_error_and_a_missing_one_a_full_load(spark, tmp_path):
    import pytest
    from helpers import state_df
    from runready.operators import state
    root = str(tmp_path / "state")
    state.write_state(state_df(spark, [(1, "p", "0", "SUCCESS", "a", 1, 2)]), root, 1, hwm_ms=5)
    ck = tmp_path / "state" / "v=000000001" / "checkpoint"
    for f in ck.glob("part-*"):
        f.write_bytes(b"not parquet")
    with pytest.raises(Exception):
        state.read_checkpoint(spark, root)
    assert state.read_checkpoint(spark, str(tmp_path / "none")) is None


def test_external_feed_read_retries_then_raises(spark, tmp_path):
    import pytest
    with pytest.raises(Exception):
        readers.read_external(spark, str(tmp_path / "missing" / "*"), attempts=2, wait_s=0)


def test_carry_over_bound_is_pushed_to_the_scan(spark):
    from helpers import state_df
    path = tempfile.mkdtemp(prefix="rr-runs-")
    raw_runs(spark, [(1, 1, "TERMINATED", "SUCCESS", 1000, 2000)]).write.mode("overwrite").parquet(path)
    old = state_df(spark, [(1, "p", "1", "RUNNING", "a", 7, None)])
    plan = _plan(runs.select_runs(readers.read_runs(spark, path, fmt="parquet"), old, hwm_ms=9000))
    assert "GreaterThanOrEqual(start_time,7000)" in plan and "GreaterThanOrEqual(start_time,9000)" in plan


def test_hot_job_latest_run_is_exact_and_not_shuffled_by_job(spark):
    """One job owns a third of the log: the per-job max is a partial aggregate and the
    join back is a broadcast, so the log is never hash-partitioned by job_id alone."""
    from pyspark.sql import functions as F
    n = 30000
    log = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1000 + 100).alias("job_id"),
        F.lit("s").alias("source"), F.lit("TERMINATED").alias("state"), F.lit("SUCCESS").alias("status"),
        F.lit("p").alias("pipeline"), (F.col("id") * 10).alias("start_time"), (F.col("id") * 10 + 5).alias("end_time"))
    latest = runs.latest_run(log, jobs_bound=1001)
    plan = _plan(latest)
    lines = plan.splitlines()
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan
    assert sum("Range (" in ln for ln in lines) == 2                       # the log is read twice
    for i, ln in enumerate(lines):                                         # job_id shuffles carry partials only
        if "Exchange hashpartitioning(job_id" in ln:
            assert "partial_max" in lines[i + 1] or "HashAggregate(keys=[" in lines[i + 1], ln
    got = {r.job_id: r.start_time for r in latest.collect()}
    assert got[7] == (n - 3) * 10 and len(got) == 1001


def test_ready_list_reads_only_its_log_partition(spark, tmp_path):
    from pyspark.sql import functions as F

    from runready.operators import logs, readiness
    path = str(tmp_path / "log")
    row = (1706702400, 1, "p", "active", "own", 0, None, "UTC", "None", "hold", 10, 0, 20, 30, 1, 2, 3, 4,
           None, "src", None, None, None, 0)
    decisions = spark.createDataFrame([row], T_DECISIONS())
    for t in (1706700000, 1706702400):
        logs.write_decision_log(decisions, path, t)
    logged = logs.read_decision_log(spark, path).where(F.col("log_time") == F.lit(1706702400))
    plan = _plan(readiness.ready_jobs(logged))
    assert "PartitionFilters: [isnotnull(log_time" in plan and "(log_time#" in plan


def T_DECISIONS():
    from pyspark.sql import types as T

    from runready.operators import logs
    return T.StructType(logs.DECISION_LOG.fields[:-2])


def test_itinerary_of_one_file_is_spread(spark):
    """Definitions that are read as one partition are decided by all cores."""
    from runready.operators import definitions
    from runready.plans.readiness_pass import build_itinerary
    from runready.sources import fixtures as fx
    defs = definitions.flatten_definitions(fx.fx_defs(spark, SMOKE)).coalesce(1)
    itin = build_itinerary(defs, fx.fx_calendar(spark), fx.AS_OF, jobs_bound=defs.count())
    assert itin.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert itin.count() == defs.count()
