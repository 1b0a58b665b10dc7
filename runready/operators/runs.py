"""Run-log operators: O4 normalize_runs, O5 select_runs, O6 open_slots, O7 latest_run, O8 lock_status,
and the active-run set behind open slots (``refresh_active_runs`` for a log holding each
run's current state, ``active_runs`` for a stream of run records).

Scale notes.  The run log is the table that grows (billions of runs, one job may own a
third of them).  No window runs over the log: every "per job" step on it is a hash
aggregate of a primitive column (``max``, ``count``) with a map-side partial, so a hot
job costs one partial row per map task.  "The rows holding the maximum" are found by
joining the log to that per-job table on (job_id, value): when the number of jobs is
known and small enough (``jobs_bound``, e.g. the definition count — normalised runs only
hold defined jobs) the per-job table is broadcast and the log is never shuffled;
otherwise the shuffle is hashed on (job_id, value), which spreads a hot job over all
reducers.  Survivors (the runs at the maximum, plus any copies of them) are
de-duplicated with a map-side partial before any per-job step on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import vocab
from ..functions.joins import broadcast_if_small, broadcast_within

# Times are epoch seconds of a long in milliseconds, far inside this bound.
TIME_BOUND = 10 ** 18


def is_terminal(state_col) -> "F.Column":
    """True iff a life-cycle state is terminal (null state -> null)."""
    c = F.col(state_col) if isinstance(state_col, str) else state_col
    return c.isin(*vocab.TERMINAL_LIFE_CYCLE_STATES)


def _floor_sec(ms_col: str):
    return F.floor(F.col(ms_col) / F.lit(1000)).cast("long")


def normalize_runs(raw_runs: DataFrame, defs: DataFrame, source: str = vocab.PLATFORM_SOURCE,
                   jobs_bound: int | None = None) -> DataFrame:
    """Raw runs (ms, nested state) -> normalised runs (s) of orchestrated jobs.

    ``status`` is the result state, or the life-cycle state while there is no result.
    The inner join to the definitions keeps runs of orchestrated jobs only and adds the
    pipeline name.  Definitions are one row per job: when ``jobs_bound`` (their row count)
    fits the broadcast budget they are broadcast, otherwise the join is left to the planner
    (AQE broadcasts or splits skewed partitions at run time).
    """
    runs = raw_runs.select(
        "job_id",
        F.col("state.life_cycle_state").alias("state"),
        F.coalesce(F.col("state.result_state"), F.col("state.life_cycle_state")).alias("status"),
        "start_time", "end_time",
    )
    names = broadcast_within(defs.select("job_id", "pipeline"), jobs_bound)
    return runs.join(names, "job_id", "inner").select(
        "job_id", F.lit(source).alias("source"), "state", "status", "pipeline",
        _floor_sec("start_time").alias("start_time"), _floor_sec("end_time").alias("end_time"),
    )


def rows_at_max(df: DataFrame, key: str, col: str, jobs_bound: int | None = None,
                null_safe: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``col`` equals the per-``key`` maximum of ``col``.

    ``null_safe``: a key whose values are all null keeps its null rows (otherwise it drops
    out, as an equi-join on null does).  ``jobs_bound``: an upper bound on the number of
    keys; the per-key table is broadcast when that many rows fit the broadcast budget.
    """
    m = broadcast_within(df.groupBy(F.col(key).alias("_k")).agg(F.max(col).alias("_m")), jobs_bound)
    eq = F.col(col).eqNullSafe(F.col("_m")) if null_safe else (F.col(col) == F.col("_m"))
    return df.join(m, (F.col(key) == F.col("_k")) & eq, "inner").drop("_k", "_m")


def _latest_per_job(raw_runs: DataFrame, jobs_bound: int | None = None) -> DataFrame:
    """Top-1 run per job by (start_time desc, run_id desc); all-null starts rank lowest."""
    at_start = rows_at_max(raw_runs, "job_id", "start_time", jobs_bound, null_safe=True)
    cols = [c for c in raw_runs.columns if c not in ("job_id", "run_id")]
    # ties on start are few; max(struct) picks the greatest run_id (partial per map task)
    top = at_start.groupBy("job_id").agg(F.max(F.struct("run_id", *cols)).alias("t"))
    return top.select("job_id", "t.*").select(*raw_runs.columns)


def carry_over_jobs(old_state: DataFrame, mode: str = "reference") -> DataFrame:
    """(job_id, bound_ms) of jobs whose latest run is polled again regardless of the high-water mark.

    ``reference``: state rows whose status is RUNNING or FAILED.  ``locked``: rows that are
    locked or FAILED (also refreshes rows stuck in another non-terminal state).
    ``bound_ms`` is the start (ms) of the run the state row records: the job's latest run
    cannot start earlier.  It is null when any of the job's carried rows has no start.
    """
    if mode == "reference":
        pred = F.col("status").isin(vocab.STATUS_RUNNING, vocab.STATUS_FAILED)
    elif mode == "locked":
        pred = (F.col("lock") == F.lit("1")) | (F.col("status") == F.lit(vocab.STATUS_FAILED))
    else:
        raise ValueError(f"unknown carry-over mode {mode!r}")
    rows = old_state.where(pred & F.col("job_id").isNotNull())
    return rows.groupBy("job_id").agg(
        F.when(F.max(F.col("start_time").isNull().cast("int")) == 0, F.min("start_time") * 1000)
        .cast("long").alias("bound_ms"))


def select_runs(raw_runs: DataFrame, old_state: DataFrame | None = None, hwm_ms: int | None = None,
                carry_over: str = "reference", jobs_bound: int | None = None) -> DataFrame:
    """The runs one pass looks at (raw shape, ``schemas.RAW_RUN``).

    * ``hwm_ms is None`` (first pass / lost checkpoint): the latest run of every job.
    * otherwise: every run started at or after the high-water mark (pushed to the scan),
      plus the latest run of each carry-over job of ``old_state`` (see ``carry_over_jobs``),
      without duplicates.

    A carried job whose recorded run is in the log needs no run older than that one: the
    scan starts at the oldest such run (pushed down).  Carried jobs whose recorded run the log
    does not hold are looked up in their whole history, so nothing is cut on trust.
    """
    if hwm_ms is None:
        return _latest_per_job(raw_runs, jobs_bound)
    recent = raw_runs.where(F.col("start_time") >= F.lit(int(hwm_ms)))
    if old_state is None:
        return recent.distinct()
    carry = broadcast_if_small(carry_over_jobs(old_state, carry_over))
    low = carry.agg(F.min("bound_ms").alias("m")).collect()[0]["m"]
    if low is None:
        carried = _latest_per_job(raw_runs.join(carry, "job_id", "left_semi"), jobs_bound)
        return recent.unionByName(carried).distinct()
    since = raw_runs.where(F.col("start_time") >= F.lit(int(low)))
    # the recorded start is in whole seconds
    at_bound = ((since["job_id"] == carry["job_id"]) & (since["start_time"] >= carry["bound_ms"])
                & (since["start_time"] < carry["bound_ms"] + 1000))
    found = broadcast_if_small(carry.join(since, at_bound, "left_semi"))
    per_job = (since["job_id"] == found["job_id"]) & (since["start_time"] >= found["bound_ms"])
    carried = _latest_per_job(since.join(found, per_job, "left_semi"), jobs_bound)
    lost = carry.join(found.select("job_id"), "job_id", "left_anti")
    if lost.limit(1).count():
        carried = carried.unionByName(_latest_per_job(raw_runs.join(lost, "job_id", "left_semi"), jobs_bound))
    return recent.unionByName(carried).distinct()


def open_slots(raw_runs: DataFrame, defs: DataFrame, jobs_bound: int | None = None) -> DataFrame:
    """(job_id, max_concurrent_runs, active_runs, jobs_open) for multi-slot jobs with an active run.

    The reference lists at most ``max_concurrent_runs`` active runs per job and subtracts
    their count, so ``jobs_open = n - least(active, n)`` is exact.  A run is active when its
    life-cycle state is not terminal; a missing state counts as active.
    """
    lc = F.col("state.life_cycle_state")
    active = (
        raw_runs.where(lc.isNull() | ~is_terminal(lc))          # pushable to the scan (nested field)
        .groupBy("job_id").agg(F.count(F.lit(1)).alias("active_runs"))
    )
    multi = broadcast_within(defs.where(F.col("max_concurrent_runs") > 1).select("job_id", "max_concurrent_runs"),
                             jobs_bound)
    return multi.join(active, "job_id", "inner").select(
        "job_id", "max_concurrent_runs", "active_runs",
        (F.col("max_concurrent_runs") - F.least(F.col("active_runs"), F.col("max_concurrent_runs")))
        .cast("int").alias("jobs_open"),
    )


def latest_run(runs: DataFrame, jobs_bound: int | None = None, running_first: bool = False) -> DataFrame:
    """Per job, the runs with the greatest end_time, then the greatest start_time.

    Same result as the reference's two max-joins: runs without an end time never win, a job
    whose winning end time has no start time drops out, exact ties are all kept and
    duplicate rows collapse.  The reference lets an older finished run beat a running one
    (end time 0); ``running_first=True`` ranks an end time of 0 above every other.  Times lie
    within ``TIME_BOUND`` of the epoch.
    """
    ended = runs.where(F.col("end_time").isNotNull())
    end = F.col("end_time")
    if running_first:
        end = F.when(end == 0, F.lit(TIME_BOUND)).otherwise(end)
    # end and start as one number: one hash-aggregated max per job and one join back, so the log is read twice
    start = F.coalesce(F.col("start_time") + F.lit(TIME_BOUND), F.lit(0))
    packed = (end.cast("decimal(19,0)") * F.lit(2 * TIME_BOUND).cast("decimal(19,0)") + start.cast("decimal(19,0)")).cast("decimal(38,0)")
    at_end = rows_at_max(ended.withColumn("_packed", packed), "job_id", "_packed", jobs_bound)
    # a job whose winning end has no start drops out; copies collapse map-side
    return at_end.where(F.col("start_time").isNotNull()).select(*runs.columns).distinct()


def lock_status(latest: DataFrame, slots: DataFrame | None = None, jobs_bound: int | None = None) -> DataFrame:
    """Latest runs -> state rows (``schemas.STATE``).

    A finished run unlocks its pipeline ("0") and reports its result; an unfinished run
    locks it ("1") and reports its life-cycle state.  A job with a free concurrent slot is
    unlocked whatever its latest run says.
    """
    term = is_terminal("state")
    rows = latest.select(
        "job_id", "source",
        F.when(term, F.lit("0")).otherwise(F.lit("1")).alias("lock"),
        F.when(term, F.col("status")).otherwise(F.col("state")).alias("status"),
        "pipeline", "start_time", "end_time",
    )
    if slots is not None:
        release = broadcast_within(
            slots.where(F.col("jobs_open") > 0).select("job_id", F.lit(True).alias("_free")).distinct(), jobs_bound)
        rows = rows.join(release, "job_id", "left").select(
            "job_id", "source",
            F.when(F.col("_free"), F.lit("0")).otherwise(F.col("lock")).alias("lock"),
            "status", "pipeline", "start_time", "end_time",
        )
    return rows.select(*schemas.STATE_COLUMNS).distinct()


def active_runs(previous: DataFrame, records: DataFrame) -> DataFrame:
    """Runs still active after applying new run records to the previous active set (raw shape).

    For each run id the newest information wins: a record of this batch over the previous
    set, and within a batch a terminal record over a non-terminal one (then the later
    start).  Runs whose winning record is terminal leave the set.  One aggregate keyed by
    run id with a map-side partial; the set holds active runs only, so it stays small.
    """
    def ranked(df: DataFrame, batch: int) -> DataFrame:
        term = F.coalesce(is_terminal(F.col("state.life_cycle_state")), F.lit(False))
        return df.select("run_id", F.struct(F.lit(batch).alias("b"), term.cast("int").alias("t"),
                                            "start_time", "job_id", "state", "end_time").alias("r"))

    latest = (ranked(previous, 0).unionByName(ranked(records, 1))
              .groupBy("run_id").agg(F.max("r").alias("r")))
    return latest.where(F.col("r.t") == 0).select(
        "run_id", "r.job_id", "r.state", "r.start_time", "r.end_time").select(*schemas.RAW_RUN.fieldNames())


def refresh_active_runs(raw_runs: DataFrame, previous: DataFrame | None = None,
                        hwm_ms: int | None = None, late_ms: int | None = None) -> DataFrame:
    """Active runs now (raw shape, one row per run id), read from a run log that holds each
    run's current state.

    By default the whole log is filtered (the state filter reaches the scan): a record may land
    long after its run started.  ``late_ms`` promises that no record lands later than that after
    its run's start; then only runs active at the previous pass and runs started since
    its high-water mark less ``late_ms`` can be active now, and the log is read from the earliest of
    those starts on (pushed to the scan; runs without a start are always read).  Copies of a run
    collapse to one row.
    """
    lc = F.col("state.life_cycle_state")
    cand = raw_runs
    if previous is not None and hwm_ms is not None and late_ms is not None:
        hwm_ms = int(hwm_ms) - int(late_ms)
        prev_low = previous.agg(F.min("start_time").alias("m")).collect()[0]["m"]
        low = min(int(hwm_ms), int(prev_low)) if prev_low is not None else int(hwm_ms)
        ids = broadcast_if_small(previous.select(F.col("run_id").alias("_prev_id")).distinct())
        cand = (raw_runs.where((F.col("start_time") >= F.lit(low)) | F.col("start_time").isNull())
                .join(ids, F.col("run_id") == F.col("_prev_id"), "left")
                .where((F.col("start_time") >= F.lit(int(hwm_ms))) | F.col("start_time").isNull()
                       | F.col("_prev_id").isNotNull())
                .drop("_prev_id"))
    act = cand.where(lc.isNull() | ~is_terminal(lc))
    one = act.groupBy("run_id").agg(F.max(F.struct("start_time", "job_id", "state", "end_time")).alias("r"))
    return one.select("run_id", "r.job_id", "r.state", "r.start_time", "r.end_time").select(
        *schemas.RAW_RUN.fieldNames())
