"""The readiness pass: inputs -> state v+1 -> decision rows -> log -> ready jobs.

read(defs, runs, external, calendar, state@v)
  -> flatten_definitions -> select_runs (high-water mark of v, carry-over of v)
  -> normalize_runs -> latest_run -> lock_status (open-slot release)
  -> combine with the external feed -> merge_state -> write state@v+1
  -> read state@v+1 back (cuts the lineage; the write is on shared storage)
  -> cron_fires + fiscal_bounds -> itinerary -> readiness_rows
  -> decision log partition for this instant -> commit v+1 (checkpoint, written last)
  -> ready_jobs read from the log partition.

Only single values reach the driver: the definition count, the checkpoint, the four
fiscal bounds and the scan bounds of the carry-over and active-run reads.  The instant is
an argument, so a pass is deterministic and can be replayed: state versions and the log
partition are overwritten, not appended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..session import ensure_checkpoint_dir
from ..functions.joins import broadcast_within, spread
from ..sources import feed
from ..operators import definitions, dependencies, fiscal, logs, product, readiness, run_log, runs, schedule, state


@dataclass
class PassResult:
    version: int
    as_of: int
    hwm_ms: int | None
    state: DataFrame
    decisions: DataFrame
    ready: DataFrame


def new_state_rows(raw_defs: DataFrame, raw_runs: DataFrame, old_state: DataFrame, hwm_ms: int | None,
                   external: DataFrame | None = None, selected: DataFrame | None = None,
                   slot_runs: DataFrame | None = None, release_slots: bool = True,
                   carry_over: str = "reference", defs: DataFrame | None = None,
                   n_jobs: int | None = None) -> DataFrame:
    """State rows one pass contributes: latest selected platform runs plus the external feed.

    The definitions are counted once; that count bounds every per-job table of the pass
    (only runs of defined jobs are kept — the others would be dropped by the join to the
    definitions anyway), which decides whether those tables are broadcast.
    """
    if defs is None:
        defs = definitions.flatten_definitions(raw_defs)
    if n_jobs is None:
        n_jobs = defs.count()
    if selected is None:
        # small (runs since the mark and one per carried job) and read twice: stored, so that it is planned and run once
        ensure_checkpoint_dir(raw_runs.sparkSession)
        selected = select_defined_runs(raw_runs, defs, n_jobs, old_state, hwm_ms, carry_over).checkpoint()
    latest = runs.latest_run(runs.normalize_runs(selected, defs, jobs_bound=n_jobs), jobs_bound=n_jobs)
    slots = (runs.open_slots(slot_runs if slot_runs is not None else raw_runs, defs, jobs_bound=n_jobs)
             if release_slots else None)
    parts = [runs.lock_status(latest, slots, jobs_bound=n_jobs)]
    if external is not None:
        parts.append(state.normalize_external(external))
    return state.combine_runs(*parts)


def select_defined_runs(raw_runs: DataFrame, defs: DataFrame, n_jobs: int, old_state: DataFrame,
                        hwm_ms: int | None, carry_over: str = "reference") -> DataFrame:
    """``select_runs`` over the runs of defined jobs (the others would be dropped later anyway).

    A log with start dates (``run_log.read_run_log``) is read by ``run_log.select_landed``.
    """
    ids = broadcast_within(defs.select("job_id"), n_jobs)
    # rows of retired jobs and of external feeds carry nothing over either; the feeds' constant job id goes by a
    # filter, as a join on a constant has no key to hash
    own = old_state.where(F.col("job_id") != F.lit(vocab.EXTERNAL_JOB_ID)).join(ids, "job_id", "left_semi")
    select = run_log.select_landed if run_log.DAY in raw_runs.columns else runs.select_runs
    return select(raw_runs.join(ids, "job_id", "left_semi"), own, hwm_ms, carry_over, jobs_bound=n_jobs)


def build_itinerary(defs: DataFrame, calendar: DataFrame, as_of: int, day_rule: str = "and",
                    jobs_bound: int | None = None) -> DataFrame:
    """Every job with its fire times and fiscal bounds at ``as_of`` (one row per job).

    The jobs are spread over all cores, as the decision rows are worked out where a job lies.
    """
    fires = schedule.cron_fires(defs, as_of=as_of, day_rule=day_rule)
    bounds = fiscal.fiscal_bounds_at(calendar, as_of)
    return dependencies.itinerary(spread(defs, "job_id"), fires, bounds, as_of=as_of, jobs_bound=jobs_bound)


def decide(spark: SparkSession, raw_defs: DataFrame, calendar: DataFrame, current_state: DataFrame, as_of: int,
           day_rule: str = "and", defs: DataFrame | None = None) -> DataFrame:
    """Decision rows of every orchestrated job at ``as_of`` against ``current_state``."""
    if defs is None:
        defs = definitions.flatten_definitions(raw_defs)
    return readiness.readiness_rows(build_itinerary(defs, calendar, as_of, day_rule), current_state)


def decide_at(spark: SparkSession, raw_defs: DataFrame, calendar: DataFrame, current_state: DataFrame,
              requests: DataFrame, day_rule: str = "and") -> DataFrame:
    """Decision rows for any number of (job_id, as_of) requests against one state.

    The requests join the definitions on job_id (an equi-join, one itinerary row per
    request); fire times are computed per distinct (cron, tz, as_of) and fiscal bounds per
    distinct instant, then joined on those keys.  Many requests share an instant, so the
    requests, the two lookup tables and the itinerary are materialised with reliable
    ``checkpoint()`` calls (in ``spark.checkpoint.dir``): the tables' exact sizes then decide
    between broadcast and a hot-key split (``lookup_join``), and nothing is recomputed.
    ``ready_jobs`` of the result gives the (job_id, as_of) pairs that are ready.
    """
    ensure_checkpoint_dir(spark)
    defs = definitions.flatten_definitions(raw_defs)
    req = requests.select("job_id", F.col("as_of").cast("long").alias("as_of")).distinct()
    jobs = defs.join(req, "job_id", "inner").checkpoint()
    fires = schedule.cron_fires(jobs, day_rule=day_rule).checkpoint()
    bounds = fiscal.fiscal_bounds(calendar, req.select("as_of")).checkpoint()
    itin = dependencies.itinerary(jobs, fires, bounds, fires_rows=fires.count(),
                                  bounds_rows=bounds.count()).checkpoint()
    return readiness.readiness_rows(itin, current_state)


def readiness_pass(spark: SparkSession, raw_defs: DataFrame, raw_runs: DataFrame, calendar: DataFrame,
                   state_root: str, log_path: str, as_of: int, external: DataFrame | None = None,
                   version: int | None = None, initial_state: DataFrame | None = None,
                   selected: DataFrame | None = None, slot_runs: DataFrame | None = None,
                   release_slots: bool = True, carry_over: str = "reference", day_rule: str = "and",
                   log_format: str = "csv", extras: dict[str, DataFrame] | None = None,
                   retention_ms: int | None = vocab.LOG_RETENTION_MS, newest_wins: bool = False,
                   stream_batch: tuple[str, int] | None = None, keep_versions: int | None = 100,
                   late_ms: int | None = None, log_shape: str = "factored", attempt: str | None = None,
                   exclusive: bool | None = None, max_redos: int = 5,
                   state_buckets: int = state.STATE_BUCKETS, external_path: str | None = None) -> PassResult:
    """Run one pass at ``as_of`` (epoch s) and write state version ``version`` (default: latest + 1).

    Of passes that start from the same version one commits the next; the others are redone on it,
    ``max_redos`` times at most, and a redone pass replaces its own log partition.  A pass with a given ``version``
    is a replay and replaces that version, unless ``exclusive`` says otherwise: then ``VersionTaken`` is raised.
    ``attempt`` names the folders of the pass (default: a new name); ``state_buckets``: see ``rewrite_state``.
    ``external_path`` names the feed's files in place of ``external``: a pass then reads those that landed since its base version.

    ``selected`` replaces the run selection (the stream passes its micro-batch),
    ``slot_runs`` the runs counted for open slots, and ``extras`` are tables committed with
    the version.  After the commit, log partitions at or before ``as_of - retention_ms``
    are dropped (``None`` keeps them all).  ``newest_wins``: see ``merge_state``.  ``stream_batch``
    (stream, batch id) is recorded with the version; the ``keep_versions`` newest versions
    are kept (``None``: all).  ``late_ms``: see ``refresh_active_runs``.  ``log_shape``: "factored"
    decision rows, or "product" for the wide rows of ``readiness_product``, in a log of its own; both give the same ready jobs.  Runs that start after
    ``as_of`` are not looked at, so a replay at a past instant sees the log of that instant.
    """
    raw_runs = raw_runs.where(F.col("start_time").isNull() | (F.col("start_time") < F.lit((int(as_of) + 1) * 1000)))
    redone = 0
    while True:
        try:
            result = _pass_once(
                spark, raw_defs, raw_runs, calendar, state_root, log_path, int(as_of), external,
                version if version is not None else (state.latest_version(spark, state_root) or 0) + 1,
                attempt or state.new_attempt(), version is None if exclusive is None else exclusive, initial_state,
                selected, slot_runs, release_slots, carry_over, day_rule, log_format, extras, newest_wins, stream_batch,
                late_ms, log_shape, state_buckets, external_path)
            break
        except state.VersionTaken:
            redone += 1
            if version is not None or redone > max_redos:
                raise
    if keep_versions is not None:
        state.prune_versions(spark, state_root, keep_versions)
    if retention_ms is not None:
        logs.drop_expired_partitions(spark, log_path, as_of, retention_ms)
    return result


def _pass_once(spark, raw_defs, raw_runs, calendar, state_root, log_path, as_of, external, version, attempt, exclusive,
               initial_state, selected, slot_runs, release_slots, carry_over, day_rule, log_format, extras, newest_wins,
               stream_batch, late_ms, log_shape, state_buckets, external_path) -> PassResult:
    """One attempt at ``version``; see ``readiness_pass``."""
    base = state.latest_version(spark, state_root, below=version)
    batches = state.read_batches(spark, state_root, base) if base is not None else {}
    if stream_batch is not None:
        batches[stream_batch[0]] = stream_batch[1]
    if base is not None:
        old = state.read_state(spark, state_root, base)
        # the mark is only needed to select runs or to refresh the active set
        needs_mark = selected is None or (release_slots and slot_runs is None)
        hwm = state.read_checkpoint(spark, state_root, base) if needs_mark else None
    else:
        old = initial_state if initial_state is not None else spark.createDataFrame([], state.schemas.STATE)
        hwm = None
    # open slots count the runs active now; the set is kept with each version and refreshed
    # from the previous one (see runs.refresh_active_runs), so the log is not read whole
    if release_slots and slot_runs is None:
        prev_active = None
        if base is not None and hwm is not None and state.has_extra(spark, state_root, base, state.ACTIVE_RUNS):
            prev_active = state.read_extra(spark, state_root, base, state.ACTIVE_RUNS, state.schemas.RAW_RUN)
        slot_runs = state.write_extra(runs.refresh_active_runs(raw_runs, prev_active, hwm, late_ms), state_root, version,
                                      state.ACTIVE_RUNS, attempt)
    if external_path is not None:
        external = feed.advance_feed(spark, external_path, state_root, version, base, attempt)
    # the definitions are read once per pass and kept for its six uses (count, run filter,
    # names, open slots, schedules, itinerary); a file of them may be one task to read, so they are spread
    defs = definitions.flatten_definitions(spread(raw_defs, "job_id")).persist()
    kept = [defs]
    try:
        n_jobs = defs.count()
        if selected is None:
            # the selection is small (runs since the mark + one per carried job, or one per
            # job on a full load) and is read twice by latest_run: keep it for the pass
            selected = select_defined_runs(raw_runs, defs, n_jobs, old, hwm, carry_over).persist()
            kept.append(selected)
        rows = new_state_rows(raw_defs, raw_runs, old, hwm, external, selected, slot_runs, release_slots, carry_over,
                              defs=defs, n_jobs=n_jobs)
        # the version is committed only after its decision log is written, so a failure
        # anywhere in the pass leaves it uncommitted and a replay redoes the whole pass
        current = state.rewrite_state(old, rows, state_root, version, base, attempt, newest_wins,
                                      state_buckets)
        for name, table in (extras or {}).items():
            state.write_extra(table, state_root, version, name, attempt)
        # the itinerary (one row per job, with its cron search) feeds both the own rows and
        # the edges; it is computed once and kept until the log is written
        itin = build_itinerary(defs, calendar, as_of, day_rule, jobs_bound=n_jobs).persist()
        try:
            # the state was just written: its row count (Parquet metadata) bounds the lookups
            n_state = current.count()
            rows_of = (product.readiness_product(itin, current, n_state) if log_shape == "product" else
                       readiness.readiness_rows(itin, current, n_state, jobs_bound=n_jobs))
            logs.write_decision_log(rows_of, log_path, as_of, log_format, log_shape)
        finally:
            itin.unpersist()
        state.commit_attempt(spark, state_root, version, attempt, int(as_of) * 1000, batches, exclusive)
    finally:
        for df in kept:
            df.unpersist()
    logged = logs.read_decision_log(spark, log_path, log_format, as_of=as_of, shape=log_shape)
    return PassResult(version, int(as_of), hwm, current, logged, readiness.ready_jobs(logged))
