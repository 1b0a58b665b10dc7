"""Definitions and run-log operators on literal inputs."""

from conftest import rows
from helpers import flat_runs, norm_runs, raw_defs, raw_runs, state_df

from runready.operators import definitions, runs


def test_flatten_definitions_defaults_zones_and_overflow(spark):
    d = raw_defs(spark, [
        {"job_id": 1, "name": "a", "state": "active"},                                   # all defaults
        {"job_id": 2, "name": "b"},                                                       # no state tag: dropped
        {"job_id": 3, "name": "c", "state": "active", "tz": "Asia/Tokyo", "spec": "fy_per_d1"},
        {"job_id": 4, "name": "d", "state": "active", "tz": "Asia/Tokyo", "spec": "none"},  # Q10: Eastern
        {"job_id": 5, "name": "e", "state": "active", "tdep2": "x", "sdep": "s1", "sdep2": "s2"},
        {"job_id": 6, "name": None, "state": "active"},                                   # no name: dropped
        {"job_id": 7, "name": "schema_placeholder", "state": "paused"},
        {"job_id": 8, "name": "h", "state": "active", "mcr": 3, "onfail": "pass", "cron": "0 6 * * *"},
    ])
    out = {r["job_id"]: r for r in definitions.flatten_definitions(d).collect()}
    assert sorted(out) == [1, 3, 4, 5, 8]
    assert (out[1]["cron"], out[1]["tz"], out[1]["spec"], out[1]["onfail"]) == ("* * * * *", "UTC", "None", "hold")
    assert out[3]["tz"] == "US/Eastern" and out[4]["tz"] == "US/Eastern"
    assert out[5]["tdep"] == "x" and out[5]["sdep"] == "s1,s2" and out[5]["cdep"] is None
    assert out[8]["max_concurrent_runs"] == 3 and out[8]["onfail"] == "pass"


def test_normalize_runs_status_join_and_seconds(spark):
    d = definitions.flatten_definitions(raw_defs(spark, [{"job_id": 1, "name": "a", "state": "active"}]))
    r = raw_runs(spark, [(10, 1, "TERMINATED", "SUCCESS", 1999, 2999), (11, 1, "RUNNING", None, 5000, None),
                         (12, 9, "TERMINATED", "FAILED", 1000, 2000)])        # job 9 not orchestrated
    assert rows(runs.normalize_runs(r, d)) == [
        (1, "azure_databricks", "RUNNING", "RUNNING", "a", 5, None),
        (1, "azure_databricks", "TERMINATED", "SUCCESS", "a", 1, 2)]


def test_latest_run_reference_rules(spark):
    n = norm_runs(spark, [
        (1, "s", "TERMINATED", "SUCCESS", "a", 10, 20), (1, "s", "TERMINATED", "FAILED", "a", 10, 20),  # tie kept
        (1, "s", "TERMINATED", "SUCCESS", "a", 5, 15),
        (2, "s", "RUNNING", "RUNNING", "b", 50, 0), (2, "s", "TERMINATED", "SUCCESS", "b", 1, 9),     # Q1
        (3, "s", "RUNNING", "RUNNING", "c", 7, None),                                                  # Q2
        (4, "s", "TERMINATED", "SUCCESS", "d", None, 30), (4, "s", "TERMINATED", "SUCCESS", "d", 3, 20),
        (5, "s", "TERMINATED", "SUCCESS", "e", 1, 2), (5, "s", "TERMINATED", "SUCCESS", "e", 1, 2),    # copies
    ])
    assert rows(runs.latest_run(n)) == [
        (1, "s", "TERMINATED", "FAILED", "a", 10, 20), (1, "s", "TERMINATED", "SUCCESS", "a", 10, 20),
        (2, "s", "TERMINATED", "SUCCESS", "b", 1, 9), (5, "s", "TERMINATED", "SUCCESS", "e", 1, 2)]


def test_select_runs_full_and_incremental(spark):
    r = raw_runs(spark, [(1, 1, "TERMINATED", "SUCCESS", 100, 200), (2, 1, "TERMINATED", "SUCCESS", 300, 400),
                         (3, 1, "TERMINATED", "FAILED", 300, 350),            # same start, higher run id wins
                         (4, 2, "RUNNING", None, 50, None), (5, 3, "PENDING", None, 60, None),
                         (6, 4, "TERMINATED", "FAILED", 70, 80), (7, 5, "TERMINATED", "SUCCESS", 1000, 1100)])
    full = rows(flat_runs(runs.select_runs(r)), "run_id")
    assert full == [(3,), (4,), (5,), (6,), (7,)]
    old = state_df(spark, [(2, "p", "1", "RUNNING", "b", 0, 0), (3, "p", "1", "PENDING", "c", 0, 0),
                           (4, "p", "0", "FAILED", "d", 0, 0)])
    inc = rows(flat_runs(runs.select_runs(r, old, hwm_ms=1000)), "run_id")
    assert inc == [(4,), (6,), (7,)]                                          # Q4: PENDING not carried
    locked = rows(flat_runs(runs.select_runs(r, old, hwm_ms=1000, carry_over="locked")), "run_id")
    assert locked == [(4,), (5,), (6,), (7,)]


def test_open_slots_and_lock_status(spark):
    d = definitions.flatten_definitions(raw_defs(spark, [
        {"job_id": 1, "name": "a", "state": "active", "mcr": 3}, {"job_id": 2, "name": "b", "state": "active", "mcr": 2},
        {"job_id": 3, "name": "c", "state": "active", "mcr": 1}, {"job_id": 4, "name": "d", "state": "active", "mcr": 2}]))
    r = raw_runs(spark, [(1, 1, "RUNNING", None, 10, None), (2, 1, None, None, 11, None),       # null state is active
                         (3, 2, "RUNNING", None, 10, None), (4, 2, "PENDING", None, 12, None),
                         (5, 2, "RUNNING", None, 13, None),                                      # more than n active
                         (6, 3, "RUNNING", None, 10, None), (7, 4, "TERMINATED", "SUCCESS", 1, 2)])  # Q13: job 4 absent
    slots = runs.open_slots(r, d)
    assert rows(slots, "job_id", "jobs_open") == [(1, 1), (2, 0)]
    latest = norm_runs(spark, [(1, "s", "RUNNING", "RUNNING", "a", 10, 0), (2, "s", "PENDING", "PENDING", "b", 12, 0),
                               (3, "s", "TERMINATED", "FAILED", "c", 1, 2), (4, "s", None, None, "d", 1, 2)])
    assert rows(runs.lock_status(latest, slots), "job_id", "lock", "status") == [
        (1, "0", "RUNNING"), (2, "1", "PENDING"), (3, "0", "FAILED"), (4, "1", None)]


def test_carry_over_bound_by_state_start(spark):
    r = raw_runs(spark, [(20, 7, "TERMINATED", "SUCCESS", 10000, 11000), (21, 7, "TERMINATED", "SUCCESS", 60000, 61000),
                         (22, 7, "RUNNING", None, 55000, None), (23, 8, "TERMINATED", "FAILED", 1000, 2000),
                         (24, 8, "TERMINATED", "SUCCESS", 3000, 4000)])
    old = state_df(spark, [(7, "p", "1", "RUNNING", "g", 55, None), (8, "p", "0", "FAILED", "h", None, None)])
    assert rows(flat_runs(runs.select_runs(r, old, hwm_ms=10**9)), "run_id") == [(21,), (24,)]
    # the recorded run of job 7 is not in the log: its whole history is looked up
    gone = r.where("run_id not in (21, 22)")
    assert rows(flat_runs(runs.select_runs(gone, old, hwm_ms=10**9)), "run_id") == [(20,), (24,)]
    carry = {row.job_id: row.bound_ms for row in runs.carry_over_jobs(old).collect()}
    assert carry == {7: 55000, 8: None}


def test_refresh_active_runs_incremental_equals_full(spark):
    # current-state run log at pass 2; the set kept at pass 1 had runs 1 and 2 active
    log2 = raw_runs(spark, [(1, 1, "TERMINATED", "SUCCESS", 1000, 5000),       # finished since pass 1
                            (2, 1, "RUNNING", None, 2000, None),               # still running
                            (3, 2, "TERMINATED", "SUCCESS", 500, 900),
                            (4, 2, "PENDING", None, 9000, None),               # new since the mark
                            (4, 2, "PENDING", None, 9000, None),               # a copy
                            (5, 3, None, None, None, None)])                   # no state, no start
    prev = raw_runs(spark, [(1, 1, "RUNNING", None, 1000, None), (2, 1, "RUNNING", None, 2000, None)])
    inc = rows(runs.refresh_active_runs(log2, prev, hwm_ms=8000, late_ms=0), "run_id")
    full = rows(runs.refresh_active_runs(log2), "run_id")
    assert inc == full == [(2,), (4,), (5,)]
    # an active run that started before the mark and landed after it: found by default and within late_ms
    late = log2.unionByName(raw_runs(spark, [(6, 3, "RUNNING", None, 7000, None)]))
    assert rows(runs.refresh_active_runs(late, prev, hwm_ms=8000), "run_id") == [(2,), (4,), (5,), (6,)]
    assert rows(runs.refresh_active_runs(late, prev, hwm_ms=8000, late_ms=1000), "run_id") == [(2,), (4,), (5,), (6,)]
