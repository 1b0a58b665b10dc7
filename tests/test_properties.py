"""Property tests: latest_run equals the reference's two max-joins; select_runs equals row_number()."""

import random

from conftest import rows
from helpers import norm_runs, raw_runs
from hypothesis import given, settings
from hypothesis import strategies as st

from runready.operators import runs


def two_step_max_join(data):
    """The reference's rule in plain Python: max(end) per job, then max(start) among those rows."""
    out = set()
    for job in {r[0] for r in data}:
        mine = [r for r in data if r[0] == job]
        ends = [r[6] for r in mine if r[6] is not None]
        if not ends:
            continue
        at_end = [r for r in mine if r[6] == max(ends)]
        starts = [r[5] for r in at_end if r[5] is not None]
        if not starts:
            continue
        out |= {r for r in at_end if r[5] == max(starts)}
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@settings(max_examples=10, deadline=None)
@given(st.integers(min_value=0, max_value=10**6), st.booleans())
def test_latest_run_equals_two_step_max_join(spark, seed, bounded):
    rnd = random.Random(seed)
    data = [(rnd.randint(1, 6), "s", rnd.choice(["TERMINATED", "RUNNING", None]), rnd.choice(["SUCCESS", "FAILED", None]),
             "p", rnd.choice([None, 1, 2, 3, 4]), rnd.choice([None, 0, 5, 6, 7])) for _ in range(rnd.randint(0, 60))]
    data += data[: rnd.randint(0, 10)]                      # exact copies
    got = rows(runs.latest_run(norm_runs(spark, data), jobs_bound=10 if bounded else None))
    assert got == two_step_max_join(data)


@settings(max_examples=8, deadline=None)
@given(st.integers(min_value=0, max_value=10**6))
def test_full_selection_is_row_number_one(spark, seed):
    rnd = random.Random(seed)
    data = [(i, rnd.randint(1, 5), rnd.choice(["TERMINATED", "RUNNING"]), None, rnd.choice([None, 10, 20, 30]), None)
            for i in range(rnd.randint(1, 40))]
    got = rows(runs.select_runs(raw_runs(spark, data)).select("job_id", "run_id"))
    best = {}
    for r in data:                      # order: start desc nulls last, run_id desc
        key = (r[4] is not None, r[4] or 0, r[0])
        if r[1] not in best or key > best[r[1]][0]:
            best[r[1]] = (key, r[0])
    assert got == sorted((j, v[1]) for j, v in best.items())


def test_running_first_option(spark):
    data = [(1, "s", "RUNNING", "RUNNING", "a", 50, 0), (1, "s", "TERMINATED", "SUCCESS", "a", 10, 20)]
    assert rows(runs.latest_run(norm_runs(spark, data)))[0][5] == 10                      # Q1: reference rule
    assert rows(runs.latest_run(norm_runs(spark, data), running_first=True))[0][5] == 50


@settings(max_examples=6, deadline=None)
@given(st.integers(min_value=0, max_value=10**6))
def test_full_then_latest_equals_incremental_from_zero(spark, seed):
    """For finished, non-overlapping runs: O7(O5 full) == O7(O5 incremental with hwm 0)."""
    from helpers import raw_defs
    from runready.operators import definitions
    rnd = random.Random(seed)
    data, t = [], {}
    for i in range(rnd.randint(1, 40)):
        job = rnd.randint(1, 5)
        start = t.get(job, 0) + rnd.randint(1, 5) * 1000
        end = start + rnd.randint(0, 4) * 1000
        t[job] = end
        data.append((i, job, "TERMINATED", rnd.choice(["SUCCESS", "FAILED"]), start, end))
    log = raw_runs(spark, data)
    defs = definitions.flatten_definitions(raw_defs(spark, [{"job_id": j, "name": f"j{j}", "state": "active"}
                                                            for j in range(1, 6)]))
    full = runs.latest_run(runs.normalize_runs(runs.select_runs(log), defs))
    inc = runs.latest_run(runs.normalize_runs(runs.select_runs(log, hwm_ms=0), defs))
    assert rows(full) == rows(inc)


def _random_state(rnd, n, names, dup=False):
    out = []
    for i in range(n):
        out.append((rnd.choice([1, 2, None]), rnd.choice(["p", "q"]), rnd.choice(["0", "1", None]),
                    rnd.choice(["SUCCESS", "FAILED", None]), rnd.choice(names), rnd.choice([None, 5, 9]),
                    rnd.choice([None, 7, 11])))
    if dup and out:
        out += [out[0]] * rnd.randint(1, 6)                     # copies of one key
    return out


@settings(max_examples=8, deadline=None)
@given(st.integers(min_value=0, max_value=10**6))
def test_merge_properties(spark, seed):
    from helpers import state_df

    from runready.operators import state
    rnd = random.Random(seed)
    names = ["a", "b", "c", "d", None]
    # unique keys: merging the same new rows twice changes nothing
    keys = rnd.sample([(n, s) for n in "abcdefg" for s in "pq"], 8)
    uniq_old = [(1, s, "0", "SUCCESS", n, 1, 2) for n, s in keys[:5]]
    uniq_new = [(2, s, rnd.choice(["1", None]), None, n, 3, None) for n, s in keys[3:]]
    a, b = state_df(spark, uniq_old), state_df(spark, uniq_new)
    once = state.merge_state(a, b)
    assert rows(state.merge_state(once, b)) == rows(once)
    # any keys, with copies: one row per key, a fixed point of the merge
    old = state_df(spark, _random_state(rnd, rnd.randint(0, 12), names))
    new = state_df(spark, _random_state(rnd, rnd.randint(0, 12), names, dup=True))
    merged = state.merge_state(old, new)
    assert merged.select("pipeline", "source").distinct().count() == merged.count()
    assert rows(state.merge_state(merged, new)) == rows(merged)
