"""External feed, union and merge; versioned storage."""

import os
import tempfile

import pytest
from conftest import rows
from helpers import state_df

from runready.operators import state


def test_normalize_external_lock_string_and_times(spark):
    ext = spark.createDataFrame([("f", 1, "SUCCESS", "x", 1706600000, "2024-01-30 07:33:20")],
                                "source string, lock int, status string, pipeline string, start_time long, end_time string")
    out = state.normalize_external(ext).collect()[0]
    assert out["lock"] == "1" and out["job_id"] == 99999999999999
    assert out["start_time"] == 1706600000 and out["end_time"] == 1706600000
    u = state.combine_runs(state_df(spark, [(1, "p", "0", "SUCCESS", "a", 1, 2)]), state.normalize_external(ext))
    assert dict(u.dtypes)["lock"] == "string"                                   # Q8


def test_merge_state_is_one_row_per_key(spark):
    old = state_df(spark, [(1, "p", "0", "SUCCESS", "a", 10, 20), (2, "p", "0", "FAILED", "b", 10, 20),
                           (3, "p", "0", "SUCCESS", "c", 10, 20), (3, "p", "1", "RUNNING", "c", 11, None),
                           (9, "q", "0", "SUCCESS", "b", 5, 6)])
    new = state_df(spark, [(2, "p", "1", None, "b", 30, None), (4, "p", "0", "SUCCESS", "d", 1, 2),
                           (3, "p", "0", "SUCCESS", "c", 40, 41), (3, "p", "0", "FAILED", "c", 40, 42)])
    out = rows(state.merge_state(old, new), "pipeline", "source", "lock", "status", "start_time", "end_time")
    assert out == [
        ("a", "p", "0", "SUCCESS", 10, 20),
        ("b", "p", "1", "FAILED", 30, 20),            # Q5: null in new keeps old; new wins even if older
        ("b", "q", "0", "SUCCESS", 5, 6),             # same name, other source: untouched
        ("c", "p", "0", "FAILED", 40, 42),            # a repeated key: its last row
        ("d", "p", "0", "SUCCESS", 1, 2)]


def test_merge_is_idempotent_for_unique_keys(spark):
    old = state_df(spark, [(1, "p", "0", "SUCCESS", "a", 10, 20), (2, "p", "0", "FAILED", "b", 10, 20)])
    new = state_df(spark, [(2, "p", "1", None, "b", 30, None), (4, "p", "0", "SUCCESS", "d", 1, 2)])
    once = state.merge_state(old, new)
    assert rows(state.merge_state(once, new)) == rows(once)


def test_versioned_state_roundtrip(spark):
    root = tempfile.mkdtemp(prefix="rr-state-")
    assert state.state_versions(spark, root) == [] and state.read_checkpoint(spark, root) is None
    s1 = state_df(spark, [(1, "p", "0", "SUCCESS", "a", 10, 20)])
    state.write_state(s1, root, 1, hwm_ms=123000)
    state.write_state(s1, root, 1, hwm_ms=123000)                 # replay overwrites
    assert state.state_versions(spark, root) == [1]
    assert state.read_checkpoint(spark, root) == 123000
    assert rows(state.read_state(spark, root)) == rows(s1)


def test_import_state_csv_keeps_float_written_ints(spark, tmp_path):
    p = tmp_path / "state.csv"
    p.write_text("job_id,source,lock,status,pipeline,start_time,end_time\n"
                 "1,p,0,SUCCESS,a,1702926855.0,\n2,p,1,RUNNING,b,1702926900.0,1702927000.0\n")
    out = rows(state.import_state_csv(spark, str(p)), "job_id", "start_time", "end_time")
    assert out == [(1, 1702926855, None), (2, 1702926900, 1702927000)]


def test_merge_keeps_its_size_over_equal_passes(spark):
    """A feed that keeps history, and null keys, add no rows from pass to pass."""
    feed = state_df(spark, [(9, "f", None if i % 2 else "1", "SUCCESS", "hot", 100 + i, None) for i in range(12)]
                    + [(6, "p", "0", "SUCCESS", None, 3, 4), (6, None, "0", "SUCCESS", "x", 3, 4)])
    now = state_df(spark, [(3, "f", "0", "SUCCESS", "hot", 1, 2)])
    sizes = []
    for _ in range(5):
        now = state.merge_state(now, feed)
        sizes.append(now.count())
    assert sizes == [3] * 5
    hot = now.where("pipeline = 'hot'").collect()[0]
    assert (hot.start_time, hot.end_time, hot.lock) == (111, 2, "1")


def test_merge_newest_wins_whatever_the_side(spark):
    old = state_df(spark, [(1, "p", "0", "SUCCESS", "a", 200, 300), (1, "p", "1", "RUNNING", "b", 200, 0)])
    late = state_df(spark, [(1, "p", "0", "FAILED", "a", 100, 150), (1, "p", "0", "SUCCESS", "b", 200, 260)])
    out = rows(state.merge_state(old, late, newest_wins=True), "pipeline", "lock", "status", "start_time", "end_time")
    assert out == [("a", "0", "SUCCESS", 200, 300), ("b", "0", "SUCCESS", 200, 260)]


def test_latest_version_and_pruning(spark):
    root = tempfile.mkdtemp(prefix="rr-state-")
    s1 = state_df(spark, [(1, "p", "0", "SUCCESS", "a", 10, 20)])
    for v in (1, 2, 4):
        state.write_state(s1, root, v, hwm_ms=v)
    state.write_state(s1, root, 5, commit=False)
    assert state.latest_version(spark, root) == 4 and state.latest_version(spark, root, below=4) == 2
    assert state.prune_versions(spark, root, keep=2) == [1]
    assert state.state_versions(spark, root) == [2, 4] and state.read_checkpoint(spark, root) == 4


def _files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")}


def _add(spark, root, version, new, **options):
    attempt = state.new_attempt()
    base = state.latest_version(spark, root, below=version)
    state.rewrite_state(state.read_state(spark, root, base), new, root, version, base, attempt, **options)
    state.commit_attempt(spark, root, version, attempt, version)


def test_only_buckets_with_changed_rows_are_written(spark):
    """The rows are those of merge_state; buckets that no change falls into keep their files, null keys and all."""
    root = tempfile.mkdtemp(prefix="rr-state-")
    old = state_df(spark, [(i, "p", "0", "SUCCESS", f"j{i}", 10, 20) for i in range(200)]
                   + [(7, None, "0", "SUCCESS", "x", 1, 2), (8, "p", None, None, None, None, None)])
    state.write_state(old, root, 0)
    _add(spark, root, 1, old.limit(0), buckets=8)                        # a table without buckets is laid out whole
    first = _files(root)
    assert len({os.path.dirname(f) for f in first}) == 8 and rows(state.read_state(spark, root)) == rows(old)
    new = state_df(spark, [(3, "p", "1", None, "j3", 30, None), (8, "p", "1", "FAILED", None, 5, 6)])
    _add(spark, root, 2, new)
    added = _files(root) - first
    assert first <= _files(root) and 1 <= len({os.path.dirname(f) for f in added}) <= 2
    want = rows(state.merge_state(old, new))
    assert rows(state.read_state(spark, root)) == want
    assert set(state.read_state(spark, root).inputFiles()) == {
        f"file://{f}" for f in first | added if os.path.basename(os.path.dirname(f))
        not in {os.path.basename(os.path.dirname(a)) for a in added} or f in added}
    before = _files(root)
    _add(spark, root, 3, new)                                             # the same again: nothing to write
    assert _files(root) == before and rows(state.read_state(spark, root)) == want
    assert rows(state.read_state(spark, root, 1)) == rows(old)            # earlier versions stay readable
    late = state_df(spark, [(3, "p", "0", "LATE", "j3", 1, 2)])
    _add(spark, root, 4, late, newest_wins=True)
    assert rows(state.read_state(spark, root)) == rows(state.merge_state(state.read_state(spark, root, 3), late, True))


def test_pruning_keeps_the_files_that_kept_versions_name(spark):
    root = tempfile.mkdtemp(prefix="rr-state-")
    every = state_df(spark, [(i, "p", "0", "SUCCESS", f"j{i}", 10, 20) for i in range(60)])
    _add(spark, root, 1, every, buckets=4)
    for v in range(2, 6):
        _add(spark, root, v, state_df(spark, [(1, "p", "0", f"S{v}", "j1", 10 + v, 20 + v)]))
    want = rows(state.read_state(spark, root))
    assert state.prune_versions(spark, root, keep=2) == [1, 2, 3]
    assert rows(state.read_state(spark, root)) == want and state.read_state(spark, root, 4).count() == 60
    assert sorted(os.listdir(f"{root}/data"))[0].startswith("written=000000001")
    assert len(os.listdir(f"{root}/data")) == 3                            # versions 2 and 3 left no file that is named
    assert len(_files(root)) == 3 + 2


def test_one_of_two_passes_on_a_base_commits(spark):
    root = tempfile.mkdtemp(prefix="rr-state-")
    _add(spark, root, 1, state_df(spark, [(1, "p", "0", "SUCCESS", "a", 10, 20)]))
    tries = {}
    for name in ("b", "c"):                                                # both read version 1
        tries[name] = state.new_attempt()
        new = state_df(spark, [(2, "p", "0", "SUCCESS", name, 10, 20)])
        state.rewrite_state(state.read_state(spark, root), new, root, 2, 1, tries[name])
    state.commit_attempt(spark, root, 2, tries["c"], 5)
    with pytest.raises(state.VersionTaken):
        state.commit_attempt(spark, root, 2, tries["b"], 6)
    assert state.read_checkpoint(spark, root) == 5
    assert rows(state.read_state(spark, root), "pipeline") == [("a",), ("c",)]
    state.commit_attempt(spark, root, 2, tries["b"], 7, exclusive=False)   # a replay replaces the version
    assert rows(state.read_state(spark, root), "pipeline") == [("a",), ("b",)]
    state.write_state(state.read_state(spark, root, 1), root, 3)
    with pytest.raises(state.VersionTaken):                                # so does a version without buckets
        state.commit_attempt(spark, root, 3, state.new_attempt(), 8)


def test_a_pass_that_loses_its_version_is_redone_on_the_new_base(spark, monkeypatch):
    from runready import schemas
    from runready.plans.readiness_pass import readiness_pass
    from runready.sources import fixtures as fx
    base = tempfile.mkdtemp(prefix="rr-state-")
    root, defs = f"{base}/state", spark.createDataFrame([], schemas.DEFINITION)
    runs, cal = spark.createDataFrame([], schemas.RAW_RUN), fx.fx_calendar(spark)

    def feed(name):
        return spark.createDataFrame([("feed", 0, "SUCCESS", name, 1706600000, 1706600900)],
                                     "source string, lock int, status string, pipeline string, start_time long, end_time long")

    commit, raced = state.commit_attempt, []

    def overtaken(*args):
        if not raced:                                                      # another pass gets in before the commit
            raced.append(1)
            readiness_pass(spark, defs, runs, cal, root, f"{base}/log", fx.AS_OF - 60, external=feed("other"))
        return commit(*args)

    monkeypatch.setattr(state, "commit_attempt", overtaken)
    done = readiness_pass(spark, defs, runs, cal, root, f"{base}/log", fx.AS_OF, external=feed("own"))
    assert done.version == 2 and state.state_versions(spark, root) == [1, 2]
    assert rows(state.read_state(spark, root), "pipeline") == [("other",), ("own",)]


@pytest.mark.parametrize("newest_wins", [False, True])
def test_decisive_rows_stand_for_the_whole_feed(spark, newest_wins):
    """Merging the few rows that decide equals merging the whole history, whatever the state holds."""
    import random
    r = random.Random(7)

    def some(*values):
        return r.choice([None, *values])

    def drawn(n):
        return [(some(1, 2), some("p", "q"), some("0", "1"), some("FAILED", "SUCCESS"), some("a", "b", "c", "d"),
                 some(*range(6)), some(*range(6))) for _ in range(n)]

    feed = state_df(spark, drawn(600) + [(None, "p", None, None, "bare", None, None)] * 2)
    few = state.decisive_rows(feed, newest_wins)
    assert few.columns == feed.columns
    assert few.groupBy("pipeline", "source").count().agg({"count": "max"}).first()[0] <= 5 and few.count() < feed.count()
    for old in (drawn(0), drawn(40), drawn(40)):
        before = state_df(spark, old)
        assert rows(state.merge_state(before, few, newest_wins)) == rows(state.merge_state(before, feed, newest_wins))
