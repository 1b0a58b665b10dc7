"""The feed read by modification time: new files only, and the answer of a whole read."""

import os
import tempfile

from conftest import rows
from helpers import state_df

from runready import schemas
from runready.operators import state
from runready.plans.readiness_pass import readiness_pass
from runready.sources import feed
from runready.sources import fixtures as fx

FEED = "source string, lock int, status string, pipeline string, start_time long, end_time long"
T1 = 1_700_000_000


def _land(spark, folder, name, data, at):
    """One file of the feed, with the given modification time."""
    part = f"{folder}/tmp-{name}"
    spark.createDataFrame(data, FEED).coalesce(1).write.parquet(part)
    found = next(f for f in os.listdir(part) if f.endswith(".parquet"))
    os.makedirs(f"{folder}/feed", exist_ok=True)
    target = f"{folder}/feed/{name}.parquet"
    with open(f"{part}/{found}", "rb") as src, open(target, "wb") as dst:
        dst.write(src.read())
    os.utime(target, (at, at))
    return target


def _advance(spark, folder, version, **options):
    root, attempt = f"{folder}/state", state.new_attempt()
    base = state.latest_version(spark, root)
    schema = spark.createDataFrame([], FEED).schema
    new = feed.advance_feed(spark, f"{folder}/feed", root, version, base, attempt, schema=schema, **options)
    state.rewrite_state(state.read_state(spark, root), new, root, version, base, attempt, buckets=4)
    state.commit_attempt(spark, root, version, attempt, version)
    return rows(new, "pipeline")


def _whole(spark, folder):
    return rows(state.merge_state(state_df(spark, []), state.normalize_external(spark.read.schema(FEED).parquet(f"{folder}/feed"))))


def test_a_pass_reads_only_files_that_landed_since(spark):
    folder = tempfile.mkdtemp(prefix="rr-feed-")
    first = _land(spark, folder, "a", [("f", 0, "SUCCESS", "x", 100, 200), ("f", 1, None, "y", 100, None)], T1)
    assert _advance(spark, folder, 1) == [("x",), ("y",)]
    # an older run of x and a later one of z land; the older run must not win over what the first file said
    _land(spark, folder, "b", [("f", 1, "FAILED", "x", 10, 20), ("f", 0, "SUCCESS", "z", 5, None), ("f", None, None, "z", 6, 7)],
          T1 + 60)
    want = _whole(spark, folder)
    with open(first, "r+b") as broken:                                     # opening the first file now would fail
        size = os.path.getsize(first)
        broken.write(b"\0" * size)
    os.utime(first, (T1, T1))
    assert _advance(spark, folder, 2, overlap_ms=-1) == [("x",), ("z",)]
    assert rows(state.read_state(spark, f"{folder}/state")) == want
    _land(spark, folder, "c", [("f", 0, "SUCCESS", "x", 300, 400)], T1 + 120)
    assert _advance(spark, folder, 3, overlap_ms=0) == [("x",), ("z",)]   # the newest file's time is read again
    now = {r.pipeline: r for r in state.read_state(spark, f"{folder}/state").collect()}
    assert (now["x"].start_time, now["x"].status, now["y"].lock, now["z"].end_time) == (300, "SUCCESS", "1", 7)


def test_overlap_finds_files_that_show_up_late(spark):
    folder = tempfile.mkdtemp(prefix="rr-feed-")
    _land(spark, folder, "a", [("f", 0, "SUCCESS", "x", 100, 200)], T1)
    _advance(spark, folder, 1)
    _land(spark, folder, "late", [("f", 0, "SUCCESS", "w", 100, 200)], T1 - 30)
    assert _advance(spark, folder, 2) == [("x",)]
    assert _advance(spark, folder, 3, overlap_ms=60_000) == [("w",), ("x",)]
    assert rows(state.read_state(spark, f"{folder}/state")) == _whole(spark, folder)


def test_passes_over_feed_files_equal_passes_over_the_whole_feed(spark):
    folder = tempfile.mkdtemp(prefix="rr-feed-")
    defs, runs = spark.createDataFrame([], schemas.DEFINITION), spark.createDataFrame([], schemas.RAW_RUN)
    cal = fx.fx_calendar(spark)
    _land(spark, folder, "a", [("f", 0, "SUCCESS", "x", 100, 200), ("g", 1, None, None, 1, None)], T1)
    readiness_pass(spark, defs, runs, cal, f"{folder}/s", f"{folder}/l", fx.AS_OF, external_path=f"{folder}/feed")
    _land(spark, folder, "b", [("f", 0, "FAILED", "x", 100, 150), ("f", 0, "SUCCESS", "z", 5, 6)], T1 + 9)
    readiness_pass(spark, defs, runs, cal, f"{folder}/s", f"{folder}/l", fx.AS_OF + 60, external_path=f"{folder}/feed")
    assert rows(state.read_state(spark, f"{folder}/s")) == _whole(spark, folder)
