"""The pass from landed files: full load, then an incremental pass from the stored checkpoint, then a replay."""

import tempfile

from conftest import rows

from runready.operators import logs, state
from runready.plans.readiness_pass import readiness_pass
from runready.sources import fixtures as fx
from runready.sources import readers

SF = "/root/testdata/sf0.001"


def test_two_passes_from_files(spark):
    base = tempfile.mkdtemp(prefix="rr-files-")
    fx.fx_defs(spark, SF).write.json(f"{base}/defs")
    fx.fx_runs(spark, SF).write.json(f"{base}/runs")
    fx.fx_calendar(spark).write.option("header", "true").csv(f"{base}/calendar")
    ext = fx.fx_external(spark, SF)
    ext.where("start_time % 2 = 0").write.parquet(f"{base}/ext/a")
    ext.where("start_time % 2 = 1").write.parquet(f"{base}/ext/b")

    defs = readers.read_definitions(spark, f"{base}/defs")
    run_log = readers.read_runs(spark, f"{base}/runs")
    cal = readers.read_calendar(spark, f"{base}/calendar")
    feed = readers.read_external(spark, f"{base}/ext/*")
    assert feed.count() == ext.count() and defs.count() == fx.fx_defs(spark, SF).count()

    root, log = f"{base}/state", f"{base}/log"
    first = readiness_pass(spark, defs, run_log, cal, root, log, fx.AS_OF - 86400, external=feed)
    assert first.version == 1 and first.hwm_ms is None                      # no checkpoint: full load
    second = readiness_pass(spark, defs, run_log, cal, root, log, fx.AS_OF, external=feed)
    assert second.version == 2 and second.hwm_ms == (fx.AS_OF - 86400) * 1000
    assert state.read_checkpoint(spark, root) == fx.AS_OF * 1000
    ready = rows(second.ready)
    assert ready, "some job is ready"
    state_v2 = rows(second.state)
    decisions_v2 = second.decisions.count()

    # replaying version 2 rewrites the same state and log partition
    again = readiness_pass(spark, defs, run_log, cal, root, log, fx.AS_OF, external=feed, version=2)
    assert rows(again.ready) == ready
    assert rows(state.read_state(spark, root, 2)) == state_v2
    per_pass = {r.log_time: 0 for r in logs.read_decision_log(spark, log).collect()}
    assert sorted(per_pass) == [fx.AS_OF - 86400, fx.AS_OF]
    assert logs.read_decision_log(spark, log).where(f"log_time = {fx.AS_OF}").count() == decisions_v2


def test_pass_drops_expired_log_partitions(spark):
    base = tempfile.mkdtemp(prefix="rr-ret-")
    defs, cal = fx.fx_defs(spark, SF), fx.fx_calendar(spark)
    run_log = fx.fx_runs(spark, SF)
    root, log = f"{base}/state", f"{base}/log"
    readiness_pass(spark, defs, run_log, cal, root, log, fx.AS_OF - 40 * 86400)
    readiness_pass(spark, defs, run_log, cal, root, log, fx.AS_OF - 20 * 86400)
    readiness_pass(spark, defs, run_log, cal, root, log, fx.AS_OF)          # 30-day retention
    kept = sorted({r.log_time for r in logs.read_decision_log(spark, log).collect()})
    assert kept == [fx.AS_OF - 20 * 86400, fx.AS_OF]


def test_api_pages_and_migration(spark, tmp_path):
    import json as _json

    from runready.plans.migrate import import_previous_state
    jobs = [{"job_id": 1, "created_time": 1700000000000, "settings": {"name": "a", "max_concurrent_runs": 1,
             "tags": {"state": "active", "cron": "0 6 * * *"}}},
            {"job_id": 2, "created_time": 1700000000000, "settings": {"name": "b", "tags": {"state": "paused"}},
             "unknown_key": 5}]
    (tmp_path / "defs.json").write_text(_json.dumps({"jobs": jobs[:1], "has_more": True}) + "\n"
                                        + _json.dumps({"jobs": jobs[1:], "has_more": False}) + "\n")
    runs = [{"job_id": 1, "run_id": 7, "state": {"life_cycle_state": "TERMINATED", "result_state": "SUCCESS"},
             "start_time": 1706000000000, "end_time": 1706000600000},
            {"job_id": 1, "run_id": 8, "state": {"life_cycle_state": "RUNNING"}, "start_time": 1706100000000,
             "end_time": 0}]
    (tmp_path / "runs.json").write_text(_json.dumps({"runs": runs, "has_more": False}) + "\n")
    d = readers.read_definition_pages(spark, str(tmp_path / "defs.json"))
    r = readers.read_run_pages(spark, str(tmp_path / "runs.json"))
    assert sorted(x.job_id for x in d.collect()) == [1, 2]
    assert sorted((x.run_id, x.state.result_state) for x in r.collect()) == [(7, "SUCCESS"), (8, None)]

    (tmp_path / "state.csv").write_text("job_id,source,lock,status,pipeline,start_time,end_time\n"
                                        "1,azure_databricks,1,RUNNING,a,1706100000.0,\n")
    (tmp_path / "checkpoint.txt").write_text("1706050000000")
    root = str(tmp_path / "state")
    assert import_previous_state(spark, str(tmp_path / "state.csv"), str(tmp_path / "checkpoint.txt"), root) \
        == 1706050000000
    result = readiness_pass(spark, d, r, fx.fx_calendar(spark), root, str(tmp_path / "log"), fx.AS_OF)
    assert result.version == 1 and result.hwm_ms == 1706050000000                  # incremental from the import
    assert readers.read_checkpoint_text(spark, str(tmp_path / "missing.txt")) is None


def test_pass_with_no_definitions(spark, tmp_path):
    from runready import schemas
    defs = spark.createDataFrame([], schemas.DEFINITION)
    result = readiness_pass(spark, defs, fx.fx_runs(spark, SF), fx.fx_calendar(spark), str(tmp_path / "state"),
                            str(tmp_path / "log"), fx.AS_OF, external=fx.fx_external(spark, SF))
    assert result.version == 1 and result.ready.count() == 0
    keys = fx.fx_external(spark, SF).select("pipeline", "source").distinct()      # the feed keeps history; the state has a row a key
    assert state.read_state(spark, str(tmp_path / "state")).count() == keys.count()
