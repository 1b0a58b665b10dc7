"""The landed run log: layout, pruning, and the same selection as over any other log."""

import glob
import json
import tempfile

import pytest
from conftest import rows
from helpers import raw_runs

from runready.__main__ import main
from runready.operators import run_log, runs
from runready.plans.readiness_pass import select_defined_runs
from runready.operators.definitions import flatten_definitions
from runready.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landed(spark):
    path = f"{tempfile.mkdtemp(prefix='rr-runlog-')}/log"
    log = fx.fx_runs(spark, SF).unionByName(raw_runs(spark, [
        (9001, 1, "TERMINATED", "SUCCESS", None, 5), (None, 2, "RUNNING", None, fx.HWM_MS, 0), (None, 2, "SKIPPED", None, fx.HWM_MS, 0)]))
    run_log.land_runs(log, path)
    return path, log


def test_landed_log_holds_every_run(spark, landed):
    path, log = landed
    assert rows(run_log.read_run_log(spark, path).select(*log.columns)) == rows(log.distinct())


@pytest.mark.parametrize("mode", ["reference", "locked"])
@pytest.mark.parametrize("ids", [1000, 0])
def test_selection_equals_that_of_a_plain_log(spark, landed, monkeypatch, mode, ids):
    path, log = landed
    monkeypatch.setattr(run_log, "MAX_IDS", ids)
    back = run_log.read_run_log(spark, path)
    old = fx.fx_state_old(spark, SF)
    for state, mark in [(old, fx.HWM_MS), (old, fx.HWM_MS - 86_400_000 * 9 + 1), (None, fx.HWM_MS), (old, None),
                        (old.where("status = 'FAILED'"), fx.HWM_MS), (old.selectExpr(
                            "job_id", "source", "lock", "status", "pipeline", "start_time + 7 as start_time", "end_time"), fx.HWM_MS)]:
        assert rows(run_log.select_landed(back, state, mark, mode)) == rows(runs.select_runs(log, state, mark, mode))
    defs = flatten_definitions(fx.fx_defs(spark, SF))
    n = defs.count()
    assert rows(select_defined_runs(back, defs, n, old, fx.HWM_MS)) == rows(select_defined_runs(log, defs, n, old, fx.HWM_MS))


def test_reads_are_pruned(spark, landed):
    path, _ = landed
    back = run_log.read_run_log(spark, path)
    # half of the recorded starts are moved, so that those runs are not in the log
    old = fx.fx_state_old(spark, SF).selectExpr("job_id", "source", "lock", "status", "pipeline",
                                                "start_time + job_id % 2 * 3 as start_time", "end_time")
    plan = run_log.select_landed(back, old, fx.HWM_MS)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert any("dynamicpruningexpression" in s for s in scans)
    assert any("start_date" in s and ">=" in s for s in scans)
    assert any("In(job_id, [" in line or "EqualTo(job_id," in line for line in plan.splitlines() if "PushedFilters" in line)
    footer = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for file in glob.glob(f"{path}/start_date=2024-01-3*/*.parquet"):
        blocks = footer.readFooter(conf, spark._jvm.org.apache.hadoop.fs.Path(f"file:{file}")).getBlocks()
        job = [c for b in blocks for c in b.getColumns() if c.getPath().toDotString() == "job_id"]
        assert job and all(c.getBloomFilterOffset() >= 0 for c in job)


def test_a_landing_replaces_records_on_its_days_only(spark):
    path = f"{tempfile.mkdtemp(prefix='rr-runlog-')}/log"
    day, t = 86_400_000, 1_706_400_000_000 // 86_400_000 * 86_400_000
    run_log.land_runs(raw_runs(spark, [(1, 1, "RUNNING", None, t, 0), (2, 1, "RUNNING", None, t + day, 0),
                                       (3, 2, "TERMINATED", "SUCCESS", t + day + 5, t + day + 9)]), path)
    files = {f for f in glob.glob(f"{path}/*/*.parquet")}
    again = raw_runs(spark, [(2, 1, "TERMINATED", "FAILED", t + day, t + day + 4), (2, 1, "RUNNING", None, t + day, 0),
                             (4, 9, "RUNNING", None, t + 3 * day, 0)])
    for _ in range(2):
        run_log.land_runs(again, path)
        got = rows(run_log.read_run_log(spark, path).selectExpr("run_id", "state.life_cycle_state", "end_time"))
        assert got == [(1, "RUNNING", 0), (2, "TERMINATED", t + day + 4), (3, "TERMINATED", t + day + 9), (4, "RUNNING", 0)]
    kept = files & {f for f in glob.glob(f"{path}/*/*.parquet")}
    assert len(kept) == 1                                          # the first day's
    run_log.land_runs(again.limit(0), path)
    assert run_log.read_run_log(spark, path).count() == 4


def test_cli_lands_passes_and_maintains(spark, capsys):
    base = tempfile.mkdtemp(prefix="rr-cli-")
    fx.fx_defs(spark, SF).write.json(f"{base}/defs")
    fx.fx_runs(spark, SF).write.json(f"{base}/runs")
    fx.fx_calendar(spark).write.option("header", "true").csv(f"{base}/calendar")
    assert main(["land", "--runs", f"{base}/runs", "--run-log", f"{base}/log"], spark=spark) == 0
    out = []
    for runs_at, fmt, name in ((f"{base}/log", "landed", "a"), (f"{base}/runs", "json", "b")):
        for as_of in (fx.AS_OF - 86_400, fx.AS_OF):
            assert main(["pass", "--defs", f"{base}/defs", "--runs", runs_at, "--runs-format", fmt, "--calendar", f"{base}/calendar",
                         "--state", f"{base}/state-{name}", "--log", f"{base}/log-{name}", "--as-of", str(as_of)], spark=spark) == 0
        out.append([json.loads(line)["ready_jobs"] for line in capsys.readouterr().out.strip().splitlines()])
    assert out[0] == out[1]
    assert main(["maintain", "--expire", f"{base}/log-a", "--as-of", str(fx.AS_OF)], spark=spark) == 0
    assert json.loads(capsys.readouterr().out)["expired_files"] == 0
