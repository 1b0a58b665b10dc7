"""The command-line job: two batch passes and a stream run over landed files."""

import json
import tempfile

from runready.__main__ import main
from runready.operators import state
from runready.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def _land(spark):
    base = tempfile.mkdtemp(prefix="rr-cli-")
    fx.fx_defs(spark, SF).write.json(f"{base}/defs")
    fx.fx_runs(spark, SF).write.json(f"{base}/runs")
    fx.fx_calendar(spark).write.option("header", "true").csv(f"{base}/calendar")
    fx.fx_external(spark, SF).write.parquet(f"{base}/ext/one")
    return base


def test_cli_pass_twice_then_stream(spark, capsys):
    base = _land(spark)
    common = ["--defs", f"{base}/defs", "--runs", f"{base}/runs", "--calendar", f"{base}/calendar",
              "--external", f"{base}/ext/*", "--state", f"{base}/state", "--log", f"{base}/log"]
    assert main(["pass", *common, "--as-of", str(fx.AS_OF - 3600)], spark=spark) == 0
    assert main(["pass", *common, "--as-of", str(fx.AS_OF)], spark=spark) == 0
    out = [json.loads(line) for line in capsys.readouterr().out.strip().splitlines()]
    assert [o["version"] for o in out] == [1, 2] and out[1]["ready_jobs"] > 0
    assert state.read_checkpoint(spark, f"{base}/state") == fx.AS_OF * 1000

    stream = ["--defs", f"{base}/defs", "--runs", f"{base}/runs", "--calendar", f"{base}/calendar",
              "--state", f"{base}/sstate", "--log", f"{base}/slog", "--checkpoint", f"{base}/ckpt"]
    assert main(["stream", *stream, "--available-now"], spark=spark) == 0
    assert state.state_versions(spark, f"{base}/sstate") == [1]
