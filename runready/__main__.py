"""Run the readiness pass as a job: ``python -m runready`` or ``spark-submit runready/__main__.py``.

Batch (one pass; schedule it every 10 minutes, or replay an instant):

    python -m runready pass --defs D --runs R --calendar C --state S --log L [--external 'E/*'] [--as-of EPOCH]

Stream (one pass per trigger over run files as they land):

    python -m runready stream --defs D --runs R --calendar C --state S --log L --checkpoint K
        [--trigger '10 minutes' | --available-now] [--tick]

Upkeep:

    python -m runready land --runs R --run-log G          # then: pass --runs G --runs-format landed
    python -m runready maintain [--invocations I] [--expire FOLDER ...]

Inputs are landed files read with declared schemas (definitions: JSON lines; runs: JSON
lines or Parquet; calendar: CSV with a header; external feed: Parquet, glob allowed).
The batch mode prints one JSON line: the instant, the state version and the number of
ready jobs; the ready jobs themselves are the pass's decision-log partition (log_time =
the instant), where every job's rows sum to readiness 0.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from .session import configure, get_spark
from .sources import readers


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="runready", description="Decide which pipelines are ready to run.")
    sub = p.add_subparsers(dest="mode", required=True)
    helps = {"pass": "run one pass at an instant and commit a new state version",
             "stream": "run a pass per trigger over run files as they land"}
    for name in ("pass", "stream"):
        s = sub.add_parser(name, help=helps[name])
        s.add_argument("--defs", required=True, help="job definitions (JSON lines)")
        s.add_argument("--runs", required=True, help="run records (folder or glob)")
        s.add_argument("--runs-format", default="json", choices=["json", "parquet", "landed"],
                       help="landed: a log written by `land` (batch mode only)")
        s.add_argument("--calendar", required=True, help="fiscal calendar (CSV with header)")
        s.add_argument("--external", help="external run feed (Parquet, glob allowed)")
        s.add_argument("--state", required=True, help="root folder of the versioned state")
        s.add_argument("--log", required=True, help="decision-log folder")
        s.add_argument("--log-format", default="csv", choices=["csv", "parquet"])
        s.add_argument("--day-rule", default="and", choices=["and", "or"])
    land = sub.add_parser("land", help="merge run records into a log with a folder a start date")
    land.add_argument("--runs", required=True, help="run records (folder or glob)")
    land.add_argument("--runs-format", default="json", choices=["json", "parquet"])
    land.add_argument("--run-log", required=True, help="folder of the landed log")
    m = sub.add_parser("maintain", help="compact an invocation log and delete old files")
    m.add_argument("--invocations", help="invocation log to compact")
    m.add_argument("--keep-hours", type=float, default=24, help="time until replaced files are deleted")
    m.add_argument("--expire", action="append", default=[], help="folder whose files expire by size and time (repeatable)")
    m.add_argument("--retention-days", type=float, default=30)
    m.add_argument("--as-of", type=int, help="instant of the retention, epoch seconds (default: now)")
    ps = sub.choices["pass"]
    ps.add_argument("--as-of", type=int, help="pass instant, epoch seconds (default: now)")
    ps.add_argument("--log-shape", default="factored", choices=["factored", "product"],
                    help="decision rows: own and edge rows, or every combination of a job's dependencies")
    ps.add_argument("--carry-over", default="reference", choices=["reference", "locked"])
    ss = sub.choices["stream"]
    ss.add_argument("--checkpoint", required=True, help="streaming checkpoint location (shared storage)")
    ss.add_argument("--trigger", default="10 minutes", help="processing-time trigger interval")
    ss.add_argument("--available-now", action="store_true", help="process what has landed, then stop")
    ss.add_argument("--tick", action="store_true", help="run a pass every trigger even without new runs")
    ss.add_argument("--max-files-per-trigger", type=int)
    return p


def _maintain(args, spark) -> int:
    from .operators import log_files, logs
    as_of = args.as_of if args.as_of is not None else int(time.time())
    out: dict = {"as_of": as_of, "expired_files": 0}
    if args.invocations:
        out["compacted_months"] = logs.compact_invocation_log(spark, args.invocations)
        out["deleted_batches"] = log_files.vacuum(spark, args.invocations, int(args.keep_hours * 3_600_000))
    for folder in args.expire:
        out["expired_files"] += log_files.drop_expired_files(spark, folder, as_of, int(args.retention_days * 86_400_000))
    print(json.dumps(out))
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    spark = configure(spark) if spark is not None else get_spark(app_name="runready")
    if args.mode == "land":
        from .operators import run_log
        run_log.land_runs(readers.read_runs(spark, args.runs, args.runs_format), args.run_log)
        return 0
    if args.mode == "maintain":
        return _maintain(args, spark)
    if args.mode == "pass":
        from .operators import run_log
        from .plans.readiness_pass import readiness_pass
        defs = readers.read_definitions(spark, args.defs)
        cal = readers.read_calendar(spark, args.calendar)
        as_of = args.as_of if args.as_of is not None else int(time.time())
        runs = (run_log.read_run_log(spark, args.runs) if args.runs_format == "landed"
                else readers.read_runs(spark, args.runs, args.runs_format))
        result = readiness_pass(spark, defs, runs, cal,
                                args.state, args.log, as_of, external_path=args.external, carry_over=args.carry_over,
                                day_rule=args.day_rule, log_format=args.log_format, log_shape=args.log_shape)
        print(json.dumps({"as_of": as_of, "version": result.version, "ready_jobs": result.ready.count(),
                          "log": f"{args.log.rstrip('/')}/log_date=*/log_time={as_of}"}))
        return 0
    from .streaming.stream import readiness_stream
    trigger = {"availableNow": True} if args.available_now else {"processingTime": args.trigger}
    # functions, so that every batch sees the definitions, calendar and feed of its time
    q = readiness_stream(spark, args.runs, lambda: readers.read_definitions(spark, args.defs),
                         lambda: readers.read_calendar(spark, args.calendar), args.state, args.log, args.checkpoint,
                         external=(lambda: readers.read_external(spark, args.external)) if args.external else None,
                         fmt=args.runs_format, max_files_per_trigger=args.max_files_per_trigger,
                         trigger=trigger, tick=args.tick, day_rule=args.day_rule, log_format=args.log_format)
    q.awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())
