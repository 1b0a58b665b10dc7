"""Heavier benchmark queries: a full pass over a run log derived from ``orders``/``lineitem``.

One run per order: job = customer, start = order date, end = the order's last ship date,
open orders are still running.  At sf0.1 that is 150,000 runs over 10,000 jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs, state
from ..sources import fixtures as fx
from . import catalog
from ..session import shared_path
from .readiness_pass import new_state_rows, readiness_pass


def fx_order_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Raw runs from orders: end time = latest ship date of the order's line items."""
    ship = fx.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("_ship"))
    o = fx.table(spark, sf, "orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    sec = F.expr("unix_seconds(cast(o_orderdate as timestamp))")
    end = F.expr("unix_seconds(cast(_ship as timestamp))")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("job_id"),
        F.struct(
            F.when(F.col("o_orderstatus") == "O", F.lit("RUNNING")).otherwise(F.lit("TERMINATED")).alias("life_cycle_state"),
            F.when(F.col("o_orderstatus") == "F", F.lit("SUCCESS"))
             .when(F.col("o_orderstatus") == "P", F.lit("FAILED")).alias("result_state")).alias("state"),
        (sec * 1000).alias("start_time"),
        F.when(F.col("o_orderstatus") == "O", F.lit(0)).otherwise(end * 1000).alias("end_time"),
    )


def q_bench_order_state(spark: SparkSession, sf: str) -> DataFrame:
    """Full-load state over the order run log (latest run per job, open slots, merge)."""
    raw = fx_order_runs(spark, sf)
    rows = new_state_rows(fx.fx_defs(spark, sf), raw, fx.fx_state_old(spark, sf), None,
                          external=fx.fx_external(spark, sf))
    return state.merge_state(fx.fx_state_old(spark, sf), rows)


def q_bench_order_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Latest run of every job over all 150k (sf0.1) order runs."""
    defs = catalog._defs(spark, sf)
    n = defs.count()
    return runs.latest_run(runs.normalize_runs(fx_order_runs(spark, sf), defs, jobs_bound=n), jobs_bound=n)


def q_bench_order_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """A whole pass over the order run log (full load: no checkpoint yet): state v1, decision log,
    and the logged decision rows read back."""
    base = shared_path(spark, "bench_pass")
    result = readiness_pass(spark, fx.fx_defs(spark, sf), fx_order_runs(spark, sf), fx.fx_calendar(spark),
                            f"{base}/state", f"{base}/log", fx.AS_OF, external=fx.fx_external(spark, sf),
                            initial_state=fx.fx_state_old(spark, sf))
    return result.decisions


def bench_queries():
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_bench_") and callable(fn)}
