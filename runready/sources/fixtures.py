"""Stand-in inputs derived from the supplied test tables.

The reference ships no sample data, so the engine's inputs are projected out of
the TPC-H-like tables (``events`` -> run log, ``customer`` -> job definitions,
``supplier`` -> external feed, ...).  These functions only give rows in the
schema the operators expect; they do none of the operators' work.  Every value
rule below is mirrored in the DuckDB text of ``runready.oracle`` so the two
engines start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

# The single as-of instant of the readiness fixtures and the
# incremental high-water mark (2024-01-31 12:00:00 UTC / 2024-01-30 00:00:00 UTC).
AS_OF = 1706702400
HWM_MS = 1706572800000
# First day of the generated fiscal calendar and its length in days.
CALENDAR_START = "1994-12-31"
CALENDAR_DAYS = 11323


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sec(ts: str) -> Column:
    # supplied timestamps load as timestamp_ntz; the session zone is UTC
    return F.expr(f"unix_seconds(cast({ts} as timestamp))")


def fx_runs_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log: run_id, job_id, life_cycle_state, result_state, start_time ms, end_time ms."""
    ev = table(spark, sf_dir, "events")
    late = "ts >= timestamp_ntz'2024-01-30 00:00:00'"
    sec = "unix_seconds(cast(ts as timestamp))"
    return ev.selectExpr(
        "event_id as run_id",
        "user_id as job_id",
        f"""case when event_type = 'signup' and {late} then 'RUNNING'
                 when event_id % 37 = 0 and {late} then 'PENDING'
                 when event_id % 43 = 0 then 'SKIPPED'
                 else 'TERMINATED' end as life_cycle_state""",
        f"""case when {late} and (event_type = 'signup' or event_id % 37 = 0) then null
                 when event_id % 43 = 0 then null
                 when event_type = 'error' then 'FAILED'
                 else 'SUCCESS' end as result_state""",
        f"{sec} * 1000 as start_time",
        f"""case when event_id % 29 = 0 then null
                 when {late} and (event_type = 'signup' or event_id % 37 = 0) then 0
                 else ({sec} + event_id % 7200) * 1000 end as end_time""",
    )


def fx_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log in the raw nested shape (``schemas.RAW_RUN``)."""
    flat = fx_runs_flat(spark, sf_dir)
    return flat.select(
        "run_id", "job_id",
        F.struct(F.col("life_cycle_state"), F.col("result_state")).alias("state"),
        "start_time", "end_time",
    )


def fx_defs_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job definitions as flat tag columns (one job per customer)."""
    cu = table(spark, sf_dir, "customer")

    n = cu.count()

    def name(offset: int) -> str:
        return f"concat('Customer#', lpad(cast((c_custkey + {offset}) % {n} as string), 9, '0'))"

    return cu.selectExpr(
        "c_custkey as job_id",
        "1672531200000 + c_custkey * 60000 as created_time",
        "c_name as pipeline",
        "cast(1 + c_custkey % 3 as int) as max_concurrent_runs",
        "case when c_mktsegment = 'MACHINERY' then 'paused' when c_custkey % 13 = 0 then null else 'active' end as state",
        """case c_custkey % 5 when 0 then null when 1 then '0 6 * * *' when 2 then '*/15 * * * *'
                when 3 then '30 2 1 * *' else '0 0 * * 1' end as cron""",
        "case c_custkey % 3 when 0 then null when 1 then 'US/Eastern' else 'Asia/Tokyo' end as tz",
        f"case when c_custkey % 4 = 0 then {name(1)} end as tdep",
        f"case when c_custkey % 8 = 0 then concat(' ', {name(2)}) end as tdep2",
        f"case when c_custkey % 6 = 0 then {name(3)} end as sdep",
        f"case when c_custkey % 10 = 0 then {name(4)} end as sdep2",
        f"case when c_custkey % 9 = 0 then concat({name(5)}, ',,', {name(6)}) end as cdep",
        "cast(null as string) as cdep2",
        """case c_custkey % 11 when 0 then 'fy_per_d1' when 1 then 'fy_per_1st_monday' when 2 then 'fy_qtr_d1'
                when 3 then 'fy_qtr_1st_monday' when 4 then 'none' else null end as spec""",
        "case when c_custkey % 7 = 0 then 'pass' else null end as onfail",
    )


def fx_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job definitions in the raw nested shape (``schemas.DEFINITION``)."""
    f = fx_defs_flat(spark, sf_dir)
    tags = F.struct(*[F.col(t.name).cast("string").alias(t.name) for t in schemas.TAGS.fields])
    settings = F.struct(
        F.col("pipeline").alias("name"),
        F.struct(F.lit(False).alias("no_alert_for_skipped_runs")).alias("email_notifications"),
        F.lit(0).cast("long").alias("timeout_seconds"),
        F.col("max_concurrent_runs").cast("long").alias("max_concurrent_runs"),
        tags.alias("tags"),
        F.lit("MULTI_TASK").alias("format"),
    )
    return f.select(
        F.col("created_time").cast("long").alias("created_time"),
        F.lit("fixture").alias("creator_user_name"),
        F.col("job_id").cast("long").alias("job_id"),
        settings.alias("settings"),
    )


def fx_cron_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fire-time requests: (cron, tz) of each job at each of its run starts, again 45 days later (even run ids) or 75
    days earlier (odd), which spans both changes of US time, and schedules or zones that are not valid."""
    tags = fx_defs_flat(spark, sf_dir).where("state is not null").selectExpr(
        "job_id", "coalesce(cron, '* * * * *') as cron",
        "case when coalesce(spec, 'None') <> 'None' then 'US/Eastern' else coalesce(tz, 'UTC') end as tz")
    at = fx_runs_flat(spark, sf_dir).selectExpr(
        "job_id", "floor(start_time / 1000) as at", "case when run_id % 2 = 0 then 45 else -75 end * 86400 as shift")
    runs = at.join(tags, "job_id").selectExpr("cron", "tz", "explode(array(at, at + shift)) as as_of")
    broken = table(spark, sf_dir, "supplier").selectExpr(
        "case s_suppkey % 4 when 0 then 'every day' when 1 then '61 * * * *' else '0 6 * * *' end as cron",
        "case s_suppkey % 4 when 2 then '+930' when 3 then '+18:30' else 'UTC' end as tz",
        "1706600000 + s_suppkey * 60 as as_of")
    return runs.unionByName(broken)


def fx_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External run feeds: one run per supplier (every tenth name is also a job name), and one per order for
    the customer's job, so that a key has as many rows as its customer has orders."""
    su = table(spark, sf_dir, "supplier").selectExpr(
        "'supplier_feed' as source",
        "case when s_suppkey % 5 = 0 then 1 else 0 end as lock",
        "case s_suppkey % 4 when 0 then 'FAILED' when 1 then null else 'SUCCESS' end as status",
        """case when s_suppkey % 10 = 0 then concat('Customer#', lpad(cast(s_suppkey as string), 9, '0'))
                else s_name end as pipeline""",
        "1706600000 + s_suppkey * 60 as start_time",
        "1706600000 + s_suppkey * 60 + 900 as end_time",
    )
    orders = table(spark, sf_dir, "orders").selectExpr(
        "'order_feed' as source",
        "case when o_orderkey % 6 = 0 then null when o_orderkey % 5 = 0 then 1 else 0 end as lock",
        "case o_orderkey % 4 when 0 then 'FAILED' when 1 then null else 'SUCCESS' end as status",
        "concat('Customer#', lpad(cast(o_custkey as string), 9, '0')) as pipeline",
        "1706000000 + o_orderkey as start_time",
        "case when o_orderkey % 3 = 0 then null else 1706000000 + o_orderkey + 600 end as end_time",
    )
    return su.unionByName(orders)


def fx_state_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous state table: a platform row and an order-feed row for most customers, with starts inside
    the run log."""
    cu = table(spark, sf_dir, "customer")
    platform = cu.where("c_custkey % 7 <> 3").selectExpr(
        "c_custkey as job_id",
        "'azure_databricks' as source",
        "'0' as lock",
        "case c_custkey % 3 when 0 then 'RUNNING' when 1 then 'FAILED' else 'SUCCESS' end as status",
        "c_name as pipeline",
        "1704067200 + c_custkey * 997 % 2400000 as start_time",
        "case when c_custkey % 17 = 0 then null else 1704067800 + c_custkey * 997 % 2400000 end as end_time",
    )
    feed = cu.where("c_custkey % 4 <> 1").selectExpr(
        "99999999999999 as job_id",
        "'order_feed' as source",
        "case when c_custkey % 3 = 0 then '1' else '0' end as lock",
        "case c_custkey % 5 when 0 then 'FAILED' when 1 then null else 'SUCCESS' end as status",
        "c_name as pipeline",
        "1700000000 + c_custkey as start_time",
        "1700000600 + c_custkey as end_time",
    )
    return platform.unionByName(feed).select(*[F.col(f.name).cast(f.dataType) for f in schemas.STATE.fields])


def fx_run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line per event as a run: some cut off, some with a word for a time, some without a job id."""
    sec = "unix_seconds(cast(ts as timestamp)) * 1000"
    whole = f"""concat('{{"run_id":', event_id, case when event_id % 13 = 0 then '' else concat(',"job_id":', user_id) end,
        ',"state":{{"life_cycle_state":"TERMINATED","result_state":"SUCCESS"}},"start_time":',
        case when event_id % 17 = 0 then '"soon"' else cast({sec} as string) end, '}}')"""
    return table(spark, sf_dir, "events").selectExpr(f"{whole} as whole", "event_id").selectExpr(
        "case when event_id % 11 = 0 then substring(whole, 1, cast(12 + event_id % 50 as int)) else whole end as value")


def fx_calendar(spark: SparkSession) -> DataFrame:
    """Fiscal calendar: 28-day periods and 84-day quarters starting on a Saturday."""
    return spark.sql(f"""
        select d as CLDR_DT, cast(n div 28 as int) as FCL_PER_INDEX, cast(n % 28 + 1 as int) as FCL_DAY_OF_PER_C,
               date_sub(d, cast(n % 28 as int)) as FCL_PER_BGN_DT, cast(n div 84 as int) as FCL_QTR_INDEX,
               cast(n % 84 + 1 as int) as FCL_DAY_OF_QTR_C, date_sub(d, cast(n % 84 as int)) as FCL_QTR_BGN_DT
        from (select date_add(date'{CALENDAR_START}', n) as d, n
              from (select explode(sequence(0, {CALENDAR_DAYS - 1})) as n))""")


def fx_order_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many as-of instants: every order date at 12:00 UTC (one row per order)."""
    return table(spark, sf_dir, "orders").select(
        (_sec("o_orderdate") + F.lit(43200)).alias("as_of"))


def fx_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invocation log lines: one per run of the run log, parameters from the event payload."""
    ev = table(spark, sf_dir, "events")
    sec = "unix_seconds(cast(ts as timestamp))"
    return ev.selectExpr(
        f"{sec} * 1000 as start_time",
        f"({sec} + event_id % 7200) * 1000 as end_time",
        "'4242' as conductor_job_id",
        "cast(user_id as string) as conductor_job_run_id",
        "case when event_id % 2 = 0 then 'db' else 'adf' end as job_type",
        "concat('job_', cast(user_id as string)) as job_name",
        "cast(event_id as string) as job_run_id",
        "case when event_type = 'view' then 'false' else 'true' end as wait_on_completion",
        "props as parameters",
    )
