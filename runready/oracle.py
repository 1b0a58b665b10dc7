"""DuckDB SQL oracles for the registered queries.

Each oracle is written independently of the Spark operators (e.g. the latest run is the
literal two-step max join, the gate is evaluated per dependency row) and runs on the
same parquet tables, which DuckDB sees as views named after the tables.
"""

from __future__ import annotations

SEC = "cast(floor(epoch(ts)) as bigint)"
LATE = "ts >= timestamp '2024-01-30 00:00:00'"
# written out here, not shared with the engine, so that a wrong literal there shows
TERMINAL = "'TERMINATED', 'SKIPPED', 'INTERNAL_ERROR', 'BLOCKED'"
AS_OF = 1706702400
HWM_MS = 1706572800000


def _name(offset: int) -> str:
    return f"concat('Customer#', lpad(cast((c_custkey + {offset}) % (select count(*) from customer) as varchar), 9, '0'))"


# ---- fixtures (mirror runready.sources.fixtures) ----------------------------------

FX: dict[str, str] = {
    "fx_runs": f"""
 select event_id as run_id, user_id as job_id,
  case when event_type = 'signup' and {LATE} then 'RUNNING' when event_id % 37 = 0 and {LATE} then 'PENDING'
       when event_id % 43 = 0 then 'SKIPPED' else 'TERMINATED' end as life_cycle_state,
  case when {LATE} and (event_type = 'signup' or event_id % 37 = 0) then null when event_id % 43 = 0 then null
       when event_type = 'error' then 'FAILED' else 'SUCCESS' end as result_state,
  {SEC} * 1000 as start_time,
  case when event_id % 29 = 0 then null when {LATE} and (event_type = 'signup' or event_id % 37 = 0) then 0
       else ({SEC} + event_id % 7200) * 1000 end as end_time
 from events""",
    "fx_defs": f"""
 select c_custkey as job_id, 1672531200000 + c_custkey * 60000 as created_time, c_name as pipeline,
  cast(1 + c_custkey % 3 as int) as max_concurrent_runs,
  case when c_mktsegment = 'MACHINERY' then 'paused' when c_custkey % 13 = 0 then null else 'active' end as state,
  case c_custkey % 5 when 0 then null when 1 then '0 6 * * *' when 2 then '*/15 * * * *' when 3 then '30 2 1 * *'
       else '0 0 * * 1' end as cron,
  case c_custkey % 3 when 0 then null when 1 then 'US/Eastern' else 'Asia/Tokyo' end as tz,
  case when c_custkey % 4 = 0 then {_name(1)} end as tdep,
  case when c_custkey % 8 = 0 then concat(' ', {_name(2)}) end as tdep2,
  case when c_custkey % 6 = 0 then {_name(3)} end as sdep,
  case when c_custkey % 10 = 0 then {_name(4)} end as sdep2,
  case when c_custkey % 9 = 0 then concat({_name(5)}, ',,', {_name(6)}) end as cdep,
  cast(null as varchar) as cdep2,
  case c_custkey % 11 when 0 then 'fy_per_d1' when 1 then 'fy_per_1st_monday' when 2 then 'fy_qtr_d1'
       when 3 then 'fy_qtr_1st_monday' when 4 then 'none' else null end as spec,
  case when c_custkey % 7 = 0 then 'pass' else null end as onfail
 from customer""",
    "fx_external": """
 select 'supplier_feed' as source, case when s_suppkey % 5 = 0 then 1 else 0 end as lock,
  case s_suppkey % 4 when 0 then 'FAILED' when 1 then null else 'SUCCESS' end as status,
  case when s_suppkey % 10 = 0 then concat('Customer#', lpad(cast(s_suppkey as varchar), 9, '0')) else s_name end as pipeline,
  1706600000 + s_suppkey * 60 as start_time, 1706600000 + s_suppkey * 60 + 900 as end_time
 from supplier
 union all
 select 'order_feed', case when o_orderkey % 6 = 0 then null when o_orderkey % 5 = 0 then 1 else 0 end,
  case o_orderkey % 4 when 0 then 'FAILED' when 1 then null else 'SUCCESS' end,
  concat('Customer#', lpad(cast(o_custkey as varchar), 9, '0')), 1706000000 + o_orderkey,
  case when o_orderkey % 3 = 0 then null else 1706000000 + o_orderkey + 600 end
 from orders""",
    "fx_state_old": """
 select cast(c_custkey as bigint) as job_id, 'azure_databricks' as source, '0' as lock,
  case c_custkey % 3 when 0 then 'RUNNING' when 1 then 'FAILED' else 'SUCCESS' end as status, c_name as pipeline,
  cast(1704067200 + c_custkey * 997 % 2400000 as bigint) as start_time,
  cast(case when c_custkey % 17 = 0 then null else 1704067800 + c_custkey * 997 % 2400000 end as bigint) as end_time
 from customer where c_custkey % 7 <> 3
 union all
 select 99999999999999, 'order_feed', case when c_custkey % 3 = 0 then '1' else '0' end,
  case c_custkey % 5 when 0 then 'FAILED' when 1 then null else 'SUCCESS' end, c_name,
  1700000000 + c_custkey, 1700000600 + c_custkey
 from customer where c_custkey % 4 <> 1""",
    "fx_calendar": """
 select d as CLDR_DT, cast(n // 28 as int) as FCL_PER_INDEX, cast(n % 28 + 1 as int) as FCL_DAY_OF_PER_C,
  d - cast(n % 28 as int) as FCL_PER_BGN_DT, cast(n // 84 as int) as FCL_QTR_INDEX,
  cast(n % 84 + 1 as int) as FCL_DAY_OF_QTR_C, d - cast(n % 84 as int) as FCL_QTR_BGN_DT
 from (select cast(date '1994-12-31' + cast(n as int) as date) as d, n from (select unnest(range(0, 11323)) as n))""",
}

def _merged(first: str, second: str, third: str, rows: str) -> str:
    """Per key and column the last non-null value, one ordered scan a column."""
    cols = ["job_id", "lock", "status", "start_time", "end_time"]
    order = ", ".join(f"{c} nulls first" for c in (first, second, third))
    picks = ", ".join(f"last({c} order by {order}, {c}) filter (where {c} is not null) as {c}" for c in cols)
    return f" select pipeline, source, {picks} from {rows} group by pipeline, source"


# ---- operator steps as CTEs ---------------------------------------------------------

STEPS: dict[str, str] = {
    "defs": """
 select job_id, created_time, pipeline, state, max_concurrent_runs, coalesce(cron, '* * * * *') as cron,
  case when coalesce(spec, 'None') <> 'None' then 'US/Eastern' else coalesce(tz, 'UTC') end as tz,
  coalesce(spec, 'None') as spec, coalesce(onfail, 'hold') as onfail,
  case when sdep2 is not null then concat_ws(',', sdep, sdep2) else sdep end as sdep,
  case when tdep2 is not null then concat_ws(',', tdep, tdep2) else tdep end as tdep,
  case when cdep2 is not null then concat_ws(',', cdep, cdep2) else cdep end as cdep
 from fx_defs where state is not null and pipeline <> 'schema_placeholder'""",
    "norm_all": """
 select r.job_id, 'azure_databricks' as source, r.life_cycle_state as state,
  coalesce(r.result_state, r.life_cycle_state) as status, d.pipeline,
  cast(floor(r.start_time / 1000.0) as bigint) as start_time, cast(floor(r.end_time / 1000.0) as bigint) as end_time
 from fx_runs r join defs d on r.job_id = d.job_id""",
    "latest_all_m1": "select job_id, max(end_time) as mx from norm_all group by job_id",
    "latest_all_a2": "select n.* from norm_all n join latest_all_m1 m on n.job_id = m.job_id and n.end_time = m.mx",
    "latest_all_m2": "select job_id, max(start_time) as ms from latest_all_a2 group by job_id",
    "latest_all": """select distinct a.* from latest_all_a2 a join latest_all_m2 m
 on a.job_id = m.job_id and a.start_time = m.ms""",
    "slots": f"""
 select job_id, max_concurrent_runs, cast(max_concurrent_runs - count(*) as int) as jobs_open from (
  select r.job_id, d.max_concurrent_runs from fx_runs r join defs d on r.job_id = d.job_id
  where d.max_concurrent_runs > 1 and (r.life_cycle_state is null or r.life_cycle_state not in ({TERMINAL}))
  qualify row_number() over (partition by r.job_id order by r.start_time desc, r.run_id desc) <= d.max_concurrent_runs)
 group by job_id, max_concurrent_runs""",
    "lock_all": f"""
 select distinct job_id, source,
  case when job_id in (select job_id from slots where jobs_open > 0) then '0'
       when state in ({TERMINAL}) then '0' else '1' end as lock,
  case when state in ({TERMINAL}) then status else state end as status, pipeline, start_time, end_time
 from latest_all""",
    "ext": """
 select cast(99999999999999 as bigint) as job_id, source, cast(lock as varchar) as lock, status, pipeline,
  cast(epoch(to_timestamp(start_time)) as bigint) as start_time, cast(epoch(to_timestamp(end_time)) as bigint) as end_time
 from fx_external""",
    "runs_full": """
 select * from fx_runs qualify row_number() over (partition by job_id order by start_time desc nulls last, run_id desc nulls last) = 1""",
    "runs_incr": f"""
 select * from fx_runs where start_time >= {HWM_MS}
 union
 select * from (select * from fx_runs where job_id in (select job_id from fx_state_old where status in ('RUNNING', 'FAILED'))
 qualify row_number() over (partition by job_id order by start_time desc nulls last, run_id desc nulls last) = 1)""",
    "norm_incr": """
 select r.job_id, 'azure_databricks' as source, r.life_cycle_state as state,
  coalesce(r.result_state, r.life_cycle_state) as status, d.pipeline,
  cast(floor(r.start_time / 1000.0) as bigint) as start_time, cast(floor(r.end_time / 1000.0) as bigint) as end_time
 from runs_incr r join defs d on r.job_id = d.job_id""",
    "incr_m1": "select job_id, max(end_time) as mx from norm_incr group by job_id",
    "incr_a2": "select n.* from norm_incr n join incr_m1 m on n.job_id = m.job_id and n.end_time = m.mx",
    "incr_m2": "select job_id, max(start_time) as ms from incr_a2 group by job_id",
    "latest_incr": "select distinct a.* from incr_a2 a join incr_m2 m on a.job_id = m.job_id and a.start_time = m.ms",
    "lock_incr": f"""
 select distinct job_id, source,
  case when job_id in (select job_id from slots where jobs_open > 0) then '0'
       when state in ({TERMINAL}) then '0' else '1' end as lock,
  case when state in ({TERMINAL}) then status else state end as status, pipeline, start_time, end_time
 from latest_incr""",
    "new_rows": """
 select job_id, source, lock, status, pipeline, start_time, end_time from lock_incr
 union all select job_id, source, lock, status, pipeline, start_time, end_time from ext""",
    "merge_in": """
 select *, 0 as side from fx_state_old
 union all by name select *, 1 as side from new_rows""",
    "merged": _merged("side", "end_time", "start_time", "merge_in"),
    "feed_in": """
 select *, 0 as side from fx_state_old
 union all by name select *, 1 as side from ext""",
    "fed": _merged("side", "end_time", "start_time", "feed_in"),
}

# dependency order of every CTE name
_DEPS: dict[str, list[str]] = {
    "defs": ["fx_defs"],
    "norm_all": ["fx_runs", "defs"],
    "latest_all_m1": ["norm_all"], "latest_all_a2": ["norm_all", "latest_all_m1"],
    "latest_all_m2": ["latest_all_a2"], "latest_all": ["latest_all_a2", "latest_all_m2"],
    "slots": ["fx_runs", "defs"],
    "lock_all": ["latest_all", "slots"],
    "ext": ["fx_external"],
    "runs_full": ["fx_runs"],
    "runs_incr": ["fx_runs", "fx_state_old"],
    "norm_incr": ["runs_incr", "defs"],
    "incr_m1": ["norm_incr"], "incr_a2": ["norm_incr", "incr_m1"], "incr_m2": ["incr_a2"],
    "latest_incr": ["incr_a2", "incr_m2"],
    "lock_incr": ["latest_incr", "slots"],
    "new_rows": ["lock_incr", "ext"],
    "merge_in": ["fx_state_old", "new_rows"],
    "merged": ["merge_in"],
    "feed_in": ["fx_state_old", "ext"],
    "fed": ["feed_in"],
}


def _order(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in _DEPS.get(n, []):
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_ctes(needs: list[str], body: str) -> str:
    parts = []
    for n in _order(needs):
        text = FX.get(n) or STEPS[n]
        parts.append(f"{n} as ({text}\n)")
    return "with " + ",\n".join(parts) + "\n" + body


RUN_FLAT = "run_id, job_id, life_cycle_state, result_state, start_time, end_time"
STATE_COLS = "job_id, source, lock, status, pipeline, start_time, end_time"

ORACLES: dict[str, str] = {
    "flatten_definitions": with_ctes(["defs"], "select * from defs"),
    "normalize_runs": with_ctes(["norm_all"], "select * from norm_all"),
    "select_runs_full": with_ctes(["runs_full"], f"select {RUN_FLAT} from runs_full"),
    "select_runs_incremental": with_ctes(["runs_incr"], f"select {RUN_FLAT} from runs_incr"),
    "open_slots": with_ctes(["slots"], "select job_id, max_concurrent_runs, jobs_open from slots"),
    "refresh_active_runs": with_ctes(["fx_runs"], f"""select distinct {RUN_FLAT} from fx_runs
 where life_cycle_state is null or life_cycle_state not in ({TERMINAL})"""),
    "latest_run": with_ctes(["latest_all"], "select * from latest_all"),
    "lock_status": with_ctes(["lock_all"], f"select {STATE_COLS} from lock_all"),
    "normalize_external": with_ctes(["ext"], f"select {STATE_COLS} from ext"),
    "combine_runs": with_ctes(["lock_all", "ext"], f"select {STATE_COLS} from lock_all union all select {STATE_COLS} from ext"),
    "merge_state": with_ctes(["merged"], f"select {STATE_COLS} from merged"),
    "feed_incremental": with_ctes(["fed"], f"select {STATE_COLS} from fed"),
    "state_rewrite": with_ctes(["merged"], f"select {STATE_COLS} from merged"),
}


# ---- cron: brute force over every minute of a window that covers the fixture instants --

def _duck_field(expr: str, lo: int, hi: int) -> str:
    it_a = "cast(split_part(it, '-', 1) as int)"
    it_b = "cast(split_part(split_part(it, '-', 2), '/', 1) as int)"
    it_s = "cast(split_part(it, '/', 2) as int)"
    return f"""list_sort(list_distinct(flatten(list_transform(string_split({expr}, ','), lambda it:
   case when regexp_full_match(it, '\\*') then range({lo}, {hi} + 1)
        when regexp_full_match(it, '\\*/[0-9]+') then range({lo}, {hi} + 1, {it_s})
        when regexp_full_match(it, '[0-9]+') then [cast(it as bigint)]
        when regexp_full_match(it, '[0-9]+-[0-9]+') then range({it_a}, {it_b} + 1)
        when regexp_full_match(it, '[0-9]+-[0-9]+/[0-9]+') then range({it_a}, {it_b} + 1, {it_s})
        when regexp_full_match(it, '[0-9]+/[0-9]+') then range(cast(split_part(it, '/', 1) as int), {hi} + 1, {it_s})
   end))))"""


def _cron_steps(prefix: str, req_sql: str, req_deps: list[str]) -> None:
    STEPS.update({
        f"{prefix}req": req_sql,
        f"{prefix}parsed": f"""
 select cron, tz, {_duck_field("f[1]", 0, 59)} as mi, {_duck_field("f[2]", 0, 23)} as hr,
  {_duck_field("f[3]", 1, 31)} as dm, {_duck_field("f[4]", 1, 12)} as mo,
  list_transform({_duck_field("f[5]", 0, 7)}, lambda x: x % 7) as dw
 from (select distinct cron, tz, string_split(trim(regexp_replace(cron, '\\s+', ' ', 'g')), ' ') as f from {prefix}req)""",
        f"{prefix}fire_list": f"""
 select p.cron, p.tz, g.fire
 from {prefix}parsed p join cron_grid g on p.tz = g.tz
 where list_contains(p.mi, minute(g.w)) and list_contains(p.hr, hour(g.w)) and list_contains(p.dm, day(g.w))
   and list_contains(p.mo, month(g.w)) and list_contains(p.dw, dayofweek(g.w))""",
        f"{prefix}prev": f"""
 select r.cron, r.tz, r.as_of, f.fire as prev_fire from {prefix}req r
 asof left join {prefix}fire_list f on r.cron = f.cron and r.tz = f.tz and r.as_of > f.fire""",
        f"{prefix}next": f"""
 select r.cron, r.tz, r.as_of, f.fire as next_fire from {prefix}req r
 asof left join {prefix}fire_list f on r.cron = f.cron and r.tz = f.tz and r.as_of < f.fire""",
    })
    _DEPS.update({
        f"{prefix}req": req_deps, f"{prefix}parsed": [f"{prefix}req"],
        f"{prefix}fire_list": [f"{prefix}parsed", "cron_grid"], f"{prefix}prev": [f"{prefix}req", f"{prefix}fire_list"],
        f"{prefix}next": [f"{prefix}req", f"{prefix}fire_list"],
    })


# every UTC minute with the local time it is in each zone
STEPS["cron_grid"] = """
 select tz, m as fire, timezone(tz, to_timestamp(m)) as w
 from (select unnest(range(1693526400, 1717200000, 60)) as m), (select unnest(['UTC', 'US/Eastern', 'Asia/Tokyo']) as tz)"""
_DEPS["cron_grid"] = []
_cron_steps("cron_", """
 select distinct cron, tz, as_of from (
  select d.cron, d.tz, unnest([s.at, s.at + s.shift]) as as_of
  from (select job_id, cast(floor(start_time / 1000.0) as bigint) as at,
          case when run_id % 2 = 0 then 45 else -75 end * 86400 as shift from fx_runs) s
  join (select job_id, coalesce(cron, '* * * * *') as cron,
          case when coalesce(spec, 'None') <> 'None' then 'US/Eastern' else coalesce(tz, 'UTC') end as tz
        from fx_defs where state is not null) d on s.job_id = d.job_id)""", ["fx_runs", "fx_defs"])
_cron_steps("pcron_", f"select distinct cron, tz, cast({AS_OF} as bigint) as as_of from defs", ["defs"])

STEPS.update({
    # fiscal bounds
    "fis_inst": "select distinct cast(floor(epoch(o_orderdate)) as bigint) + 43200 as as_of from orders",
    "fis_row": """
 select i.as_of,
  case when c.FCL_DAY_OF_PER_C < 3 then c.FCL_PER_INDEX - 1 else c.FCL_PER_INDEX end as pi,
  case when c.FCL_DAY_OF_QTR_C < 3 then c.FCL_QTR_INDEX - 1 else c.FCL_QTR_INDEX end as qi,
  c.FCL_PER_BGN_DT as pb, c.FCL_QTR_BGN_DT as qb
 from fis_inst i left join fx_calendar c on c.CLDR_DT = cast(timezone('US/Eastern', to_timestamp(i.as_of)) as date)""",
    "fis": """
 select r.as_of,
  cast(epoch(timezone('US/Eastern', cast(r.pb as timestamp))) as bigint) as fcl_per_start_time,
  (select cast(epoch(timezone('US/Eastern', cast(min(c.CLDR_DT) as timestamp))) as bigint) from fx_calendar c
    where c.FCL_PER_INDEX = r.pi and c.FCL_DAY_OF_PER_C = 3) as fcl_per_first_mon,
  cast(epoch(timezone('US/Eastern', cast(r.qb as timestamp))) as bigint) as fcl_qtr_start_time,
  (select cast(epoch(timezone('US/Eastern', cast(min(c.CLDR_DT) as timestamp))) as bigint) from fx_calendar c
    where c.FCL_QTR_INDEX = r.qi and c.FCL_DAY_OF_QTR_C = 3) as fcl_qtr_first_mon
 from fis_row r""",
})
_DEPS.update({
    "fis_inst": [], "fis_row": ["fis_inst", "fx_calendar"], "fis": ["fis_row", "fx_calendar"],
})
ORACLES.update({
    "cron_fires": with_ctes(["cron_prev", "cron_next"], """
 select p.cron, p.tz, p.as_of, p.prev_fire, n.next_fire, true as valid
 from cron_prev p join cron_next n on p.cron = n.cron and p.tz = n.tz and p.as_of = n.as_of
 union all
 select distinct case s_suppkey % 4 when 0 then 'every day' when 1 then '61 * * * *' else '0 6 * * *' end,
  case s_suppkey % 4 when 2 then '+930' when 3 then '+18:30' else 'UTC' end, 1706600000 + s_suppkey * 60,
  null, null, false from supplier"""),
    "fiscal_bounds": with_ctes(["fis"], "select * from fis"),
})


# ---- readiness pass at the fixture instant -------------------------------------------

OWN_RULE = """(last_start_time < prev_min_exec_time)
   and (spec = 'None' or (spec = 'fy_per_d1' and last_start_time < prev_fcl_per_start_time)
        or (spec = 'fy_per_1st_monday' and last_start_time < prev_fcl_per_first_mon)
        or (spec = 'fy_qtr_d1' and last_start_time < prev_fcl_qtr_start_time)
        or (spec = 'fy_qtr_1st_monday' and last_start_time < prev_fcl_qtr_first_mon))
   and lock_flag = 0 and (pipeline_status is null or pipeline_status <> 'FAILED' or onfail = 'pass')
   and state = 'active'"""
BOUNDS = "prev_min_exec_time, next_min_exec_time, prev_fcl_per_start_time, prev_fcl_per_first_mon, " \
         "prev_fcl_qtr_start_time, prev_fcl_qtr_first_mon"

STEPS.update({
    "pfis_row": f"""
 select i.as_of,
  case when c.FCL_DAY_OF_PER_C < 3 then c.FCL_PER_INDEX - 1 else c.FCL_PER_INDEX end as pi,
  case when c.FCL_DAY_OF_QTR_C < 3 then c.FCL_QTR_INDEX - 1 else c.FCL_QTR_INDEX end as qi,
  c.FCL_PER_BGN_DT as pb, c.FCL_QTR_BGN_DT as qb
 from (select cast({AS_OF} as bigint) as as_of) i
 left join fx_calendar c on c.CLDR_DT = cast(timezone('US/Eastern', to_timestamp(i.as_of)) as date)""",
    "pfis": STEPS["fis"].replace("from fis_row r", "from pfis_row r"),
    "itin": """
 select d.*, cp.prev_fire as prev_min_exec_time, cn.next_fire as next_min_exec_time,
  f.fcl_per_start_time as prev_fcl_per_start_time, f.fcl_per_first_mon as prev_fcl_per_first_mon,
  f.fcl_qtr_start_time as prev_fcl_qtr_start_time, f.fcl_qtr_first_mon as prev_fcl_qtr_first_mon
 from defs d left join pcron_prev cp on d.cron = cp.cron and d.tz = cp.tz
 left join pcron_next cn on d.cron = cn.cron and d.tz = cn.tz cross join pfis f""",
    "own": """
 select i.*, s.source, coalesce(try_cast(s.lock as int), 0) as lock_flag, s.status as pipeline_status,
  coalesce(s.start_time, cast(floor(i.created_time / 1000.0) as bigint)) as last_start_time,
  coalesce(s.end_time, 0) as last_end_time
 from itin i left join merged s on trim(i.pipeline) = s.pipeline""",
    "items": """
 select job_id, 'trigger' as kind, unnest(string_split(tdep, ',')) as dependency from itin where tdep is not null
 union all select job_id, 'status' as kind, unnest(string_split(sdep, ',')) as dependency from itin where sdep is not null
 union all select job_id, 'completed' as kind, unnest(string_split(cdep, ',')) as dependency from itin where cdep is not null""",
    "edges": """
 select it.job_id, it.kind, it.dependency, s.source, s.start_time as dep_start_time, s.end_time as dep_end_time,
  s.status as dep_status
 from items it left join merged s on trim(it.dependency) = s.pipeline where it.dependency <> ''""",
    "decisions": f"""
 select cast({AS_OF} as bigint) as as_of, job_id, pipeline, state, 'own' as row_kind, lock_flag, pipeline_status, tz, spec, onfail, last_start_time,
  last_end_time, {BOUNDS}, cast(null as varchar) as dependency, source, cast(null as bigint) as dep_start_time,
  cast(null as bigint) as dep_end_time, cast(null as varchar) as dep_status,
  case when {OWN_RULE} then 0 else 1 end as readiness
 from own
 union all
 select cast({AS_OF} as bigint) as as_of, e.job_id, i.pipeline, i.state, e.kind as row_kind, cast(null as int) as lock_flag,
  cast(null as varchar) as pipeline_status, i.tz, i.spec, i.onfail, m.mx as last_start_time,
  cast(null as bigint) as last_end_time, i.prev_min_exec_time, i.next_min_exec_time, i.prev_fcl_per_start_time,
  i.prev_fcl_per_first_mon, i.prev_fcl_qtr_start_time, i.prev_fcl_qtr_first_mon,
  e.dependency, e.source, e.dep_start_time, e.dep_end_time, e.dep_status,
  case when e.kind = 'trigger' and m.mx < e.dep_end_time and e.dep_status = 'SUCCESS' then 0
       when e.kind = 'status' and e.dep_status = 'SUCCESS' then 0
       when e.kind = 'completed' and m.mx < e.dep_end_time then 0 else 1 end as readiness
 from edges e join itin i on e.job_id = i.job_id
 join (select job_id, max(last_start_time) as mx from own group by job_id) m on e.job_id = m.job_id""",
    "ready": f"""
 select i.job_id from itin i
 where not exists (select 1 from own o where o.job_id = i.job_id and not coalesce({OWN_RULE.replace("last_start_time", "o.last_start_time")}, false))
   and not exists (select 1 from own o join edges e on o.job_id = e.job_id where o.job_id = i.job_id
                   and e.kind = 'trigger' and not coalesce(o.last_start_time < e.dep_end_time and e.dep_status = 'SUCCESS', false))
   and not exists (select 1 from edges e where e.job_id = i.job_id and e.kind = 'status'
                   and not coalesce(e.dep_status = 'SUCCESS', false))
   and not exists (select 1 from own o join edges e on o.job_id = e.job_id where o.job_id = i.job_id
                   and e.kind = 'completed' and not coalesce(o.last_start_time < e.dep_end_time, false))""",
})
_DEPS.update({
    "pfis_row": ["fx_calendar"], "pfis": ["pfis_row", "fx_calendar"],
    "itin": ["defs", "pcron_prev", "pcron_next", "pfis"],
    "own": ["itin", "merged"], "items": ["itin"], "edges": ["items", "merged"],
    "decisions": ["own", "edges", "itin"], "ready": ["itin", "own", "edges"],
})
# every combination, by joins of whole lists; blank items stay in the product as null dependencies
STEPS["titems"] = """
 select it.job_id, it.kind, it.dependency, s.start_time, s.end_time, s.status
 from items it left join merged s on trim(it.dependency) = s.pipeline"""
STEPS["wide"] = f"""
 select cast({AS_OF} as bigint) as as_of, o.job_id, o.pipeline, o.state, o.lock_flag, o.pipeline_status, o.tz, o.spec, o.onfail,
  o.last_start_time, o.last_end_time, {BOUNDS}, nullif(t.dependency, '') as trigger_dependency, t.start_time as tdep_start_time,
  t.end_time as tdep_end_time, t.status as tdep_status, nullif(s.dependency, '') as status_dependency, s.status as sdep_status,
  nullif(c.dependency, '') as completed_dependency, c.start_time as cdep_start_time, c.end_time as cdep_end_time
 from own o
 left join (select * from titems where kind = 'trigger') t on t.job_id = o.job_id
 left join (select * from titems where kind = 'status') s on s.job_id = o.job_id
 left join (select * from titems where kind = 'completed') c on c.job_id = o.job_id"""
_DEPS.update({"titems": ["items", "merged"], "wide": ["own", "titems"]})
ORACLES["readiness_product"] = with_ctes(["wide"], f"""
 select *, case when {OWN_RULE} and (trigger_dependency is null or (last_start_time < tdep_end_time and tdep_status = 'SUCCESS'))
   and (status_dependency is null or sdep_status = 'SUCCESS')
   and (completed_dependency is null or last_start_time < cdep_end_time) then 0 else 1 end as readiness,
  '2024-01-31' as log_date, cast({AS_OF} as bigint) as log_time
 from wide""")

# the same rules at many instants: requests in place of the one instant
_cron_steps("dcron_", "select distinct d.cron, d.tz, r.as_of from dreq r join defs d on d.job_id = r.job_id", ["dreq", "defs"])
STEPS.update({
    "dreq": "select distinct job_id, (cast(floor(start_time / 86400000.0) as bigint) + 20) * 86400 + 43200 as as_of from fx_runs",
    "dfis_row": STEPS["fis_row"].replace("from fis_inst i", "from (select distinct as_of from dreq) i"),
    "dfis": STEPS["fis"].replace("from fis_row r", "from dfis_row r"),
    "ditin": """
 select d.*, r.as_of, cp.prev_fire as prev_min_exec_time, f.fcl_per_start_time as prev_fcl_per_start_time,
  f.fcl_per_first_mon as prev_fcl_per_first_mon, f.fcl_qtr_start_time as prev_fcl_qtr_start_time,
  f.fcl_qtr_first_mon as prev_fcl_qtr_first_mon
 from dreq r join defs d on d.job_id = r.job_id
 left join dcron_prev cp on d.cron = cp.cron and d.tz = cp.tz and r.as_of = cp.as_of left join dfis f on r.as_of = f.as_of""",
    "down": STEPS["own"].replace("from itin i", "from ditin i"),
})
_DEPS.update({
    "dreq": ["fx_runs"], "dfis_row": ["dreq", "fx_calendar"], "dfis": ["dfis_row", "fx_calendar"],
    "ditin": ["dreq", "defs", "dcron_prev", "dfis"], "down": ["ditin", "merged"],
})
ORACLES["decide_at"] = with_ctes(["down", "edges"], f"""
 select job_id, as_of, cast(count(*) as bigint) as decision_rows, cast(sum(fails) as bigint) as failed_rows from (
  select job_id, as_of, case when {OWN_RULE} then 0 else 1 end as fails from down
  union all
  select m.job_id, m.as_of, case when coalesce(case e.kind when 'trigger' then m.mx < e.dep_end_time and e.dep_status = 'SUCCESS'
    when 'status' then e.dep_status = 'SUCCESS' else m.mx < e.dep_end_time end, false) then 0 else 1 end
  from edges e join (select job_id, as_of, max(last_start_time) as mx from down group by job_id, as_of) m on e.job_id = m.job_id)
 group by job_id, as_of""")
DECISION_COLS = ("as_of, job_id, pipeline, state, row_kind, lock_flag, pipeline_status, tz, spec, onfail, last_start_time, "
                 f"last_end_time, {BOUNDS}, dependency, source, dep_start_time, dep_end_time, dep_status, readiness")
ORACLES.update({
    "dependency_edges": with_ctes(["edges"], "select job_id, kind, dependency, source, dep_start_time, dep_end_time, dep_status from edges"),
    "readiness_rows": with_ctes(["decisions"], f"select {DECISION_COLS} from decisions"),
    "ready_jobs": with_ctes(["ready"], f"select job_id, cast({AS_OF} as bigint) as as_of from ready"),
})


# ---- logs and outcomes ----------------------------------------------------------------

FX["fx_invocations"] = f"""
 select {SEC} * 1000 as start_time, ({SEC} + event_id % 7200) * 1000 as end_time, '4242' as conductor_job_id,
  cast(user_id as varchar) as conductor_job_run_id, case when event_id % 2 = 0 then 'db' else 'adf' end as job_type,
  concat('job_', cast(user_id as varchar)) as job_name, cast(event_id as varchar) as job_run_id,
  case when event_type = 'view' then 'false' else 'true' end as wait_on_completion, props as parameters
 from events"""
STEPS["outcome_in"] = """
 select 'db' as system, cast(run_id as varchar) as run_key, life_cycle_state as state, result_state as result from fx_runs
 union all
 select 'ADF' as system, pipeline as run_key,
  case when lock = 1 then 'InProgress' when status = 'FAILED' then 'Failed' when status = 'SUCCESS' then 'Succeeded'
       else 'Cancelled' end as state, cast(null as varchar) as result
 from fx_external"""
_DEPS["outcome_in"] = ["fx_runs", "fx_external"]
ORACLES.update({
    "decision_log": with_ctes(["decisions"], f"""
 select {DECISION_COLS}, '2024-01-31' as log_date, cast({AS_OF} as bigint) as log_time from decisions"""),
    "invocation_log": with_ctes(["fx_invocations"], """
 select *, strftime(epoch_ms(start_time), '%Y%m') as yyyymm from fx_invocations"""),
    "expire_log": with_ctes(["fx_runs"], f"""
 select run_id, job_id, cast(floor(start_time / 1000.0) as bigint) as log_time from fx_runs
 where cast(floor(start_time / 1000.0) as bigint) * 1000 > {AS_OF * 1000 - 10 * 86400 * 1000}"""),
    "expire_files": with_ctes(["fx_runs"], f"""
 select run_id, job_id, start_time, strftime(epoch_ms(start_time), '%Y-%m-%d') as day from fx_runs
 where (start_time // 86400000 + 1) * 86400000 > {AS_OF * 1000 - 10 * 86400 * 1000}"""),
    "classify_outcome": with_ctes(["outcome_in"], f"""
 select system, run_key, state, result,
  case when lower(system) = 'db' then coalesce(state in ({TERMINAL}), false)
       when lower(system) = 'adf' then coalesce(state in ('Succeeded', 'Failed', 'Cancelled'), false) end as terminal,
  case when lower(system) = 'db' then coalesce(state in ({TERMINAL}), false) and coalesce(result <> 'SUCCESS', true)
       when lower(system) = 'adf' then coalesce(state = 'Failed', false) end as failed
 from outcome_in"""),
})
ORACLES["readiness_pass"] = ORACLES["ready_jobs"]
ORACLES["run_log_selection"] = ORACLES["select_runs_incremental"]
ORACLES["invocation_compaction"] = ORACLES["invocation_log"]
ORACLES["quarantine"] = f"""
 with w as (select event_id, user_id, {SEC} * 1000 as ms,
   concat('{{"run_id":', event_id, case when event_id % 13 = 0 then '' else concat(',"job_id":', user_id) end,
    ',"state":{{"life_cycle_state":"TERMINATED","result_state":"SUCCESS"}},"start_time":',
    case when event_id % 17 = 0 then '"soon"' else cast({SEC} * 1000 as varchar) end, '}}') as whole from events),
 l as (select *, case when event_id % 11 = 0 then substring(whole, 1, cast(12 + event_id % 50 as int)) else whole end as line,
   case when event_id % 11 = 0 then 'not json' when event_id % 17 = 0 then 'wrong type' when event_id % 13 = 0 then 'missing job_id'
        else 'good' end as reason from w)
 select case when reason = 'good' then event_id end as run_id, case when reason = 'good' then user_id end as job_id,
  case when reason = 'good' then ms end as start_time, case when reason <> 'good' then line end as line, reason from l"""


# ---- stream: one batch per week of run starts, folded column-wise ---------------------

STEPS.update({
    "sb": """
 select r.*, dense_rank() over (order by date_trunc('week', epoch_ms(r.start_time))) as k from fx_runs r""",
    "sn": """
 select s.job_id, 'azure_databricks' as source, s.life_cycle_state as state,
  coalesce(s.result_state, s.life_cycle_state) as status, d.pipeline,
  cast(floor(s.start_time / 1000.0) as bigint) as start_time, cast(floor(s.end_time / 1000.0) as bigint) as end_time, s.k
 from sb s join defs d on s.job_id = d.job_id""",
    "sm1": "select job_id, k, max(end_time) as mx from sn group by job_id, k",
    "sa2": "select n.* from sn n join sm1 m on n.job_id = m.job_id and n.k = m.k and n.end_time = m.mx",
    "sm2": "select job_id, k, max(start_time) as ms from sa2 group by job_id, k",
    "slat": "select distinct a.* from sa2 a join sm2 m on a.job_id = m.job_id and a.k = m.k and a.start_time = m.ms",
    "sact": f"""
 select b.k, r.job_id, count(distinct r.run_id) as c
 from (select distinct k from sb) b join sb r on r.k <= b.k
 where r.life_cycle_state is null or r.life_cycle_state not in ({TERMINAL})
 group by b.k, r.job_id""",
    "sslots": """
 select a.k, a.job_id, d.max_concurrent_runs - least(a.c, d.max_concurrent_runs) as jobs_open
 from sact a join defs d on a.job_id = d.job_id where d.max_concurrent_runs > 1""",
    "srows": f"""
 select distinct l.k, l.job_id, l.source,
  case when s.jobs_open > 0 then '0' when l.state in ({TERMINAL}) then '0' else '1' end as lock,
  case when l.state in ({TERMINAL}) then l.status else l.state end as status, l.pipeline, l.start_time, l.end_time
 from slat l left join sslots s on s.k = l.k and s.job_id = l.job_id""",
    "sall": f"""
 select k, job_id, source, lock, status, pipeline, start_time, end_time from srows
 union all
 select b.k, e.job_id, e.source, e.lock, e.status, e.pipeline, e.start_time, e.end_time
 from (select distinct k from sb) b, ext e""",
    "sfinal": _merged("start_time", "end_time", "k", "sall"),
})
_DEPS.update({
    "sb": ["fx_runs"], "sn": ["sb", "defs"], "sm1": ["sn"], "sa2": ["sn", "sm1"], "sm2": ["sa2"],
    "slat": ["sa2", "sm2"], "sact": ["sb"], "sslots": ["sact", "defs"], "srows": ["slat", "sslots"],
    "sall": ["srows", "sb", "ext"], "sfinal": ["sall"],
})
ORACLES["readiness_stream"] = with_ctes(["sfinal"], f"select {STATE_COLS} from sfinal")
