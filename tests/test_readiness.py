"""Dependency edges, decision rows and the gate (rules R1-R9, quirks Q10-Q12)."""

import random

from conftest import rows
from helpers import raw_defs, state_df
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from runready.operators import definitions, dependencies, fiscal, readiness, schedule
from runready.sources import fixtures as fx

AS_OF = 1706702400           # 2024-01-31 12:00:00 UTC; '* * * * *' last fired at 11:59
START = 1706000000
UP = [(90, "p", "0", "SUCCESS", "up_ok", 1706400000, 1706500000),
      (91, "p", "0", "SUCCESS", "up_old", 1704000000, 1705000000),
      (92, "p", "0", "FAILED", "up_failed", 1706400000, 1706500000),
      (93, "p", "0", "SUCCESS", "up_two", 1706400000, 1706500000),
      (94, "q", "0", "FAILED", "up_two", 1706400000, 1706500000)]


def _pass(spark, jobs, own_state):
    defs = definitions.flatten_definitions(raw_defs(spark, jobs))
    fires = schedule.cron_fires(defs, as_of=AS_OF)
    bounds = fiscal.fiscal_bounds_at(fx.fx_calendar(spark), AS_OF)
    itin = dependencies.itinerary(defs, fires, bounds, as_of=AS_OF)
    dec = readiness.readiness_rows(itin, state_df(spark, UP + own_state))
    return dec, {r[0] for r in rows(readiness.ready_jobs(dec))}


def test_each_rule_blocks_alone(spark):
    jobs, own = [], []

    def job(i, state_row=True, lock="0", status="SUCCESS", start=START, **tags):
        name = f"job{i}"
        jobs.append({"job_id": i, "name": name, "state": tags.pop("state", "active"), **tags})
        if state_row:
            own.append((i, "p", lock, status, name, start, start + 60))

    job(1)                                                          # baseline: ready
    job(2, cron="0 0 1 1 *")                                        # R1: already ran since the last fire
    job(3, spec="fy_per_d1", start=1705800000)                      # R2: ran since period start
    job(4, spec="fy_per_d1", start=1705000000)                      # R2 holds
    job(5, spec="fy_per_1st_monday", start=1705800000)              # before period day 3: ready
    job(6, spec="fy_qtr_1st_monday", start=1703500000)              # after quarter day 3: blocked
    job(7, tdep="up_ok")                                            # R3 holds
    job(8, tdep="up_old")                                           # R3: upstream ended before our start
    job(9, tdep="up_failed")                                        # R3: upstream failed
    job(10, sdep="up_failed")                                       # R4
    job(11, sdep="up_old")                                          # R4 holds (no time condition)
    job(12, cdep="up_failed")                                       # R5 holds (any status)
    job(13, cdep="up_old")                                          # R5
    job(14, lock="1")                                               # R6
    job(15, status="FAILED")                                        # R7 hold
    job(16, status="FAILED", onfail="pass")                         # R7 pass
    job(17, status="CANCELED")                                      # Q12: not FAILED
    job(18, state="paused")                                         # R8
    job(19, tdep="nobody")                                          # unknown upstream blocks
    job(20, tdep="up_ok", tdep2="up_old")                           # two upstreams, one fails
    job(21, state_row=False, created_time=1600000000000)            # never ran: creation time
    job(22, spec="none")                                            # Q10: never ready
    job(23, tdep="up_ok,,up_ok")                                    # Q11: blank item passes
    job(24, tdep=" ")                                               # Q11: whitespace item blocks
    job(25, tdep=" up_ok")                                          # names are trimmed
    job(26, sdep="up_two")                                          # upstream under two sources: both count
    job(27, spec="bogus")                                           # unknown fiscal rule
    own.append((28, "q", "1", "RUNNING", "job28", START, START))   # own name under two sources
    job(28)
    job(29, cron="not a cron")                                      # Q15: bad cron blocks this job only
    job(30, tz="Not/AZone")                                         # Q15: unknown zone blocks this job only
    job(31, cron="0 0 31 2 *")                                      # never fires: no previous fire
    dec, ready = _pass(spark, jobs, own)
    assert ready == {1, 4, 5, 7, 11, 12, 16, 17, 21, 23, 25}
    bad = {r.job_id: r.prev_min_exec_time for r in dec.where("job_id in (29, 30, 31)").collect()}
    assert bad == {29: None, 30: None, 31: None}


def test_decision_rows_are_own_plus_edges(spark):
    jobs = [{"job_id": 1, "name": "job1", "state": "active", "tdep": "up_ok,up_old", "sdep": "up_two",
             "cdep": "up_ok,,"}]
    dec, ready = _pass(spark, jobs, [(1, "p", "0", "SUCCESS", "job1", START, START + 1)])
    kinds = sorted((r["row_kind"], r["dependency"], r["source"], r["readiness"]) for r in dec.collect())
    assert kinds == [("completed", "up_ok", "p", 0), ("own", None, "p", 0), ("status", "up_two", "p", 0),
                     ("status", "up_two", "q", 1), ("trigger", "up_ok", "p", 0), ("trigger", "up_old", "p", 1)]
    assert ready == set()


# ---- property: the factored gate equals the reference's product form ------------------

NAMES = ["a", "b", "c", " a", "", "zz"]
ITIN = T.StructType([T.StructField(n, t) for n, t in [
    ("as_of", T.LongType()), ("job_id", T.LongType()), ("created_time", T.LongType()), ("pipeline", T.StringType()),
    ("state", T.StringType()), ("tz", T.StringType()), ("spec", T.StringType()), ("onfail", T.StringType()),
    ("tdep", T.StringType()), ("sdep", T.StringType()), ("cdep", T.StringType()),
    ("prev_min_exec_time", T.LongType()), ("next_min_exec_time", T.LongType()),
    ("prev_fcl_per_start_time", T.LongType()), ("prev_fcl_per_first_mon", T.LongType()),
    ("prev_fcl_qtr_start_time", T.LongType()), ("prev_fcl_qtr_first_mon", T.LongType())]])


def _lt(a, b):
    return a is not None and b is not None and a < b


def product_gate(itin, state):
    """The reference's rule, literally: explode every list, join everything, all rows must pass."""
    def match(name):
        found = [s for s in state if name is not None and s[4] == name.strip()]
        return found or [None]

    def items(lst):
        return [None if x == "" else x for x in (lst.split(",") if lst is not None else [""])]

    ready = set()
    for j in itin:
        (_at, jid, created, pipe, st_, _tz, spec, onfail, tdep, sdep, cdep, pm, _nm, ps, pf, qs, qf) = j
        ok = True
        for r in match(pipe):
            lock = r[2] if r else None
            lock_flag = int(lock) if lock is not None and lock.strip().lstrip("-").isdigit() else 0
            status = r[3] if r else None
            ls = r[5] if r and r[5] is not None else (created // 1000 if created is not None else None)
            own = (_lt(ls, pm)
                   and (spec == "None" or (spec == "fy_per_d1" and _lt(ls, ps)) or (spec == "fy_per_1st_monday" and _lt(ls, pf))
                        or (spec == "fy_qtr_d1" and _lt(ls, qs)) or (spec == "fy_qtr_1st_monday" and _lt(ls, qf)))
                   and lock_flag == 0 and (status is None or status != "FAILED" or onfail == "pass")
                   and st_ == "active")
            for t in items(tdep):
                for tr in match(t):
                    for s in items(sdep):
                        for sr in match(s):
                            for c in items(cdep):
                                for cr in match(c):
                                    row = (own
                                           and (t is None or (tr is not None and _lt(ls, tr[6]) and tr[3] == "SUCCESS"))
                                           and (s is None or (sr is not None and sr[3] == "SUCCESS"))
                                           and (c is None or (cr is not None and _lt(ls, cr[6]))))
                                    ok = ok and bool(row)
        if ok:
            ready.add(jid)
    return ready


def _random_case(seed):
    rnd = random.Random(seed)

    def pick(xs):
        return rnd.choice(xs)

    def dep_list():
        if rnd.random() < 0.4:
            return None
        return ",".join(pick(NAMES) for _ in range(rnd.randint(1, 3)))

    state = [(i, pick(["p", "q"]), pick(["0", "0", "1", None, "x"]), pick(["SUCCESS", "SUCCESS", "FAILED", "RUNNING", None]),
              pick(NAMES[:4] + ["zz"]), pick([None, 5, 10, 15, 20]), pick([None, 8, 12, 18, 25]))
             for i in range(rnd.randint(0, 9))]
    itin = [(100, j, pick([None, 3000, 9000, 30000]), pick(NAMES), pick(["active", "active", "paused"]), "UTC",
             pick(["None", "None", "fy_per_d1", "fy_qtr_1st_monday", "none"]), pick(["hold", "pass"]),
             dep_list(), dep_list(), dep_list(), pick([14, 30, None]), 40, pick([9, 30]), 11, 16, pick([2, 21]))
            for j in range(rnd.randint(1, 25))]
    return itin, state


@settings(max_examples=12, deadline=None)
@given(st.integers(min_value=0, max_value=10**6), st.sampled_from(["shuffle", "split", "broadcast"]))
def test_factored_gate_equals_product_form(spark, seed, lookup):
    itin, state = _random_case(seed)
    idf = spark.createDataFrame(itin, ITIN)
    sdf = state_df(spark, state)
    kwargs = {"shuffle": {}, "split": {"hot_rows": 2}, "broadcast": {"state_rows": len(state)}}[lookup]
    got = {r[0] for r in rows(readiness.ready_jobs(readiness.readiness_rows(idf, sdf, **kwargs)))}
    assert got == product_gate(itin, state)


def test_decide_at_many_instants_equals_scalar_passes(spark):
    from pyspark.sql import functions as F

    from runready.plans.readiness_pass import decide, decide_at
    jobs = [{"job_id": i, "name": f"job{i}", "state": "active", "cron": c, "spec": sp, "tdep": td}
            for i, (c, sp, td) in enumerate([("0 6 * * *", None, None), ("*/15 * * * *", "fy_per_d1", None),
                                              ("30 2 1 * *", None, "up_ok"), ("0 0 * * 1", "fy_qtr_1st_monday", "up_old"),
                                              (None, None, "up_ok,up_two")], start=1)]
    own = [(i, "p", "0", "SUCCESS", f"job{i}", START - 40000 * i, START) for i in range(1, 6)]
    defs = raw_defs(spark, jobs)
    st_ = state_df(spark, UP + own)
    cal = fx.fx_calendar(spark)
    instants = [AS_OF, AS_OF - 3 * 86400, AS_OF - 10 * 86400]
    req = spark.createDataFrame([(j["job_id"], t) for j in jobs for t in instants], "job_id long, as_of long")
    many = rows(readiness.ready_jobs(decide_at(spark, defs, cal, st_, req)))
    one = sorted(r for t in instants for r in rows(readiness.ready_jobs(decide(spark, defs, cal, st_, t))))
    assert many == one and len({r[1] for r in many}) >= 2
    dec = decide_at(spark, defs, cal, st_, req)
    assert dec.select("as_of").distinct().count() == 3 and dec.where(F.col("prev_min_exec_time").isNull()).count() == 0


def test_lookup_join_split_equals_plain_join(spark):
    """Beyond the broadcast budget, hot keys take a broadcast of their own rows: same result."""
    from pyspark.sql import functions as F

    from runready.functions.joins import lookup_join
    left = spark.createDataFrame([(i, k) for i, k in enumerate(["hot"] * 40 + ["a", "b", " hot", None, "zz"] * 3)],
                                 "id long, name string")
    right = spark.createDataFrame([("hot", "p", 1), ("hot", "q", 2), ("a", "p", 3), ("b", "p", 4)],
                                  "rk string, src string, v long")
    plain = left.join(right, F.trim(F.col("name")) == F.col("rk"), "left")
    split = lookup_join(left, right, F.trim(F.col("name")), "rk", right_rows=None, hot_rows=10)
    bcast = lookup_join(left, right, F.trim(F.col("name")), "rk", right_rows=4)
    assert rows(split, "id", "rk", "src", "v") == rows(plain, "id", "rk", "src", "v") == rows(bcast, "id", "rk", "src", "v")
    assert len(rows(split, "id")) == 40 * 2 + 3 * 3 + 3 * 2 + 3   # hot x2 sources, ' hot' trims to hot


def test_many_instant_itinerary_paths_agree(spark):
    """Broadcast, hot-key split and plain joins give the same itinerary for shared instants."""
    from runready.operators import definitions
    defs = definitions.flatten_definitions(raw_defs(spark, [
        {"job_id": i, "name": f"j{i}", "state": "active", "cron": ["0 6 * * *", None][i % 2]} for i in range(1, 13)]))
    req = spark.createDataFrame([(i, AS_OF - 86400 * (i % 3)) for i in range(1, 13)], "job_id long, as_of long")
    jobs = defs.join(req, "job_id").checkpoint()
    fires = schedule.cron_fires(jobs).checkpoint()
    bounds = fiscal.fiscal_bounds(fx.fx_calendar(spark), req.select("as_of")).checkpoint()
    cols = ["job_id", "as_of", "prev_min_exec_time", "next_min_exec_time", "prev_fcl_per_start_time",
            "prev_fcl_qtr_first_mon"]
    plain = rows(dependencies.itinerary(jobs, fires, bounds), *cols)
    bcast = rows(dependencies.itinerary(jobs, fires, bounds, fires_rows=fires.count(), bounds_rows=bounds.count()),
                 *cols)
    split = rows(dependencies.itinerary(jobs, fires, bounds, fires_rows=10**12, bounds_rows=10**12, hot_rows=2),
                 *cols)
    assert plain == bcast == split and len(plain) == 12 and all(r[2] is not None for r in plain)


# ---- product form ----------------------------------------------------------------------

def _product_rows(itin, state):
    """The wide rows, literally: explode every list, join everything."""
    def match(name):
        return [s for s in state if name is not None and s[4] == name.strip()] or [None]

    def items(lst):
        return [None] if lst is None else lst.split(",")

    out = []
    for j in itin:
        for r in match(j[3]):
            for t in items(j[8]):
                for tr in match(t):
                    for s in items(j[9]):
                        for sr in match(s):
                            for c in items(j[10]):
                                for cr in match(c):
                                    out.append((j[1], r and r[1], t or None, tr and tr[5], tr and tr[6], tr and tr[3],
                                                s or None, sr and sr[3], c or None, cr and cr[5], cr and cr[6]))
    return out


WIDE = ["trigger_dependency", "tdep_start_time", "tdep_end_time", "tdep_status", "status_dependency", "sdep_status",
        "completed_dependency", "cdep_start_time", "cdep_end_time"]


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=0, max_value=10**6), st.sampled_from([1, 2, 20_000]), st.booleans())
def test_product_rows_equal_the_literal_product(spark, seed, piece, broadcast):
    from collections import Counter

    from runready.operators import product
    itin, state = _random_case(seed)
    idf, sdf = spark.createDataFrame(itin, ITIN), state_df(spark, state)
    wide = product.readiness_product(idf, sdf, len(state) if broadcast else None, hot_rows=2, piece=piece)
    got = Counter((r["job_id"], *[r[c] for c in WIDE]) for r in wide.collect())
    assert got == Counter((x[0], *x[2:]) for x in _product_rows(itin, state))
    gate = {r[0] for r in rows(readiness.ready_jobs(wide))}
    assert gate == {r[0] for r in rows(readiness.ready_jobs(readiness.readiness_rows(idf, sdf)))} == product_gate(itin, state)


def test_a_large_product_is_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    from runready.operators import product
    names = [f"up{k}" for k in range(40)]
    state = state_df(spark, [(k, "p", "0", "SUCCESS", n, 5, 50) for k, n in enumerate(names)])
    lists = ",".join(names)
    itin = [(100, 1, 3000, "big", "active", "UTC", "None", "hold", lists, lists, lists, 14, 40, 9, 11, 16, 2)]
    itin += [(100, j, 3000, f"small{j}", "active", "UTC", "None", "hold", "up1", None, "", 14, 40, 9, 11, 16, 2) for j in range(2, 30)]
    wide = product.readiness_product(spark.createDataFrame(itin, ITIN), state, piece=1000)
    assert wide.count() == 40 ** 3 + 28
    a_task = wide.where("job_id = 1").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert a_task <= 40 ** 3 / 2                           # 64 pieces dealt over the shuffle partitions


def test_pass_with_a_wide_log(spark, tmp_path):
    from runready.operators import logs
    from runready.plans.readiness_pass import readiness_pass
    sf = "/root/testdata/sf0.001"
    ready = {}
    for shape in ("factored", "product"):
        got = readiness_pass(spark, fx.fx_defs(spark, sf), fx.fx_runs(spark, sf), fx.fx_calendar(spark), str(tmp_path / shape / "s"),
                             str(tmp_path / shape / "l"), fx.AS_OF, external=fx.fx_external(spark, sf), log_shape=shape)
        ready[shape] = rows(got.ready)
    assert ready["factored"] == ready["product"] and ready["product"]
    log = logs.read_decision_log(spark, str(tmp_path / "product" / "l"), shape="product")
    assert log.columns[1] == "job_id" and len(log.columns) == 29 and log.count() > 0
