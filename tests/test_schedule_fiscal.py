"""O2 cron_fires against a brute-force minute scan; O3 fiscal_bounds on period/quarter edges."""

import datetime as dt
import zoneinfo

from hypothesis import given, settings
from hypothesis import strategies as st

from runready.operators import fiscal, schedule
from runready.sources import fixtures as fx

CRONS = ["* * * * *", "*/15 * * * *", "0 6 * * *", "30 2 1 * *", "0 0 * * 1", "5,35 9-17/2 * * MON-FRI",
         "0 12 29 2 *", "0 0 * JAN,JUL SUN", "15 3 * * 7", "10/20 1 * * *", "0 0 31 2 *", "bad", "0 0 * *",
         "61 * * * *", "5-1 * * * *"]
ZONES = ["UTC", "US/Eastern", "Asia/Tokyo", "Not/AZone"]
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
DAYS = ["SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"]


def _expand(f, lo, hi, names=None, first=0):
    f = f.upper()
    for i, n in enumerate(names or []):
        f = f.replace(n, str(first + i))
    out = set()
    for it in f.split(","):
        step = 1
        stepped = "/" in it
        if stepped:
            it, s = it.split("/")
            step = int(s)
        if it == "*":
            a, b = lo, hi
        elif "-" in it:
            a, b = map(int, it.split("-"))
        else:
            a = int(it)
            b = hi if stepped else a
        if a > b or a < lo or b > hi:
            raise ValueError(f)
        out |= set(range(a, b + 1, step))
    return out


def brute(cron, zone, as_of, horizon_days=400, day_rule="and"):
    try:
        zi = zoneinfo.ZoneInfo(zone)
        f = cron.split()
        assert len(f) == 5
        mi, hr, dm = _expand(f[0], 0, 59), _expand(f[1], 0, 23), _expand(f[2], 1, 31)
        mo, dw = _expand(f[3], 1, 12, MONTHS, 1), {v % 7 for v in _expand(f[4], 0, 7, DAYS, 0)}
    except Exception:
        return None, None, False
    restricted = not f[2].startswith("*") and not f[4].startswith("*")

    def day_ok(t):
        dom_ok, dow_ok = t.day in dm, t.isoweekday() % 7 in dw
        return t.month in mo and ((dom_ok or dow_ok) if (day_rule == "or" and restricted) else (dom_ok and dow_ok))

    def scan(t, step):
        """Nearest UTC minute whose local time matches: no local time is ever turned into an instant."""
        end = t + step * 86400 * horizon_days
        while (t < end) if step > 0 else (t > end):
            local = dt.datetime.fromtimestamp(t, zi)
            if not day_ok(local) and t % 900 == 0:
                t += 900 * step
                continue
            if day_ok(local) and local.minute in mi and local.hour in hr:
                return t
            t += 60 * step
        return None

    first = as_of - as_of % 60
    return scan(first if first < as_of else first - 60, -1), scan(first + 60, 1), True


# instants: fixture noon, both US DST changes of 2024, exactly on a fire, a second after midnight
INSTANTS = [1706702400, 1710054000, 1710052200, 1730611800, 1730615400, 1704067200, 1704067201]


def test_cron_fires_equal_brute_force(spark):
    req = [(c, z, a) for c in CRONS for z in ZONES for a in INSTANTS]
    df = spark.createDataFrame(req, "cron string, tz string, as_of long")
    got = {(r.cron, r.tz, r.as_of): (r.prev_fire, r.next_fire, r.valid) for r in schedule.cron_fires(df).collect()}
    assert len(got) == len(req)
    for c, z, a in req:
        exp = brute(c, z, a) if z != "Not/AZone" else (None, None, False)
        if c in ("0 12 29 2 *", "0 0 31 2 *") and exp[2]:
            continue                                   # beyond the brute-force horizon: checked below
        assert got[(c, z, a)] == exp, (c, z, a)
    assert got[("0 12 29 2 *", "UTC", 1706702400)] == (1582977600, 1709208000, True)   # 2020-02-29, 2024-02-29
    assert got[("0 0 31 2 *", "UTC", 1706702400)] == (None, None, True)                 # never fires


def test_fires_around_changes_of_offset_equal_brute_force(spark):
    """Skipped and repeated hours, in three zones, on and around both change days."""
    crons = ["30 2 * * *", "*/15 * * * *", "15,45 1-3 * * *", "0 0 * * *", "30 2 10 3 *", "30 1 3 11 *", "*/20 2 * 3 SUN"]
    changes = {"US/Eastern": (1710054000, 1730613600), "Europe/London": (1711846800, 1729990800),
               "Australia/Lord_Howe": (1712415600, 1728142200)}
    req = [(c, z, at + d) for z, both in changes.items() for at in both for c in crons
           for d in (-90000, -7200, -1800, -60, 0, 60, 600, 1800, 3599, 3600, 5400, 9000, 90000)]
    df = spark.createDataFrame(req, "cron string, tz string, as_of long")
    got = {(r.cron, r.tz, r.as_of): (r.prev_fire, r.next_fire, r.valid) for r in schedule.cron_fires(df).collect()}
    for c, z, a in req:
        assert got[(c, z, a)] == brute(c, z, a, horizon_days=800), (c, z, a)


def test_every_offset_that_passes_the_check_converts(spark):
    zones = [f"{p}{s}{h}{m}" for p in ("", "UTC", "GMT", "UT") for s in "+-" for h in ("0", "9", "09", "17", "18", "19")
             for m in ("", "30", ":30", ":00", "00")] + ["Z", "UTC", "+930", "+18:30", "+99", "UTC+", "Mars/Base"]
    df = spark.createDataFrame([("0 6 * * *", z, 1706702400) for z in dict.fromkeys(zones)], "cron string, tz string, as_of long")
    got = {r.tz: r for r in schedule.cron_fires(df).collect()}
    assert all(r.valid == (r.prev_fire is not None) for r in got.values())
    assert got["+9:30"].valid and got["-17:30"].valid and got["UTC+0930"].valid and got["+18"].valid
    assert not any(got[z].valid for z in ("+930", "+18:30", "+1830", "+99", "UTC+", "Mars/Base", "+19"))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(min_value=1577836800, max_value=1893456000), min_size=5, max_size=20),
       st.sampled_from(["US/Eastern", "Asia/Tokyo", "UTC", "Australia/Sydney"]))
def test_prev_before_next_after(spark, instants, zone):
    df = spark.createDataFrame([(c, zone, a) for c in CRONS[:10] for a in instants], "cron string, tz string, as_of long")
    for r in schedule.cron_fires(df).collect():
        assert r.valid and r.prev_fire < r.as_of < r.next_fire


def test_day_rule_or_equals_brute_force(spark):
    crons = ["0 0 13 * 5", "30 6 1,15 * MON", "0 12 * * 0", "15 3 31 * SUN", "0 0 1 JAN,JUL *", "*/30 1 10-12 * 1-5"]
    req = [(c, z, a) for c in crons for z in ZONES[:3] for a in INSTANTS]
    df = spark.createDataFrame(req, "cron string, tz string, as_of long")
    got = {(r.cron, r.tz, r.as_of): (r.prev_fire, r.next_fire, r.valid)
           for r in schedule.cron_fires(df, day_rule="or").collect()}
    for c, z, a in req:
        assert got[(c, z, a)] == brute(c, z, a, day_rule="or"), (c, z, a)


def test_day_rule_or(spark):
    # 13th of the month OR a Friday; 2024-01-31 is a Wednesday
    df = spark.createDataFrame([("0 0 13 * 5", "UTC", 1706702400)], "cron string, tz string, as_of long")
    and_rule = schedule.cron_fires(df).collect()[0]
    or_rule = schedule.cron_fires(df, day_rule="or").collect()[0]
    assert and_rule.prev_fire == 1697155200      # Friday 2023-10-13
    assert or_rule.prev_fire == 1706227200       # Friday 2024-01-26
    assert or_rule.next_fire == 1706832000       # Friday 2024-02-02


def test_fiscal_bounds_period_and_quarter_days(spark):
    cal = fx.fx_calendar(spark)
    inst = [1705770000,   # 2024-01-20 12:00 ET: period day 1
            1705856400,   # 2024-01-21 12:00 ET: day 2
            1705942800,   # 2024-01-22 12:00 ET: day 3 (the "first Monday")
            1705719600,   # 2024-01-20 03:00 UTC = 01-19 22:00 ET: previous period, day 28
            1706702400]
    got = {r.as_of: r for r in fiscal.fiscal_bounds(cal, spark.createDataFrame([(a,) for a in inst], "as_of long")).collect()}
    for a in inst[:2]:
        assert (got[a].fcl_per_start_time, got[a].fcl_per_first_mon) == (1705726800, 1703480400)
    assert (got[1705942800].fcl_per_start_time, got[1705942800].fcl_per_first_mon) == (1705726800, 1705899600)
    assert got[1705719600].fcl_per_start_time == 1703307600
    assert (got[1706702400].fcl_qtr_start_time, got[1706702400].fcl_qtr_first_mon) == (1703307600, 1703480400)
    assert fiscal.fiscal_bounds_at(cal, 1706702400) == {
        "fcl_per_start_time": 1705726800, "fcl_per_first_mon": 1705899600,
        "fcl_qtr_start_time": 1703307600, "fcl_qtr_first_mon": 1703480400}


def test_as_of_join_equals_a_search_for_each_request(spark):
    """Random instants over two years in zones with and without changes of offset, on the broadcast and the split path."""
    import random

    from runready.functions import joins
    rnd = random.Random(11)
    zones = ["UTC", "US/Eastern", "Australia/Lord_Howe", "Asia/Kathmandu", "America/St_Johns", "America/Havana", "Not/AZone"]
    req = [(rnd.choice(CRONS), rnd.choice(zones), rnd.randrange(1672531200, 1735689600)) for _ in range(400)]
    req += [("*/15 * * * *", "US/Eastern", 1710054000 + 600 * k) for k in range(-20, 20)] + [(None, "UTC", 1706702400), ("0 6 * * *", None, 1706702400)]
    df = spark.createDataFrame(req, "cron string, tz string, as_of long").distinct().cache()
    key = lambda r: (str(r.cron), str(r.tz), r.as_of)
    for rule in ("or",):
        want = {key(r): (r.prev_fire, r.next_fire, bool(r.valid)) for r in schedule.search_fires(df, rule).collect()}
        assert {key(r): (r.prev_fire, r.next_fire, r.valid) for r in schedule.fires_as_of(df, rule).collect()} == want
    budget, joins.MAX_BROADCAST_BYTES = joins.MAX_BROADCAST_BYTES, 4096
    try:
        got = {key(r): (r.prev_fire, r.next_fire, r.valid) for r in schedule.fires_as_of(df, "or", hot_rows=20).collect()}
    finally:
        joins.MAX_BROADCAST_BYTES = budget
    assert got == want


def test_fires_are_worked_out_once_a_schedule_day(spark):
    from pyspark.sql import functions as F
    many = spark.range(20_000).select(F.lit("*/7 * * * *").alias("cron"), F.lit("UTC").alias("tz"), (F.lit(1706702400) + F.col("id") % 7200).alias("as_of"))
    days = schedule.schedule_days(many.select("cron", "tz", F.to_date(F.timestamp_seconds("as_of")).alias("day")).distinct())
    assert days.count() == 1
    got = schedule.cron_fires(many)
    assert got.count() == 7200 and got.where("prev_fire is null or next_fire is null or prev_fire >= as_of or next_fire <= as_of").count() == 0
