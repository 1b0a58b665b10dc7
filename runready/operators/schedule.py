"""O2 cron_fires: previous and next fire time of a cron schedule in its zone.

With one instant (``search_fires``) each distinct schedule is expanded into allowed-value arrays
(``runready.functions.cron``) and searched with array expressions — JVM expressions, no
Python (the higher-order ``filter``/``transform`` calls are evaluated per row rather
than compiled into the surrounding whole-stage code):

* the as-of instant is turned into local wall time in ``tz``;
* on the local day itself, the last (first) allowed minute strictly before (after) the
  wall time is taken;
* otherwise the nearest firing day before (after) it is found by filtering a day
  sequence — first within a week, then two months, one year, 8 years (Feb 29) and 40
  years (Feb 29 on a given weekday), each wider search only for rows still empty — and
  its last (first) allowed minute is taken;
* the local fire time goes back to UTC under both offsets of its day, and only an instant
  whose local time is that fire time counts.

A fire is a UTC minute whose local wall time matches: a wall time that a change of offset
skips does not fire that day, one that it repeats fires twice.  Within ``NEAR`` of a change
of offset, where the nearest wall time need not be the nearest instant, all fires of the local
days around are listed as instants and compared as such (a few days a year of any zone).

prev_fire < as_of < next_fire (epoch seconds).  An unparsable cron or unknown zone gives ``valid = false`` and null fire times instead of
failing the pass.  With many instants (``fires_as_of``) the search runs once per distinct (cron, tz, local day), and
the requests are joined to those days: the work grows with schedule-days, and a request costs a look at one hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cron as cronf
from ..functions.joins import HOT_KEY_ROWS, broadcast_if_small, lookup_join
from ..functions.zones import safe_zone, with_zone_check
from ..session import ensure_checkpoint_dir

# Search horizons in days, tried in order (each only for rows the previous one left null).
HORIZONS = (7, 62, 366, 366 * 8, 366 * 40)
# Seconds around the instant within which a change of offset leads to the search by instants, and
# the local days listed on either side then.
NEAR = 26 * 3600
DAYS_AROUND = 1


# ---- searching a schedule: columns _hr, _mi, _dom, _mo, _dow, _doms, _dows of its parsed cron, _tz its zone

def _day_ok(d, day_rule: str):
    return cronf.day_matches(d, F.col("_mo"), F.col("_dom"), F.col("_dow"), F.col("_doms"), F.col("_dows"), day_rule)


def _epoch_day(d):
    return F.unix_seconds(d.cast("timestamp"))


def _local(t):
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(t), F.col("_tz")))


def _offset_at(t):
    return _local(t) - t


def _nearest_day(back: bool, day, skip: int, day_rule: str):
    """Nearest firing day at least ``skip`` days before (after) ``day``; wider horizons only where none is found."""
    def ok(d):
        return _day_ok(d, day_rule)

    if back:
        return F.coalesce(*[F.array_max(F.filter(F.sequence(F.date_sub(day, h), F.date_sub(day, skip)), ok)) for h in HORIZONS])
    return F.coalesce(*[F.array_min(F.filter(F.sequence(F.date_add(day, skip), F.date_add(day, h)), ok)) for h in HORIZONS])


def _instants(walls, around):
    """Instants whose local time is one of ``walls``, under the offsets ``around`` (before, after)."""
    return F.flatten(F.transform(walls, lambda w: F.filter(
        F.array(w - around[0], w - around[1]), lambda t: _local(t) == w)))


def _walls_of(day):
    return F.flatten(F.transform("_hr", lambda h: F.transform("_mi", lambda m: _epoch_day(day) + (h * 60 + m) * 60)))


def _on_day(back: bool, day):
    """Last (first) fire of a firing day: of its last (first) minute, or of all where no clock shows that one."""
    pick = F.array_max if back else F.array_min
    wall = _epoch_day(day) + (pick("_hr") * 60 + pick("_mi")) * 60
    around = (_offset_at(_epoch_day(day) - 86400), _offset_at(_epoch_day(day) + 2 * 86400))
    return F.coalesce(pick(_instants(F.array(wall), around)), pick(_instants(_walls_of(day), around)))


# ---- many instants: an as-of join to the days of each schedule -------------------------

def schedule_days(days: DataFrame, day_rule: str = "and") -> DataFrame:
    """One row per (cron, tz, day) of ``days``: what any instant of that local day needs to find its fires.

    ``hours``, ``minutes``: of a firing day, else null; ``offset``: local minus UTC, the same around the day; ``before``, ``after``: the
    last fire of earlier days and the first of later ones.  Where the offset changes near the day,
    ``listed`` holds all fires of it and its neighbours as instants, a struct (lo, hi, fires) for each wall hour.
    """
    parsed = _with_schedules(with_zone_check(days, "tz", "_tz_ok"))
    day = F.col("day")
    start = _epoch_day(day) - _offset_at(_epoch_day(day))
    steady = parsed.withColumns({"_from": _offset_at(start - NEAR), "_to": _offset_at(start + 86400 + NEAR)}) \
        .withColumn("_near", F.col("_from") != F.col("_to")) \
        .withColumns({"_before": _offset_at(start - NEAR - DAYS_AROUND * 86400), "_after": _offset_at(start + 86400 + NEAR + DAYS_AROUND * 86400)})

    def ok(d):
        return _day_ok(d, day_rule)

    def of_hour(d, h):
        walls = F.transform("_mi", lambda m: _epoch_day(d) + (h * 60 + m) * 60)
        return _instants(walls, (F.col("_before"), F.col("_after")))

    near_days = F.filter(F.sequence(F.date_sub(day, DAYS_AROUND), F.date_add(day, DAYS_AROUND)), ok)
    by_hour = F.filter(F.flatten(F.transform(near_days, lambda d: F.transform("_hr", lambda h: of_hour(d, h)))), lambda x: F.size(x) > 0)
    listed = F.transform(by_hour, lambda x: F.struct(F.array_min(x).alias("lo"), F.array_max(x).alias("hi"), x.alias("fires")))
    found = steady.withColumn("listed", F.when(F.col("valid") & F.col("_near"), listed))
    for back, name in ((True, "before"), (False, "after")):
        skip = F.when(F.col("_near"), _nearest_day(back, day, DAYS_AROUND + 1, day_rule)).otherwise(_nearest_day(back, day, 1, day_rule))
        found = found.withColumn(f"_{name}_day", F.when(F.col("valid"), skip)) \
            .withColumn(f"_{name}_there", F.when(F.col(f"_{name}_day").isNotNull(), _on_day(back, F.col(f"_{name}_day")))) \
            .withColumn(f"_{name}_beyond", F.when(F.col(f"_{name}_day").isNotNull() & F.col(f"_{name}_there").isNull(),
                                                  _nearest_day(back, F.col(f"_{name}_day"), 1, day_rule))) \
            .withColumn(name, F.coalesce(f"_{name}_there", F.when(
                F.col(f"_{name}_beyond").isNotNull(), _on_day(back, F.col(f"_{name}_beyond")))))
    fires = F.col("valid") & ~F.col("_near") & ok(day)
    return found.select("cron", "tz", "day", "valid", "_tz", F.col("_from").alias("offset"), F.col("_near").alias("near"),
                        F.when(fires, F.col("_hr")).alias("hours"), F.when(fires, F.col("_mi")).alias("minutes"),
                        "listed", "before", "after")


def fires_as_of(req: DataFrame, day_rule: str = "and", hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """``cron_fires`` of many (cron, tz, as_of) requests by an as-of join.

    The fires of a schedule are worked out once per local day that has requests (``schedule_days``), stored, and met by the
    requests on (cron, tz, day); a request then looks at one hour's minutes.  Many requests share a schedule-day, so the
    join is a broadcast within the budget, and beyond it splits hot schedule-days off (``lookup_join``).
    """
    zoned = with_zone_check(req, "tz", "_tz_ok")
    dated = zoned.withColumn("day", F.to_date(F.from_utc_timestamp(
        F.timestamp_seconds("as_of"), safe_zone(F.col("tz"), F.col("_tz_ok"))))).drop("_tz_ok")
    spark = req.sparkSession
    ensure_checkpoint_dir(spark)
    # few bytes but much work to a row: dealt out by number, which AQE leaves as it is
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    days = schedule_days(dated.select("cron", "tz", "day").distinct().repartition(parts), day_rule).checkpoint()
    key = F.struct("cron", "tz", "day")
    met = lookup_join(dated, days.withColumn("_dk", key).drop("cron", "tz", "day"), key, "_dk", days.count(), hot_rows)

    at, hours, minutes = F.col("as_of"), F.col("hours"), F.col("minutes")
    day0 = _epoch_day(F.col("day"))
    sod = at + F.col("offset") - day0
    h0 = F.floor(sod / 3600).cast("int")
    in_hour = F.array_contains(hours, h0)
    wall = {
        True: F.coalesce(h0 * 60 + F.when(in_hour, F.array_max(F.filter(minutes, lambda m: (h0 * 60 + m) * 60 < sod))),
                         F.array_max(F.filter(hours, lambda h: h < h0)) * 60 + F.array_max(minutes)),
        False: F.coalesce(h0 * 60 + F.when(in_hour, F.array_min(F.filter(minutes, lambda m: (h0 * 60 + m) * 60 > sod))),
                          F.array_min(F.filter(hours, lambda h: h > h0)) * 60 + F.array_min(minutes))}
    inside = F.flatten(F.transform(F.filter("listed", lambda x: (x.lo <= at) & (x.hi >= at)), lambda x: x.fires))
    near = {
        True: F.greatest(F.array_max(F.transform(F.filter("listed", lambda x: x.hi < at), lambda x: x.hi)),
                         F.array_max(F.filter(inside, lambda t: t < at))),
        False: F.least(F.array_min(F.transform(F.filter("listed", lambda x: x.lo > at), lambda x: x.lo)),
                       F.array_min(F.filter(inside, lambda t: t > at)))}

    def fire(back: bool, other: str):
        same = F.when(F.col("near"), near[back]).otherwise(day0 + wall[back] * 60 - F.col("offset"))
        return F.when(F.col("valid"), F.coalesce(same, F.col(other)))

    return met.select("cron", "tz", "as_of", fire(True, "before").alias("prev_fire"), fire(False, "after").alias("next_fire"), "valid")


# ---- entry -----------------------------------------------------------------------------

def cron_fires(requests: DataFrame, as_of: int | None = None, cron_col: str = "cron", tz_col: str = "tz",
               as_of_col: str = "as_of", day_rule: str = "and") -> DataFrame:
    """(cron, tz, as_of, prev_fire, next_fire, valid) for each distinct request.

    ``requests`` holds ``cron_col`` and ``tz_col`` and, unless a scalar ``as_of`` (epoch
    seconds) is given, ``as_of_col``.  One instant is searched for each schedule (``search_fires``), many are
    joined to the days of the schedules (``fires_as_of``).
    """
    if as_of is not None:
        return search_fires(requests.select(F.col(cron_col).alias("cron"), F.col(tz_col).alias("tz")).distinct()
                            .withColumn("as_of", F.lit(int(as_of)).cast("long")), day_rule)
    return fires_as_of(requests.select(F.col(cron_col).alias("cron"), F.col(tz_col).alias("tz"),
                                       F.col(as_of_col).cast("long").alias("as_of")).distinct(), day_rule)


_PARTS = dict(zip(["n_fields", "minutes", "hours", "doms", "months", "dows", "dom_star", "dow_star"],
                  ["_nf", "_mi", "_hr", "_dom", "_mo", "_dow", "_doms", "_dows"]))


def _with_schedules(req: DataFrame) -> DataFrame:
    """Adds the parsed cron (null where not valid), ``_tz`` and ``valid``; each distinct cron string is parsed once, in a
    table broadcast behind a row-count check."""
    p = cronf.parse(F.col("_cron"))
    schedules = req.select(F.col("cron").alias("_cron")).distinct().select("_cron", *[p[c].alias(a) for c, a in _PARTS.items()])
    parsed = req.join(broadcast_if_small(schedules), req["cron"] == schedules["_cron"], "left").drop("_cron")
    valid = F.coalesce(F.col("_tz_ok") & (F.col("_nf") == 5), F.lit(False))
    for c in ("_mi", "_hr", "_dom", "_mo", "_dow"):
        valid = valid & F.col(c).isNotNull()
    return parsed.withColumns({"valid": valid, "_tz": safe_zone(F.col("tz"), F.col("_tz_ok"))}).withColumns(
        {c: F.when(F.col("valid"), F.col(c)) for c in ("_mi", "_hr")})


def search_fires(req: DataFrame, day_rule: str = "and") -> DataFrame:
    """``cron_fires`` by a search of its own for each distinct (cron, tz, as_of): best for one instant."""
    req = with_zone_check(req, "tz", "_tz_ok")

    # the requests are the distinct schedules of one instant, so parsing happens in place
    p = cronf.parse(F.col("cron"))
    parsed = req.select("*", *[p[c].alias(a) for c, a in _PARTS.items()])
    valid = (F.col("_tz_ok") & (F.col("_nf") == 5) & F.col("_mi").isNotNull() & F.col("_hr").isNotNull()
             & F.col("_dom").isNotNull() & F.col("_mo").isNotNull() & F.col("_dow").isNotNull())
    tz = safe_zone(F.col("tz"), F.col("_tz_ok"))
    wall = F.from_utc_timestamp(F.timestamp_seconds(F.col("as_of")), tz)
    staged = parsed.select(
        "cron", "tz", "as_of", valid.alias("valid"), tz.alias("_tz"),
        F.when(valid, F.col("_mi")).alias("_mi"), F.when(valid, F.col("_hr")).alias("_hr"),
        "_dom", "_mo", "_dow", "_doms", "_dows",
        F.to_date(wall).alias("_day"),
        F.unix_seconds(wall).alias("_wall"),
    ).withColumn("_day0", F.unix_seconds(F.col("_day").cast("timestamp"))) \
     .withColumn("_sod", F.col("_wall") - F.col("_day0")) \
     .withColumn("_h0", (F.col("_sod") / 3600).cast("int"))

    def day_ok(d):
        return _day_ok(d, day_rule)

    mi, hr, h0, sod = F.col("_mi"), F.col("_hr"), F.col("_h0"), F.col("_sod")
    today = F.col("_day")
    # same local day: within the current hour first, then the nearest other allowed hour
    in_hour = F.array_contains(hr, h0)
    prev_min = F.when(in_hour, F.array_max(F.filter(mi, lambda m: (h0 * 60 + m) * 60 < sod)))
    next_min = F.when(in_hour, F.array_min(F.filter(mi, lambda m: (h0 * 60 + m) * 60 > sod)))
    prev_hour = F.array_max(F.filter(hr, lambda h: h < h0))
    next_hour = F.array_min(F.filter(hr, lambda h: h > h0))
    same_prev = F.when(day_ok(today), F.coalesce(h0 * 60 + prev_min, prev_hour * 60 + F.array_max(mi)))
    same_next = F.when(day_ok(today), F.coalesce(h0 * 60 + next_min, next_hour * 60 + F.array_min(mi)))
    # by wall time: the offset does not change near the instant
    steady = staged.withColumn("_near", _offset_at(F.col("as_of") - NEAR) != _offset_at(F.col("as_of") + NEAR)) \
        .withColumn("_off", F.col("_wall") - F.col("as_of")) \
        .withColumn("_before", _offset_at(F.col("as_of") - NEAR - DAYS_AROUND * 86400)) \
        .withColumn("_after", _offset_at(F.col("as_of") + NEAR + DAYS_AROUND * 86400))
    # all fires of the days around a change, as instants
    days = F.filter(F.sequence(F.date_sub(today, DAYS_AROUND), F.date_add(today, DAYS_AROUND)), day_ok)
    listed = _instants(F.flatten(F.transform(days, _walls_of)), (F.col("_before"), F.col("_after")))
    found = steady.withColumn("_listed", F.when(F.col("valid") & F.col("_near"), listed)) \
        .withColumn("_prev", F.when(F.col("_near"), F.array_max(F.filter("_listed", lambda t: t < F.col("as_of"))))
                    .otherwise(F.col("_day0") + same_prev * 60 - F.col("_off"))) \
        .withColumn("_next", F.when(F.col("_near"), F.array_min(F.filter("_listed", lambda t: t > F.col("as_of"))))
                    .otherwise(F.col("_day0") + same_next * 60 - F.col("_off")))
    # other days: the nearest firing day, or where no clock showed any of its fires, the one beyond it
    for back, name in ((True, "_prev"), (False, "_next")):
        skip = F.when(F.col(name).isNull() & F.col("valid"), F.when(
            F.col("_near"), _nearest_day(back, today, DAYS_AROUND + 1, day_rule)).otherwise(_nearest_day(back, today, 1, day_rule)))
        found = found.withColumn(f"{name}_day", skip) \
            .withColumn(f"{name}_there", F.when(F.col(f"{name}_day").isNotNull(), _on_day(back, F.col(f"{name}_day")))) \
            .withColumn(f"{name}_beyond", F.when(
                F.col(f"{name}_day").isNotNull() & F.col(f"{name}_there").isNull(),
                _nearest_day(back, F.col(f"{name}_day"), 1, day_rule))) \
            .withColumn(f"{name}_fire", F.coalesce(name, f"{name}_there", F.when(
                F.col(f"{name}_beyond").isNotNull(), _on_day(back, F.col(f"{name}_beyond")))))
    return found.select(
        "cron", "tz", "as_of",
        F.when(F.col("valid"), F.col("_prev_fire")).alias("prev_fire"),
        F.when(F.col("valid"), F.col("_next_fire")).alias("next_fire"),
        "valid",
    )

