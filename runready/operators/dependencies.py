"""Itinerary, own-state rows and dependency edges.

The reference explodes a job's trigger, status and completed lists one after another,
so a job with t, s and c upstreams and r matching state rows becomes r*t*s*c rows.  Here
the lists become edge rows instead — one row per (job, kind, upstream item, matching
upstream state row) — and the job's own state rows stay separate, so the row count is
r + t + s + c.  ``readiness.readiness_rows`` shows why the gate is unchanged.

Blank list items ("a,,b", an empty list) never block a job and produce no edge; an item
that is only whitespace is kept and, like any name without a state row, blocks.
Both lookups join on ``trim(name) = state.pipeline`` (state names are not trimmed), and
key on the name only, so a name present under two sources gives two rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import HOT_KEY_ROWS, broadcast_within, lookup_join

# Dependency kinds and the definition tag each one comes from.
DEPENDENCY_KINDS = [("trigger", "tdep"), ("status", "sdep"), ("completed", "cdep")]


def itinerary(defs: DataFrame, fires: DataFrame, bounds, as_of: int | None = None,
              jobs_bound: int | None = None, fires_rows: int | None = None,
              bounds_rows: int | None = None, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Definitions with their schedule and fiscal bounds.

    ``fires`` is ``cron_fires`` output.  With a scalar ``as_of`` every job is evaluated at
    that instant: ``fires`` must be computed at it and is joined on (cron, tz), and
    ``bounds`` is the dict of ``fiscal_bounds_at``, attached as constants.  Without it,
    ``defs`` carries an ``as_of`` column, ``bounds`` is ``fiscal_bounds`` output, and both
    are joined on their keys (cron, tz, as_of) and (as_of).  The fire table has at most one
    row per job; it is broadcast when ``jobs_bound`` (the definition count) rows fit the
    broadcast budget.

    Many jobs share an instant (and often a schedule), so in the many-instant form those
    keys can be hot: with known row counts of the two tables (``fires_rows``,
    ``bounds_rows``) each lookup is a ``lookup_join`` (broadcast when it fits, else hot keys
    split off; ``defs`` should then be materialised, as it is read more than once); without
    them the joins are left to AQE.
    """
    names = {"fcl_per_start_time": "prev_fcl_per_start_time", "fcl_per_first_mon": "prev_fcl_per_first_mon",
             "fcl_qtr_start_time": "prev_fcl_qtr_start_time", "fcl_qtr_first_mon": "prev_fcl_qtr_first_mon"}
    f = fires.select("cron", "tz", "as_of", F.col("prev_fire").alias("prev_min_exec_time"),
                     F.col("next_fire").alias("next_min_exec_time"))
    f = broadcast_within(f, jobs_bound)
    if as_of is not None:
        it = defs.join(f.drop("as_of"), ["cron", "tz"], "left")
        return it.withColumns({"as_of": F.lit(int(as_of)).cast("long"),
                               **{names[k]: F.lit(bounds[k]).cast("long") for k in names}})
    if fires_rows is None or bounds_rows is None:
        # one row per distinct key on the right: AQE broadcasts them when its measured size
        # allows and splits skew otherwise
        b = bounds.select("as_of", *[F.col(k).alias(v) for k, v in names.items()])
        return defs.join(f, ["cron", "tz", "as_of"], "left").join(b, "as_of", "left")
    fk = f.withColumn("_fk", F.struct("cron", "tz", "as_of")).drop("cron", "tz", "as_of")
    it = lookup_join(defs, fk, F.struct("cron", "tz", "as_of"), "_fk", fires_rows, hot_rows).drop("_fk")
    b = bounds.select(F.col("as_of").alias("_bk"), *[F.col(k).alias(v) for k, v in names.items()])
    return lookup_join(it, b, F.col("as_of"), "_bk", bounds_rows, hot_rows).drop("_bk")


def _state_lookup(state: DataFrame, prefix: str) -> DataFrame:
    return state.select(
        F.col("pipeline").alias(f"{prefix}_key"), F.col("source"), F.col("lock").alias(f"{prefix}_lock"),
        F.col("status").alias(f"{prefix}_status"), F.col("start_time").alias(f"{prefix}_start_time"),
        F.col("end_time").alias(f"{prefix}_end_time"))


def own_rows(itin: DataFrame, state: DataFrame, state_rows: int | None = None,
             hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """One row per (job, state row of its trimmed name); a job without state keeps one row.

    lock_flag: the state lock as an integer, 0 when missing or not a number.  A job that
    never ran counts its creation time (ms, floored to s) as its last start and 0 as its
    last end.
    """
    j = lookup_join(itin, _state_lookup(state, "own"), F.trim(F.col("pipeline")), "own_key", state_rows, hot_rows)
    return j.select(
        *[c for c in itin.columns],
        "source",
        F.coalesce(F.col("own_lock").try_cast("int"), F.lit(0)).alias("lock_flag"),
        F.col("own_status").alias("pipeline_status"),
        F.coalesce(F.col("own_start_time"), F.floor(F.col("created_time") / 1000).cast("long")).alias("last_start_time"),
        F.coalesce(F.col("own_end_time"), F.lit(0).cast("long")).alias("last_end_time"),
    )


def dependency_items(itin: DataFrame) -> DataFrame:
    """(job columns..., kind, dependency): one row per non-blank item of each dependency list."""
    def items(kind: str, tag: str):
        parts = F.coalesce(F.split(F.col(tag), ","), F.array().cast("array<string>"))
        return F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("dependency")))

    keep = [c for c in itin.columns if c not in ("tdep", "sdep", "cdep")]
    exploded = itin.select(*keep, F.explode(F.concat(*[items(k, t) for k, t in DEPENDENCY_KINDS])).alias("_e"))
    return (exploded.select(*keep, F.col("_e.kind").alias("kind"), F.col("_e.dependency").alias("dependency"))
            .where(F.col("dependency") != F.lit("")))


def dependency_edges(itin: DataFrame, state: DataFrame, state_rows: int | None = None,
                     hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Items joined to their upstream's state rows (left join: an unknown upstream keeps nulls).

    A heavily shared upstream is a hot key on the item side.  When ``state_rows`` (the
    state's row count) fits the broadcast budget the state is broadcast, so no task holds
    a hot key; beyond it hot upstreams (``hot_rows`` items or more) join a broadcast of
    their own state rows and only the rest is shuffled (``functions.joins.lookup_join``).
    """
    items = dependency_items(itin)
    j = lookup_join(items, _state_lookup(state, "dep"), F.trim(F.col("dependency")), "dep_key", state_rows,
                    hot_rows)
    return j.drop("dep_key", "dep_lock")
