"""O13 readiness_rows (the decision rows) and O14 ready_jobs (the gate).

A job is ready iff every row the reference builds for it passes its rules.  Those rows
are the product own(r) x trigger(t) x status(s) x completed(c), and a row passes iff
own(r) and T(r, t) and S(s) and C(r, c).  Hence "all rows pass" iff

* every own row passes R1, R2, R6, R7, R8 (so every last start is known), and
* every trigger edge passes R3 at the job's latest own start (``max_r``; ``<`` is
  monotone in the start), every status edge passes R4, and every completed edge passes
  R5 at that same start.

``readiness_rows`` emits exactly these own rows and edge rows, each with ``readiness``
0 (pass) or 1 (fail, including unknown/null inputs), so the gate is
``sum(readiness) = 0`` per job over r + t + s + c rows instead of r*t*s*c.

Everything is keyed by (job_id, as_of), so one call can decide many jobs at many
instants (the itinerary carries one row per requested (job, instant)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import vocab
from ..functions.joins import HOT_KEY_ROWS, broadcast_within
from .dependencies import dependency_edges, own_rows


def _flag(pred) -> "F.Column":
    """0 when the predicate is true, 1 when false or unknown."""
    return F.when(pred, F.lit(0)).otherwise(F.lit(1))


def own_rule(last_start="last_start_time") -> "F.Column":
    """R1, R2, R6, R7, R8 on an own row."""
    ls = F.col(last_start)
    spec = F.col("spec")
    r1 = ls < F.col("prev_min_exec_time")
    r2 = ((spec == F.lit(vocab.SPEC_NONE))
          | ((spec == F.lit(vocab.SPEC_PERIOD_DAY1)) & (ls < F.col("prev_fcl_per_start_time")))
          | ((spec == F.lit(vocab.SPEC_PERIOD_FIRST_MONDAY)) & (ls < F.col("prev_fcl_per_first_mon")))
          | ((spec == F.lit(vocab.SPEC_QUARTER_DAY1)) & (ls < F.col("prev_fcl_qtr_start_time")))
          | ((spec == F.lit(vocab.SPEC_QUARTER_FIRST_MONDAY)) & (ls < F.col("prev_fcl_qtr_first_mon"))))
    r6 = F.col("lock_flag") == 0
    ps = F.col("pipeline_status")
    r7 = ps.isNull() | (ps != F.lit(vocab.STATUS_FAILED)) | (F.col("onfail") == F.lit(vocab.ONFAIL_PASS))
    r8 = F.col("state") == F.lit(vocab.STATE_ACTIVE)
    return r1 & r2 & r6 & r7 & r8


def edge_rule(last_start="last_start_time") -> "F.Column":
    """R3 (trigger), R4 (status), R5 (completed) on an edge row."""
    ls, end, st, kind = F.col(last_start), F.col("dep_end_time"), F.col("dep_status"), F.col("row_kind")
    ok = F.lit(vocab.STATUS_SUCCESS)
    return (F.when(kind == "trigger", (ls < end) & (st == ok))
            .when(kind == "status", st == ok)
            .when(kind == "completed", ls < end))


def readiness_rows(itin: DataFrame, state: DataFrame, state_rows: int | None = None,
                   hot_rows: int = HOT_KEY_ROWS, jobs_bound: int | None = None) -> DataFrame:
    """Decision rows (``schemas.DECISION_COLUMNS``): own rows and edge rows with ``readiness``.

    ``state_rows``: the state's row count, when known; it decides whether the state lookups
    are broadcast; ``hot_rows`` is the key frequency from which a lookup key is split off
    when they are not (see ``dependency_edges``).  ``jobs_bound`` (itinerary rows) bounds the
    per-(job, instant) start table joined to the edges, which is broadcast when it fits.
    """
    own = own_rows(itin, state, state_rows, hot_rows)
    job_start = broadcast_within(own.groupBy(F.col("job_id").alias("_job"), F.col("as_of").alias("_at")).agg(
        F.max("last_start_time").alias("_job_start")), jobs_bound)
    own_out = own.select(
        "as_of", "job_id", "pipeline", "state", F.lit("own").alias("row_kind"), "lock_flag", "pipeline_status",
        "tz", "spec", "onfail", "last_start_time", "last_end_time",
        "prev_min_exec_time", "next_min_exec_time", "prev_fcl_per_start_time", "prev_fcl_per_first_mon",
        "prev_fcl_qtr_start_time", "prev_fcl_qtr_first_mon",
        F.lit(None).cast("string").alias("dependency"), "source",
        F.lit(None).cast("long").alias("dep_start_time"), F.lit(None).cast("long").alias("dep_end_time"),
        F.lit(None).cast("string").alias("dep_status"),
        _flag(own_rule()).alias("readiness"),
    )
    edges = dependency_edges(itin, state, state_rows, hot_rows)
    e = edges.join(job_start, (edges["job_id"] == job_start["_job"]) & (edges["as_of"] == job_start["_at"]),
                   "inner").select(
        "as_of", "job_id", "pipeline", "state", F.col("kind").alias("row_kind"),
        F.lit(None).cast("int").alias("lock_flag"), F.lit(None).cast("string").alias("pipeline_status"),
        "tz", "spec", "onfail", F.col("_job_start").alias("last_start_time"),
        F.lit(None).cast("long").alias("last_end_time"),
        "prev_min_exec_time", "next_min_exec_time", "prev_fcl_per_start_time", "prev_fcl_per_first_mon",
        "prev_fcl_qtr_start_time", "prev_fcl_qtr_first_mon",
        "dependency", "source", "dep_start_time", "dep_end_time", "dep_status",
    )
    e = e.withColumn("readiness", _flag(edge_rule()))
    return own_out.unionByName(e).select(*schemas.DECISION_COLUMNS)


def ready_jobs(decisions: DataFrame) -> DataFrame:
    """(job_id, as_of) of every job whose decision rows at that instant all pass (``sum(readiness) = 0``)."""
    return (decisions.groupBy("job_id", "as_of").agg(F.sum("readiness").alias("_fails"))
            .where(F.col("_fails") == 0).select("job_id", "as_of"))
