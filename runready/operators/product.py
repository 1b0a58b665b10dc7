"""O13 in product form: one decision row per combination of a job's own state rows and the state rows of its
trigger, status and completed upstreams (r x t x s x c rows a job), for users of the wide decision log.

The gate needs none of this (``readiness.readiness_rows`` decides on r + t + s + c rows); this form is for logs and
audits that want each combination.  Its row count is the result's own size; what is bounded here is what one task does:

* every list item meets the state once, as an edge row, before anything is multiplied, so no product row is joined;
* an own row knows its exact number of combinations before they are made.  They are numbered 0 .. t*s*c-1 and dealt out in
  pieces of ``PIECE`` numbers; the pieces of own rows with more than one piece are repartitioned, so that a
  job with a large product is spread over as many tasks as it has pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import vocab
from ..functions.joins import HOT_KEY_ROWS, lookup_join
from .dependencies import DEPENDENCY_KINDS, _state_lookup, own_rows
from .readiness import _flag, own_rule

# Combinations of one piece: rows that one generator makes in a task.
PIECE = 20_000

_UPSTREAM = "array<struct<dependency: string, start_time: bigint, end_time: bigint, status: string>>"


def upstream_lists(itin: DataFrame, state: DataFrame, state_rows: int | None = None, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """(job_id, as_of, trigger, status, completed): for each list the (item, state row) pairs of the job.

    Every item counts, blank ones too (an empty list is one blank item), and an item without a state row keeps
    nulls; a missing list is null here.
    """
    def items(kind: str, tag: str):
        return F.transform(F.split(F.col(tag), ","), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("dependency")))

    parts = [F.coalesce(items(k, t), F.array().cast("array<struct<kind: string, dependency: string>>")) for k, t in DEPENDENCY_KINDS]
    each = (itin.select("job_id", "as_of", F.explode(F.concat(*parts)).alias("e"))
            .select("job_id", "as_of", "e.kind", "e.dependency"))
    met = lookup_join(each, _state_lookup(state, "dep"), F.trim(F.col("dependency")), "dep_key", state_rows, hot_rows)
    row = F.struct("dependency", F.col("dep_start_time").alias("start_time"), F.col("dep_end_time").alias("end_time"),
                   F.col("dep_status").alias("status"))
    lists = met.groupBy("job_id", "as_of").agg(
        *[F.collect_list(F.when(F.col("kind") == k, row)).alias(k) for k, _ in DEPENDENCY_KINDS])
    return lists.select("job_id", "as_of", *[F.when(F.size(k) > 0, F.col(k)).alias(k) for k, _ in DEPENDENCY_KINDS])


def product_rule() -> "F.Column":
    """R1-R8 on one combination: a blank or missing dependency passes."""
    ls, ok = F.col("last_start_time"), F.lit(vocab.STATUS_SUCCESS)
    trigger = F.col("trigger_dependency").isNull() | ((ls < F.col("tdep_end_time")) & (F.col("tdep_status") == ok))
    status = F.col("status_dependency").isNull() | (F.col("sdep_status") == ok)
    completed = F.col("completed_dependency").isNull() | (ls < F.col("cdep_end_time"))
    return own_rule() & trigger & status & completed


def readiness_product(itin: DataFrame, state: DataFrame, state_rows: int | None = None,
                      hot_rows: int = HOT_KEY_ROWS, piece: int = PIECE) -> DataFrame:
    """Wide decision rows (``schemas.PRODUCT_COLUMNS``) of every (job, instant) of ``itin``.

    A blank item shows as a null dependency and passes, as a missing list does; an item that is only white space, or
    unknown, stays and blocks.  ``ready_jobs`` of these rows equals that of the factored rows.  ``state_rows`` and
    ``hot_rows``: see ``dependency_edges``.  ``piece``: combinations made by one task at a time.
    """
    kinds = [k for k, _ in DEPENDENCY_KINDS]
    own = own_rows(itin, state, state_rows, hot_rows).drop(*[t for _, t in DEPENDENCY_KINDS])
    lists = upstream_lists(itin, state, state_rows, hot_rows)
    none = F.lit(None).cast(_UPSTREAM[6:-1])
    rows = own.join(lists, ["job_id", "as_of"], "left")
    rows = rows.withColumns({k: F.coalesce(F.col(k).cast(_UPSTREAM), F.array(none)) for k in kinds})
    t, s, c = (F.size(k).cast("long") for k in kinds)
    rows = rows.withColumns({"_n": t * s * c, "_piece": F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((t * s * c - 1) / piece).cast("long")))})
    # few rows have more than one piece: only these are dealt out anew, by number, as AQE would put so few bytes together
    spark = itin.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    large = F.col("_n") > piece
    dealt = rows.where(~large).unionByName(
        rows.where(large).repartition(parts, F.col("job_id"), F.col("as_of"), F.col("source"), F.col("_piece")))
    at = dealt.withColumn("_at", F.explode(F.sequence(
        F.col("_piece") * piece, F.least((F.col("_piece") + 1) * piece, F.col("_n")) - 1)))
    s, c = F.size("status"), F.size("completed")
    one = at.withColumns({
        "_t": F.get("trigger", (F.col("_at") / (s * c)).cast("int")),
        "_s": F.get("status", (F.floor(F.col("_at") / c) % s).cast("int")),
        "_c": F.get("completed", (F.col("_at") % c).cast("int"))})

    def named(row: str):
        return F.when(F.col(f"{row}.dependency") != "", F.col(f"{row}.dependency"))

    wide = one.select(
        "as_of", "job_id", "pipeline", "state", "lock_flag", "pipeline_status", "tz", "spec", "onfail", "last_start_time",
        "last_end_time", "prev_min_exec_time", "next_min_exec_time", "prev_fcl_per_start_time", "prev_fcl_per_first_mon",
        "prev_fcl_qtr_start_time", "prev_fcl_qtr_first_mon",
        named("_t").alias("trigger_dependency"), F.col("_t.start_time").alias("tdep_start_time"),
        F.col("_t.end_time").alias("tdep_end_time"), F.col("_t.status").alias("tdep_status"),
        named("_s").alias("status_dependency"), F.col("_s.status").alias("sdep_status"),
        named("_c").alias("completed_dependency"), F.col("_c.start_time").alias("cdep_start_time"),
        F.col("_c.end_time").alias("cdep_end_time"))
    return wide.withColumn("readiness", _flag(product_rule())).select(*schemas.PRODUCT_COLUMNS)
