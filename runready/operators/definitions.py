"""O1 flatten_definitions: raw job definitions -> one orchestration row per job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocab

# Name of the placeholder job the reference seeds its job list with;
# a job of that name is never orchestrated.
PLACEHOLDER_PIPELINE = "schema_placeholder"


def _joined(first: str, overflow: str):
    """``xdep`` + ``xdep2`` as one comma list; ``concat_ws`` skips a null ``xdep``."""
    return F.when(F.col(overflow).isNotNull(), F.concat_ws(",", F.col(first), F.col(overflow))).otherwise(F.col(first))


def flatten_definitions(raw_defs: DataFrame) -> DataFrame:
    """Flatten ``settings.tags.*``, fill default tags and resolve the job's zone.

    Output: job_id, created_time (ms), pipeline, state, max_concurrent_runs (int), cron, tz,
    spec, onfail, sdep, tdep, cdep.  Jobs without a ``state`` tag are not orchestrated and
    are dropped, as are jobs without a name.  A job with a fiscal gate (``spec`` other than
    the literal ``None``) always runs on the fiscal calendar's zone.
    """
    parsed = (
        raw_defs.select(
            "job_id", "created_time",
            F.col("settings.name").alias("pipeline"),
            F.expr("try_cast(settings.max_concurrent_runs as int)").alias("max_concurrent_runs"),
            "settings.tags.*",
        )
        .where(F.col("state").isNotNull() & (F.col("pipeline") != F.lit(PLACEHOLDER_PIPELINE)))
        .fillna({"cron": vocab.DEFAULT_CRON, "tz": vocab.DEFAULT_TZ, "spec": vocab.DEFAULT_SPEC,
                 "onfail": vocab.DEFAULT_ONFAIL})
    )
    return parsed.select(
        "job_id", "created_time", "pipeline", "state", "max_concurrent_runs", "cron",
        F.when(F.col("spec") != F.lit(vocab.SPEC_NONE), F.lit(vocab.FISCAL_TZ)).otherwise(F.col("tz")).alias("tz"),
        "spec", "onfail",
        _joined("sdep", "sdep2").alias("sdep"),
        _joined("tdep", "tdep2").alias("tdep"),
        _joined("cdep", "cdep2").alias("cdep"),
    )
