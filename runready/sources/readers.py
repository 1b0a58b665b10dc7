"""Readers for the engine's inputs as landed files, each with a declared schema."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Job definitions as JSON lines (one job object per line); unknown keys are dropped."""
    return spark.read.schema(schemas.DEFINITION).json(path)


def read_runs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Run records (JSON lines or Parquet) in the raw nested shape."""
    return spark.read.schema(schemas.RAW_RUN).format(fmt).load(path)


# Attempts and wait between them when the external feed cannot be listed.
EXTERNAL_READ_ATTEMPTS = 5
EXTERNAL_READ_WAIT_S = 10


def read_external(spark: SparkSession, path: str, attempts: int = EXTERNAL_READ_ATTEMPTS,
                  wait_s: float = EXTERNAL_READ_WAIT_S) -> DataFrame:
    """External run feed (Parquet, glob allowed); its schema comes from the files.

    Resolving the files (listing + footer schema) is retried ``attempts`` times ``wait_s``
    apart, since the feed is landed by another system; reading the data itself is left to
    Spark's task retries.  The last error is raised.
    """
    last = None
    for i in range(max(1, attempts)):
        try:
            return spark.read.parquet(path)
        except Exception as e:  # missing path, partial landing, transient store errors
            last = e
            if i + 1 < attempts:
                time.sleep(wait_s)
    raise last


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Fiscal calendar as CSV with a header, read with the declared schema (no inference)."""
    return spark.read.schema(schemas.CALENDAR).option("header", "true").csv(path)


def read_definition_pages(spark: SparkSession, path: str) -> DataFrame:
    """Job definitions from landed list-API pages (``{"jobs": [...], "has_more": ...}``, one per line)."""
    page = T.StructType([T.StructField("jobs", T.ArrayType(schemas.DEFINITION))])
    return spark.read.schema(page).json(path).select(F.explode("jobs").alias("j")).select("j.*")


def read_run_pages(spark: SparkSession, path: str) -> DataFrame:
    """Run records from landed run-list pages (``{"runs": [...], "has_more": ...}``, one per line)."""
    page = T.StructType([T.StructField("runs", T.ArrayType(schemas.RAW_RUN))])
    return spark.read.schema(page).json(path).select(F.explode("runs").alias("r")).select("r.*")


def read_checkpoint_text(spark: SparkSession, path: str) -> int | None:
    """A checkpoint saved as one integer (epoch ms) in a text file; None when missing or not a number."""
    try:
        rows = spark.read.text(path).limit(1).collect()
    except Exception:
        return None
    try:
        return int(rows[0]["value"].strip()) if rows else None
    except ValueError:
        return None
