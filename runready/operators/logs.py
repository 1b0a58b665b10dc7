"""Log sinks and retention: O15 decision_log, O16 invocation_log, O17 expire_log.

* Decision log: the decision rows of one pass plus the pass instant, partitioned by
  (log_date, log_time).  Writes use dynamic partition overwrite, so replaying a pass
  replaces its own partition instead of appending a second copy.
* Invocation log: one line per started job, pipe-separated with every field quoted and a
  header, partitioned by the month of its start (``yyyymm``); appends.
* Retention: rows (and partitions) whose instant is at or before ``as_of - retention``
  expire; partition folders are dropped through the Hadoop FileSystem API.  ``log_files`` has retention by
  the size and time of files, and the compaction of the invocation log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import vocab
from ..session import path_exists
from . import log_files

_DECISION_TYPES = {
    "as_of": T.LongType(), "job_id": T.LongType(), "lock_flag": T.IntegerType(), "last_start_time": T.LongType(),
    "last_end_time": T.LongType(), "prev_min_exec_time": T.LongType(), "next_min_exec_time": T.LongType(),
    "prev_fcl_per_start_time": T.LongType(), "prev_fcl_per_first_mon": T.LongType(),
    "prev_fcl_qtr_start_time": T.LongType(), "prev_fcl_qtr_first_mon": T.LongType(),
    "dep_start_time": T.LongType(), "dep_end_time": T.LongType(), "readiness": T.IntegerType(),
    **{f"{k}dep_{t}_time": T.LongType() for k in "tc" for t in ("start", "end")},
}


def _log_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, _DECISION_TYPES.get(c, T.StringType())) for c in columns]
                        + [T.StructField("log_date", T.StringType()), T.StructField("log_time", T.LongType())])


DECISION_LOG = _log_schema(schemas.DECISION_COLUMNS)
# the log of wide decision rows (``operators.product``)
PRODUCT_LOG = _log_schema(schemas.PRODUCT_COLUMNS)
SHAPES = {"factored": DECISION_LOG, "product": PRODUCT_LOG}

# Pipe-separated, every field quoted, whitespace kept, null written as \N so that an
# empty string and a null survive the round trip as themselves.
CSV_OPTIONS = {"sep": "|", "header": "true", "quoteAll": "true", "escape": '"', "nullValue": "\\N",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _csv(writer_or_reader, fmt: str):
    return writer_or_reader.options(**CSV_OPTIONS) if fmt == "csv" else writer_or_reader


# Characters that would end a line, stand for null or start an escape, and what is written for them; undone in
# reverse order, so that any string survives and files stay splittable at line ends.
ESCAPES = [("%", "%25"), ("\n", "%0A"), ("\r", "%0D"), ("\\", "%5C")]


def _each_string(df: DataFrame, change) -> DataFrame:
    return df.select(*[change(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
                       for f in df.schema.fields])


def _escaped(c):
    for char, code in ESCAPES:
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def _unescaped(c):
    for char, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def _delete(spark: SparkSession, path: str) -> None:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def _partition(path: str, as_of: int) -> str:
    from datetime import UTC, datetime
    day = datetime.fromtimestamp(int(as_of), UTC).strftime("%Y-%m-%d")
    return f"{path.rstrip('/')}/log_date={day}/log_time={int(as_of)}"


def write_decision_log(decisions: DataFrame, path: str, as_of: int | None = None, fmt: str = "csv",
                       shape: str = "factored") -> None:
    """Write decision rows, one partition per pass instant (idempotent per instant).

    ``shape``: "factored" for ``readiness_rows``, "product" for the wide rows of ``readiness_product``.

    ``as_of`` stamps every row with one pass instant; without it each row's own ``as_of``
    is its log time (decisions at many instants go to one partition per instant).
    """
    t = F.lit(int(as_of)).cast("long") if as_of is not None else F.col("as_of").cast("long")
    out = decisions.select(*SHAPES[shape].fieldNames()[:-2])
    if fmt == "csv":
        out = _each_string(out, _escaped)
    if as_of is not None:                # a replay that yields no rows must leave none
        _delete(decisions.sparkSession, _partition(path, as_of))
    out = out.withColumns({
        "log_date": F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd"),
        "log_time": t,
    })
    w = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("log_date", "log_time")
    _csv(w, fmt).format(fmt).save(path)


def read_decision_log(spark: SparkSession, path: str, fmt: str = "csv", as_of: int | None = None,
                      shape: str = "factored") -> DataFrame:
    """The decision log, or the partition of one pass (only its folder is opened)."""
    reader = _csv(spark.read.schema(SHAPES[shape]), fmt).format(fmt)
    if as_of is not None:
        folder = _partition(path, as_of)
        if not path_exists(spark, folder):
            return spark.createDataFrame([], SHAPES[shape])
        log = reader.option("basePath", path).load(folder)
    else:
        log = reader.load(path)
    return _each_string(log, _unescaped) if fmt == "csv" else log


def write_invocation_log(invocations: DataFrame, path: str, batch: str | None = None) -> None:
    """Append invocation lines, one folder per month of their start time and batch.

    Writing the same ``batch`` again replaces its lines; without one the lines are a batch of their own.
    """
    if batch is not None and batch.startswith(log_files.COMPACTED):
        raise ValueError(f"batch names that begin with {log_files.COMPACTED!r} are taken")
    out = invocations.select(*[F.col(f.name).cast(f.dataType) for f in schemas.INVOCATION.fields])
    out = _each_string(out, _escaped).withColumns({
        "yyyymm": F.date_format(F.timestamp_millis(F.col("start_time")), "yyyyMM"),
        "batch": F.lit(batch if batch is not None else uuid.uuid4().hex)})
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("yyyymm", "batch")
     .options(**CSV_OPTIONS).csv(path))


INVOCATION_FILES = T.StructType(list(schemas.INVOCATION.fields)
                               + [T.StructField("yyyymm", T.StringType()), T.StructField("batch", T.StringType())])


def _invocation_lines(spark: SparkSession, path: str) -> DataFrame:
    """The log's lines as they lie in its files, of all batches."""
    return spark.read.schema(INVOCATION_FILES).options(**CSV_OPTIONS).csv(path)


def read_invocation_log(spark: SparkSession, path: str) -> DataFrame:
    """The invocation lines of all months; a compacted batch stands for those it was made from."""
    lines = log_files.read_visible(spark, path, lambda: _invocation_lines(spark, path))
    return _each_string(lines, _unescaped).drop("batch")


def compact_invocation_log(spark: SparkSession, path: str, **how) -> list[str]:
    """One set of files a month in place of one a batch (see ``log_files.compact``, also for ``how``)."""
    return log_files.compact(spark, path, lambda: _invocation_lines(spark, path), CSV_OPTIONS, **how)


def expire_log(log: DataFrame, as_of: int, retention_ms: int = vocab.LOG_RETENTION_MS,
               time_col: str = "log_time") -> DataFrame:
    """Rows still inside the retention window (instant in seconds > as_of - retention)."""
    # in seconds, so that the filter is a bare column's and reaches the scan
    cutoff = (int(as_of) * 1000 - int(retention_ms)) // 1000
    return log.where(F.col(time_col) > F.lit(cutoff))


def drop_expired_partitions(spark: SparkSession, path: str, as_of: int,
                            retention_ms: int = vocab.LOG_RETENTION_MS) -> list[str]:
    """Delete decision-log pass folders (``log_date=*/log_time=*``) at or before the cutoff."""
    if not path_exists(spark, path):
        return []
    cutoff_ms = int(as_of) * 1000 - int(retention_ms)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    removed = []
    for day in fs.listStatus(root):
        if not day.isDirectory() or not day.getPath().getName().startswith("log_date="):
            continue
        left = 0
        for part in fs.listStatus(day.getPath()):
            name = part.getPath().getName()
            if part.isDirectory() and name.startswith("log_time="):
                if int(name.split("=", 1)[1]) * 1000 <= cutoff_ms:
                    fs.delete(part.getPath(), True)
                    removed.append(f"{day.getPath().getName()}/{name}")
                else:
                    left += 1
        if left == 0:
            fs.delete(day.getPath(), True)
    return removed
