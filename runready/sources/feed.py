"""The external run feed read by file modification time: a pass reads the files that landed since the last one.

The feed keeps its history, and a key's value is its last non-null one over all of it.  So each version keeps, per
(pipeline, source) and column, that value with the times it is ordered by: a greatest value, which new files
can only raise.  The table has a row per key, however long the feed; beside it stands the newest modification time read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import state
from .readers import read_external

_KEY = ("pipeline", "source")
_VALUES = tuple(f for f in schemas.STATE.fields if f.name not in _KEY)
KEPT = T.StructType([*[T.StructField(c, T.StringType()) for c in _KEY],
                     *[T.StructField(f.name, T.StructType([T.StructField("end", T.LongType()), T.StructField("start", T.LongType()),
                                                           T.StructField("v", f.dataType)])) for f in _VALUES],
                     T.StructField("seen_ms", T.LongType()), T.StructField("fresh", T.BooleanType())])


def read_since(spark: SparkSession, path: str, since_ms: int | None, schema: T.StructType | None = None) -> DataFrame:
    """Rows of the feed's files modified at or after ``since_ms`` (None: all), with ``seen_ms``, their file's time.

    The condition is on a file's metadata: files before it are not opened.  ``schema`` spares the look
    into a file's footer.
    """
    rows = spark.read.schema(schema).parquet(path) if schema is not None else read_external(spark, path)
    landed = F.col("_metadata.file_modification_time")
    if since_ms is not None:
        rows = rows.where(landed >= F.timestamp_millis(F.lit(int(since_ms))))
    return rows.select("*", F.unix_millis(landed).alias("seen_ms"))


def advance_feed(spark: SparkSession, path: str, root: str, version: int, base: int | None, attempt: str,
                 schema: T.StructType | None = None, overlap_ms: int = 0, name: str = "feed") -> DataFrame:
    """State rows of the keys that files landed since version ``base`` hold; the feed's table goes into the attempt.

    Files modified at the newest time that ``base`` knows are read again, and those up to ``overlap_ms`` before it, for files
    that show up late; a row read twice changes nothing.  Without a table in ``base`` the whole feed is read.
    ``name`` tells the tables of several feeds apart.
    """
    before = state.read_extra(spark, root, base, name, KEPT) if base is not None else spark.createDataFrame([], KEPT)
    mark = before.agg(F.max("seen_ms")).first()[0]
    rows = read_since(spark, path, None if mark is None else mark - overlap_ms, schema)
    seen = F.col("seen_ms")
    normal = state.normalize_external(rows.withColumn("_seen", seen), keep=("_seen",))
    new = _greatest(normal.select(*_KEY, *[
        F.when(F.col(f.name).isNotNull(), F.struct(F.col("end_time").alias("end"), F.col("start_time").alias("start"),
                                                   F.col(f.name).alias("v"))).alias(f.name) for f in _VALUES],
        F.col("_seen").alias("seen_ms"), F.lit(True).alias("fresh")))
    both = _greatest(before.withColumn("fresh", F.lit(False)).unionByName(new))
    kept = state.write_extra(both.select(*KEPT.fieldNames()), root, version, name, attempt)
    return kept.where("fresh").select(*[c if c in _KEY else F.col(f"{c}.v").alias(c) for c in schemas.STATE_COLUMNS])


def _greatest(rows: DataFrame) -> DataFrame:
    """One row per key; greatest value of every other column, so partial results combine in any order."""
    return rows.groupBy(*_KEY).agg(*[F.max(f.name).alias(f.name) for f in KEPT.fields if f.name not in _KEY])


__all__ = ["read_since", "advance_feed", "KEPT"]
