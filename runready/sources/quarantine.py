"""Quarantine of records that do not parse: JSON lines are split into good rows and bad lines with a reason.

A plain read turns a broken line into a row of nulls, which later joins drop without a word.  Here each line is read as text and
parsed against the declared schema in one projection, so nothing is shuffled or read twice but by the sinks:

* ``not json``: the line is no JSON object (cut off, or other text);
* ``wrong type``: JSON, but a field does not fit its declared type;
* ``missing <field>``: a required field is absent or null.

Blank lines are no records.  Unknown fields are ignored, as in a plain read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import path_exists

_CORRUPT = "_corrupt_record"
QUARANTINE = T.StructType([T.StructField("line", T.StringType()), T.StructField("reason", T.StringType()),
                           T.StructField("feed", T.StringType()), T.StructField("as_of", T.LongType())])


class TooManyBadRecords(RuntimeError):
    """The share of bad records in a feed is over its limit."""


def split_lines(lines: DataFrame, schema: T.StructType, required: tuple[str, ...] = (), line_col: str = "value") -> DataFrame:
    """``line, reason, record`` of every non-blank line: ``reason`` is null for a good one, ``record`` holds its fields.

    ``required`` names fields (dots for nested ones) that must not be null.
    """
    parsed_schema = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    line = F.col(f"`{line_col}`")
    rows = (lines.where(F.length(F.trim(line)) > 0)
            .select(line.alias("line"), F.from_json(line, parsed_schema, {
                "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("_r")))
    is_object = F.ltrim("line").startswith("{") & F.get_json_object("line", "$").isNotNull()
    missing = [F.when(F.col(f"_r.{f}").isNull(), F.lit(f"missing {f}")) for f in required]
    reason = F.when(~is_object, F.lit("not json")).when(F.col(f"_r.{_CORRUPT}").isNotNull(), F.lit("wrong type"))
    fields = F.struct(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])
    return rows.select("line", F.coalesce(reason, *missing).alias("reason"), fields.alias("record"))


def read_checked(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """``split_lines`` of the JSON-lines files at ``path``."""
    return split_lines(spark.read.text(path), schema, required)


def good_rows(split: DataFrame) -> DataFrame:
    """The good records, in the declared schema."""
    return split.where(F.col("reason").isNull()).select("record.*")


def write_quarantine(split: DataFrame, path: str, feed: str, as_of: int) -> None:
    """Write the bad lines of one feed and pass; a replayed pass replaces its own partition, also when nothing is left to write."""
    spark = split.sparkSession
    part = f"{path.rstrip('/')}/feed={feed}/as_of={int(as_of)}"
    (split.where(F.col("reason").isNotNull()).select("line", "reason").write.mode("overwrite").parquet(part))
    spark.catalog.refreshByPath(path)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """All quarantined lines: ``line, reason, feed, as_of``."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], QUARANTINE)
    return spark.read.schema(QUARANTINE).option("basePath", path).parquet(path)


def error_gate(split: DataFrame, max_share: float) -> dict[str, int]:
    """Counts by reason (``good`` among them); raises ``TooManyBadRecords`` where bad lines are over ``max_share`` of all.

    One aggregate over the lines: a handful of reasons reach the driver.
    """
    counts = {r["reason"] or "good": r["count"] for r in split.groupBy("reason").count().collect()}
    total = sum(counts.values())
    bad = total - counts.get("good", 0)
    if total and bad > max_share * total:
        raise TooManyBadRecords(f"{bad} of {total} records are bad, over {max_share:.2%}: {counts}")
    return counts


__all__ = ["split_lines", "read_checked", "good_rows", "write_quarantine", "read_quarantine", "error_gate", "TooManyBadRecords"]
