"""Zone validation: Spark raises on an unknown zone, so zones are checked before use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Offsets Spark accepts besides region ids: Z, +h, +hh, +h:mm, +hh:mm, +hhmm (optionally after UTC/GMT/UT), up to
# 18 hours; minutes without a colon need two hour digits.
OFFSET_PATTERN = (r"^(?:(?:UTC|GMT|UT)?[+-](?:0?[0-9]|1[0-8]|(?:0?[0-9]|1[0-7]):[0-5][0-9]|18:00"
                  r"|(?:0[0-9]|1[0-7])[0-5][0-9]|1800)|Z|UTC|GMT|UT)$")


_ZONE_IDS: list[str] | None = None


def zone_ids(spark: SparkSession) -> list[str]:
    """Region ids and short aliases known to the JVM (about 600; falls back to Python's tz list)."""
    global _ZONE_IDS
    if _ZONE_IDS is not None:
        return _ZONE_IDS
    try:
        jz = spark.sparkContext._jvm.java.time.ZoneId
        ids = set(jz.getAvailableZoneIds()) | set(jz.SHORT_IDS.keySet())
    except Exception:  # no JVM gateway (e.g. a Connect session)
        import zoneinfo
        ids = set(zoneinfo.available_timezones())
    _ZONE_IDS = sorted(ids)
    return _ZONE_IDS


def zone_table(spark: SparkSession) -> DataFrame:
    """One row per known zone id: a fixed-size table (bounded by the JVM's zone list)."""
    return spark.createDataFrame([(z,) for z in zone_ids(spark)], "zone_id string")


def with_zone_check(df: DataFrame, tz_col: str, out_col: str = "tz_ok") -> DataFrame:
    """Add ``out_col`` = whether ``tz_col`` names a zone Spark can convert with."""
    zones = F.broadcast(zone_table(df.sparkSession).withColumn("_known", F.lit(True)))
    joined = df.join(zones, df[tz_col] == zones["zone_id"], "left")
    ok = F.coalesce(F.col("_known"), F.lit(False)) | F.coalesce(F.col(tz_col).rlike(OFFSET_PATTERN), F.lit(False))
    return joined.withColumn(out_col, ok).drop("zone_id", "_known")


def safe_zone(tz: Column, ok: Column) -> Column:
    """The zone when it is valid, else null (conversions with a null zone give null)."""
    return F.when(ok, tz)
