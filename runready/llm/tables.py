"""Reading the given tables and cutting lineage through the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runready.session import shared_path

# Words are runs of anything but the six ASCII white-space characters; ``bytes.split()`` splits
# on exactly these, and ``bytes.lower()`` lowers A-Z alone.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage on shared storage, so a lost executor costs a re-read and not a
    recomputation, and lets each reader prune to the columns it needs.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_words(text: str) -> list[bytes]:
    """The words of ``text`` with A-Z lowered."""
    return text.encode("utf-8").lower().split()


_cache: dict = {}


def worker_cache(key, make):
    """What a Python worker keeps from task to task: the cache of one operator at a time, so that those of a
    pipeline's stages do not add up in workers that Spark uses again."""
    if key not in _cache:
        _cache.clear()
        _cache[key] = make()
    return _cache[key]


def shielded(df: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with all columns but ``own`` under names of their own, and the columns that restore the
    original names and order: an operator's new columns then clash with none of the table's."""
    names = {c: c if c in own else f"x_{k}" for k, c in enumerate(df.columns)}
    return (df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]),
            [F.col(n).alias(c) for c, n in names.items()])


__all__ = ["WORD", "read_table", "stored", "ascii_words", "worker_cache", "shielded"]
