"""State-table operators: O9 normalize_external, O10 combine_runs, O11 merge_state.

The state table holds the latest known run per (pipeline, source).  Each pass reads version v and
adds version v+1.  The rows lie in buckets, a hash of (pipeline, source); a pass reads the buckets that
its new rows fall into and writes those whose rows change, and a version names the files of each bucket.
Files are never overwritten: every attempt at a version has folders of its own, and one of them is
committed, by creating the version's marker file where there is none.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import vocab
from ..session import list_dirs, path_exists


def normalize_external(ext: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """External feed -> state rows.

    All external runs share one job id; ``lock`` is kept as the string "0"/"1" (a union
    with an integer lock would otherwise turn the column into bigint under ANSI); times
    of any castable type become epoch seconds.  ``keep`` names further columns to carry along.
    """
    def epoch(c: str):
        return F.unix_timestamp(F.expr(f"try_cast({c} as timestamp)")).cast("long")

    return ext.select(
        F.lit(vocab.EXTERNAL_JOB_ID).cast("long").alias("job_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lock").cast("string").alias("lock"),
        F.col("status").cast("string").alias("status"),
        F.col("pipeline").cast("string").alias("pipeline"),
        epoch("start_time").alias("start_time"),
        epoch("end_time").alias("end_time"),
        *keep,
    )


def combine_runs(*frames: DataFrame, distinct: bool = False) -> DataFrame:
    """Union of state-row frames by column name (UNION ALL unless ``distinct``)."""
    if not frames:
        raise ValueError("combine_runs needs at least one frame")
    out = frames[0].select(*schemas.STATE_COLUMNS)
    for f in frames[1:]:
        out = out.unionByName(f.select(*schemas.STATE_COLUMNS))
    return out.distinct() if distinct else out


_KEY = ("pipeline", "source")
_VALUES = tuple(c for c in schemas.STATE_COLUMNS if c not in _KEY)


def merge_state(old: DataFrame, new: DataFrame, newest_wins: bool = False) -> DataFrame:
    """One row per (pipeline, source); each column takes its last non-null value.

    Old rows come before new ones, and rows of one side are ordered by end and start (null first);
    ``newest_wins`` orders by start and end first and by side last, for records that may arrive
    late.  Rows are never deleted.  A key that a side repeats (a feed that keeps history) yields
    one row all the same, so equal passes leave the state's size as it is; a null in a key
    is a value like any other.

    One aggregate per key with a map-side partial: a hot key costs a row per map task, and
    neither side is joined or counted.
    """
    return _merged(old, new, newest_wins).select(*schemas.STATE_COLUMNS)


def decisive_rows(rows: DataFrame, newest_wins: bool = False) -> DataFrame:
    """The rows that give a key one of its values in ``merge_state``, whatever they are merged with.

    As many as there are value columns at most, however many rows of a key a feed holds: merging them
    in place of all ``rows`` (as the new side) gives the same state.
    """
    order = ["start_time", "end_time"] if newest_wins else ["end_time", "start_time"]
    # the greatest by time, then by the value, as in ``_merged``; the whole row goes along
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(*[F.col(o).alias(f"o{k}") for k, o in enumerate(order)],
                                                        F.col(c).alias("v"), F.struct(*_VALUES).alias("row")))).alias(c) for c in _VALUES]
    found = rows.groupBy(*_KEY).agg(*last)
    picked = F.array_distinct(F.filter(F.array(*[F.col(f"{c}.row") for c in _VALUES]), lambda r: r.isNotNull()))
    # a key without any value has a row all the same
    none = F.array(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.STATE.fields if f.name not in _KEY]))
    each = found.select(*_KEY, F.explode(F.when(F.size(picked) > 0, picked).otherwise(none)).alias("row"))
    return each.select(*_KEY, "row.*").select(*schemas.STATE_COLUMNS)


def _merged(old: DataFrame, new: DataFrame, newest_wins: bool) -> DataFrame:
    """``merge_state`` and ``changed``: the key is new, or a value is not the one of its (greatest) old row."""
    rows = (old.select(*schemas.STATE_COLUMNS).withColumn("_side", F.lit(0))
            .unionByName(new.select(*schemas.STATE_COLUMNS).withColumn("_side", F.lit(1))))
    order = ["start_time", "end_time", "_side"] if newest_wins else ["_side", "end_time", "start_time"]
    # the value itself comes last: rows that tie in time still give one answer
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(*[F.col(o).alias(f"o{k}") for k, o in enumerate(order)],
                                                        F.col(c).alias("v")))).alias(c) for c in _VALUES]
    was = F.max(F.when(F.col("_side") == 0, F.struct(*_VALUES))).alias("_was")
    merged = rows.groupBy(*_KEY).agg(*last, was)
    merged = merged.select(*[c if c in _KEY else F.col(f"{c}.v").alias(c) for c in schemas.STATE_COLUMNS], "_was")
    return merged.withColumn("changed", F.col("_was").isNull() | ~F.col("_was").eqNullSafe(F.struct(*_VALUES))).drop("_was")


# ---- versioned storage -------------------------------------------------------------
#
# A pass writes, for version 7 and an attempt of its own:
#
# <root>/data/written=000000007-<attempt>/bucket=3   the rows of a bucket that the pass changed (Parquet)
# <root>/v=000000007/<attempt>/buckets      for each bucket, the ``written`` folder that holds its rows
# <root>/v=000000007/<attempt>/checkpoint   one row: the high-water mark (ms) the next pass starts from, and the last
#                                         batch of each stream that is part of the state (carried from version to version)
# <root>/v=000000007/_committed             the attempt that the version is; created last, and only where there is none
#
# ``write_state`` writes a whole table at once, into the version's own folder (state, checkpoint); such a version is
# committed once its checkpoint has _SUCCESS.

CHECKPOINT_SCHEMA = "hwm_ms long, batches map<string, long>"
MANIFEST_SCHEMA = "bucket int, written string"
# name of the active-run table kept with each version (runs active at that pass)
ACTIVE_RUNS = "active_runs"
# buckets of a new state; a state keeps its number
STATE_BUCKETS = 32


class VersionTaken(RuntimeError):
    """Another pass committed the version first: this one was worked out from a state that is no longer the newest."""


def _version_dir(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/v={version:09d}"


def new_attempt() -> str:
    return uuid.uuid4().hex[:12]


def _version_numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all version folders, committed or not, ascending: one listing."""
    return sorted(int(n[2:]) for n in list_dirs(spark, root) if n.startswith("v=") and n[2:].isdigit())


def _fs(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def _delete(spark: SparkSession, path: str) -> None:
    fs, hpath = _fs(spark, path)
    fs.delete(hpath, True)


def _winner(spark: SparkSession, root: str, version: int) -> str | None:
    """The attempt named by the version's marker; None without a marker, or while it is being written."""
    fs, marker = _fs(spark, f"{_version_dir(root, version)}/_committed")
    if not fs.exists(marker):
        return None
    stream = fs.open(marker)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") or None
    finally:
        stream.close()


def _home(spark: SparkSession, root: str, version: int) -> str | None:
    """The folder of a committed version's tables; None when the version is not committed."""
    folder = _version_dir(root, version)
    winner = _winner(spark, root, version)
    if winner:
        return f"{folder}/{winner}"
    return folder if path_exists(spark, f"{folder}/checkpoint/_SUCCESS") else None


def _committed(spark: SparkSession, root: str, version: int) -> bool:
    return _home(spark, root, version) is not None


def state_versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions under ``root``, ascending (asks the store once per version)."""
    return [v for v in _version_numbers(spark, root) if _committed(spark, root, v)]


def latest_version(spark: SparkSession, root: str, below: int | None = None) -> int | None:
    """Greatest committed version (below ``below``): one listing and a look at the newest folders."""
    for v in reversed(_version_numbers(spark, root)):
        if (below is None or v < below) and _committed(spark, root, v):
            return v
    return None


def prune_versions(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Delete the version folders older than the ``keep`` newest committed ones; returns their numbers."""
    numbers = _version_numbers(spark, root)
    kept, oldest = 0, None
    for v in reversed(numbers):
        if _committed(spark, root, v):
            kept, oldest = kept + 1, v
            if kept == max(1, keep):
                break
    gone = [v for v in numbers if oldest is not None and kept >= keep and v < oldest]
    if gone:
        kept_homes = [h for v in numbers if v >= oldest and (h := _home(spark, root, v))]
        _prune_data(spark, root, oldest, [f"{h}/buckets" for h in kept_homes if path_exists(spark, f"{h}/buckets/_SUCCESS")])
    for v in gone:
        _delete(spark, _version_dir(root, v))
    return gone


def _prune_data(spark: SparkSession, root: str, oldest: int, manifests: list[str]) -> None:
    """Delete the bucket folders written before version ``oldest`` that none of the kept versions' ``manifests`` names."""
    data = f"{root.rstrip('/')}/data"
    early = [f for f in list_dirs(spark, data) if int(f.removeprefix("written=").split("-", 1)[0]) < oldest]
    if not early:
        return
    named = set()
    if manifests:                        # at most a row per early folder and bucket
        rows = spark.read.schema(MANIFEST_SCHEMA).parquet(*manifests).where(F.col("written") < F.lit(f"{oldest:09d}"))
        named = {(f"written={r.written}", f"bucket={r.bucket}") for r in rows.distinct().collect()}
    used = {w for w, _ in named}
    for folder in early:
        if folder not in used:
            _delete(spark, f"{data}/{folder}")
            continue
        for bucket in list_dirs(spark, f"{data}/{folder}"):
            if (folder, bucket) not in named:
                _delete(spark, f"{data}/{folder}/{bucket}")


def read_state(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """State at ``version`` (latest committed when None); an empty state when there is none."""
    if version is None:
        version = latest_version(spark, root)
    if version is None:
        return spark.createDataFrame([], schemas.STATE)
    home = _home(spark, root, version) or _version_dir(root, version)
    manifest = _manifest(spark, home)
    return _read_buckets(spark, root, manifest) if manifest else spark.read.schema(schemas.STATE).parquet(f"{home}/state")


def _manifest(spark: SparkSession, home: str | None) -> dict[int, str | None]:
    """Bucket -> ``written`` folder (None: no rows yet); empty for a version without buckets.  A row per bucket reaches the driver."""
    if home is None or not path_exists(spark, f"{home}/buckets/_SUCCESS"):
        return {}
    return {r.bucket: r.written for r in spark.read.schema(MANIFEST_SCHEMA).parquet(f"{home}/buckets").collect()}


def _read_buckets(spark: SparkSession, root: str, manifest: dict[int, str | None], only: set[int] | None = None) -> DataFrame:
    paths = [f"{root.rstrip('/')}/data/written={w}/bucket={b}" for b, w in sorted(manifest.items())
             if w is not None and (only is None or b in only)]
    return spark.read.schema(schemas.STATE).parquet(*paths) if paths else spark.createDataFrame([], schemas.STATE)


def rewrite_state(old: DataFrame, new: DataFrame, root: str, version: int, base: int | None, attempt: str,
                  newest_wins: bool = False, buckets: int = STATE_BUCKETS) -> DataFrame:
    """``merge_state`` of version ``base`` and ``new``, written as an attempt at ``version``; returns the result read back.

    Of a base in buckets only those that ``new`` falls into are read, and of these only the ones in
    which a row changes are written; all others keep their files.  A base without buckets (None, or a
    table of ``write_state``) is taken from ``old`` and written whole, in one look at ``new``, which is not stored for it.
    """
    spark = new.sparkSession
    named = _manifest(spark, _home(spark, root, base)) if base is not None else {}
    n = len(named) or buckets
    bucket = F.pmod(F.xxhash64(*_KEY), F.lit(n)).cast("int").alias("bucket")
    kept = []
    try:
        if named:
            if new.storageLevel == StorageLevel.NONE:
                kept.append(new.persist())
            touched = {r.bucket for r in new.select(bucket).distinct().collect()}
            old = _read_buckets(spark, root, named, touched)
        merged = _merged(old, new, newest_wins).withColumn("bucket", bucket).persist()
        kept.append(merged)
        rows = merged if not named else merged.where("changed")
        changed = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
        written = f"{version:09d}-{attempt}"
        if changed:
            (merged.where(F.col("bucket").isin(changed)).select(*schemas.STATE_COLUMNS, "bucket").repartition("bucket")
             .write.mode("overwrite").partitionBy("bucket").parquet(f"{root.rstrip('/')}/data/written={written}"))
    finally:
        for df in kept:
            df.unpersist()
    named = {b: named.get(b) for b in range(n)} | dict.fromkeys(changed, written)
    write_extra(spark.createDataFrame(sorted(named.items()), MANIFEST_SCHEMA).coalesce(1), root, version, "buckets", attempt)
    return _read_buckets(spark, root, named)


def _checkpoint_row(spark: SparkSession, root: str, version: int | None):
    if version is None:
        version = latest_version(spark, root)
    folder = None if version is None else f"{_home(spark, root, version) or _version_dir(root, version)}/checkpoint"
    if folder is None or not path_exists(spark, folder):
        return None
    rows = spark.read.schema(CHECKPOINT_SCHEMA).parquet(folder).limit(1).collect()
    return rows[0] if rows else None


def read_checkpoint(spark: SparkSession, root: str, version: int | None = None) -> int | None:
    """High-water mark (ms) stored with ``version``; None when there is none (the next pass is a full load).

    Only a missing mark means a full load: an error of the store or a damaged file is raised.
    """
    row = _checkpoint_row(spark, root, version)
    return row["hwm_ms"] if row else None


def read_batches(spark: SparkSession, root: str, version: int | None = None) -> dict[str, int]:
    """The last batch of each stream that is part of ``version`` (default: the latest)."""
    row = _checkpoint_row(spark, root, version)
    return dict(row["batches"] or {}) if row else {}


def write_state(state: DataFrame, root: str, version: int, hwm_ms: int | None = None,
                extras: dict[str, DataFrame] | None = None, commit: bool = True) -> str:
    """Write ``state`` (and named ``extras`` tables) as ``version``, then commit it.

    The checkpoint is written last and marks the version committed (``commit=False``
    leaves that to ``commit_version``, after work that must precede it); overwrite makes
    a replay idempotent.
    """
    path = _version_dir(root, version)
    state.select(*schemas.STATE_COLUMNS).write.mode("overwrite").parquet(f"{path}/state")
    for name, df in (extras or {}).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    if commit:
        commit_version(state.sparkSession, root, version, hwm_ms)
    return path


def commit_version(spark: SparkSession, root: str, version: int, hwm_ms: int | None,
                   batches: dict[str, int] | None = None) -> None:
    """Write the checkpoint of a ``write_state`` version; its _SUCCESS marks the version committed."""
    _delete(spark, f"{_version_dir(root, version)}/_committed")
    _write_checkpoint(spark, _version_dir(root, version), hwm_ms, batches)


def _write_checkpoint(spark: SparkSession, folder: str, hwm_ms: int | None, batches: dict[str, int] | None) -> None:
    spark.createDataFrame([(hwm_ms, batches or {})], CHECKPOINT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
        f"{folder}/checkpoint")


def commit_attempt(spark: SparkSession, root: str, version: int, attempt: str, hwm_ms: int | None,
                   batches: dict[str, int] | None = None, exclusive: bool = True) -> None:
    """Make ``attempt`` the version: of several passes on one base the first wins, the others get ``VersionTaken``.

    The marker is created with ``overwrite=false``, which is atomic on HDFS and on stores with
    conditional writes.  A marker left empty by a writer that died in between commits nothing, and keeps
    its number taken until it is removed.  ``exclusive=False`` replaces what the version was (a replay).
    """
    folder = _version_dir(root, version)
    if exclusive and path_exists(spark, f"{folder}/checkpoint/_SUCCESS"):
        raise VersionTaken(f"version {version} of {root} is committed")
    _write_checkpoint(spark, f"{folder}/{attempt}", hwm_ms, batches)
    fs, marker = _fs(spark, f"{folder}/_committed")
    try:
        out = fs.create(marker, not exclusive)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise VersionTaken(f"version {version} of {root} is committed") from e
        raise
    try:
        out.write(bytearray(attempt.encode()))
    finally:
        out.close()


def _extra_dir(spark: SparkSession, root: str, version: int, name: str, attempt: str | None) -> str:
    folder = _version_dir(root, version)
    return f"{folder}/{attempt}/{name}" if attempt else f"{_home(spark, root, version) or folder}/{name}"


def has_extra(spark: SparkSession, root: str, version: int, name: str, attempt: str | None = None) -> bool:
    return path_exists(spark, f"{_extra_dir(spark, root, version, name, attempt)}/_SUCCESS")


def read_extra(spark: SparkSession, root: str, version: int | None, name: str, schema, attempt: str | None = None) -> DataFrame:
    """An extra table stored with a version, or with an attempt at it; empty when the version or table is missing."""
    if version is None:
        version = latest_version(spark, root)
    if version is None or not has_extra(spark, root, version, name, attempt):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_extra_dir(spark, root, version, name, attempt))


def write_extra(df: DataFrame, root: str, version: int, name: str, attempt: str) -> DataFrame:
    """Write a table into an attempt at ``version`` and return it read back."""
    path = _extra_dir(df.sparkSession, root, version, name, attempt)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def import_state_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a state table saved as CSV with a header by the reference's pandas writer.

    A nullable integer column is written by pandas as ``1702926855.0``; reading the times
    as double and casting keeps those values instead of turning them into nulls.
    """
    raw = (spark.read.option("header", "true")
           .schema("job_id double, source string, lock string, status string, pipeline string, "
                   "start_time double, end_time double").csv(path))
    return raw.select(
        F.col("job_id").cast("long").alias("job_id"), "source",
        F.regexp_replace(F.col("lock"), r"\.0$", "").alias("lock"), "status", "pipeline",
        F.col("start_time").cast("long").alias("start_time"), F.col("end_time").cast("long").alias("end_time"),
    )
