"""O18 readiness_stream: the readiness pass as a Structured Streaming job over a run log.

Run records land as files; a file ``readStream`` turns each new batch of files into one
micro-batch, and ``foreachBatch`` runs the pass on it:

* the micro-batch is the pass's run selection (records arrive as runs start and change,
  so no high-water mark and no carry-over poll is needed);
* the batch becomes the next state version, whatever wrote the versions before it; each
  version records the last batch of every stream (named by its checkpoint folder), so a
  replay after a failure (Spark re-runs the last uncommitted batch) is skipped if that very
  batch is part of the state, and a batch pass or a new checkpoint folder hides nothing;
* definitions, calendar and external feed may be given as functions: they are called, and so
  read again, for every batch; a feed given as a frame is read once, by the first batch, which
  keeps the rows that give a key its values (``state.decisive_rows``) for itself and all later ones;
* files may arrive in any order: per key the run with the later start and end wins;
* open-slot release counts the runs still active after the batch: the set of active runs
  (latest record per run id, terminal records leave it) is kept with each state version
  and updated from the batch;
* the decision log gets one partition per batch instant (overwritten on replay).

The pass instant of a batch is, by default, the latest run start in it (deterministic on
replay); pass ``as_of_fn`` to use another clock.  Spark's own checkpoint (offsets and
commits) lives in ``checkpoint_location`` on shared storage, so the query survives
driver restarts and executor loss.

Readiness also changes with time alone (a cron fires, a fiscal period starts), but a file
stream only runs a batch when new files arrive.  With ``tick=True`` the run stream is
unioned with Spark's ``rate-micro-batch`` source (one row per trigger), so every trigger
— e.g. ``{"processingTime": "10 minutes"}`` — runs a pass, at the processing time, even
without new runs; the tick rows are dropped before the pass.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..operators import runs as runs_ops
from ..operators import state as st
from ..functions import vocab
from ..plans.readiness_pass import readiness_pass
from ..session import ensure_checkpoint_dir


# name of the active-run table kept with each state version
ACTIVE = st.ACTIVE_RUNS


def batch_instant(batch: DataFrame) -> int | None:
    """Latest run start of a micro-batch, in epoch seconds (rounded up); None when empty."""
    row = batch.agg(F.max("start_time").alias("m")).collect()[0]
    return None if row["m"] is None else -(-int(row["m"]) // 1000)


# attempts of a batch to commit the version after the newest one
MAX_REDOS = 10
INSTANT_SCHEMA = "stream string, batch long, as_of long"


def _now(source: DataFrame | Callable[[], DataFrame] | None) -> DataFrame | None:
    """A frame as it is, or the result of calling a function that reads it."""
    return source if source is None or isinstance(source, DataFrame) else source()


def _attempt(stream: str, batch_id: int) -> str:
    """The folder name of a batch's attempts: a repeated attempt finds what the one before it noted."""
    return f"{hashlib.sha256(stream.encode()).hexdigest()[:12]}-{batch_id}"


def _instant(spark: SparkSession, state_root: str, version: int, stream: str, batch_id: int,
             take: Callable[[], int | None]) -> int | None:
    """The batch's instant: the one noted by an attempt that failed, else ``take()``, noted."""
    attempt = _attempt(stream, batch_id)
    noted = st.read_extra(spark, state_root, version, "instant", INSTANT_SCHEMA, attempt).where(
        (F.col("stream") == stream) & (F.col("batch") == batch_id)).collect()
    if noted:
        return noted[0]["as_of"]
    as_of = take()
    if as_of is not None:
        st.write_extra(spark.createDataFrame([(stream, batch_id, int(as_of))], INSTANT_SCHEMA).coalesce(1),
                       state_root, version, "instant", attempt)
    return as_of


def readiness_stream(spark: SparkSession, runs_dir: str, raw_defs: DataFrame | Callable[[], DataFrame],
                     calendar: DataFrame | Callable[[], DataFrame], state_root: str, log_path: str,
                     checkpoint_location: str, external: DataFrame | Callable[[], DataFrame] | None = None,
                     fmt: str = "json", max_files_per_trigger: int | None = None,
                     as_of_fn: Callable[[DataFrame, int], int | None] | None = None,
                     release_slots: bool = True, trigger: dict | None = None,
                     query_name: str | None = None, tick: bool = False, day_rule: str = "and",
                     log_format: str = "csv", retention_ms: int | None = vocab.LOG_RETENTION_MS,
                     keep_versions: int | None = 100) -> StreamingQuery:
    """Start the stream; ``trigger`` defaults to ``{"availableNow": True}``.

    ``max_files_per_trigger`` decides what one batch, and so one pass and its instant, holds; by default
    a batch takes all files that have arrived.
    """
    stream = checkpoint_location.rstrip("/")
    reader = spark.readStream.schema(schemas.RAW_RUN).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    runs = reader.load(runs_dir).withColumn("_tick", F.lit(False))
    if tick:
        ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load().select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.RAW_RUN.fields], F.lit(True).alias("_tick"))
        runs = runs.unionByName(ticks)
    if as_of_fn is None:
        as_of_fn = (lambda b, i: int(time.time())) if tick else (lambda b, i: batch_instant(b))

    feed_rows: list[DataFrame] = []

    def feed() -> DataFrame | None:
        if not isinstance(external, DataFrame):
            return _now(external)
        if not feed_rows:
            ensure_checkpoint_dir(spark)
            feed_rows.append(st.decisive_rows(st.normalize_external(external), newest_wins=True).checkpoint())
        return feed_rows[0]

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        # the batch is read from its files once: persisted before the instant is taken
        batch = batch.where(~F.col("_tick")).drop("_tick").persist()
        try:
            # where another pass takes the version, the batch goes on top of that one
            if not any(attempt_batch(batch, int(batch_id)) for _ in range(MAX_REDOS)):
                raise st.VersionTaken(f"batch {batch_id} lost its version {MAX_REDOS} times")
        finally:
            batch.unpersist()

    def attempt_batch(batch: DataFrame, batch_id: int) -> bool:
        base = st.latest_version(spark, state_root)
        if base is not None and st.read_batches(spark, state_root, base).get(stream, -1) >= batch_id:
            return True
        version, attempt = (base or 0) + 1, _attempt(stream, batch_id)
        as_of = _instant(spark, state_root, version, stream, batch_id, lambda: as_of_fn(batch, batch_id))
        if as_of is None:
            return True
        prev_active = st.read_extra(spark, state_root, base, ACTIVE, schemas.RAW_RUN)
        # written into the (uncommitted) attempt first, then read back for the slot count
        active = st.write_extra(runs_ops.active_runs(prev_active, batch), state_root, version, ACTIVE, attempt)
        try:
            readiness_pass(spark, _now(raw_defs), batch, _now(calendar), state_root, log_path, as_of,
                           external=feed(), version=version, selected=batch, slot_runs=active,
                           release_slots=release_slots, day_rule=day_rule, log_format=log_format,
                           retention_ms=retention_ms, newest_wins=True, stream_batch=(stream, batch_id),
                           keep_versions=keep_versions, attempt=attempt, exclusive=True)
        except st.VersionTaken:
            return False
        return True

    writer = runs.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_location)
    if query_name:
        writer = writer.queryName(query_name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
