"""Files of the logs: retention by size and modification time, and compaction of a month's many small batches.

A log is appended to in batches, one folder ``yyyymm=M/batch=B`` each.  Compaction rewrites a month's batches as one
batch ``compact-...`` of files near a target size and then commits a manifest, beside the log in ``<log>.compacted``:
the batch that is read from now on and the batches that it stands for.  A manifest is one file, created with
``overwrite=false`` under the month's next number, so of two compactions of a month one commits.  Readers skip batches
that a manifest replaces and compacted ones that none names: they see a month before or after, never half, and a
compaction that dies leaves only files that nobody reads.  Files are deleted by ``vacuum`` alone, some time after.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.joins import broadcast_if_small
from ..session import ensure_checkpoint_dir, path_exists

COMPACTED = "compact-"
TARGET_BYTES = 128 * 1024 * 1024
LISTING = "path string, length long, modified timestamp"
MARKS = "yyyymm string, batch string, hidden boolean, since timestamp"
MAX_READS = 10


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, modified`` of every file below a folder, at any depth; hidden files (``_``, ``.``) are not listed.

    No file is opened; conditions on ``length`` and ``modified`` reach the listing.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], LISTING)
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select("path", "length", F.col("modificationTime").alias("modified")))


def expired_files(listing: DataFrame, as_of: int, retention_ms: int = vocab.LOG_RETENTION_MS) -> DataFrame:
    """O17 by file: those that hold anything and were last written at or before ``as_of`` (s) less the retention."""
    cutoff = F.timestamp_millis(F.lit(int(as_of) * 1000 - int(retention_ms)))
    return listing.where((F.col("length") > 0) & (F.col("modified") <= cutoff))


def _fs(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def drop_expired_files(spark: SparkSession, path: str, as_of: int, retention_ms: int = vocab.LOG_RETENTION_MS) -> int:
    """Delete the expired files of a log, and the folders that this empties; the number of files deleted.

    Each file is deleted by itself, and a folder only when it is empty, so what a writer adds meanwhile stays.
    """
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return 0
    root, n, folders = fs.resolvePath(root), 0, set()
    for row in expired_files(list_files(spark, path), as_of, retention_ms).select("path").toLocalIterator():
        file = _fs(spark, row.path)[1]
        n += bool(fs.delete(file, False))
        folders.add(file.getParent().toString())
    for name in sorted(folders, key=len, reverse=True):
        folder = _fs(spark, name)[1]
        while folder.depth() > root.depth() and fs.exists(folder) and not fs.listStatus(folder):
            fs.delete(folder, False)
            folder = folder.getParent()
    return n


def _manifest_dir(path: str) -> str:
    return f"{path.rstrip('/')}.compacted"


def _generations(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The numbers of each month's manifests."""
    fs, pattern = _fs(spark, f"{_manifest_dir(path)}/yyyymm=*/*.json")
    found: dict[str, list[int]] = {}
    for status in fs.globStatus(pattern) or []:
        name = status.getPath()
        found.setdefault(name.getParent().getName().split("=", 1)[1], []).append(int(name.getName().split(".")[0]))
    return {month: sorted(each) for month, each in found.items()}


def _marks(spark: SparkSession, path: str) -> DataFrame:
    """What the newest manifest of each month says: the batch that is read and those it stands for."""
    if not path_exists(spark, _manifest_dir(path)):
        return spark.createDataFrame([], MARKS)
    rows = spark.read.schema("live string, replaced array<string>, yyyymm string").json(_manifest_dir(path))
    number = F.split_part(F.col("_metadata.file_name"), F.lit("."), F.lit(1)).cast("int")
    newest = (rows.select("*", number.alias("number"), F.col("_metadata.file_modification_time").alias("since"))
              .where("live is not null").groupBy("yyyymm")
              .agg(F.max_by(F.struct("live", "replaced", "since"), "number").alias("m")))
    return newest.select("yyyymm", F.explode(F.concat(
        F.transform("m.replaced", lambda b: F.struct(b.alias("batch"), F.lit(True).alias("hidden"))),
        F.array(F.struct(F.col("m.live").alias("batch"), F.lit(False).alias("hidden"))))).alias("b"), "m.since").select(
        "yyyymm", "b.batch", "b.hidden", "since")


def _marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows(yyyymm, batch, ...)`` with ``hidden``: a replaced batch, or a compacted one that no manifest names."""
    return (rows.join(broadcast_if_small(marks), ["yyyymm", "batch"], "left")
            .withColumn("hidden", F.coalesce("hidden", F.startswith("batch", F.lit(COMPACTED)))))


def read_visible(spark: SparkSession, path: str, load: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``load()`` (which lists the log's files) in batches that count now."""
    for _ in range(MAX_READS):
        before = _generations(spark, path)
        marks, rows = _marks(spark, path), load()
        if before == _generations(spark, path):       # no compaction came between the manifests and the listing
            break
    # without a manifest this is a condition on the folder's name
    if not before:
        return rows.where(~F.startswith("batch", F.lit(COMPACTED)))
    return _marked(rows, marks).where(~F.col("hidden")).select(*rows.columns)


def _batches(spark: SparkSession, path: str) -> DataFrame:
    """Every file of the log with the month and batch of its folder."""
    def part(name):
        raw = F.regexp_extract("path", f"/{name}=([^/]*)/", 1)       # special characters stand as %XX in a folder's name
        return F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))).alias(name)

    return list_files(spark, path).select(part("yyyymm"), part("batch"), "path", "length", "modified").where("batch <> ''")


def compact(spark: SparkSession, path: str, load: Callable[[], DataFrame], options: dict[str, str],
            target_bytes: int = TARGET_BYTES, settle_ms: int = 3_600_000, now_ms: int | None = None) -> list[str]:
    """Rewrite each month that has more files than its size asks for; the months committed.

    ``load()`` gives the log's rows as they lie in its files, with ``yyyymm`` and ``batch``; ``options`` are those of its
    CSV files.  Batches written less than ``settle_ms`` ago are left for later.  A month is dealt out by a hash of its
    rows over as many files as its bytes ask for, so one that holds most of the log is no single task.  Doing it
    again changes nothing; a batch that is replaced does not come back when it is written again.
    """
    now = int(time.time() * 1000) if now_ms is None else int(now_ms)
    ensure_checkpoint_dir(spark)
    numbers = _generations(spark, path)
    visible = _marked(_batches(spark, path), _marks(spark, path)).where(~F.col("hidden"))
    each = (visible.groupBy("yyyymm", "batch")
            .agg(F.sum("length").alias("bytes"), F.count("*").alias("files"), F.max("modified").alias("modified"))
            .where(F.col("modified") <= F.timestamp_millis(F.lit(now - int(settle_ms)))).checkpoint())
    per_month = (each.groupBy("yyyymm").agg(F.sum("files").alias("files"), F.ceil(F.sum("bytes") / F.lit(int(target_bytes)))
                                            .cast("int").alias("wanted")).where("files > wanted"))
    months = {r.yyyymm: r.wanted for r in per_month.collect()}       # a row a month
    if not months:
        return []
    wanted = spark.createDataFrame(sorted(months.items()), "yyyymm string, _files int")
    names = broadcast_if_small(each.join(F.broadcast(wanted), "yyyymm").select("yyyymm", "batch", "_files"))
    rows = load()
    columns = [c for c in rows.columns if c not in ("yyyymm", "batch")]
    live = f"{COMPACTED}{uuid.uuid4().hex}"
    (rows.join(names, ["yyyymm", "batch"])
     .withColumns({"_file": F.pmod(F.xxhash64(*columns), F.col("_files")), "batch": F.lit(live)})
     .repartition(sum(months.values()), "yyyymm", "_file").sortWithinPartitions("yyyymm", *columns[:1])
     .select(*columns, "yyyymm", "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("yyyymm", "batch").options(**options).csv(path))
    before = _marks(spark, path).where("hidden").select("yyyymm", "batch")
    stood_for = {r.yyyymm: sorted(r.batches) for r in each.select("yyyymm", "batch").unionByName(before)
                 .join(F.broadcast(wanted), "yyyymm").groupBy("yyyymm").agg(F.collect_set("batch").alias("batches")).collect()}
    done = []
    for month in sorted(months):
        number = max(numbers.get(month, [0])) + 1
        if _commit(spark, f"{_manifest_dir(path)}/yyyymm={month}/{number:09d}.json", live, stood_for[month]):
            done.append(month)
        else:                                         # another compaction of the month came first
            fs, folder = _fs(spark, f"{path.rstrip('/')}/yyyymm={month}/batch={live}")
            fs.delete(folder, True)
    return done


def _commit(spark: SparkSession, path: str, live: str, replaced: list[str]) -> bool:
    fs, file = _fs(spark, path)
    try:
        out = fs.create(file, False)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    try:
        out.write(bytearray(json.dumps({"live": live, "replaced": replaced}).encode()))
    finally:
        out.close()
    return True


def vacuum(spark: SparkSession, path: str, keep_ms: int = 86_400_000, now_ms: int | None = None) -> int:
    """Delete batches that a manifest has replaced, and compacted ones that none names, ``keep_ms`` later; their number.

    Manifests but the newest of each month go as well.  Reads that began longer ago than ``keep_ms`` fail on a missing file.
    """
    now = int(time.time() * 1000) if now_ms is None else int(now_ms)
    marked = _marked(_batches(spark, path), _marks(spark, path)).where("hidden")
    folders = (marked.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"))
               .agg(F.max(F.coalesce("since", "modified")).alias("since"))
               .where(F.col("since") <= F.timestamp_millis(F.lit(now - int(keep_ms)))))
    n = 0
    for row in folders.select("folder").toLocalIterator():
        fs, folder = _fs(spark, row.folder)
        n += bool(fs.delete(folder, True))
    for month, numbers in _generations(spark, path).items():
        for number in numbers[:-2]:                   # the one before the newest stays for readers that just looked
            fs, file = _fs(spark, f"{_manifest_dir(path)}/yyyymm={month}/{number:09d}.json")
            fs.delete(file, False)
    return n


__all__ = ["list_files", "expired_files", "drop_expired_files", "read_visible", "compact", "vacuum"]
