"""Retention by size and modification time of files; compaction of the invocation log's batches."""

import os
import tempfile

from conftest import rows

from pyspark.sql import functions as F

from runready import schemas
from runready.operators import log_files, logs

AS_OF = 1706702400
DAY = 86400
HOUR_MS = 3_600_000


def _file(path, age_days, content="x", seconds=0):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(content)
    at = AS_OF - age_days * DAY + seconds
    os.utime(path, (at, at))


def test_files_expire_by_size_and_time(spark):
    root = tempfile.mkdtemp(prefix="rr-files-")
    _file(f"{root}/at-the-cutoff.csv", 30)
    _file(f"{root}/inside.csv", 30, seconds=1)
    _file(f"{root}/old-empty.csv", 90, content="")
    _file(f"{root}/a=1/b=2/old.csv", 31)
    _file(f"{root}/a=1/b=3/old.csv", 31)
    _file(f"{root}/a=1/b=3/new file %41.csv", 1)
    _file(f"{root}/a=2/with space/old %41+.csv", 400)
    listing = log_files.list_files(spark, root)
    expired = log_files.expired_files(listing, AS_OF)
    assert "PushedFilters: [IsNotNull(length)" in expired._jdf.queryExecution().toString().replace("DataFilters", "")
    assert expired.count() == 4
    assert log_files.drop_expired_files(spark, root, AS_OF) == 4
    left = sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)
    assert left == ["a=1/b=3/new file %41.csv", "inside.csv", "old-empty.csv"]
    assert not os.path.exists(f"{root}/a=2") and not os.path.exists(f"{root}/a=1/b=2")      # emptied folders go
    assert log_files.drop_expired_files(spark, root, AS_OF) == 0
    assert log_files.drop_expired_files(spark, f"{root}/none", AS_OF) == 0


def _lines(spark, *ids, month=1):
    start = 1704067200000 + (month - 1) * 31 * DAY * 1000
    return spark.createDataFrame([(start + i, start + i + 5, "7", str(i), "db", f"job | \"{i}\"\n\\", str(i), None if i % 2 else "",
                                   "{'k': 'v|w'}") for i in ids], schemas.INVOCATION)


def _files(path, month="202401"):
    return sum(f.endswith(".csv") for d, _, fs in os.walk(f"{path}/yyyymm={month}") for f in fs)


def test_batches_become_one_file_set(spark):
    path = f"{tempfile.mkdtemp(prefix='rr-compact-')}/log"
    expected = []
    for k in range(5):
        lines = _lines(spark, 10 * k, 10 * k + 1).unionByName(_lines(spark, 10 * k, month=2))
        logs.write_invocation_log(lines, path, f"batch {k}+%41")
        expected += rows(lines)
    columns = schemas.INVOCATION.fieldNames()

    def read():
        return rows(logs.read_invocation_log(spark, path), *columns)

    assert read() == sorted(expected, key=lambda t: tuple((x is None, str(x)) for x in t))
    whole = read()
    assert logs.compact_invocation_log(spark, path, settle_ms=HOUR_MS) == []            # too fresh
    assert logs.compact_invocation_log(spark, path, settle_ms=0) == ["202401", "202402"]
    assert read() == whole
    assert logs.compact_invocation_log(spark, path, settle_ms=0) == []                  # nothing left to do
    assert log_files.vacuum(spark, path, keep_ms=HOUR_MS) == 0 and read() == whole
    assert log_files.vacuum(spark, path, keep_ms=0) == 10 and read() == whole
    assert _files(path) == _files(path, "202402") == 1
    # a replaced batch that is written again does not come back; a new one is read at once and compacted with the rest
    logs.write_invocation_log(_lines(spark, 0, 1), path, "batch 0+%41")
    assert read() == whole
    logs.write_invocation_log(_lines(spark, 90, 91), path, "batch 9")
    assert len(read()) == len(whole) + 2
    grown = read()
    assert logs.compact_invocation_log(spark, path, settle_ms=0) == ["202401"] and read() == grown
    assert log_files.vacuum(spark, path, keep_ms=0) > 0 and read() == grown and _files(path) == 1


def test_half_done_and_losing_compactions_change_nothing(spark, monkeypatch):
    path = f"{tempfile.mkdtemp(prefix='rr-compact-')}/log"
    for k in range(3):
        logs.write_invocation_log(_lines(spark, k, k + 10), path, f"b{k}")
    whole = rows(logs.read_invocation_log(spark, path))

    def dies(*args):
        raise RuntimeError("killed before the commit")

    with monkeypatch.context() as m:
        m.setattr(log_files, "_commit", dies)
        try:
            logs.compact_invocation_log(spark, path, settle_ms=0)
        except RuntimeError:
            pass
    assert _files(path) > 3 and rows(logs.read_invocation_log(spark, path)) == whole
    # another compaction takes the number in between: this one's files go
    commit = log_files._commit

    def late(spark, file, live, replaced):
        monkeypatch.setattr(log_files, "_commit", commit)
        assert logs.compact_invocation_log(spark, path, settle_ms=0) == ["202401"]
        return commit(spark, file, live, replaced)

    monkeypatch.setattr(log_files, "_commit", late)
    assert logs.compact_invocation_log(spark, path, settle_ms=0) == []
    assert rows(logs.read_invocation_log(spark, path)) == whole
    log_files.vacuum(spark, path, keep_ms=0)
    assert _files(path) == 1 and rows(logs.read_invocation_log(spark, path)) == whole


def test_a_large_month_is_spread_over_files(spark):
    path = f"{tempfile.mkdtemp(prefix='rr-compact-')}/log"
    for k in range(3):
        logs.write_invocation_log(_lines(spark, *range(k * 400, k * 400 + 400)), path, f"b{k}")
    size = log_files.list_files(spark, path).agg(F.sum("length")).first()[0]
    logs.compact_invocation_log(spark, path, settle_ms=0, target_bytes=size)            # 3 files -> 1
    log_files.vacuum(spark, path, keep_ms=0)
    for k in range(3, 9):
        logs.write_invocation_log(_lines(spark, *range(k * 400, k * 400 + 400)), path, f"b{k}")
    before = _files(path)
    assert logs.compact_invocation_log(spark, path, settle_ms=0, target_bytes=size) == ["202401"]
    log_files.vacuum(spark, path, keep_ms=0)
    assert 1 < _files(path) <= 4 < before
    assert logs.read_invocation_log(spark, path).count() == 3600
