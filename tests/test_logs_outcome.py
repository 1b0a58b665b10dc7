"""O15-O17 log sinks and retention, O19 outcome classification."""

import tempfile

from pyspark.sql import types as T

from conftest import rows

from runready import schemas
from runready.operators import logs, outcome


def _decisions(spark, n=3):
    data = [(1706702400, i, f"p{i}", "active", "own", 0, None, "UTC", "None", "hold", 10, 0, 20, 30, 1, 2, 3, 4,
             " dep|with\"quote", "", None, None, None, i % 2) for i in range(n)]
    return spark.createDataFrame(data, T.StructType(logs.DECISION_LOG.fields[:-2]))


def test_decision_log_roundtrip_and_replay(spark):
    path = tempfile.mkdtemp(prefix="rr-log-")
    d = _decisions(spark)
    logs.write_decision_log(d, path, 1706702400)
    logs.write_decision_log(d, path, 1706702400)            # replay: same partition replaced
    logs.write_decision_log(d, path, 1706702400 + 600)      # next pass
    back = logs.read_decision_log(spark, path)
    assert back.count() == 6
    one = back.where("log_time = 1706702400")
    assert rows(one, *schemas.DECISION_COLUMNS) == rows(d)
    assert {r.log_date for r in back.collect()} == {"2024-01-31"}


def test_retention_boundary_and_partition_drop(spark):
    path = tempfile.mkdtemp(prefix="rr-log-")
    d = _decisions(spark, 1)
    day = 86400
    as_of = 1706702400
    for t in (as_of - 31 * day, as_of - 30 * day, as_of - 30 * day + 1, as_of):
        logs.write_decision_log(d, path, t)
    kept = logs.expire_log(logs.read_decision_log(spark, path), as_of)
    assert sorted(r.log_time for r in kept.collect()) == [as_of - 30 * day + 1, as_of]   # cutoff itself expires
    removed = logs.drop_expired_partitions(spark, path, as_of)
    assert len(removed) == 2
    assert sorted(r.log_time for r in logs.read_decision_log(spark, path).collect()) == [as_of - 30 * day + 1, as_of]


def test_invocation_log_append_by_month(spark):
    path = tempfile.mkdtemp(prefix="rr-inv-")
    inv = spark.createDataFrame([
        (1706702400000, 1706702460000, "7", "70", "db", "job a", "11", "true", "{'k': 'v|w'}"),
        (1709208000000, 1709208060000, "7", "71", "adf", "pipe", "ab-12", "false", "")],
        schemas.INVOCATION)
    logs.write_invocation_log(inv, path)
    logs.write_invocation_log(inv.limit(1), path)
    back = logs.read_invocation_log(spark, path)
    assert rows(back, "job_run_id", "yyyymm", "parameters") == [
        ("11", "202401", "{'k': 'v|w'}"), ("11", "202401", "{'k': 'v|w'}"), ("ab-12", "202402", "")]


def test_classify_outcome(spark):
    df = spark.createDataFrame([
        ("db", "TERMINATED", "SUCCESS"), ("db", "TERMINATED", "FAILED"), ("DB", "INTERNAL_ERROR", None),
        ("db", "RUNNING", None), ("adf", "Succeeded", None), ("ADF", "Failed", None), ("adf", "Cancelled", None),
        ("adf", "InProgress", None), ("other", "TERMINATED", "SUCCESS")], "system string, state string, result string")
    got = rows(outcome.classify_outcome(df), "system", "state", "terminal", "failed")
    assert got == sorted([
        ("db", "TERMINATED", True, False), ("db", "TERMINATED", True, True), ("DB", "INTERNAL_ERROR", True, True),
        ("db", "RUNNING", False, False), ("adf", "Succeeded", True, False), ("ADF", "Failed", True, True),
        ("adf", "Cancelled", True, False), ("adf", "InProgress", False, False), ("other", "TERMINATED", None, None)],
        key=lambda t: tuple((x is None, str(x)) for x in t))
