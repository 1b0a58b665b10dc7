"""Bad records are set aside with a reason; good ones read as a plain read reads them."""

import json

import pytest
from conftest import rows

from runready import schemas
from runready.sources import quarantine, readers

GOOD = {"run_id": 1, "job_id": 5, "state": {"life_cycle_state": "RUNNING"}, "start_time": 1000, "other": [1]}
LINES = [json.dumps(GOOD), json.dumps(GOOD | {"run_id": 2, "end_time": None}), '{"run_id": 3, "job_id"', "no json at all", "[1, 2]", "7", "null",
         json.dumps(GOOD | {"start_time": "soon"}), json.dumps({"run_id": 4}), json.dumps(GOOD | {"run_id": None}), "{}", "", "   "]


def test_lines_are_split_by_reason(spark, tmp_path):
    (tmp_path / "runs.json").write_text("\n".join(LINES) + "\n")
    split = quarantine.read_checked(spark, str(tmp_path / "runs.json"), schemas.RAW_RUN, ("run_id", "job_id"))
    got = {r["line"]: r["reason"] for r in split.collect()}
    assert got == dict(zip(LINES[:11], [None, None, "not json", "not json", "not json", "not json", "not json", "wrong type",
                                        "missing job_id", "missing run_id", "missing run_id"], strict=True))
    (tmp_path / "good.json").write_text("\n".join(LINES[:2]) + "\n")
    plain = readers.read_runs(spark, str(tmp_path / "good.json"))
    good = quarantine.good_rows(split)
    assert good.schema.simpleString() == plain.schema.simpleString() and rows(good) == rows(plain)


def test_sink_is_replaced_by_a_replay(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(LINES))
    (tmp_path / "b.json").write_text(LINES[0])
    out = str(tmp_path / "bad")
    assert quarantine.read_quarantine(spark, out).count() == 0
    split = [quarantine.read_checked(spark, str(tmp_path / f), schemas.RAW_RUN, ("run_id",)) for f in ("a.json", "b.json")]
    for _ in range(2):
        quarantine.write_quarantine(split[0], out, "runs", 100)
    quarantine.write_quarantine(split[0], out, "runs", 200)
    found = quarantine.read_quarantine(spark, out)
    assert sorted(found.groupBy("feed", "as_of").count().collect()) == [("runs", 100, 8), ("runs", 200, 8)]
    quarantine.write_quarantine(split[1], out, "runs", 200)                   # the replay finds nothing bad
    assert [r.as_of for r in quarantine.read_quarantine(spark, out).select("as_of").distinct().collect()] == [100]


def test_gate(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(LINES))
    split = quarantine.read_checked(spark, str(tmp_path / "a.json"), schemas.RAW_RUN, ("run_id", "job_id"))
    assert quarantine.error_gate(split, 0.9) == {"good": 2, "not json": 5, "wrong type": 1, "missing job_id": 1, "missing run_id": 2}
    with pytest.raises(quarantine.TooManyBadRecords, match="9 of 11"):
        quarantine.error_gate(split, 0.5)
    assert quarantine.error_gate(split.limit(0), 0.0) == {}
