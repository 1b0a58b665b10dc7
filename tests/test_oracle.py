"""Every registered query against its DuckDB oracle at sf0.01 (the driver's correctness gate)."""

import re

import pytest

import __spark_entry__ as E
from oracle_check import compare

SF = "/root/testdata/sf0.01"
QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLES))
def test_query_matches_oracle(spark, name):
    r = compare(spark, SF, name, QUERIES[name], ORACLES[name])
    assert r["status"] == "ok", r


def test_every_query_has_an_oracle():
    own = {n for n in QUERIES if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert sorted(own - set(ORACLES)) == []


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["job_id", "as_of"]
    assert df.count() > 0
