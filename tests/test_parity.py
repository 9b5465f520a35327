"""Every registered report equals its SQL twin (DuckDB) row for row."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as E
from cohortlens.plans import catalog
from parity import compare, duck
from conftest import SF_MID, SF_SMALL

# The training-data queries are tested in their own folder.
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()
NAMES = sorted(QUERIES)
# A representative subset also runs at sf0.01 (the driver's correctness scale).
MID_NAMES = ["retention_curve", "integrity_report", "mix_balance", "level_funnel",
             "retention_maturity_gate", "playtime_quirk", "missing_cohort_days"]


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_entry_returns_the_curve(spark):
    df = E.entry(spark)
    assert df.columns == ["version", "cohort_day", "cohort_size", "active_users", "retention_pct"]
    assert df.count() > 0


@pytest.fixture(scope="module")
def con_small():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_parity_small(spark, con_small, name):
    r = compare(spark, SF_SMALL, name, QUERIES[name], ORACLE[name], con_small)
    assert r["status"] == "ok", r


@pytest.mark.skipif(not os.path.exists(SF_MID), reason="sf0.01 data not present")
@pytest.mark.parametrize("name", MID_NAMES)
def test_parity_mid(spark, name):
    r = compare(spark, SF_MID, name, QUERIES[name], ORACLE[name])
    assert r["status"] == "ok", r
