"""The Spark SQL texts equal the DataFrame reports, and keep the pushdown."""

from __future__ import annotations

import pytest

from cohortlens.operators import funnel as FN
from cohortlens.operators import retention as R
from cohortlens.operators.window import derive_window
from cohortlens.plans import catalog
from cohortlens.plans.sql import SQL_REPORTS, sql_report
from cohortlens.sources.cells import register
from parity import _key, _norm

SPEC = catalog.SPEC
SLICE = ("s_country", "NATION_1")


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)


@pytest.mark.parametrize("name", SQL_REPORTS)
def test_sql_equals_dataframe(spark, small_cells, name):
    act, prog = small_cells
    register(spark, act, prog)
    w = derive_window(act, SPEC)
    expected = {
        "retention_curve": lambda: R.retention_curve(act, w, SPEC),
        "retention_reads": lambda: R.retention_reads(act, w, SPEC),
        "retention_slice_curve": lambda: R.retention_slice_curve(act, w, *SLICE, SPEC),
        "level_funnel": lambda: FN.level_funnel(prog, w, SPEC),
    }[name]()
    got = sql_report(spark, name, w, SPEC, *SLICE)
    assert sorted(got.columns) == sorted(expected.columns)
    assert _rows(got) == _rows(expected)
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_slice_value_is_bound_not_pasted(spark, small_cells):
    act, prog = small_cells
    register(spark, act, prog)
    w = derive_window(act, SPEC)
    got = sql_report(spark, "retention_slice_curve", w, SPEC, "s_country", "Cote d'Ivoire")
    assert got.count() == 0
    plan = spark._jvm.PythonSQLUtils.explainString(
        sql_report(spark, "retention_reads", w, SPEC)._jdf.queryExecution(), "simple")
    initial = plan.split("+- == Initial Plan ==")[-1]
    assert initial.count("Scan ") == 1, plan   # both reads come from one scan
