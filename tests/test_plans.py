"""Plan checks: the shapes the library promises hold in the physical plans."""

from __future__ import annotations

import pytest

from cohortlens.plans import catalog
from conftest import SF_SMALL

QUERIES = catalog.queries()   # the training-data queries are tested in their own folder

FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython",
             "ArrowEvalPython", "PythonUDF")


def _plan(df) -> str:
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_nested_loop_or_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in plan, (name, bad)


@pytest.mark.parametrize("name,rollups", [("retention_curve", False), ("retention_slice", True)])
def test_window_filter_reaches_the_scan(spark, name, rollups):
    plan = _plan(catalog.queries(rollups=rollups)[name](spark, SF_SMALL))
    pushed = [line for line in plan.splitlines() if line.startswith("PushedFilters")]
    schema = [line for line in plan.splitlines() if line.startswith("ReadSchema")]
    assert pushed and schema, plan
    assert "GreaterThanOrEqual(d_install_date" in pushed[0]
    assert "LessThanOrEqual(d_install_date" in pushed[0]
    assert "In(s_app_version" in pushed[0]
    # Only the columns the report needs are read.
    assert "i_count_sessions" not in schema[0] and "f_playtime" not in schema[0]


def test_clean_progression_is_not_shuffled_for_duplicates(spark, small_cells):
    """The plan used at scale: nothing is small enough for a broadcast by size."""
    from cohortlens.operators import integrity as Q
    from cohortlens.plans.analysis import prepare

    act, prog = small_cells
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        clean = prepare(spark, act, prog, catalog.SPEC, catalog.PARAMS).duplicate_prog_keys()
        plan = _plan(clean)
        assert clean.count() == 0
        assert "Scan parquet" not in plan and "Join" not in plan, plan
        bad = prog.unionByName(prog.orderBy(*prog.columns).limit(3))
        found = prepare(spark, act, bad, catalog.SPEC, catalog.PARAMS)
        assert sorted(found.duplicate_prog_keys().collect()) == sorted(
            Q.duplicate_keys(bad, Q.S.KEY7).collect())
        few = Q.flagged_keys(found.pairs)
        plan = _plan(Q.duplicate_prog_keys(bad, few, few.count()))
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# Reports that join raw rows on purpose (AQE's skew join splits a hot key).
RAW_ROW_SHUFFLES = {"fixture_activity", "fixture_progression", "playtime_quirk",
                    "playtime_quirk_cells"}


def _exchanges_without_partial_aggregate(plan: str) -> list[str]:
    """Hash exchanges whose input is not an aggregate (partial, or the final
    result of an earlier aggregate), looking through projections/filters."""
    lines = [ln for ln in plan.splitlines() if ln.strip()]
    bad = []
    for i, ln in enumerate(lines):
        if "Exchange hashpartitioning" not in ln:
            continue
        j = i + 1
        while j < len(lines) and any(k in lines[j] for k in ("Project [", "Filter ")):
            j += 1
        if j >= len(lines) or "HashAggregate" not in lines[j]:
            bad.append(lines[j].strip()[:120] if j < len(lines) else ln)
    return bad


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RAW_ROW_SHUFFLES))
def test_hash_shuffles_carry_partial_aggregates(spark, name):
    """Skew safety: a key holding a large share of the rows is combined
    map-side before it is shuffled, in every aggregate-only report."""
    df = QUERIES[name](spark, SF_SMALL)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    initial = plan.split("+- == Initial Plan ==")[-1]
    assert _exchanges_without_partial_aggregate(initial) == [], name


def test_date_partitioned_cells_are_pruned(spark, small_cells):
    import os
    import tempfile

    from cohortlens.operators import retention as R
    from cohortlens.operators.window import derive_window
    from cohortlens.sources.cells import read_activity, write_cells
    from cohortlens.spec import CohortSpec

    act, _ = small_cells
    spec = CohortSpec()
    path = os.path.join(tempfile.mkdtemp(prefix="pruned-", dir="/tmp"), "act")
    write_cells(act.filter("d_install_date >= date'2001-06-01'"), path)
    cells = read_activity(spark, path)
    w = derive_window(cells, spec)
    plan = _plan(R.retention_curve(cells, w, spec))
    part = [line for line in plan.splitlines() if line.startswith("PartitionFilters")]
    assert part and "d_install_date" in part[0], plan
