"""Published runs: whole or not at all, typed, readable by id."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortlens.plans import analysis as A
from cohortlens.plans import catalog, runs
from cohortlens.sources.metrics import keys_text, typed_metrics

ONLY = ["analysis_window", "retention_curve", "label_predates_parent", "retention_gap_by_cohort",
        "orphan_act_cells", "retention_chart_series"]


@pytest.fixture(scope="module")
def root():
    return tempfile.mkdtemp(prefix="published-", dir="/tmp")


def _run(spark, cells, root, run_id, **options):
    return runs.published_run(spark, *cells, root, catalog.SPEC, catalog.PARAMS, run_id=run_id,
                              threads=4, only=ONLY, **options)


def test_nothing_published_before_the_first_run(spark):
    root = tempfile.mkdtemp(prefix="unpublished-", dir="/tmp")
    assert runs.published_runs(spark, root).count() == 0
    with pytest.raises(runs.NoPublishedRun):
        runs.published(spark, root)


def test_killed_run_leaves_the_earlier_one_whole(spark, small_cells, root, monkeypatch):
    first = _run(spark, small_cells, root, "first")
    curve = sorted(runs.read_published(spark, root, "retention_curve").collect())
    assert first.run_id == "first" and len(curve) == 16

    written = []
    reports = A.Analysis.reports

    def dying(self):
        def die():
            raise KeyboardInterrupt("killed between two reports")
        thunks = reports(self)
        for name, thunk in list(thunks.items()):
            thunks[name] = (lambda n=name, t=thunk: (written.append(n), t())[1])
        thunks["retention_gap_by_cohort"] = die
        return thunks

    monkeypatch.setattr(A.Analysis, "reports", dying)
    with pytest.raises(KeyboardInterrupt):
        _run(spark, small_cells, root, "second")
    monkeypatch.undo()
    assert written and os.path.isdir(os.path.join(root, "runs", "second"))   # some of it was written
    now = runs.published(spark, root)
    assert now == first
    for name in now.reports:
        assert runs.read_published(spark, root, name).count() > 0
    assert sorted(runs.read_published(spark, root, "retention_curve").collect()) == curve


def test_refused_run_is_not_published(spark, small_cells, root):
    act, prog = small_cells
    broken = prog.withColumn("i_level_started", F.col("i_level_started") + 1)
    with pytest.raises(Exception, match="identity_breaks"):
        _run(spark, (act, broken), root, "broken")
    assert "broken" not in {r["run_id"] for r in runs.published_runs(spark, root).collect()}


def test_next_run_takes_over_and_both_stay_readable(spark, small_cells, root):
    act, prog = small_cells
    before = runs.published(spark, root)
    half = act.filter("d_install_date < date'2001-07-01'")
    after = _run(spark, (half, prog), root, "third")
    assert runs.published(spark, root) == after and after.published_at > before.published_at
    last = half.agg(F.max("d_install_date")).first()[0]
    assert after.extract_date == last < before.extract_date
    old = runs.read_published(spark, root, "analysis_window", run_id="first").first()
    assert old["extract_date"] == before.extract_date
    history = runs.metric_history(spark, root, "analysis_window", "extract_date").collect()
    assert {(r["run_id"], r["value_date"]) for r in history} == {
        ("first", before.extract_date), ("third", after.extract_date)}
    with pytest.raises(ValueError, match="published already"):
        _run(spark, small_cells, root, "third")
    with pytest.raises(runs.NoPublishedRun):
        runs.read_published(spark, root, "level_funnel")   # not among this run's reports


def test_missing_report_stops_the_commit(spark, root):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        runs.publish(spark, root, "hollow", None, {"retention_curve": ("runs/hollow/none", "parquet")})
    with pytest.raises(runs.NoPublishedRun):
        runs.published(spark, root, "hollow")


def test_json_run(spark, small_cells):
    root = tempfile.mkdtemp(prefix="published-json-", dir="/tmp")
    run = _run(spark, small_cells, root, "j", out_format="json")
    assert run.extract_date is not None
    assert runs.read_published(spark, root, "retention_curve").count() == 16


def test_typed_metrics_keep_every_value_and_type(spark, small_cells, root):
    metrics = runs.read_published(spark, root, runs.TYPED, run_id="first")
    assert not set(ONLY) & A.DETAIL_REPORTS & {r["report"] for r in metrics.select("report").distinct().collect()}
    window = {r["metric"]: r for r in metrics.filter("report = 'analysis_window'").collect()}
    assert window["extract_date"]["kind"] == "date" and isinstance(window["extract_date"]["value_date"], dt.date)
    assert window["horizon_days"]["value_long"] == 7 and window["rule"]["kind"] == "text"
    label = {r["metric"]: r for r in metrics.filter("report = 'label_predates_parent'").collect()}
    assert label["predates_parent"]["kind"] == "boolean" and label["predates_parent"]["value_boolean"] is not None
    gaps = metrics.filter("report = 'retention_gap_by_cohort'")
    report = runs.read_published(spark, root, "retention_gap_by_cohort", run_id="first")
    assert {(r["k"], r["value_double"]) for r in gaps.select(keys_text(F.col("keys")).alias("k"), "value_double").collect()} == {
        (f"install_date={r['install_date']}", r["d1_gap_pts"]) for r in report.collect()}
    set_columns = sum((F.col(c).isNotNull().cast("int") for c, _ in
                       [("value_double", 0), ("value_long", 0), ("value_date", 0), ("value_boolean", 0), ("value_text", 0)]), F.lit(0))
    assert metrics.filter(set_columns > 1).count() == 0


def test_typed_metrics_edges(spark):
    df = spark.createDataFrame([(None, None, 1.5, True), ("x", 3, None, None)],
                               "name string, n int, v double, b boolean")
    rows = typed_metrics("r", df, ("name",)).withColumn("k", keys_text(F.col("keys"))).collect()
    assert {(r["k"], r["metric"], r["value_long"], r["value_double"], r["value_boolean"]) for r in rows} == {
        ("name=null", "n", None, None, None), ("name=null", "v", None, 1.5, None), ("name=null", "b", None, None, True),
        ("name=x", "n", 3, None, None), ("name=x", "v", None, None, None), ("name=x", "b", None, None, None)}
    assert typed_metrics("r", df.limit(0), ("name",)).count() == 0
    with pytest.raises(ValueError, match="no key columns"):
        typed_metrics("r", df, ("other",))
    assert set(A.METRIC_KEYS) == set(A.REPORT_NAMES) - A.DETAIL_REPORTS
