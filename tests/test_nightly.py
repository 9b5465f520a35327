"""Nightly re-runs: only new and changed dates are read, and every report equals that of a full run."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cohortlens import spec as S
from cohortlens.plans import analysis as A
from cohortlens.plans import catalog, nightly, runs
from cohortlens.sources.cells import read_activity, read_progression, write_cells
from parity import _key, _norm
from test_plans import _plan

FROM, LOADED, TO = dt.date(2001, 6, 10), dt.date(2001, 7, 5), dt.date(2001, 7, 20)


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=_key)


def between(df, lo, hi):
    return df.filter(F.col(S.INSTALL_DATE).between(F.lit(lo), F.lit(hi)))


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture(scope="module")
def late_day(small_cells):
    """A date loaded at first, with cells beyond cohort day 1."""
    late = between(small_cells[0], FROM, LOADED).filter(F.col(S.COHORT_DAY) > 1)
    return late.groupBy(S.INSTALL_DATE).count().orderBy(F.desc("count"), S.INSTALL_DATE).first()[0]


@pytest.fixture(scope="module")
def store(spark, small_cells, late_day):
    """Cells by date up to LOADED, without the late cells of one day."""
    base = tempfile.mkdtemp(prefix="nightly-", dir="/tmp")
    paths = f"{base}/act", f"{base}/prog"
    for df, path in zip(small_cells, paths, strict=True):
        write_cells(between(df, FROM, LOADED).filter(
            (F.col(S.INSTALL_DATE) != F.lit(late_day)) | (F.col(S.COHORT_DAY) <= 1)), path)
    return base, *paths


def same_as_full(spark, store, analysis):
    base, act_path, prog_path = store
    full = A.prepare(spark, read_activity(spark, act_path), read_progression(spark, prog_path),
                     catalog.SPEC, catalog.PARAMS)
    assert analysis.window == full.window
    got, want = analysis.reports(), full.reports()
    for name in ("integrity_report", "orphan_act_cells", "duplicate_prog_keys", "playtime_quirk",
                 "retention_curve", "mix_balance", "level_by_country", "level_funnel", "version_profile"):
        assert rows(got[name]()) == rows(want[name]()), name


def refreshed(spark, store):
    base, act_path, prog_path = store
    return nightly.refreshed_analysis(spark, act_path, prog_path, f"{base}/state", catalog.SPEC, catalog.PARAMS)


def test_first_load_reads_every_date(spark, store):
    analysis, done = refreshed(spark, store)
    days = {r[0] for r in read_activity(spark, store[1]).select(S.INSTALL_DATE).distinct().collect()}
    assert set(done.read) == set(done.dates) == days
    same_as_full(spark, store, analysis)


def test_nothing_new_reads_nothing(spark, store):
    before = files_of(f"{store[0]}/state")
    _, done = refreshed(spark, store)
    assert done.version is None and done.read == ()
    assert files_of(f"{store[0]}/state") == before


def test_appended_dates_are_the_only_ones_read(spark, store, small_cells):
    for df, path in zip(small_cells, store[1:], strict=True):
        write_cells(between(df, LOADED + dt.timedelta(days=1), TO), path, mode="append")
    analysis, done = refreshed(spark, store)
    assert done.read and min(done.read) > LOADED and len(done.dates) > len(done.read)
    # The part written holds those dates and their cells only.
    part = spark.read.parquet(f"{store[0]}/state/act_cube/version={done.version}").filter(F.col("dim") == A.ALL_CELLS)
    cells = between(small_cells[0], LOADED + dt.timedelta(days=1), TO)
    assert part.agg(F.sum(A.CELLS)).first()[0] == cells.count()
    plan = _plan(nightly._on_dates(read_activity(spark, store[1]), done.read))
    assert any("PartitionFilters" in line and S.INSTALL_DATE in line for line in plan.splitlines())
    same_as_full(spark, store, analysis)


def test_late_cells_change_one_date(spark, store, small_cells, late_day):
    untouched = {f: t for path in store[1:] for f, t in files_of(path).items() if str(late_day) not in f}
    for df, path in zip(small_cells, store[1:], strict=True):
        write_cells(between(df, late_day, late_day), path, mode="dates")
    now = {f: t for path in store[1:] for f, t in files_of(path).items()}
    assert untouched.items() <= now.items()   # only that date's files were written
    analysis, done = refreshed(spark, store)
    assert done.read == (late_day,)
    same_as_full(spark, store, analysis)
    # Replayed, the cells are equal, files anew: the date is read again and nothing else changes.
    cells = rows(read_activity(spark, store[1]))
    for df, path in zip(small_cells, store[1:], strict=True):
        write_cells(between(df, late_day, late_day), path, mode="dates")
    assert rows(read_activity(spark, store[1])) == cells
    analysis, done = refreshed(spark, store)
    assert done.read == (late_day,)
    same_as_full(spark, store, analysis)


def test_killed_refresh_leaves_the_state(spark, store, monkeypatch, small_cells, late_day):
    held = nightly.committed(spark, f"{store[0]}/state", catalog.SPEC)
    write_cells(between(small_cells[0], late_day, late_day), store[1], mode="dates")

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(nightly, "_commit", killed)
    with pytest.raises(KeyboardInterrupt):
        refreshed(spark, store)
    monkeypatch.undo()
    assert nightly.committed(spark, f"{store[0]}/state", catalog.SPEC) == held
    analysis, done = refreshed(spark, store)
    assert done.read == (late_day,)
    same_as_full(spark, store, analysis)


def test_compacted_state_is_equal(spark, store):
    state = f"{store[0]}/state"
    version = nightly.compacted(spark, state, catalog.SPEC)
    assert {v for _, v in nightly.committed(spark, state, catalog.SPEC).values()} == {version}
    assert nightly.compacted(spark, state, catalog.SPEC) is None
    analysis, done = refreshed(spark, store)
    assert done.version is None
    same_as_full(spark, store, analysis)


def test_nightly_run_publishes(spark, store):
    run, done = nightly.nightly_run(spark, store[1], store[2], store[0], catalog.SPEC, catalog.PARAMS, run_id="n1",
                                    threads=4, only=["analysis_window", "retention_curve", "playtime_quirk"])
    assert done.version is None and run.extract_date == max(done.dates)
    assert runs.read_published(spark, store[0], "retention_curve").count() > 0


def test_removed_date_and_other_spec(spark, store, monkeypatch):
    import dataclasses

    state, listed = f"{store[0]}/state", nightly.date_signatures
    gone = max(nightly.committed(spark, state, catalog.SPEC))
    with monkeypatch.context() as m:   # as if the date's files were gone
        m.setattr(nightly, "date_signatures", lambda *a: {d: s for d, s in listed(*a).items() if d != gone})
        done = nightly.refresh(spark, store[1], store[2], state, catalog.SPEC)
    assert done.read == () and done.version and gone not in done.dates
    for name in nightly.TABLES:
        held = nightly.state_table(spark, state, name, done.dates)
        assert held.count() and not held.filter(F.col(S.INSTALL_DATE) == F.lit(gone)).count()
    assert nightly.refresh(spark, store[1], store[2], state, catalog.SPEC).read == (gone,)   # and back
    other = dataclasses.replace(catalog.SPEC, dims=(("network", S.NETWORK),))
    again = nightly.refresh(spark, store[1], store[2], state, other)
    assert set(again.read) == set(again.dates)   # the state's tables depend on the dimensions


def test_cells_not_stored_by_date_are_refused(spark, small_cells):
    base = tempfile.mkdtemp(prefix="flat-", dir="/tmp")
    write_cells(small_cells[0].limit(5), f"{base}/act", partition_by=None)
    with pytest.raises(ValueError, match="not stored by"):
        nightly.date_signatures(spark, (f"{base}/act",))
    with pytest.raises(ValueError, match="partitioned by date"):
        write_cells(small_cells[0].limit(5), f"{base}/act", mode="dates", partition_by=None)
