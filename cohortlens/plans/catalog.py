"""Named reports over the derived fixture: the ``queries()`` registry.

Every entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame.  Per
application and scale the fixture cells are built once and read back from
Parquet (``sources.fixture.fixture_tables``), the window is derived once,
and the shared intermediates of ``plans.analysis`` (two rollups, grain pairs,
cohort rollup) are materialised once; each report then reads whichever of
cells or intermediates it needs.  The SQL twin of
each entry is ``cohortlens.plans.oracle.ORACLE[name]``.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import integrity as Q
from cohortlens.plans import oracle as O
from cohortlens.plans.analysis import (
    METRIC_KEYS, REPORT_NAMES, Analysis, AnalysisParams, metrics_table, prepare)
from cohortlens.plans.sql import function_call, register_functions
from cohortlens.session import shared_dir
from cohortlens.sources.cells import quarantine_counts, read_activity_checked, register, write_cells
from cohortlens.sources.faults import csv_with_bad_records, with_faults
from cohortlens.sources.fixture import fixture_tables
from cohortlens.sources.metrics import keys_text
from cohortlens.sources.partitions import window_from_partitions
from cohortlens.spec import CohortSpec

SPEC = CohortSpec(base=O.BASE, cand=O.CAND, horizon=O.HORIZON)

# Report parameters for the fixture (its levels run 1..12, its countries are
# NATION_0..NATION_24); the library defaults are the original analysis's.
PARAMS = AnalysisParams(
    patch_label=O.PATCH,
    slice_value=O.SLICE_COUNTRY,
    reach_levels=O.REACH_LEVELS,
    tail_from=O.DRIFT_TAIL_FROM,
    second_break_level=O.SECOND_BREAK_LEVEL,
    report_max_level=O.REPORT_MAX_LEVEL,
    report_min_starts=O.REPORT_MIN_STARTS,
)

_ANALYSES: dict[tuple[str, str, bool | str], Analysis] = {}
_LOCK = threading.Lock()


def analysis(spark: SparkSession, sf_dir: str, rollups: bool = True) -> Analysis:
    key = (spark.sparkContext.applicationId, sf_dir, rollups)
    with _LOCK:   # concurrent callers share one window and one set of rollups
        if key not in _ANALYSES:
            act, prog = fixture_tables(spark, sf_dir)
            _ANALYSES[key] = prepare(spark, act, prog, SPEC, PARAMS, rollups=rollups)
        return _ANALYSES[key]


def faulty_analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    """The analysis of the fixture cells with planted faults (``sources.faults``)."""
    key = (spark.sparkContext.applicationId, sf_dir, "faults")
    with _LOCK:
        if key not in _ANALYSES:
            act, prog = with_faults(*fixture_tables(spark, sf_dir))
            _ANALYSES[key] = prepare(spark, act, prog, SPEC, PARAMS)
        return _ANALYSES[key]


def metrics_long(a: Analysis) -> DataFrame:
    """Every metric of every small report, typed, keys as one text."""
    reports = a.reports()
    table = metrics_table({n: reports[n]() for n in METRIC_KEYS})
    return table.withColumn("keys", keys_text(F.col("keys")))


def rows_beyond_extract(a: Analysis) -> DataFrame:
    """Q7 on both tables: table_name, rows_beyond_extract."""
    both = [Q.rows_beyond_extract(cells, a.window.extract).select(F.lit(name).alias("table_name"), "rows_beyond_extract")
            for name, cells in (("activity", a.act), ("progression", a.prog))]
    return both[0].unionByName(both[1])


_CSV: dict[tuple[str, str], str] = {}


def csv_cells(a: Analysis, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cells, quarantine) read from CSV files of the fixture's activity with bad records (written once)."""
    key = (a.spark.sparkContext.applicationId, sf_dir)
    with _LOCK:
        if key not in _CSV:
            path = f"{shared_dir(a.spark)}/cohortlens-fixture/{uuid.uuid4().hex}/csv"
            csv_with_bad_records(a.act).write.option("header", True).csv(path)
            _CSV[key] = path
    return read_activity_checked(a.spark, _CSV[key])


_STORED: dict[tuple[str, str], str] = {}


def listed_window(a: Analysis, sf_dir: str) -> DataFrame:
    """P1 and P2 of the fixture's activity stored by install date (written once): the bounds from the folders."""
    key = (a.spark.sparkContext.applicationId, sf_dir)
    with _LOCK:
        if key not in _STORED:
            path = f"{shared_dir(a.spark)}/cohortlens-fixture/{uuid.uuid4().hex}/by-date"
            write_cells(a.act, path)
            _STORED[key] = path
    w = window_from_partitions(a.spark, _STORED[key], a.spec)
    row = (w.extract, w.start, w.end, w.horizon, w.rule(a.spec))
    return a.spark.createDataFrame([row], "extract_date date, win_start date, win_end date, horizon_days long, rule string")


def sql_function(a: Analysis, name: str) -> DataFrame:
    """A standalone report, called as a SQL table function over the registered cells."""
    with _LOCK:   # views and functions are the session's
        register(a.spark, a.act, a.prog)
        register_functions(a.spark, a.window, a.spec, prefix="cohortlens_")
        return a.spark.sql(function_call(name, a.window, a.spec, a.params.slice_value, prefix="cohortlens_"))


def context(spark: SparkSession, sf_dir: str) -> Analysis:
    return analysis(spark, sf_dir)


def _reports(a: Analysis, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    out: dict[str, Callable[[], DataFrame]] = {
        "fixture_activity": lambda: a.act,
        "fixture_progression": lambda: a.prog,
    }
    out.update(a.reports())
    out["metrics_long"] = lambda: metrics_long(a)
    out["analysis_window_listed"] = lambda: listed_window(a, sf_dir)
    out["csv_activity"] = lambda: csv_cells(a, sf_dir)[0]
    out["csv_quarantine"] = lambda: quarantine_counts(csv_cells(a, sf_dir)[1])
    for name in O.SQL_FUNCTIONS:
        out[f"sql_{name}"] = lambda name=name: sql_function(a, name)
    return out


def _faulty_reports(a: Analysis) -> dict[str, Callable[[], DataFrame]]:
    reports = a.reports()
    out = {f"faulty_{n}": reports[n] for n in O.FAULTY}
    out["faulty_rows_beyond_extract"] = lambda: rows_beyond_extract(a)
    return out


def report_names() -> list[str]:
    """The reports of an analysis and the cells they read."""
    return ["fixture_activity", "fixture_progression", *REPORT_NAMES]


def query_names() -> list[str]:
    """Every registered query: the reports, the metrics, and the checks over planted faults."""
    return list(O.ORACLE)


def queries(rollups: bool = True) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(name: str) -> Callable[[SparkSession, str], DataFrame]:
        if name.startswith("faulty_"):
            return lambda spark, sf_dir: _faulty_reports(faulty_analysis(spark, sf_dir))[name]()
        return lambda spark, sf_dir: _reports(analysis(spark, sf_dir, rollups), sf_dir)[name]()
    return {name: bind(name) for name in query_names()}


def oracle_sql() -> dict[str, str]:
    return dict(O.ORACLE)
