"""The comparison window of cells stored by install date, without a scan of the cells.

``write_cells`` keeps one folder per install date, so the dates come from a
listing of the files.  The extract date is the last one with a row: that reads
no column, only the row counts in the files' footers.  The window's start is the
first date with a row of the candidate build: dates are tried in order, in blocks
that double, so no date long after the first install is opened, and the pushed
build filter skips the row groups before it by their statistics and dictionaries.

Cells that are not stored by install date have their window derived by a scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import spec as S
from cohortlens.operators.window import AnalysisWindow, checked_window, derive_window
from cohortlens.sources.cells import read_activity
from cohortlens.spec import CohortSpec


def listed_dates(spark: SparkSession, path: str) -> list[dt.date] | None:
    """The install dates that have files, in order; None if a file lies outside the date folders.

    Cells without an install date (their own folder) are left out."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.parquet").load(path))
    days = [r[0] for r in files.select(F.regexp_extract("path", f"/{S.INSTALL_DATE}=([^/]*)/", 1)).distinct().collect()]
    if not days or "" in days:
        return None
    return sorted(dt.date.fromisoformat(d) for d in days if not d.startswith("__HIVE"))


def rows_on(cells: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """First and last install date of the cells installed between two dates: a partition filter
    and an aggregate of the partition column."""
    day = F.col(S.INSTALL_DATE)
    return cells.filter(day.between(F.lit(first), F.lit(last))).agg(F.min(day).alias("first"), F.max(day).alias("last"))


def _nearest(cells: DataFrame, days: list[dt.date], which: str) -> dt.date | None:
    """The first of ``days`` (in their order) that has a row, tried in blocks of 1, 2, 4, ... dates."""
    at, size = 0, 1
    while at < len(days):
        block = days[at:at + size]
        found = rows_on(cells, min(block), max(block)).first()[which]
        if found is not None:
            return found
        at, size = at + size, 2 * size
    return None


def window_from_partitions(spark: SparkSession, path: str, spec: CohortSpec = CohortSpec(),
                           expected_extract: dt.date | None = None) -> AnalysisWindow:
    """P1 for Parquet cells at ``path``: the window that ``derive_window`` finds by a scan."""
    cells = read_activity(spark, path)
    days = listed_dates(spark, path)
    if days is None:
        return derive_window(cells, spec, expected_extract)
    extract = _nearest(cells, days[::-1], "last")
    start = _nearest(cells.filter(F.col(S.VERSION) == spec.cand), days, "first")
    return checked_window(extract, start, spec, expected_extract)
