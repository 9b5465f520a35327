"""The whole analysis as one Spark application (what a nightly run does).

1. derive the window (one single-row action);
2. build three shared intermediates, one pass each, written to the shared
   folder (``spark.checkpoint.dir``) and read back:
     act_cube   (build, install date, cohort day) x (all cells, or one value of
                one dimension) -> cells, actives, sessions, playtime,
                zero-playtime actives; its part for all cells is act_day
     prog_cube  (build, install date, level) x (all cells, or one country) ->
                starts, completions, failures, users, level seconds; its part
                for all cells is prog_level
     cell_pairs (activity grain) -> both tables' per-key counts and fault
                counts, paired by a full outer join
     cohorts    (KEY5 rollup of the pairs) -> day-0 / later actives, days
                present, every integrity counter; built on first use (in a
                full run: alongside the first wave of reports)
   The two rollups have builds x dates x days (or levels) rows whatever the
   number of cells, so every report that only splits by build, date, cohort
   day or level reads a few thousand rows (cached) instead of the cells.  The
   integrity counters, orphan / duplicate / bad-cohort lists and the time
   quirk read the grain pairs instead of re-aggregating the cells;
   The cubes are GROUPING SETS aggregates: one scan of each table, partial
   aggregates before the shuffle, written by dimension;
3. mix, slices and level by country read their dimension's part of the cubes;
   the quarantine list (and a slice by a column that is no dimension) reads the
   cells;
4. the stop-the-run rule is checked first (identity breaks from the grain
   pairs; other counters from the integrity report written first), then all
   other reports as concurrent Spark jobs, each small one with its slice of
   the long metrics table.
"""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import fixed
from cohortlens import spec as S
from cohortlens.operators import charts as C
from cohortlens.operators import engagement as E
from cohortlens.operators import funnel as FN
from cohortlens.operators import integrity as Q
from cohortlens.operators import labels as L
from cohortlens.operators import mix as M
from cohortlens.operators import retention as R
from cohortlens.operators.window import AnalysisWindow, derive_window, quarantine, window_summary
from cohortlens.session import shared_dir
from cohortlens.sources.metrics import long_metrics, typed_metrics
from cohortlens.spec import CohortSpec

ZERO_PT = "zero_playtime_users"
CELLS = "n_cells"


@dataclass(frozen=True)
class AnalysisParams:
    """Report parameters that are not part of the build comparison."""
    patch_label: str = fixed.PATCH_BUILD
    slice_column: str = S.COUNTRY
    slice_value: str = fixed.SLICE_COUNTRY
    break_level: int = fixed.BREAK_LEVEL
    time_levels: tuple[int, ...] = fixed.TIME_LEVELS
    reach_levels: tuple[int, ...] = fixed.REACH_LEVELS
    early_levels: tuple[int, int] = fixed.EARLY_LEVELS
    late_levels: tuple[int, int] = fixed.LATE_LEVELS
    tail_from: int = fixed.TAIL_FROM_LEVEL
    second_break_level: int = fixed.SECOND_BREAK_LEVEL
    report_max_level: int = fixed.REPORT_MAX_LEVEL
    report_min_starts: int | None = None
    chart_max_level: int = fixed.REPORT_MAX_LEVEL


def _activity_sums() -> list:
    return [
        F.count(F.lit(1)).alias(CELLS),
        F.sum(S.ACTIVE).alias(S.ACTIVE),
        F.sum(S.SESSIONS).alias(S.SESSIONS),
        F.sum(S.PLAYTIME).alias(S.PLAYTIME),
        F.sum(Q.zero_playtime_users(F.col(S.ACTIVE), F.col(S.PLAYTIME))).alias(ZERO_PT),
    ]


def _progression_sums() -> list:
    return [F.sum(c).alias(c) for c in (S.STARTED, S.COMPLETED, S.FAILED, S.USERS, S.LEVEL_TIME)]


def activity_rollup(act: DataFrame) -> DataFrame:
    """Cells summed by (build, install date, cohort day)."""
    return act.groupBy(S.VERSION, S.INSTALL_DATE, S.COHORT_DAY).agg(*_activity_sums())


def progression_rollup(prog: DataFrame) -> DataFrame:
    """Progression cells summed by (build, install date, level)."""
    return prog.groupBy(S.VERSION, S.INSTALL_DATE, S.LEVEL).agg(*_progression_sums())


ALL_CELLS = "all cells"   # the cube's rows over every value of every dimension


def _cube(cells: DataFrame, keys: list[str], dims: tuple[tuple[str, str], ...],
          sums: list) -> DataFrame:
    """GROUPING SETS: ``keys`` alone, and ``keys`` with each dimension alone, as rows
    (dim, val, keys, sums).  ``dim`` is read from the grouping bits, so a NULL
    value of a dimension keeps its own row, apart from the total."""
    columns = [c for _, c in dims]
    sets = [[F.col(k) for k in keys]] + [[F.col(k) for k in [*keys, c]] for c in columns]
    grouped = cells.groupingSets(sets, *[F.col(c) for c in [*keys, *columns]]).agg(
        *sums, *[F.grouping(c).alias(f"_without_{k}") for k, c in enumerate(columns)])
    dim, val = F.lit(ALL_CELLS), F.lit(None).cast("string")
    for k, (name, c) in enumerate(dims):
        dim = F.when(F.col(f"_without_{k}") == 0, F.lit(name)).otherwise(dim)
        val = F.when(F.col(f"_without_{k}") == 0, F.col(c)).otherwise(val)
    measures = [c for c in grouped.columns
                if c not in keys and c not in columns and not c.startswith("_without_")]
    return grouped.select(dim.alias("dim"), val.alias("val"), *keys, *measures)


def activity_cube(act: DataFrame, spec: CohortSpec = CohortSpec()) -> DataFrame:
    """Activity by (build, install date, cohort day), over all cells and by one dimension at a time."""
    return _cube(act, [S.VERSION, S.INSTALL_DATE, S.COHORT_DAY], spec.dims, _activity_sums())


LEVEL_DIMS = (("country", S.COUNTRY),)   # dimensions that level reports are split by


def progression_cube(prog: DataFrame) -> DataFrame:
    """Progression by (build, install date, level), over all cells and by country."""
    return _cube(prog, [S.VERSION, S.INSTALL_DATE, S.LEVEL], LEVEL_DIMS, _progression_sums())


def cube_part(cube: DataFrame, dim: str, column: str | None = None) -> DataFrame:
    """One dimension's rows of a cube, its values named ``column`` (none for all cells)."""
    part = cube.filter(F.col("dim") == dim).drop("dim")
    return part.withColumnRenamed("val", column) if column else part.drop("val")


def materialise(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back (cuts lineage)."""
    spark.sparkContext.setJobDescription(f"cohortlens prepare {path.rsplit('/', 1)[-1]}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialise_cube(spark: SparkSession, cube: DataFrame, path: str) -> DataFrame:
    """Write a cube to the shared folder, a directory per dimension, and read it back."""
    spark.sparkContext.setJobDescription(f"cohortlens prepare {path.rsplit('/', 1)[-1]}")
    cube.write.mode("overwrite").partitionBy("dim").parquet(path)
    return spark.read.schema(cube.schema).parquet(path)


def _cached(rollup: DataFrame) -> DataFrame:
    """A written rollup in executor memory.  A lost cached block is re-read
    from the files, not recomputed from the cells."""
    rollup = rollup.cache()
    rollup.count()
    return rollup


@dataclass
class Analysis:
    spark: SparkSession
    act: DataFrame
    prog: DataFrame
    window: AnalysisWindow
    act_day: DataFrame
    prog_level: DataFrame
    pairs: DataFrame
    spec: CohortSpec = field(default_factory=CohortSpec)
    params: AnalysisParams = field(default_factory=AnalysisParams)
    rolled: bool = True   # act_day / prog_level are rollups (else the cells)
    work_dir: str | None = None        # where shared intermediates are written
    act_cube: DataFrame | None = None    # by dimension (else reports read the cells)
    prog_cube: DataFrame | None = None
    cohorts: DataFrame | None = None   # KEY5 rollup of the pairs, built on first use
    duplicates: DataFrame | None = None   # duplicated progression keys, counted on first use
    n_duplicated: int | None = None    # activity keys with more than one row
    _lock: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def cohort_rollup(self) -> DataFrame:
        """The cohort (KEY5) rollup of the grain pairs, built once: written to
        the shared folder when there is one, else kept lazy."""
        with self._lock:
            if self.cohorts is None:
                rollup = Q.cohort_rollup(self.pairs, self.window.extract, self.spec)
                self.cohorts = (materialise(self.spark, rollup, f"{self.work_dir}/cohorts")
                                if self.work_dir else rollup)
            return self.cohorts

    def duplicate_prog_keys(self) -> DataFrame:
        """Duplicated progression keys, recounted once: the flagged keys are
        written first, and their number decides how progression is filtered."""
        with self._lock:
            if self.duplicates is None:
                if not self.work_dir:
                    return Q.duplicate_prog_keys(self.prog, self.pairs)
                flagged = materialise(self.spark, Q.flagged_keys(self.pairs),
                                      f"{self.work_dir}/flagged_keys")
                n = flagged.count()
                found = Q.duplicate_prog_keys(self.prog, flagged, n)
                self.duplicates = (materialise(self.spark, found, f"{self.work_dir}/dup_prog")
                                   if n else found)
            return self.duplicates

    def quirk_cells(self) -> DataFrame:
        """Cells whose level seconds exceed their session seconds, from the
        pairs; activity rows are read only under duplicated keys, if any."""
        with self._lock:
            if self.n_duplicated is None:
                self.n_duplicated = self.pairs.filter(F.col("a_rows") > 1).count()
        return Q.quirk_cells_from_pairs(self.pairs, self.act, self.n_duplicated)

    def _activity_by(self, column: str) -> DataFrame:
        """Activity that keeps build, date, cohort day and ``column``: the cube's part, else the cells."""
        name = next((n for n, c in self.spec.dims if c == column), None)
        if self.act_cube is None or name is None:
            return self.act
        return cube_part(self.act_cube, name, column)

    def _mix(self) -> DataFrame:
        if self.act_cube is None:
            return M.mix_balance(self.act, self.window, self.spec)
        return M.mix_balance_from_cube(self.act_cube, self.window, self.spec)

    def reports(self) -> dict[str, Callable[[], DataFrame]]:
        """Every report as a thunk; rollup-backed where the split allows."""
        a, p, w, sp, pr = self.act, self.prog, self.window, self.spec, self.params
        ad, pl, pairs = self.act_day, self.prog_level, self.pairs
        by_country = p if self.prog_cube is None else cube_part(self.prog_cube, "country", S.COUNTRY)
        sliced = self._activity_by(pr.slice_column)
        cells_col = CELLS if self.rolled else None
        zero_col = ZERO_PT if self.rolled else None

        def funnel() -> DataFrame:
            return FN.level_funnel(pl, w, sp)

        def curve() -> DataFrame:
            return R.retention_curve(ad, w, sp)

        return {
            # window and labels
            "analysis_window": lambda: window_summary(ad, w, sp),
            "quarantined_cells": lambda: quarantine(a, sp),
            "version_profile": lambda: Q.version_profile(ad, row_count=cells_col),
            "label_volume_by_month": lambda: L.label_volume_by_month(ad, pr.patch_label),
            "label_behaviour_profile": lambda: L.label_behaviour_profile(ad, pl, w, pr.break_level),
            "label_predates_parent": lambda: L.label_predates_parent(ad, pr.patch_label, sp.cand),
            # integrity
            "integrity_report": lambda: Q.integrity_from_cohorts(
                self.cohort_rollup(), pairs, p, w.extract, sp, self.duplicate_prog_keys()),
            "bad_cohort_cells": lambda: Q.bad_cohort_cells_from_cohorts(self.cohort_rollup()),
            "orphan_prog_cells": lambda: Q.orphan_prog_cells(pairs),
            "orphan_act_cells": lambda: Q.orphan_act_cells(pairs),
            "missing_cohort_days": lambda: Q.missing_cohort_days(ad, w.extract, sp),
            "duplicate_act_keys": lambda: Q.duplicate_act_keys(pairs),
            "duplicate_prog_keys": self.duplicate_prog_keys,
            "extract_day_check": lambda: Q.extract_day_check(ad, w.extract, sp),
            "playtime_quirk": lambda: (
                Q.playtime_quirk_from(self.quirk_cells(), ad, row_count=CELLS) if self.rolled
                else Q.playtime_quirk(a, pairs=pairs)),
            "playtime_quirk_cells": lambda: (
                self.quirk_cells() if self.rolled else Q.playtime_quirk_cells(a, pairs=pairs)),
            "zero_playtime_actives": lambda: Q.zero_playtime_actives(ad, w, sp, per_cell=zero_col),
            # retention
            "retention_naive": lambda: R.retention_naive(ad, sp),
            "retention_maturity_gate": lambda: R.retention_maturity_gate(ad, w, sp),
            "retention_reads": lambda: R.retention_reads(ad, w, sp),
            "retention_curve": curve,
            "retention_spread": lambda: R.retention_spread(ad, w, sp),
            "retention_headline": lambda: R.retention_headline(curve(), sp),
            "retention_z_test": lambda: R.retention_z_test(curve(), sp),
            "retention_gap_by_cohort": lambda: R.retention_gap_by_cohort(ad, w, sp),
            "gap_sign_summary": lambda: R.gap_sign_summary(R.retention_gap_by_cohort(ad, w, sp)),
            "retention_slice": lambda: R.retention_slice(sliced, w, pr.slice_column, pr.slice_value, sp),
            "retention_slice_curve": lambda: R.retention_slice_curve(
                sliced, w, pr.slice_column, pr.slice_value, sp),
            "censoring_bias": lambda: R.censoring_bias(ad, w, sp),
            # mix
            "mix_balance": self._mix,
            "mix_max_gap": lambda: M.mix_max_gap(self._mix()),
            # funnel
            "level_funnel": funnel,
            "level_funnel_reported": lambda: FN.suppress_thin(
                funnel(), sp, max_level=pr.report_max_level, min_starts=pr.report_min_starts),
            "level_time": lambda: FN.level_time(pl, w, sp, pr.time_levels),
            "level_by_country": lambda: FN.level_by_dimension(by_country, w, sp, pr.break_level, S.COUNTRY),
            "level_by_cohort": lambda: FN.level_by_cohort(pl, sp.cand, pr.break_level),
            "level_reach": lambda: FN.level_reach(pl, w, sp, pr.reach_levels),
            "drift_summary": lambda: FN.drift_summary(
                funnel(), sp, pr.early_levels, pr.late_levels, pr.break_level, pr.tail_from),
            "second_break_test": lambda: FN.second_break_test(
                pl, w, sp, pr.second_break_level, pr.late_levels),
            # engagement
            "engagement": lambda: E.engagement(ad, w, sp),
            "engagement_by_day": lambda: E.engagement_by_day(ad, w, sp),
            # chart series
            "retention_chart_series": lambda: C.retention_chart_series(curve(), sp),
            "funnel_chart_series": lambda: C.funnel_chart_series(
                funnel(), sp, pr.chart_max_level, pr.break_level),
        }


REPORT_NAMES = (
    "analysis_window", "quarantined_cells", "version_profile", "label_volume_by_month",
    "label_behaviour_profile", "label_predates_parent", "integrity_report", "bad_cohort_cells",
    "orphan_prog_cells", "orphan_act_cells", "missing_cohort_days", "duplicate_act_keys",
    "duplicate_prog_keys", "extract_day_check", "playtime_quirk", "playtime_quirk_cells",
    "zero_playtime_actives", "retention_naive", "retention_maturity_gate", "retention_reads",
    "retention_curve", "retention_spread", "retention_headline", "retention_z_test",
    "retention_gap_by_cohort", "gap_sign_summary", "retention_slice", "retention_slice_curve",
    "censoring_bias", "mix_balance", "mix_max_gap", "level_funnel", "level_funnel_reported",
    "level_time", "level_by_country", "level_by_cohort", "level_reach", "drift_summary",
    "second_break_test", "engagement", "engagement_by_day", "retention_chart_series",
    "funnel_chart_series",
)

# Presentation order of each report (the original's ORDER BY; NULLs last).
# Reports absent here keep the order they are produced in.
ORDER: dict[str, tuple[str, ...]] = {
    "version_profile": (S.VERSION,),
    "label_volume_by_month": ("ym",),
    "label_behaviour_profile": (S.VERSION,),
    "zero_playtime_actives": (S.VERSION,),
    "retention_naive": (S.VERSION,),
    "retention_maturity_gate": (S.VERSION,),
    "retention_reads": ("read_type", "version"),
    "retention_curve": ("version", "cohort_day"),
    "retention_spread": (S.VERSION,),
    "retention_headline": ("cohort_day",),
    "retention_z_test": ("cohort_day",),
    "retention_gap_by_cohort": ("install_date",),
    "retention_slice": ("version",),
    "retention_slice_curve": ("version", "cohort_day"),
    "censoring_bias": ("cohort_day",),
    "level_funnel": (S.LEVEL,),
    "level_funnel_reported": (S.LEVEL,),
    "level_time": (S.LEVEL, S.VERSION),
    "level_by_country": (S.COUNTRY,),
    "level_by_cohort": ("install_date",),
    "level_reach": (S.LEVEL,),
    "engagement": (S.VERSION,),
    "engagement_by_day": ("cohort_day",),
    "retention_chart_series": ("version", "cohort_day"),
    "funnel_chart_series": (S.LEVEL,),
}


# What names a row of each small report in the typed metrics; its other columns are metrics.
METRIC_KEYS: dict[str, tuple[str, ...]] = {
    "analysis_window": (),
    "version_profile": (S.VERSION,),
    "label_volume_by_month": ("ym",),
    "label_behaviour_profile": (S.VERSION,),
    "label_predates_parent": ("label", "parent"),
    "integrity_report": ("check_name",),
    "extract_day_check": (),
    "playtime_quirk": (),
    "zero_playtime_actives": (S.VERSION,),
    "retention_naive": (S.VERSION,),
    "retention_maturity_gate": (S.VERSION,),
    "retention_reads": ("read_type", "version"),
    "retention_curve": ("version", "cohort_day"),
    "retention_spread": (S.VERSION,),
    "retention_headline": ("day_label", "cohort_day"),
    "retention_z_test": ("day_label", "cohort_day"),
    "retention_gap_by_cohort": ("install_date",),
    "gap_sign_summary": (),
    "retention_slice": ("version",),
    "retention_slice_curve": ("version", "cohort_day"),
    "censoring_bias": ("day_label", "cohort_day"),
    "mix_balance": ("dim", "val"),
    "mix_max_gap": (),
    "level_funnel": (S.LEVEL,),
    "level_funnel_reported": (S.LEVEL,),
    "level_time": (S.LEVEL, S.VERSION),
    "level_by_country": (S.COUNTRY,),
    "level_by_cohort": ("install_date",),
    "level_reach": (S.LEVEL,),
    "drift_summary": (),
    "second_break_test": (),
    "engagement": (S.VERSION,),
    "engagement_by_day": ("cohort_day",),
    "retention_chart_series": ("version", "cohort_day"),
    "funnel_chart_series": (S.LEVEL,),
}


def metrics_table(reports: dict[str, DataFrame]) -> DataFrame:
    """The typed metrics of small reports in one table (see ``typed_metrics``)."""
    parts = [typed_metrics(n, df, METRIC_KEYS[n]) for n, df in reports.items()]
    return reduce(DataFrame.unionByName, parts)


def presentation_order(name: str, df: DataFrame) -> list:
    """Sort expressions for ``name``; mix is by dimension, then base share
    descending."""
    if name == "mix_balance":
        base = [c for c in df.columns if c.startswith("pct_")][0]
        return [F.col("dim").asc_nulls_last(), F.col(base).desc_nulls_last()]
    return [F.col(c).asc_nulls_last() for c in ORDER.get(name, ())]


# Reports whose row count grows with the cells: kept out of the long table.
DETAIL_REPORTS = frozenset({"quarantined_cells", "bad_cohort_cells", "orphan_prog_cells",
                            "orphan_act_cells", "missing_cohort_days", "duplicate_act_keys",
                            "duplicate_prog_keys", "playtime_quirk_cells"})


def prepare(spark: SparkSession, act: DataFrame, prog: DataFrame,
            spec: CohortSpec = CohortSpec(), params: AnalysisParams = AnalysisParams(),
            work_dir: str | None = None, threads: int = 3, rollups: bool = True,
            expected_extract: dt.date | None = None, window: AnalysisWindow | None = None) -> Analysis:
    """Derive the window (unless it is given) and materialise the shared
    intermediates (or, with ``rollups=False``, run every report on the cells)."""
    if not rollups:
        return Analysis(spark, act, prog, window or derive_window(act, spec, expected_extract), act, prog,
                        Q.cell_pairs(act, prog), spec, params, rolled=False)
    work_dir = work_dir or f"{shared_dir(spark)}/cohortlens-run/{uuid.uuid4().hex}"
    with ThreadPoolExecutor(max_workers=threads + 1) as pool:
        fw = pool.submit(lambda: window or derive_window(act, spec, expected_extract))
        fa = pool.submit(materialise_cube, spark, activity_cube(act, spec), f"{work_dir}/act_cube")
        fp = pool.submit(materialise_cube, spark, progression_cube(prog), f"{work_dir}/prog_cube")
        fc = pool.submit(materialise, spark, Q.cell_pairs(act, prog), f"{work_dir}/cell_pairs")
        found, pairs = fw.result(), fc.result()
        act_cube, prog_cube = fa.result(), fp.result()
    act_day, prog_level = (_cached(cube_part(c, ALL_CELLS)) for c in (act_cube, prog_cube))
    return Analysis(spark, act, prog, found, act_day, prog_level, pairs, spec, params,
                    work_dir=work_dir, act_cube=act_cube, prog_cube=prog_cube)


def run_analysis(spark: SparkSession, act: DataFrame, prog: DataFrame, out_dir: str,
                 spec: CohortSpec = CohortSpec(), params: AnalysisParams = AnalysisParams(),
                 threads: int = 16, only: list[str] | None = None,
                 fail_on: tuple[str, ...] = ("identity_breaks",),
                 out_format: str = "parquet",
                 expected_extract: dt.date | None = None,
                 analysis: Analysis | None = None) -> dict[str, str]:
    """Run every report and write it under ``out_dir``; the small reports are
    also written as one long metrics table (``out_dir/metrics``, partitioned
    by report).  Returns report name -> path.  A non-zero ``fail_on``
    counter raises ``IntegrityError`` before any other report is written, an
    extract date other than ``expected_extract`` raises ``WindowError`` before
    anything is.  Shared intermediates go to the shared folder.
    ``out_format`` is 'parquet' or 'json' (JSON lines, one file per small
    report).  ``analysis`` is one prepared already (a nightly run's)."""
    if out_format not in ("parquet", "json"):
        raise ValueError(f"unsupported output format {out_format!r}")
    analysis = analysis or prepare(spark, act, prog, spec, params, expected_extract=expected_extract)
    thunks = analysis.reports()
    names = list(dict.fromkeys((only or list(thunks)) + ["integrity_report"]))
    paths = {n: f"{out_dir}/{n}" for n in names}

    metrics_dir = f"{out_dir}/metrics"

    def write(name: str) -> None:
        spark.sparkContext.setJobDescription(f"cohortlens report {name}")
        df = thunks[name]()
        if name in DETAIL_REPORTS:
            df.write.mode("overwrite").format(out_format).save(paths[name])
            return
        # A handful of rows: one ordered file, and its long form next to it,
        # in the same thread (one directory per report, so writers never
        # share one).  Sorting one partition needs no extra job.
        order = presentation_order(name, df)
        small = df.coalesce(1)
        if order:
            small = small.sortWithinPartitions(*order)
        small.write.mode("overwrite").format(out_format).save(paths[name])
        written = spark.read.schema(df.schema).format(out_format).load(paths[name])
        long = long_metrics(name, written)
        if long is not None:
            (long.drop("report").coalesce(1).write.mode("overwrite").format(out_format)
             .save(f"{metrics_dir}/report={name}"))

    # A failed stop-the-run check must prevent every output.  Identity breaks
    # are summed exactly in the grain pairs, so that check is one small
    # aggregate and every report can then run at once; any other counter
    # needs the integrity report itself, written first.
    rest = names
    if set(fail_on) <= {"identity_breaks"}:
        if fail_on:
            breaks = analysis.pairs.agg(F.sum("p_identity_breaks").alias("n")).first()["n"]
            if breaks:
                raise Q.IntegrityError(f"integrity checks failed: {{'identity_breaks': {breaks}}}")
    else:
        write("integrity_report")
        Q.assert_clean(spark.read.format(out_format).load(paths["integrity_report"]), fail_on)
        rest = [n for n in names if n != "integrity_report"]
    # Dependent reports read what another job wrote instead of rescanning
    # cells: the quirk summary reads the flagged cells (and the totals of
    # the cached rollup), the largest mix gap reads the mix, and the
    # integrity counters and bad-cohort list read the cohort rollup.  Each
    # starts as soon as its own parents are done.
    parents: dict[str, list[str]] = {}

    def written(name: str, session: SparkSession, schema) -> DataFrame:
        return session.read.schema(schema).format(out_format).load(paths[name])

    if analysis.rolled and {"playtime_quirk", "playtime_quirk_cells"} <= set(rest):
        small = analysis.act_day.sparkSession
        cells_schema = thunks["playtime_quirk_cells"]().schema
        thunks["playtime_quirk"] = lambda: Q.playtime_quirk_from(
            written("playtime_quirk_cells", small, cells_schema), analysis.act_day,
            row_count=CELLS)
        parents["playtime_quirk"] = ["playtime_quirk_cells"]
    if {"mix_max_gap", "mix_balance"} <= set(rest):
        mix_schema = thunks["mix_balance"]().schema
        thunks["mix_max_gap"] = lambda: M.mix_max_gap(written("mix_balance", spark, mix_schema))
        parents["mix_max_gap"] = ["mix_balance"]
    cohort_users = [n for n in ("integrity_report", "bad_cohort_cells") if n in rest]
    if analysis.rolled and cohort_users:
        for n in cohort_users:
            parents[n] = ["_cohorts"]

    def after(name: str, futures: dict) -> None:
        for parent in parents[name]:
            futures[parent].result()
        write(name)

    with ThreadPoolExecutor(max_workers=threads) as pool:
        # Parents are queued before dependents and the pool runs jobs in
        # order, so a waiting dependent never holds up one of its parents.
        futures = {}
        if any(parents[n] == ["_cohorts"] for n in parents):
            futures["_cohorts"] = pool.submit(analysis.cohort_rollup)
        for n in rest:
            if n not in parents:
                futures[n] = pool.submit(write, n)
        for n in rest:
            if n in parents:
                futures[n] = pool.submit(after, n, futures)
        for future in futures.values():
            future.result()
    for rollup in (analysis.act_day, analysis.prog_level):
        rollup.unpersist()
    if any(n not in DETAIL_REPORTS for n in names):
        paths["metrics"] = metrics_dir
    return paths
