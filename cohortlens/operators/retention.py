"""Retention reports.

Retention DN = actives on cohort day N / actives on day 0 (cohort size),
pooled within a build.  Every report is a single scan of the activity cells
with conditional aggregates; the build keys (two labels) make the grouped
output tiny, so the shuffle after the partial aggregate carries a handful of
rows per task regardless of input size or skew between builds.  Statistics
that combine builds (gaps, z) are column expressions over those tiny
results; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import fixed
from cohortlens import spec as S
from cohortlens.functions import (
    count_if, max_if, pct, ratio, round_even, round_scaled, sum_if, two_proportion_z,
)
from cohortlens.operators.window import AnalysisWindow, comparable, two_builds
from cohortlens.spec import CohortSpec


# Short column accessors: actives, cohort day, install date, build label.
def _u() -> Column:
    return F.col(S.ACTIVE)


def _cd() -> Column:
    return F.col(S.COHORT_DAY)


def _d() -> Column:
    return F.col(S.INSTALL_DATE)


def _v() -> Column:
    return F.col(S.VERSION)


def _gated(n: int, window: AnalysisWindow) -> Column:
    """Cohort is old enough to have a day-n row: installed <= extract - n."""
    return _d() <= F.date_sub(F.lit(window.extract), n)


def retention_naive(act: DataFrame, spec: CohortSpec = CohortSpec()) -> DataFrame:
    """Pooled DN / D0 over the full history, no maturity gate.

    Wrong on purpose (cohorts too young for day N stay in the denominator);
    kept as the censored read that the corrected reads are compared with.
    """
    size = sum_if(_u(), _cd() == 0)
    return two_builds(act, spec).groupBy(S.VERSION).agg(
        *[round_scaled(pct(sum_if(_u(), _cd() == n), size), 2).alias(f"d{n}") for n in spec.days])


def retention_maturity_gate(act: DataFrame, window: AnalysisWindow,
                            spec: CohortSpec = CohortSpec()) -> DataFrame:
    """Full history; at day N a cohort counts in numerator *and*
    denominator only if installed on or before extract - N."""
    return two_builds(act, spec).groupBy(S.VERSION).agg(
        *[round_scaled(pct(sum_if(_u(), (_cd() == n) & _gated(n, window)),
                           sum_if(_u(), (_cd() == 0) & _gated(n, window))), 2).alias(f"d{n}")
          for n in spec.days])


NAIVE_READ = fixed.NAIVE_READ
GATED_READ = fixed.GATED_READ


def retention_reads(act: DataFrame, window: AnalysisWindow,
                    spec: CohortSpec = CohortSpec()) -> DataFrame:
    """R1 and R3 stacked with a ``read_type`` column.

    Both reads come from one scan and one aggregate; the two rows per build
    are unfolded from the aggregate afterwards (no UNION of two scans).
    """
    aggs = []
    for n in spec.days:
        aggs.append(round_scaled(pct(sum_if(_u(), _cd() == n), sum_if(_u(), _cd() == 0)), 2)
                    .alias(f"naive_d{n}"))
        aggs.append(round_scaled(pct(sum_if(_u(), (_cd() == n) & _gated(n, window)),
                                     sum_if(_u(), (_cd() == 0) & _gated(n, window))), 2)
                    .alias(f"gated_d{n}"))
    wide = two_builds(act, spec).groupBy(S.VERSION).agg(*aggs)
    reads = F.array(
        F.struct(F.lit(NAIVE_READ).alias("read_type"),
                 *[F.col(f"naive_d{n}").alias(f"d{n}") for n in spec.days]),
        F.struct(F.lit(GATED_READ).alias("read_type"),
                 *[F.col(f"gated_d{n}").alias(f"d{n}") for n in spec.days]),
    )
    return (wide.select(F.col(S.VERSION).alias("version"), F.explode(reads).alias("r"))
            .select("r.read_type", "version", *[f"r.d{n}" for n in spec.days]))


def retention_curve(act: DataFrame, window: AnalysisWindow, spec: CohortSpec = CohortSpec(),
                    where: Column | None = None,
                    days: Sequence[int] | None = None) -> DataFrame:
    """R2 (R11 with ``where``/``days``): matched window, per build x cohort
    day: cohort size, actives, retention % (2 dp).

    One scan, one aggregate to (build, day); the cohort size is the day-0 row
    of the same build, read with a window over that <= 2 x (horizon+1) row
    result instead of a second scan and a join.  A build without a day-0 row
    has no cohort size and is left out, as an inner join would.
    """
    base = comparable(act, window, spec).filter(_cd() <= spec.horizon)
    if where is not None:
        base = base.filter(where)
    per_day = base.groupBy(S.VERSION, S.COHORT_DAY).agg(F.sum(_u()).alias("active_users"))
    build = Window.partitionBy(S.VERSION)
    is_day0 = F.col(S.COHORT_DAY) == 0
    curve = (per_day
             .withColumn("cohort_size", F.sum(F.when(is_day0, F.col("active_users"))).over(build))
             .withColumn("_has_day0", F.max(is_day0).over(build))
             .filter(F.col("_has_day0")))
    if days is not None:
        curve = curve.filter(F.col(S.COHORT_DAY).isin(*days))
    return curve.select(
        F.col(S.VERSION).alias("version"),
        F.col(S.COHORT_DAY).alias("cohort_day"),
        "cohort_size",
        "active_users",
        round_scaled(pct("active_users", "cohort_size"), 2).alias("retention_pct"),
    )


def retention_spread(act: DataFrame, window: AnalysisWindow, spec: CohortSpec = CohortSpec(),
                     day: int = 1) -> DataFrame:
    """Per build, spread of per-install-date DN inside the window:
    number of dates, min, unweighted mean and max (1 dp)."""
    per_date = comparable(act, window, spec).groupBy(S.VERSION, S.INSTALL_DATE).agg(
        pct(sum_if(_u(), _cd() == day), sum_if(_u(), _cd() == 0)).alias("r"))
    return per_date.groupBy(S.VERSION).agg(
        F.count(F.lit(1)).alias("n_cohort_dates"),
        round_scaled(F.min("r"), 1).alias(f"d{day}_min"),
        round_scaled(F.avg("r"), 1).alias(f"d{day}_unweighted_mean"),
        round_scaled(F.max("r"), 1).alias(f"d{day}_max"),
    )


def _per_day(curve: DataFrame, spec: CohortSpec) -> DataFrame:
    """Base and candidate figures side by side, one row per headline day."""
    cv, day = F.col("version"), F.col("cohort_day")
    return (curve.filter(day.isin(*spec.days)).groupBy("cohort_day").agg(
        max_if("retention_pct", cv == spec.base).alias("p_base"),
        max_if("retention_pct", cv == spec.cand).alias("p_cand"),
        max_if("active_users", cv == spec.base).alias("x_base"),
        max_if("cohort_size", cv == spec.base).alias("n_base"),
        max_if("active_users", cv == spec.cand).alias("x_cand"),
        max_if("cohort_size", cv == spec.cand).alias("n_cand"),
    ))


def retention_headline(curve: DataFrame, spec: CohortSpec = CohortSpec()) -> DataFrame:
    """DN per build, absolute gap (1 dp) and relative change (whole %),
    both computed from the *rounded* rates of the curve."""
    t = _per_day(curve, spec)
    return t.select(
        F.concat(F.lit("D"), F.col("cohort_day").cast("string")).alias("day_label"),
        "cohort_day",
        F.col("p_base").alias(f"pct_{spec.base_tag}"),
        F.col("p_cand").alias(f"pct_{spec.cand_tag}"),
        round_scaled(F.col("p_base") - F.col("p_cand"), 1).alias("abs_gap_pts"),
        round_even(F.try_divide(F.lit(100.0) * (F.col("p_cand") - F.col("p_base")),
                                F.col("p_base"))).alias("rel_change_pct"),
    )


def retention_z_test(curve: DataFrame, spec: CohortSpec = CohortSpec()) -> DataFrame:
    """Pooled two-proportion z of base against candidate per day (1 dp)."""
    t = _per_day(curve, spec)
    return t.select(
        F.concat(F.lit("D"), F.col("cohort_day").cast("string")).alias("day_label"),
        "cohort_day",
        round_scaled(two_proportion_z("x_base", "n_base", "x_cand", "n_cand"), 1).alias("z"),
    )


def retention_gap_by_cohort(act: DataFrame, window: AnalysisWindow,
                            spec: CohortSpec = CohortSpec(), day: int = 1) -> DataFrame:
    """Per install date, candidate DN minus base DN in points (1 dp);
    NULL when a build has no cohort that date.  One aggregate by date."""
    def rate(label: str) -> Column:
        build = _v() == label
        return ratio(sum_if(_u(), build & (_cd() == day)), sum_if(_u(), build & (_cd() == 0)))

    return comparable(act, window, spec).groupBy(S.INSTALL_DATE).agg(
        round_scaled(F.lit(100.0) * (rate(spec.cand) - rate(spec.base)), 1)
        .alias(f"d{day}_gap_pts"),
    ).withColumnRenamed(S.INSTALL_DATE, "install_date")


def gap_sign_summary(gaps: DataFrame, day: int = 1) -> DataFrame:
    """How many dates have a negative gap, of how many; min and max."""
    g = F.col(f"d{day}_gap_pts")
    return gaps.agg(
        count_if(g < 0).alias("n_negative"),
        F.count(F.lit(1)).alias("n_dates"),
        F.min(g).alias("min_gap_pts"),
        F.max(g).alias("max_gap_pts"),
    )


def retention_slice(act: DataFrame, window: AnalysisWindow, column: str, value: str,
                    spec: CohortSpec = CohortSpec()) -> DataFrame:
    """The headline read for one value of one dimension, wide:
    cohort size and DN columns per build (size from the slice's day 0)."""
    size = sum_if(_u(), _cd() == 0)
    base = comparable(act, window, spec).filter(F.col(column) == value)
    return (base.groupBy(S.VERSION)
            .agg(count_if(_cd() == 0).alias("_n0"), size.alias("cohort_size"),
                 *[round_scaled(pct(sum_if(_u(), _cd() == n), size), 2).alias(f"d{n}")
                   for n in spec.days])
            .filter(F.col("_n0") > 0)
            .select(F.col(S.VERSION).alias("version"), "cohort_size",
                    *[f"d{n}" for n in spec.days]))


def retention_slice_curve(act: DataFrame, window: AnalysisWindow, column: str, value: str,
                          spec: CohortSpec = CohortSpec()) -> DataFrame:
    """The slice in long form, headline days only."""
    return retention_curve(act, window, spec, where=F.col(column) == value,
                           days=spec.days).drop("active_users")


def censoring_bias(act: DataFrame, window: AnalysisWindow,
                   spec: CohortSpec = CohortSpec()) -> DataFrame:
    """Per headline day, the candidate's naive (censored) rate, its
    corrected matched-window rate and the base build's matched-window rate.
    One global aggregate over the two builds, unfolded into one row per day."""
    inwin = _d().between(F.lit(window.start), F.lit(window.end)) & (_cd() <= spec.horizon)
    everything = F.lit(True)

    def rate(label: str, n: int, where: Column) -> Column:
        build = (_v() == label) & where
        return round_scaled(pct(sum_if(_u(), build & (_cd() == n)),
                                sum_if(_u(), build & (_cd() == 0))), 2)

    aggs = []
    for n in spec.days:
        aggs += [
            rate(spec.cand, n, everything).alias(f"naive_{n}"),
            rate(spec.cand, n, inwin).alias(f"corr_{n}"),
            rate(spec.base, n, inwin).alias(f"ref_{n}"),
        ]
    wide = two_builds(act, spec).agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(f"D{n}").alias("day_label"), F.lit(n).cast("bigint").alias("cohort_day"),
                 F.col(f"naive_{n}").alias("cand_naive"),
                 F.col(f"corr_{n}").alias("cand_corrected"),
                 F.col(f"ref_{n}").alias("base_reference"))
        for n in spec.days])
    return wide.select(F.explode(rows).alias("r")).select("r.*")
