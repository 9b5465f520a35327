"""Level funnel (F1-F10): where does the candidate break?

Ratios only (completed / started, started / users, seconds / started), so
the pre-aggregated grain and retries do not distort them.  Every report is
one scan of the progression cells filtered to the window and the two
builds, aggregated to one row per level (or level x build); follow-up
statistics (drift, second-break z) are aggregates over that <= #levels row
result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens import fixed
from cohortlens import spec as S
from cohortlens.functions import max_if, pct, pooled_se, ratio, round_scaled, sum_if
from cohortlens.operators.window import AnalysisWindow, comparable
from cohortlens.spec import CohortSpec


def _is(spec_label: str) -> Column:
    return F.col(S.VERSION) == spec_label


def _completion(label: str) -> Column:
    return pct(sum_if(F.col(S.COMPLETED), _is(label)), sum_if(F.col(S.STARTED), _is(label)))


def level_funnel(prog: DataFrame, window: AnalysisWindow,
                 spec: CohortSpec = CohortSpec()) -> DataFrame:
    """Per level, completion % per build (1 dp), attempts per user
    (2 dp), candidate starts, the rounded difference of the rounded
    completions, and seconds per attempt per build (0 dp)."""
    b, c = spec.base, spec.cand
    bt, ct = spec.base_tag, spec.cand_tag
    st, us, pt = F.col(S.STARTED), F.col(S.USERS), F.col(S.LEVEL_TIME)
    agg = comparable(prog, window, spec).groupBy(S.LEVEL).agg(
        round_scaled(_completion(b), 1).alias(f"comp_{bt}"),
        round_scaled(_completion(c), 1).alias(f"comp_{ct}"),
        round_scaled(ratio(sum_if(st, _is(b)), sum_if(us, _is(b))), 2).alias(f"att_{bt}"),
        round_scaled(ratio(sum_if(st, _is(c)), sum_if(us, _is(c))), 2).alias(f"att_{ct}"),
        sum_if(st, _is(c)).alias(f"starts_{ct}"),
        round_scaled(ratio(sum_if(pt, _is(b)), sum_if(st, _is(b))), 0).alias(f"sec_per_attempt_{bt}"),
        round_scaled(ratio(sum_if(pt, _is(c)), sum_if(st, _is(c))), 0).alias(f"sec_per_attempt_{ct}"),
    )
    return agg.withColumn(
        "delta_pts", round_scaled(F.col(f"comp_{ct}") - F.col(f"comp_{bt}"), 1))


def suppress_thin(funnel: DataFrame, spec: CohortSpec = CohortSpec(),
                  max_level: int | None = None, min_starts: int | None = None) -> DataFrame:
    """drop levels too deep or too thin in candidate volume to report."""
    out = funnel
    if max_level is not None:
        out = out.filter(F.col(S.LEVEL) <= max_level)
    if min_starts is not None:
        out = out.filter(F.col(f"starts_{spec.cand_tag}") >= min_starts)
    return out


def level_time(prog: DataFrame, window: AnalysisWindow, spec: CohortSpec = CohortSpec(),
               levels: Sequence[int] = fixed.TIME_LEVELS) -> DataFrame:
    """level x build: seconds per attempt and per user (0 dp)."""
    base = comparable(prog, window, spec).filter(F.col(S.LEVEL).isin(*levels))
    return base.groupBy(S.LEVEL, S.VERSION).agg(
        round_scaled(ratio(F.sum(S.LEVEL_TIME), F.sum(S.STARTED)), 0).alias("sec_per_attempt"),
        round_scaled(ratio(F.sum(S.LEVEL_TIME), F.sum(S.USERS)), 0).alias("sec_per_user"),
    )


def level_by_dimension(prog: DataFrame, window: AnalysisWindow, spec: CohortSpec = CohortSpec(),
                       level: int = fixed.BREAK_LEVEL, column: str = S.COUNTRY) -> DataFrame:
    """one level's completion by the values of one dimension, both builds."""
    base = comparable(prog, window, spec).filter(F.col(S.LEVEL) == level)
    return base.groupBy(column).agg(
        round_scaled(_completion(spec.base), 1).alias(f"comp_{spec.base_tag}"),
        round_scaled(_completion(spec.cand), 1).alias(f"comp_{spec.cand_tag}"),
    )


def level_by_cohort(prog: DataFrame, build: str, level: int = fixed.BREAK_LEVEL) -> DataFrame:
    """one level's starts and completion per install date for one build,
    over the full history (not windowed)."""
    from cohortlens.spec import label_tag

    base = prog.filter((F.col(S.VERSION) == build) & (F.col(S.LEVEL) == level))
    return base.groupBy(F.col(S.INSTALL_DATE).alias("install_date")).agg(
        F.sum(S.STARTED).alias("starts"),
        round_scaled(pct(F.sum(S.COMPLETED), F.sum(S.STARTED)), 1).alias(f"comp_{label_tag(build)}"),
    )


def level_reach(prog: DataFrame, window: AnalysisWindow, spec: CohortSpec = CohortSpec(),
                levels: Sequence[int] = fixed.REACH_LEVELS) -> DataFrame:
    """users seen at each selected level as % of the largest count over
    the selected levels, per build (1 dp).

    The denominator is a window over the per-level rollup, which has at most
    ``len(levels)`` rows, so the single partition it needs is bounded."""
    us = F.col(S.USERS)
    per_level = (comparable(prog, window, spec).filter(F.col(S.LEVEL).isin(*levels))
                 .groupBy(S.LEVEL)
                 .agg(sum_if(us, _is(spec.base)).alias("u_base"),
                      sum_if(us, _is(spec.cand)).alias("u_cand")))
    every = Window.partitionBy()
    return per_level.select(
        S.LEVEL,
        round_scaled(pct("u_base", F.max("u_base").over(every)), 1).alias(f"reach_{spec.base_tag}"),
        round_scaled(pct("u_cand", F.max("u_cand").over(every)), 1).alias(f"reach_{spec.cand_tag}"),
    )


def _delta(funnel: DataFrame, spec: CohortSpec) -> Column:
    """Unrounded difference of the rounded completions."""
    return F.col(f"comp_{spec.cand_tag}") - F.col(f"comp_{spec.base_tag}")


def drift_summary(funnel: DataFrame, spec: CohortSpec = CohortSpec(),
                  early: tuple[int, int] = fixed.EARLY_LEVELS,
                  late: tuple[int, int] = fixed.LATE_LEVELS,
                  break_level: int = fixed.BREAK_LEVEL,
                  tail_from: int = fixed.TAIL_FROM_LEVEL) -> DataFrame:
    """F8: mean completion delta over an early and a late level range (1 dp),
    the delta at the break level, and candidate starts from ``tail_from`` on."""
    lv = F.col(S.LEVEL)
    d = _delta(funnel, spec)
    return funnel.agg(
        round_scaled(F.avg(F.when(lv.between(*early), d)), 1)
        .alias(f"levels_{early[0]}_{early[1]}_mean_delta_pts"),
        round_scaled(F.avg(F.when(lv.between(*late), d)), 1)
        .alias(f"levels_{late[0]}_{late[1]}_mean_delta_pts"),
        max_if(F.col("delta_pts"), lv == break_level).alias(f"level_{break_level}_delta_pts"),
        F.coalesce(sum_if(F.col(f"starts_{spec.cand_tag}"), lv >= tail_from), F.lit(0))
        .cast("bigint").alias(f"tail_{tail_from}_plus_starts_{spec.cand_tag}"),
    )


def second_break_test(prog: DataFrame, window: AnalysisWindow, spec: CohortSpec = CohortSpec(),
                      level: int = fixed.SECOND_BREAK_LEVEL,
                      late: tuple[int, int] = fixed.LATE_LEVELS) -> DataFrame:
    """is a second level's drop more than the late-level drift?

    z of (base completion + drift - candidate completion) at ``level`` with a
    pooled standard error; the drift is the mean of the rounded completion
    deltas over ``late`` without ``level`` (left unrounded)."""
    b, c = spec.base, spec.cand
    st, co = F.col(S.STARTED), F.col(S.COMPLETED)
    per_level = comparable(prog, window, spec).groupBy(S.LEVEL).agg(
        sum_if(st, _is(b)).alias("st_b"), sum_if(co, _is(b)).alias("co_b"),
        sum_if(st, _is(c)).alias("st_c"), sum_if(co, _is(c)).alias("co_c"),
        round_scaled(_completion(b), 1).alias("comp_b"),
        round_scaled(_completion(c), 1).alias("comp_c"),
    )
    lv = F.col(S.LEVEL)
    at = lv == level
    t = per_level.agg(
        F.avg(F.when(lv.between(*late) & ~at, F.col("comp_c") - F.col("comp_b"))).alias("drift"),
        max_if(F.col("st_b"), at).alias("st_b"), max_if(F.col("co_b"), at).alias("co_b"),
        max_if(F.col("st_c"), at).alias("st_c"), max_if(F.col("co_c"), at).alias("co_c"),
    )
    st_b, co_b, st_c, co_c = (F.col(x).cast("double") for x in ("st_b", "co_b", "st_c", "co_c"))
    se = pooled_se(F.try_divide(co_b + co_c, st_b + st_c), st_b, st_c)
    excess = (F.try_divide(co_b, st_b) + F.col("drift") / F.lit(100.0) - F.try_divide(co_c, st_c))
    return t.select(
        F.lit(level).cast("bigint").alias(S.LEVEL),
        round_scaled(pct("co_b", "st_b"), 1).alias(f"comp_{spec.base_tag}"),
        round_scaled(pct("co_c", "st_c"), 1).alias(f"comp_{spec.cand_tag}"),
        F.col("st_c").alias(f"starts_{spec.cand_tag}"),
        round_scaled("drift", 1).alias("drift_baseline_pts"),
        round_scaled(F.try_divide(excess, se), 1).alias("excess_z_vs_drift"),
    )
