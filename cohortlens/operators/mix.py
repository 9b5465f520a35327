"""Mix balance (M1, M2): is the pooled comparison fair?

Day-0 share of every value of every dimension per build, and the absolute
gap between builds.  The dimensions are unpivoted from one scan (no UNION of
one scan per dimension).  The totals are one row per dimension, joined back to
the (dimension, value) rollup, so no task holds all values of a dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import spec as S
from cohortlens.functions import pct, round_scaled, sum_if
from cohortlens.operators.window import AnalysisWindow, comparable
from cohortlens.spec import CohortSpec


def mix_balance(act: DataFrame, window: AnalysisWindow,
                spec: CohortSpec = CohortSpec()) -> DataFrame:
    """M1: dim, val, base share (1 dp), candidate share (1 dp), absolute gap
    (2 dp, from the unrounded shares)."""
    day0 = comparable(act, window, spec).filter(F.col(S.COHORT_DAY) == 0)
    long = day0.select(
        S.VERSION, S.ACTIVE,
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("dim"), F.col(col).alias("val"))
            for name, col in spec.dims])).alias("dv"),
    ).select(S.VERSION, S.ACTIVE, "dv.dim", "dv.val")
    return _shares(long, spec)


def mix_balance_from_cube(cube: DataFrame, window: AnalysisWindow,
                          spec: CohortSpec = CohortSpec()) -> DataFrame:
    """M1 from the dimension cube (``plans.analysis.activity_cube``), whose rows are
    already per dimension value: no unpivot and no scan of the cells."""
    names = [name for name, _ in spec.dims]
    day0 = comparable(cube, window, spec).filter(
        (F.col(S.COHORT_DAY) == 0) & F.col("dim").isin(*names))
    return _shares(day0.select(S.VERSION, S.ACTIVE, "dim", "val"), spec)


def _shares(long: DataFrame, spec: CohortSpec) -> DataFrame:
    """Shares of every (dim, val), from rows (build, actives, dim, val)."""
    v, u = F.col(S.VERSION), F.col(S.ACTIVE)
    per_val = long.groupBy("dim", "val").agg(
        sum_if(u, v == spec.base).alias("u_base"),
        sum_if(u, v == spec.cand).alias("u_cand"))
    totals = per_val.groupBy("dim").agg(F.sum("u_base").alias("all_base"),
                                        F.sum("u_cand").alias("all_cand"))
    shares = (per_val.join(F.broadcast(totals), "dim")   # one row per entry of spec.dims
              .withColumn("p_base", pct("u_base", F.col("all_base")))
              .withColumn("p_cand", pct("u_cand", F.col("all_cand"))))
    return shares.select(
        "dim", "val",
        round_scaled("p_base", 1).alias(f"pct_{spec.base_tag}"),
        round_scaled("p_cand", 1).alias(f"pct_{spec.cand_tag}"),
        round_scaled(F.abs(F.col("p_cand") - F.col("p_base")), 2).alias("abs_gap_pts"),
    )


def mix_max_gap(mix: DataFrame) -> DataFrame:
    """M2: the largest gap over all dimensions."""
    return mix.agg(F.max("abs_gap_pts").alias("max_abs_gap_pts"))
