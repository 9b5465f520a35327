"""Checks on a build label that cannot be trusted (Q20-Q22).

A patch label whose installs start before its parent build's first install
is mislabelled.  These reports profile such a label so it can be
quarantined (``window.quarantine``) rather than silently dropped or merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import fixed
from cohortlens import spec as S
from cohortlens.functions import min_if, pct, round_scaled, sum_if
from cohortlens.operators.window import AnalysisWindow


def label_volume_by_month(act: DataFrame, label: str) -> DataFrame:
    """Q20: day-0 users of one label per calendar month ('yyyy-MM')."""
    return (act.filter(F.col(S.VERSION) == label)
            .groupBy(F.date_format(S.INSTALL_DATE, fixed.MONTH_FORMAT).alias("ym"))
            .agg(sum_if(F.col(S.ACTIVE), F.col(S.COHORT_DAY) == 0).alias("d0_users")))


def label_behaviour_profile(act: DataFrame, prog: DataFrame, window: AnalysisWindow,
                            level: int = fixed.BREAK_LEVEL, day: int = 1) -> DataFrame:
    """Q21: per build label, maturity-gated DN (1 dp) and all-history
    completion of one level (1 dp), side by side.

    Both sides are aggregated to one row per label before a left join on the
    label, so the join moves a handful of rows."""
    u, cd, d = F.col(S.ACTIVE), F.col(S.COHORT_DAY), F.col(S.INSTALL_DATE)
    mature = d <= F.date_sub(F.lit(window.extract), day)
    ret = act.groupBy(S.VERSION).agg(
        round_scaled(pct(sum_if(u, (cd == day) & mature), sum_if(u, (cd == 0) & mature)), 1)
        .alias(f"d{day}"))
    comp = (prog.filter(F.col(S.LEVEL) == level).groupBy(S.VERSION)
            .agg(round_scaled(pct(F.sum(S.COMPLETED), F.sum(S.STARTED)), 1)
                 .alias(f"l{level}_completion")))
    return ret.join(comp, on=S.VERSION, how="left")


def label_predates_parent(act: DataFrame, label: str, parent: str) -> DataFrame:
    """Q22: first install of a label against its parent's, and the label's
    share of all day-0 users.  One global aggregate."""
    v, d, u, cd = F.col(S.VERSION), F.col(S.INSTALL_DATE), F.col(S.ACTIVE), F.col(S.COHORT_DAY)
    t = act.agg(
        min_if(d, v == label).alias("label_first_install"),
        min_if(d, v == parent).alias("parent_first_install"),
        sum_if(u, (v == label) & (cd == 0)).alias("label_d0_users"),
        sum_if(u, cd == 0).alias("all_d0_users"),
    )
    return t.select(
        F.lit(label).alias("label"),
        F.lit(parent).alias("parent"),
        "label_first_install",
        "parent_first_install",
        F.datediff("parent_first_install", "label_first_install").cast("bigint")
        .alias("days_before_parent"),
        (F.col("label_first_install") < F.col("parent_first_install")).alias("predates_parent"),
        "label_d0_users",
        round_scaled(pct("label_d0_users", "all_d0_users"), 2).alias("label_share_pct"),
    )
