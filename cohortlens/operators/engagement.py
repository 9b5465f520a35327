"""Engagement intensity (E1, E2): do the survivors also play less?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import spec as S
from cohortlens.functions import ratio, round_scaled, sum_if
from cohortlens.operators.window import AnalysisWindow, comparable
from cohortlens.spec import CohortSpec


def engagement(act: DataFrame, window: AnalysisWindow,
               spec: CohortSpec = CohortSpec()) -> DataFrame:
    """Per build, sessions per active user (2 dp) and playtime seconds per
    active user (0 dp), cohort days pooled."""
    return comparable(act, window, spec).groupBy(S.VERSION).agg(
        round_scaled(ratio(F.sum(S.SESSIONS), F.sum(S.ACTIVE)), 2).alias("sessions_per_active"),
        round_scaled(ratio(F.sum(S.PLAYTIME), F.sum(S.ACTIVE)), 0).alias("playtime_per_active_sec"),
    )


def engagement_by_day(act: DataFrame, window: AnalysisWindow,
                      spec: CohortSpec = CohortSpec()) -> DataFrame:
    """Per cohort day, playtime seconds per active user for each build."""
    v, u, pt = F.col(S.VERSION), F.col(S.ACTIVE), F.col(S.PLAYTIME)

    def per_active(label: str):
        return round_scaled(ratio(sum_if(pt, v == label), sum_if(u, v == label)), 0)

    return comparable(act, window, spec).groupBy(
        F.col(S.COHORT_DAY).alias("cohort_day")).agg(
        per_active(spec.base).alias(f"sec_per_active_{spec.base_tag}"),
        per_active(spec.cand).alias(f"sec_per_active_{spec.cand_tag}"),
    )
