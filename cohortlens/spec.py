"""Data model: the two cohort-cell tables, their grain and the comparison spec.

Both inputs are *pre-aggregated cohort cells*, not users or events:

* activity    -- one row per install date x build x country x network x
                 package group x cohort day (days since install);
* progression -- the activity grain x level.

Everything downstream is a function of these two DataFrames plus a
:class:`CohortSpec` (which two builds to compare, horizon, dimensions).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from cohortlens import fixed

# Column names of the activity / progression cells.
INSTALL_DATE = "d_install_date"
VERSION = "s_app_version"
COUNTRY = "s_country"
NETWORK = "s_acquisition_network"
PACKAGE = "s_installing_pckg_group"
COHORT_DAY = "i_cohort_groups"
ACTIVE = "i_active_users"
SESSIONS = "i_count_sessions"
PLAYTIME = "f_playtime"
LEVEL = "i_level"
STARTED = "i_level_started"
COMPLETED = "i_level_completed"
FAILED = "i_level_failed"
USERS = "i_users"
LEVEL_TIME = "f_play_time"

# Grain: a cohort is (date, build, country, network, package); a cell adds the
# cohort day; a progression cell adds the level.
KEY5 = [INSTALL_DATE, VERSION, COUNTRY, NETWORK, PACKAGE]
KEY6 = KEY5 + [COHORT_DAY]
KEY7 = KEY6 + [LEVEL]

# Explicit schemas: labels such as "10.2" must stay strings (a CSV holding
# only 10.2 / 11.0 would otherwise be inferred as double).
ACTIVITY_SCHEMA = T.StructType([
    T.StructField(INSTALL_DATE, T.DateType()),
    T.StructField(VERSION, T.StringType()),
    T.StructField(COUNTRY, T.StringType()),
    T.StructField(NETWORK, T.StringType()),
    T.StructField(PACKAGE, T.StringType()),
    T.StructField(COHORT_DAY, T.LongType()),
    T.StructField(ACTIVE, T.LongType()),
    T.StructField(SESSIONS, T.LongType()),
    T.StructField(PLAYTIME, T.DoubleType()),
])

PROGRESSION_SCHEMA = T.StructType([
    T.StructField(INSTALL_DATE, T.DateType()),
    T.StructField(VERSION, T.StringType()),
    T.StructField(COUNTRY, T.StringType()),
    T.StructField(NETWORK, T.StringType()),
    T.StructField(PACKAGE, T.StringType()),
    T.StructField(COHORT_DAY, T.LongType()),
    T.StructField(LEVEL, T.LongType()),
    T.StructField(STARTED, T.LongType()),
    T.StructField(COMPLETED, T.LongType()),
    T.StructField(FAILED, T.LongType()),
    T.StructField(USERS, T.LongType()),
    T.StructField(LEVEL_TIME, T.DoubleType()),
])

# Mix dimensions: output name -> cell column.
DEFAULT_DIMS = fixed.MIX_DIMENSIONS


def label_tag(label: str) -> str:
    """Column-name suffix for a build label: '10.2' -> '10_2'."""
    return "".join(ch if ch.isalnum() else "_" for ch in label)


@dataclass(frozen=True)
class CohortSpec:
    """Which builds are compared and over what horizon.

    ``base`` is the live build, ``cand`` the candidate under rollout.  Labels
    are compared as strings.  ``horizon`` is the last cohort day in scope; the
    matched window ends ``horizon`` days before the extract so every cohort in
    it is mature to that day.
    """

    base: str = fixed.BASE_BUILD
    cand: str = fixed.CANDIDATE_BUILD
    horizon: int = fixed.HORIZON_DAYS
    days: tuple[int, ...] = fixed.HEADLINE_DAYS
    dims: tuple[tuple[str, str], ...] = field(default=DEFAULT_DIMS)

    @property
    def builds(self) -> tuple[str, str]:
        return (self.base, self.cand)

    @property
    def base_tag(self) -> str:
        return label_tag(self.base)

    @property
    def cand_tag(self) -> str:
        return label_tag(self.cand)
