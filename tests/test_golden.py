"""Golden tests of the post-aggregate statistics against the published
results of the original analysis (its full extract is not available, but its
aggregates are, and these operators only consume aggregates)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

from cohortlens.functions import pct, round_scaled
from cohortlens.operators import funnel as FN
from cohortlens.operators import mix as M
from cohortlens.operators import retention as R
from cohortlens.spec import CohortSpec

SPEC = CohortSpec()

# Published matched-window curve (version, day, cohort size, actives).
CURVE = [
    ("10.2", 0, 22334, 22334), ("10.2", 1, 22334, 12380), ("10.2", 2, 22334, 8894),
    ("10.2", 3, 22334, 7119), ("10.2", 4, 22334, 6053), ("10.2", 5, 22334, 5329),
    ("10.2", 6, 22334, 4804), ("10.2", 7, 22334, 4384),
    ("11.0", 0, 10595, 10595), ("11.0", 1, 10595, 5304), ("11.0", 2, 10595, 3480),
    ("11.0", 3, 10595, 2567), ("11.0", 4, 10595, 2057), ("11.0", 5, 10595, 1771),
    ("11.0", 6, 10595, 1544), ("11.0", 7, 10595, 1368),
]
# Published retention % for the rows above.
CURVE_PCT = [100.0, 55.43, 39.82, 31.88, 27.1, 23.86, 21.51, 19.63,
             100.0, 50.06, 32.85, 24.23, 19.41, 16.72, 14.57, 12.91]

# Published level funnel (level, comp 10.2, comp 11.0, starts 11.0, delta).
FUNNEL = [
    (1, 94.4, 91.3, 11505, -3.1), (2, 94.2, 91.7, 11144, -2.5), (3, 93.8, 91.7, 10306, -2.1),
    (4, 94.0, 91.4, 8752, -2.6), (5, 94.4, 91.3, 7201, -3.1), (6, 94.1, 92.3, 5835, -1.8),
    (7, 85.4, 39.6, 9455, -45.8), (8, 82.1, 74.1, 4320, -8.0), (9, 81.0, 75.2, 3801, -5.8),
    (10, 80.6, 71.8, 3600, -8.8), (11, 79.0, 71.8, 3279, -7.2), (12, 79.1, 70.4, 3071, -8.7),
    (13, 77.3, 68.4, 2915, -8.9), (14, 75.9, 67.3, 2710, -8.6), (15, 74.8, 67.3, 2475, -7.5),
    (16, 71.9, 63.9, 2347, -8.0), (17, 68.4, 62.6, 2109, -5.8), (18, 67.0, 58.1, 1933, -8.9),
    (19, 64.5, 56.7, 1648, -7.8), (20, 62.4, 54.4, 1357, -8.0), (21, 60.6, 53.2, 1060, -7.4),
    (22, 57.6, 51.9, 761, -5.7), (23, 58.6, 45.1, 548, -13.5), (24, 55.8, 47.1, 314, -8.7),
    (25, 51.5, 48.2, 191, -3.3), (26, 49.1, 49.5, 97, 0.4), (27, 45.2, 29.2, 48, -16.0),
    (28, 36.0, 41.2, 17, 5.2), (29, 53.7, 28.6, 7, -25.1), (30, 33.3, 50.0, 2, 16.7),
]

# Published D1 gap by install date (2026-04-15 .. 04-26), points.
GAPS = [-7.0, -7.1, -7.1, -3.1, -4.6, -7.7, -4.5, -8.9, -7.3, -0.4, -4.9, -5.8]

# Published mix gaps (dimension, value, abs gap).
MIX_GAPS = [
    ("country", "US", 0.62), ("country", "BR", 0.07), ("country", "IN", 0.3),
    ("country", "JP", 0.3), ("country", "MX", 0.03), ("country", "DE", 0.11),
    ("country", "ID", 0.04), ("country", "FR", 0.13), ("country", "TR", 0.34),
    ("country", "GB", 0.23), ("network", "Meta Ads", 0.53), ("network", "Organic", 0.4),
    ("network", "Google Ads", 0.6), ("network", "AppLovin", 0.49), ("network", "Unity Ads", 0.37),
    ("network", "ironSource", 0.47), ("network", "TikTok", 0.38),
    ("package", "com.android.vending", 0.72), ("package", "other", 0.72),
]


def _curve_df(spark):
    df = spark.createDataFrame(CURVE, "version string, cohort_day bigint, cohort_size bigint, "
                                     "active_users bigint")
    return df.withColumn("retention_pct",
                         round_scaled(pct("active_users", "cohort_size"), 2))


def test_curve_percentages(spark):
    got = [r["retention_pct"] for r in _curve_df(spark).collect()]
    assert got == CURVE_PCT


def test_headline_gaps_and_relative_change(spark):
    rows = {r["day_label"]: r for r in R.retention_headline(_curve_df(spark), SPEC).collect()}
    assert [rows[d]["abs_gap_pts"] for d in ("D1", "D3", "D7")] == [5.4, 7.6, 6.7]
    assert [rows[d]["rel_change_pct"] for d in ("D1", "D3", "D7")] == [-10, -24, -34]
    assert [rows[d]["pct_10_2"] for d in ("D1", "D3", "D7")] == [55.43, 31.88, 19.63]


def test_pooled_z_scores(spark):
    rows = {r["day_label"]: r["z"] for r in R.retention_z_test(_curve_df(spark), SPEC).collect()}
    assert [rows["D1"], rows["D3"], rows["D7"]] == [9.1, 14.2, 15.0]


def _funnel_df(spark):
    schema = T.StructType([
        T.StructField("i_level", T.LongType()), T.StructField("comp_10_2", T.DoubleType()),
        T.StructField("comp_11_0", T.DoubleType()), T.StructField("starts_11_0", T.LongType()),
        T.StructField("published_delta", T.DoubleType())])
    df = spark.createDataFrame(FUNNEL, schema)
    return df.withColumn("delta_pts", round_scaled(df.comp_11_0 - df.comp_10_2, 1))


def test_funnel_delta_is_rounded_difference(spark):
    for r in _funnel_df(spark).collect():
        assert r["delta_pts"] == r["published_delta"], r["i_level"]


def test_drift_summary(spark):
    r = FN.drift_summary(_funnel_df(spark), SPEC).collect()[0]
    assert r["levels_1_6_mean_delta_pts"] == -2.5
    assert r["levels_8_24_mean_delta_pts"] == -8.1
    assert r["level_7_delta_pts"] == -45.8
    assert r["tail_25_plus_starts_11_0"] == 362


def test_second_break_drift_baseline(spark):
    # The baseline of the level-23 test excludes level 23 from levels 8..24.
    r = FN.drift_summary(_funnel_df(spark).filter("i_level <> 23"), SPEC).collect()[0]
    assert r["levels_8_24_mean_delta_pts"] == -7.7


def test_gap_sign_summary(spark):
    start = dt.date(2026, 4, 15)
    rows = [(start + dt.timedelta(days=i), g) for i, g in enumerate(GAPS)]
    gaps = spark.createDataFrame(rows, "install_date date, d1_gap_pts double")
    r = R.gap_sign_summary(gaps).collect()[0]
    assert (r["n_negative"], r["n_dates"], r["min_gap_pts"], r["max_gap_pts"]) == (12, 12, -8.9, -0.4)


def test_mix_max_gap(spark):
    mix = spark.createDataFrame(MIX_GAPS, "dim string, val string, abs_gap_pts double")
    assert M.mix_max_gap(mix).collect()[0]["max_abs_gap_pts"] == 0.72
