"""Cell sources and sinks: explicit schemas, CSV and partitioned Parquet."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from cohortlens import spec as S
from cohortlens.sources.cells import read_activity, read_progression, register, write_cells


def test_csv_labels_stay_strings(spark):
    d = tempfile.mkdtemp(prefix="cells-csv-", dir="/tmp")
    path = os.path.join(d, "act.csv")
    with open(path, "w") as f:
        f.write(",".join(S.ACTIVITY_SCHEMA.fieldNames()) + "\n")
        f.write("2026-04-15,10.2,US,Organic,other,0,10,12,600.5\n")
        f.write("2026-04-15,11.0,US,Organic,other,0,8,9,400.0\n")
    act = read_activity(spark, path, fmt="csv")
    assert act.schema == S.ACTIVITY_SCHEMA
    assert sorted(r[S.VERSION] for r in act.collect()) == ["10.2", "11.0"]
    assert act.collect()[0][S.INSTALL_DATE] == dt.date(2026, 4, 15)


def test_csv_columns_go_by_name(spark):
    import pytest

    d = tempfile.mkdtemp(prefix="cells-csv-", dir="/tmp")
    row = dict(zip(S.ACTIVITY_SCHEMA.fieldNames(),
                   ("2026-04-15", "10.2", "US", "Organic", "other", "0", "10", "12", "600.5"), strict=True))
    names = [*reversed(row), "extra"]
    for file, columns in (("permuted.csv", names), ("short.csv", names[1:])):
        with open(os.path.join(d, file), "w") as f:
            f.write(",".join(columns) + "\n" + ",".join({**row, "extra": "x"}[c] for c in columns) + "\n")
    got = read_activity(spark, os.path.join(d, "permuted.csv"), fmt="csv")
    assert got.schema == S.ACTIVITY_SCHEMA
    assert tuple(got.first()) == (dt.date(2026, 4, 15), "10.2", "US", "Organic", "other", 0, 10, 12, 600.5)
    with pytest.raises(ValueError, match=names[0]):
        read_activity(spark, os.path.join(d, "short.csv"), fmt="csv")


def test_parquet_roundtrip_partitioned(spark, small_cells):
    act, prog = small_cells
    d = tempfile.mkdtemp(prefix="cells-pq-", dir="/tmp")
    sample = act.filter("d_install_date >= date'2001-07-01'")
    write_cells(sample, os.path.join(d, "act"))
    back = read_activity(spark, os.path.join(d, "act"))
    assert back.schema == S.ACTIVITY_SCHEMA
    assert back.count() == sample.count()
    assert back.exceptAll(sample).count() == 0
    write_cells(prog.filter("d_install_date >= date'2001-07-01'"), os.path.join(d, "prog"),
                partition_by=None)
    assert read_progression(spark, os.path.join(d, "prog")).schema == S.PROGRESSION_SCHEMA


def test_register_views(spark, small_cells):
    act, prog = small_cells
    register(spark, act, prog)
    n = spark.sql("SELECT COUNT(*) AS n FROM act WHERE i_cohort_groups = 0").collect()[0]["n"]
    assert n == act.filter("i_cohort_groups = 0").count()
    assert spark.sql("SELECT COUNT(*) FROM prog").collect()[0][0] == prog.count()


def test_parquet_timestamp_dates_and_int_counts_are_aligned(spark):
    from pyspark.sql import functions as F

    d = tempfile.mkdtemp(prefix="cells-ts-", dir="/tmp")
    raw = spark.createDataFrame(
        [("2026-04-15 00:00:00", "10.2", "US", "Organic", "other", 0, 10, 12, 600.5)],
        "d string, v string, c string, n string, p string, cd int, u int, s int, pt double")
    raw = raw.select(F.to_timestamp("d").alias(S.INSTALL_DATE), F.col("v").alias(S.VERSION),
                     F.col("c").alias(S.COUNTRY), F.col("n").alias(S.NETWORK),
                     F.col("p").alias(S.PACKAGE), F.col("cd").alias(S.COHORT_DAY),
                     F.col("u").alias(S.ACTIVE), F.col("s").alias(S.SESSIONS),
                     F.col("pt").alias(S.PLAYTIME))
    raw.write.parquet(os.path.join(d, "act"))
    act = read_activity(spark, os.path.join(d, "act"))
    assert act.schema == S.ACTIVITY_SCHEMA
    assert act.first()[S.INSTALL_DATE] == dt.date(2026, 4, 15)


def test_write_metrics_long_form(spark, small_cells):
    from cohortlens.operators import retention as R
    from cohortlens.operators.window import derive_window
    from cohortlens.sources.metrics import write_metrics
    from cohortlens.spec import CohortSpec

    act, _ = small_cells
    spec = CohortSpec()
    w = derive_window(act, spec)
    reports = {"retention_curve": R.retention_curve(act, w, spec),
               "retention_naive": R.retention_naive(act, spec)}
    out = os.path.join(tempfile.mkdtemp(prefix="metrics-", dir="/tmp"), "m")
    write_metrics(reports, out)
    long = spark.read.parquet(out)
    assert long.columns == ["report", "keys", "metric", "value"]
    # curve: 16 rows x 4 numeric columns; naive: 2 builds x 3 days
    assert long.filter("report = 'retention_curve'").count() == 16 * 4
    row = long.filter("report = 'retention_naive' AND metric = 'd1' AND keys['s_app_version'] = '10.2'")
    expected = R.retention_naive(act, spec).filter("s_app_version = '10.2'").first()["d1"]
    assert row.first()["value"] == expected
