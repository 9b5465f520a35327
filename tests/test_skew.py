"""A key holding a third of all rows: results stay exact (brute force in
pandas on the small fixture) and nothing is dropped or capped."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cohortlens import spec as S
from cohortlens.operators import integrity as Q
from cohortlens.operators import retention as R
from cohortlens.operators.window import derive_window
from cohortlens.spec import CohortSpec

SPEC = CohortSpec()


def _skewed(spark, act):
    n = act.count()
    hot = act.filter((F.col(S.VERSION) == "10.2") & (F.col(S.COHORT_DAY) == 1)).limit(1)
    copies = hot.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(n // 2)))).drop("_k")
    return act.unionByName(copies), n // 2


def test_hot_key_counts_exactly(spark, small_cells):
    act, prog = small_cells
    skewed, extra = _skewed(spark, act)
    assert extra * 3 >= skewed.count() - 1          # the hot key is ~1/3 of the rows
    w = derive_window(act, SPEC)
    clean = {r["check_name"]: r["n"] for r in Q.integrity_report(act, prog, w.extract, SPEC).collect()}
    hot = {r["check_name"]: r["n"] for r in Q.integrity_report(skewed, prog, w.extract, SPEC).collect()}
    assert hot["act_rows"] - clean["act_rows"] == extra
    assert hot["dup_act"] - clean["dup_act"] == 1
    assert hot["bad_cohort_cells"] >= clean["bad_cohort_cells"]


def test_hot_key_retention_matches_brute_force(spark, small_cells):
    act, _ = small_cells
    skewed, _ = _skewed(spark, act)
    pdf = skewed.toPandas()
    got = {r["s_app_version"]: r for r in R.retention_naive(skewed, SPEC).collect()}
    for v in SPEC.builds:
        b = pdf[pdf[S.VERSION] == v]
        d0 = b.loc[b[S.COHORT_DAY] == 0, S.ACTIVE].sum()
        for n in SPEC.days:
            dn = b.loc[b[S.COHORT_DAY] == n, S.ACTIVE].sum()
            expect = math.floor(100.0 * dn / d0 * 100 + 0.5) / 100   # scaled, half away (x > 0)
            assert abs(got[v][f"d{n}"] - expect) < 1e-9, (v, n)
