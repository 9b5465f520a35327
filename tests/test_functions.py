"""The numeric conventions agree with the SQL engine used as oracle."""

from __future__ import annotations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from cohortlens.functions import pct, ratio, round_scaled


def test_round_scaled_matches_sql_round_on_ratios(spark):
    rng = np.random.default_rng(5)
    n = rng.integers(1, 5000, 3000)
    k = (rng.random(3000) * n).astype(int)
    pairs = [(int(a), int(b)) for a, b in zip(k, n)] + [(57, 200), (1, 8), (285, 1000), (0, 3)]
    df = spark.createDataFrame(pairs, "k bigint, n bigint")
    got = df.select("k", "n", *[round_scaled(pct("k", "n"), p).alias(f"r{p}") for p in (0, 1, 2)],
                    round_scaled(ratio("k", "n"), 2).alias("q2")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k BIGINT, n BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", pairs)
    want = {(r[0], r[1]): r[2:] for r in con.execute(
        "SELECT k, n, ROUND(100.0 * CAST(k AS DOUBLE) / n, 0), ROUND(100.0 * CAST(k AS DOUBLE) / n, 1),"
        " ROUND(100.0 * CAST(k AS DOUBLE) / n, 2), ROUND(CAST(k AS DOUBLE) / n, 2) FROM t").fetchall()}
    mismatches = [r for r in got if (r["r0"], r["r1"], r["r2"], r["q2"]) != want[(r["k"], r["n"])]]
    assert mismatches == []


def test_zero_denominator_is_null(spark):
    row = spark.range(1).select(pct(F.lit(5), F.lit(0)).alias("p"),
                                ratio(F.lit(0), F.lit(0)).alias("r")).first()
    assert row["p"] is None and row["r"] is None
