"""Fixture cells are built where their installs are dealt: no task's work grows with the input."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cohortlens import spec as S
from cohortlens.sources import fixture

ORDERS = 3000


def _tables(path) -> str:
    day = dt.datetime(2000, 1, 1)
    orders = {
        "o_orderkey": list(range(ORDERS)),
        "o_custkey": [None if i % 97 == 0 else i % 40 for i in range(ORDERS)],
        "o_orderdate": [None if i % 89 == 0 else day + dt.timedelta(days=i * 7 % 60) for i in range(ORDERS)],
        "o_orderpriority": [None if i % 83 == 0 else ("1-URGENT", "5-LOW")[i % 2] for i in range(ORDERS)],
    }
    keys = [*range(40), 7]   # one customer twice
    customer = {"c_custkey": keys, "c_nationkey": [k % 3 for k in keys], "c_mktsegment": [None if k == 5 else f"s{k % 4}" for k in keys]}
    nation = {"n_nationkey": [0, 1, 2], "n_name": ["A", "B", None]}
    for name, columns in (("orders", orders), ("customer", customer), ("nation", nation)):
        pq.write_table(pa.table(columns), f"{path}/{name}.parquet")
    return str(path)


def test_cells_are_dealt_by_cohort(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixture, "INSTALLS_PER_TASK", 100, raising=False)
    sf_dir = _tables(tmp_path)
    built, plain = fixture.fixture_tables(spark, sf_dir), fixture.fixture_frames(spark, sf_dir)
    for got, want in zip(built, plain, strict=True):
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    for path in fixture.fixture_paths(spark, sf_dir):
        cells = spark.read.parquet(path).withColumn("file", F.input_file_name())
        assert cells.select("file").distinct().count() >= 20
        files = cells.groupBy(*S.KEY5).agg(F.countDistinct("file").alias("n"))
        assert files.where("n > 1").count() == 0
        days = cells.groupBy("file").agg(F.countDistinct(S.INSTALL_DATE).alias("n"))
        assert days.agg(F.max("n")).first()[0] < 20


def test_exploded_rows_are_not_shuffled(spark, tmp_path):
    base, extract = fixture.installs(spark, _tables(tmp_path))
    for cells in fixture.cells_from(spark, str(tmp_path), fixture.dealt_by_cohort(base), extract):
        plan = cells._jdf.queryExecution().executedPlan().toString()
        dealt = plan[plan.index("Generate explode"):]
        assert "rangepartitioning" in dealt
        assert "hashpartitioning(d#" not in plan
