"""Intermediate tables in the folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; only a local run without one gets a folder of its own."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="cohortlens-llm-")
    spark.sparkContext._conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, so lost
    executors cost no more than the tasks they ran.  Tables stay until the folder is cleared."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of at most 1,000 rows, so that a task holds few of them at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > 1000:
        spark.conf.set(key, "1000")
