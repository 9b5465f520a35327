"""Session helpers: a tuned local session for tests/bench, and the shared
folder used to materialise intermediate tables.

On a cluster the session is created by the caller; we only read
``spark.checkpoint.dir`` from it.  A private folder under the system temp
directory is set only when the setting is missing *and* the master is local
(tests, bench); on a cluster a missing setting is an error, because a
machine-local folder would not survive the loss of an executor.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "cohortlens") -> SparkSession:
    """A local session configured the way the library expects."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("COHORTLENS_DRIVER_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for materialised tables (``spark.checkpoint.dir``)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        try:
            path = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # not set anywhere
            path = None
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS...) before running on a cluster")
        app = sc.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
        path = _LOCAL_DIRS[app]
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")
