"""Spark session helpers.

The library never creates hidden sessions inside operators; callers pass a
``SparkSession``. ``build_session`` exists for tests, the bench and scripts.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session used with the library should carry. They are
# correctness settings (time zone, the last of repeated JSON keys counts) or scale settings (AQE re-planning, skew
# splitting) and are safe on a 1000-executor cluster as well as local mode.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "mailflow", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's base configuration."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (SparkSession.builder
               .master(master or f"local[{cpus}]")
               .appName(app_name)
               .config("spark.driver.memory", "16g")
               .config("spark.sql.shuffle.partitions",
                       str(shuffle_partitions or int(cpus))))
    conf = {**BASE_CONF, **(extra or {})}
    if "spark.checkpoint.dir" not in conf and not _active_checkpoint_dir():
        conf["spark.checkpoint.dir"] = _local_folder(master or f"local[{cpus}]")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator of the cluster sets it to shared storage and we
    only read it. When it is unset (local tests), a private scratch folder is
    created and registered; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        path = _local_folder(sc.master)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def _local_folder(master: str) -> str:
    """A private folder for local runs; executors elsewhere would not see it."""
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    return tempfile.mkdtemp(prefix="mailflow-ckpt-")


def _active_checkpoint_dir() -> str | None:
    active = SparkSession.getActiveSession()
    if active is None:
        return None
    sc = active.sparkContext
    return sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A location under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
