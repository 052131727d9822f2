"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings a job needs whatever the cluster; sizes and counts stay with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "citeloom", cores: str | int = "*", memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench."""
    shuffle = str(os.cpu_count() or 8) if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", shuffle)
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return bool(re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """In a local session, use all cores on a table stored in fewer splits than there are cores; no shuffle on a cluster."""
    if not is_local(rows.sparkSession) or rows.rdd.getNumPartitions() >= rows.sparkSession.sparkContext.defaultParallelism:
        return rows
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, as in tests, gets a temporary folder of its own, which goes with the
    process; any other master must name one, as executors don't see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not is_local(spark):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="citeloom-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return _OWN["dir"]


def staged(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read back.

    For a table that several later steps read: it is computed once, its lineage ends
    at the files, and a lost executor re-reads them.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/staged/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
