"""Parquet tables written as logs: every batch adds one version, the newest row of a key counts.

A batch costs what it brings, not what the table holds, and a batch repeated after
a failure rewrites its own version.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "version"


def replace_by_document(existing: DataFrame, new: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """``existing`` without the chunks of re-ingested documents, plus the new ones.

    ``done(document_id)`` names the re-ingested documents when some produce no chunk.
    """
    touched = (new if done is None else done).select("document_id").distinct()
    return existing.join(touched, "document_id", "left_anti").unionByName(new, allowMissingColumns=True)


def append_runs(runs: DataFrame, path: str) -> None:
    """Add run rows, one per attempt."""
    runs.write.mode("append").parquet(path)


def write_version(rows: DataFrame, path: str, version: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{VERSION}={version:012d}")


def read_log(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """All versions of a table, or those before one; no rows while nothing is written."""
    full = f"{schema}, {VERSION} bigint"
    try:
        rows = spark.read.schema(full).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # anything else is not an empty table
            raise
        return spark.createDataFrame([], full)
    return rows if before is None else rows.filter(F.col(VERSION) < before)


def read_version(spark: SparkSession, path: str, schema: str, version: int) -> DataFrame:
    """The rows of one version alone."""
    return spark.read.schema(schema).parquet(f"{path}/{VERSION}={version:012d}")


def newest_rows(log: DataFrame, key: str) -> DataFrame:
    """The newest version of each key's row."""
    columns = [c for c in log.columns if c != VERSION]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*columns), VERSION).alias("_row"))
    return newest.select("_row.*")


def current_chunks(chunks: DataFrame, runs: DataFrame) -> DataFrame:
    """Chunks of each document's newest successful run (``runs(document_id, status, version)``)."""
    newest = runs.filter("status = 'ready'").groupBy("document_id").agg(F.max(VERSION).alias(VERSION))
    return chunks.join(newest, ["document_id", VERSION], "left_semi").drop(VERSION)


#: Folders of a full-text table.
BUCKETS = 256


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def read_postings(spark: SparkSession, path: str, terms: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The folders of a full-text table that hold some of ``terms(term)``: the others are not listed."""
    wanted = [r["bucket"] for r in terms.select(_bucket(buckets).alias("bucket")).distinct().collect()]  # at most as many as there are folders
    return spark.read.parquet(path).filter(F.col("bucket").isin(wanted)).drop("bucket")


def write_postings(postings: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Full-text table clustered by term: each term sits in one bucket folder, in one sorted file per task.

    Postings, several times the texts they come from, are written where they are made: nothing is exchanged.
    """
    rows = postings.withColumn("bucket", _bucket(buckets)).sortWithinPartitions("bucket", "term", "chunk_id")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)
