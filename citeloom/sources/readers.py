"""Readers of facility files, raw documents and folder listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import files
from citeloom.functions.text import strip

FACILITY_COLUMNS = [
    "id",
    "name",
    "prefecture",
    "city",
    "service_type",
    "address",
    "phone",
    "business_hours",
    "features",
    "last_updated",
    "source_url",
]
LISTING_SCHEMA = "id string, name string, mimeType string, size string, modifiedTime string, webViewLink string, trashed boolean"


def shape_facilities(rows: DataFrame) -> DataFrame:
    """Trim every cell, null being blank, and split ``features`` on ``|``, dropping blanks."""
    cells = rows.select(*[c for c in rows.columns if c not in FACILITY_COLUMNS], *[strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in FACILITY_COLUMNS])
    listed = F.filter(F.transform(F.split("features", r"\|"), strip), lambda x: x != "")
    return cells.withColumn("features", listed).withColumnRenamed("id", "facility_id")


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    """Facility CSV with a header; ``ordinal`` is the order in the file. Fails when empty."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    missing = [c for c in FACILITY_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"facility file lacks columns: {', '.join(missing)}")
    rows = shape_facilities(raw.select(F.monotonically_increasing_id().alias("ordinal"), *FACILITY_COLUMNS))
    if rows.isEmpty():
        raise ValueError(f"No facility records in CSV: {path}")
    return rows


def read_raw_documents(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """Catalogue rows with their bytes; drive-held videos carry empty bytes.

    ``path`` is the root the storage keys are relative to.
    """
    root = path.rstrip("/") + "/"
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # keys start at the root's own last folder name
    name = root.rstrip("/").rsplit("/", 1)[-1]
    key = F.regexp_extract(F.col("path"), rf"/{name}/(.+)$", 1)
    held = stored.select(F.try_url_decode(key).alias("storage_key"), "content")
    title_only = F.col("storage_key").startswith(files.DRIVE) & files.is_listed_video(F.col("file_name"), F.col("mime_type"))
    joined = documents.join(held, "storage_key", "left")
    return joined.withColumn("content", F.when(title_only, F.lit(b"")).otherwise(F.col("content")))


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Folder listing pages as JSON lines, without trashed files."""
    rows = spark.read.schema(LISTING_SCHEMA).json(path)
    return rows.filter(~F.coalesce("trashed", F.lit(False))).drop("trashed")
