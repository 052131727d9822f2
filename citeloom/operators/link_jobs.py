"""Folder requests and citation links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import links


def parse_folder_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their ``folder_id``, and the bad ones with their ``error``."""
    parsed = requests.withColumn("_p", links.folder_request(F.col("value")))
    good = parsed.filter("_p.error IS NULL").withColumn("folder_id", F.col("_p.folder_id")).drop("_p")
    bad = parsed.filter("_p.error IS NOT NULL").withColumn("error", F.col("_p.error")).drop("_p")
    return good, bad


def enrich_citation_links(cites: DataFrame, base_url: str) -> DataFrame:
    """Add every link column of a citation in one pass."""
    shown = F.col("anchored_url")
    return (
        cites.withColumn("source_url", links.source_url(F.col("storage_key"), base_url))
        .withColumn("page_no", links.page_no(F.col("ref")))
        .withColumn("anchored_url", links.anchored_url(F.col("source_url"), F.col("page_no")))
        .withColumn("seconds", links.seconds(F.col("ref")))
        .withColumn("is_drive", links.is_drive_url(shown))
        .withColumn("download_url", links.download_url(shown))
        .withColumn("is_video", links.is_video(F.col("mime_type"), F.col("ref_type")))
        .withColumn("open_url", links.timed_url(shown, F.col("seconds")))
        .withColumn("embed_url", links.embed_url(shown, F.col("seconds")))
    )
