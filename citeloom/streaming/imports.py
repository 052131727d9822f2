"""Folder listings as a stream: each snapshot is reconciled with the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from citeloom.operators import catalogue
from citeloom.sources import tables

LISTING = "workspace_id string, item_no long, id string, name string, mimeType string, size string"
DOCUMENTS = (
    "document_id string, workspace_id string, file_name string, mime_type string, storage_key string, status string, "
    "page_count int, tags array<string>, fail_reason string"
)


def start_imports(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Apply every listing row (columns of :data:`LISTING`) that arrived since the last run to ``out/documents``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1  # version 0 is the table before the first batch
        log = tables.read_log(batch.sparkSession, f"{out}/documents", DOCUMENTS, before=version)
        documents = tables.newest_rows(log, "document_id")
        actions = catalogue.reconcile_import(catalogue.video_files(batch), documents)
        tables.write_version(actions, f"{out}/actions", version)
        queued = actions.filter("action <> 'skip'").select("document_id")
        changed = catalogue.apply_import(documents, actions).join(queued, "document_id", "left_semi")
        tables.write_version(changed, f"{out}/documents", version)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    return tables.newest_rows(tables.read_log(spark, f"{out}/documents", DOCUMENTS), "document_id")
