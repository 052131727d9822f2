"""Incremental ingestion of documents that arrive in parts: recognised pages and paragraphs.

Parts of a document come in any order over any number of micro-batches, more than once too. Those
of unfinished documents are kept as a table with one version per batch; what a batch reads is the
version before and its own rows, never what is already ingested. A document is ingested when all
parts that it declares are there, or given up when the stream's time has moved on too far. A batch
repeated after a failure reads the same version and rewrites its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeloom.functions import text
from citeloom.operators import blocks, catalogue, chunking, embedding, triage
from citeloom.session import staged
from citeloom.sources import tables
from citeloom.streaming.ingest import CHUNKS

#: ``kind`` is page or paragraph, ``no`` its place, ``parts`` how many the document has (null: unknown), ``whole_ocr`` the recognised text of all of it.
PARTS = (
    "workspace_id string, document_id string, kind string, no int, parts int, raw_text string, ocr_text string, "
    "style string, whole_ocr string, arrived timestamp"
)
RUNS = (
    "document_id string, status string, reason string, tags array<string>, page_count int, extracted_pages int, "
    "failed_pages array<struct<page:int,reason:string>>, failed_pages_count int, ocr_used_pages array<int>, chunk_count int, "
    "started_at timestamp, finished_at timestamp, log map<string,string>"
)
NO_CHUNKS = "No chunks generated from extracted text"
_KEYS = ["document_id", "kind", "no"]


def _distinct_parts(rows: DataFrame) -> DataFrame:
    """The part that arrived last of each number; equally late ones are told apart by content, so that a repeated batch decides alike."""
    known = rows.filter(F.col("document_id").isNotNull() & F.col("no").isNotNull())
    rest = [c for c in known.columns if c not in _KEYS]
    order = F.struct("arrived", F.xxhash64(*[c for c in rest if c != "arrived"]))
    return known.groupBy(*_KEYS).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*_KEYS, "_r.*")


def settle(parts: DataFrame, patience: int) -> DataFrame:
    """One row per document: parts there and declared, first and last arrival, and whether it is ``complete`` or ``over``.

    A document is over ``patience`` seconds after its last part, by the time of the parts themselves;
    one that declares no number is then taken as it is.
    """
    clock = parts.agg(F.max("arrived").alias("clock"))
    docs = parts.groupBy("document_id").agg(
        F.min("workspace_id").alias("workspace_id"), F.min("kind").alias("kind"), F.count("*").cast("int").alias("got"), F.max("parts").alias("wanted"),
        F.min("arrived").alias("started_at"), F.max("arrived").alias("last"), F.max("whole_ocr").alias("doc_ocr_text"),
    )
    docs = docs.crossJoin(F.broadcast(clock))  # one row
    over = F.coalesce(F.unix_timestamp("clock") - F.unix_timestamp("last") > patience, F.lit(False))
    complete = F.coalesce(F.col("got") >= F.col("wanted"), over)
    return docs.withColumn("over", over).withColumn("complete", complete)


def _blocks(parts: DataFrame, triaged: DataFrame, report: DataFrame) -> DataFrame:
    of = ["document_id", F.col("block_no").cast("long").alias("block_no"), "text", "page", "section_title"]
    paragraphs = parts.filter("kind = 'paragraph'").select("document_id", F.col("no").alias("ordinal"), "style", F.col("raw_text").alias("text"))
    headed = blocks.paragraph_blocks(paragraphs).withColumn("block_no", F.col("ordinal")).withColumn("page", F.lit(None).cast("int"))
    return triage.page_blocks(triaged, report).select(*of).unionByName(headed.select(*of))


def _run_rows(ended: DataFrame, report: DataFrame, stored: DataFrame) -> DataFrame:
    """A whole run record for every document that came to its end."""
    counts = stored.groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_count"))
    marks = embedding.embed_fallback_tag(stored).withColumnRenamed("tags", "embed_tags")
    read = report.select("document_id", "page_count", "extracted_pages", "failed_pages", "ocr_used_pages", F.col("tags").alias("page_tags"))
    rows = ended.join(read, "document_id", "left").join(counts, "document_id", "left").join(marks, "document_id", "left")
    chunks = F.coalesce("chunk_count", F.lit(0))
    reason = (
        F.when(~F.col("complete"), F.concat(F.col("got").cast("string"), F.lit(" of "), F.col("wanted").cast("string"), F.lit(" parts arrived")))
        .when(chunks == 0, NO_CHUNKS)
    )
    rows = rows.withColumn("reason", reason).withColumn("chunk_count", chunks)
    ready = F.col("reason").isNull()
    empty = lambda kind: F.array().cast(kind)
    tags = text.merge_tags(F.col("page_tags"), F.col("embed_tags"))
    rows = rows.select(
        "document_id", F.when(ready, "ready").otherwise("failed").alias("status"), "reason", tags.alias("tags"),
        "page_count", F.coalesce("extracted_pages", ready.cast("int")).alias("extracted_pages"),
        F.coalesce("failed_pages", empty("array<struct<page:int,reason:string>>")).alias("failed_pages"),
        F.coalesce("ocr_used_pages", empty("array<int>")).alias("ocr_used_pages"), "chunk_count", "started_at", F.col("clock").alias("finished_at"),
    )
    entry = F.create_map(
        F.lit("stage"), F.when(ready, "completed").otherwise("failed"),
        F.lit("message"), F.when(ready, "ingestion finished"),
        F.lit("reason"), F.col("reason"),
        F.lit("chunk_count"), F.when(ready, F.col("chunk_count").cast("string")),
        F.lit("tags"), F.array_join("tags", ","),
    )
    log = F.map_filter(entry, lambda _, v: v.isNotNull())
    return rows.withColumn("failed_pages_count", F.size("failed_pages")).withColumn("log", log)


def start_parts(
    stream: DataFrame, out: str, checkpoint: str, provider: embedding.Provider | None = None, dim: int = 64, size: int = 4200,
    overlap: int = 500, patience: int = 3600,
) -> StreamingQuery:
    """Ingest the documents whose parts (columns of :data:`PARTS`) have arrived since the last run.

    Writes versions of three tables below ``out``: ``pending`` (parts of unfinished documents),
    ``chunks``, then ``runs``; chunks count once their run is there. Parts without document or
    number are left out. A document that comes again after its end starts anew.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*spark.createDataFrame([], PARTS).columns)
        if batch_id:
            rows = rows.unionByName(tables.read_version(spark, f"{out}/pending", PARTS, batch_id - 1))
        parts = staged(_distinct_parts(rows))
        docs = staged(settle(parts, patience))
        ended = docs.filter("complete or over")
        pending = parts.join(ended.select("document_id"), "document_id", "left_anti")
        tables.write_version(pending.select(*rows.columns), f"{out}/pending", batch_id)

        whole = docs.filter("complete").select("document_id", "workspace_id", "doc_ocr_text")
        here = parts.join(whole.select("document_id"), "document_id", "left_semi")
        pages = here.filter("kind = 'page'").select("document_id", F.col("no").alias("page"), "raw_text", "ocr_text")
        triaged = staged(triage.triage_pages(pages))
        report = staged(triage.parse_report(triaged, whole))
        units = chunking.build_units(_blocks(here, triaged, report).join(whole.select("document_id", "workspace_id"), "document_id"), size)
        embedded = embedding.embed_chunks(chunking.build_chunks(units, size, overlap), provider, dim)
        tables.write_version(embedded, f"{out}/chunks", batch_id)
        stored = tables.read_version(spark, f"{out}/chunks", CHUNKS, batch_id)
        tables.write_version(_run_rows(ended, report, stored), f"{out}/runs", batch_id)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_runs(spark: SparkSession, out: str) -> DataFrame:
    """All run records, with the version (batch) that wrote them."""
    return tables.read_log(spark, f"{out}/runs", RUNS)


def read_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The searchable chunks after all ingested batches."""
    return tables.current_chunks(tables.read_log(spark, f"{out}/chunks", CHUNKS), read_runs(spark, out))


def read_documents(spark: SparkSession, out: str, documents: DataFrame) -> DataFrame:
    """The ``documents`` table as the newest run of each document leaves it."""
    newest = staged(tables.newest_rows(read_runs(spark, out), "document_id"))
    done = catalogue.apply_success(documents, newest.filter("status = 'ready'"))[0]
    error: Column = F.col("reason").alias("message")
    failed = newest.filter("status = 'failed'").select("document_id", F.lit("ingest").alias("kind"), error, "tags", "extracted_pages", "failed_pages", "ocr_used_pages", "finished_at")
    return catalogue.apply_failure(done, failed)[0]
