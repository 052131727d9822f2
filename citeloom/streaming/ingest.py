"""Incremental ingestion: raw files in, chunks, runs and documents out.

Each micro-batch runs the batch operators and writes one version of each table, named
by its batch id; a batch repeated after a lost executor or driver rewrites that version.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeloom.functions import files, text
from citeloom.operators import blocks, chunking, decoding, embedding
from citeloom.sources import tables

RAW_SCHEMA = "workspace_id string, document_id string, file_name string, mime_type string, content binary"
CHUNKS = (
    "chunk_id string, workspace_id string, document_id string, chunk_index int, text string, page_start int, "
    "page_end int, section_title string, snippet string, embedding array<float>"
)
RUNS = (
    "document_id string, status string, reason string, tags array<string>, extracted_pages int, chunk_count int"
)


SUPERSEDED = "a later upload of the document came with it"
#: Order of uploads, where the stream brings one; a file stream without it is ordered by its files' times.
ARRIVED = "arrived"


def newest_uploads(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of several uploads of a document the newest, and the others.

    Uploads of one time are told apart by their bytes, so that a repeated batch decides alike.
    """
    order = [F.col(ARRIVED).desc_nulls_last(), F.xxhash64("content").desc(), F.col("file_name").desc_nulls_last()]
    ranked = raw.withColumn("_rank", F.row_number().over(Window.partitionBy("document_id").orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank", ARRIVED), ranked.filter("_rank > 1").drop("_rank", ARRIVED)


def _decoded(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    routed = decoding.route_corpus(raw)
    return routed, decoding.decode_corpus(routed.filter("route = 'text'"))


def embedded_chunks(
    raw: DataFrame, provider: embedding.Provider | None = None, dim: int = 64, size: int = 4200, overlap: int = 500
) -> DataFrame:
    """Chunks with vectors of all raw documents that can be read."""
    _, decoded = _decoded(raw)
    is_markdown = F.lower(files.suffix(F.col("file_name"))) == ".md"
    packed = chunking.chunk_documents(decoded.withColumn("_md", is_markdown), size, overlap, F.col("_md"))
    videos = blocks.video_blocks(raw).join(raw.select("document_id", "workspace_id"), "document_id")
    titles = chunking.build_units(
        videos.select("workspace_id", "document_id", F.lit(0).alias("block_no"), "text", F.lit(None).cast("int").alias("page"), "section_title"),
        size,
    )
    chunks = packed.unionByName(chunking.build_chunks(titles, size, overlap))
    return embedding.embed_chunks(chunks, provider, dim)


def outcomes(raw: DataFrame, embedded: DataFrame) -> DataFrame:
    """One row per raw document: what became of it; a bad document fails alone."""
    routed, decoded = _decoded(raw)
    counts = embedded.groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_count"))
    marks = embedding.embed_fallback_tag(embedded).withColumnRenamed("tags", "embed_tags")
    read = decoded.select("document_id", "decode_tags")
    outcome = routed.drop("content").join(read, "document_id", "left").join(counts, "document_id", "left")
    outcome = outcome.join(marks, "document_id", "left")
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("route").isin("pdf", "docx"), F.lit("binary pages are read from page tables"))
        .when(F.col("chunk_count").isNull() & (F.col("route") == "text"), F.lit("Text document is empty"))
    )
    video = F.when(F.col("route") == "video", files.video_tags())
    tags = text.merge_tags(F.col("route_tags"), F.col("decode_tags"), F.col("embed_tags"), video)
    return outcome.withColumn("reason", reason).select(
        "document_id",
        F.when(F.col("reason").isNull(), "ready").otherwise("failed").alias("status"),
        "reason",
        tags.alias("tags"),
        F.when(F.col("reason").isNull(), 1).otherwise(0).alias("extracted_pages"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
    )


def superseded(raw: DataFrame) -> DataFrame:
    """Outcome rows of uploads that a later one of the same batch replaces."""
    none = F.lit(0)
    return raw.select(
        "document_id", F.lit("superseded").alias("status"), F.lit(SUPERSEDED).alias("reason"),
        F.array().cast("array<string>").alias("tags"), none.alias("extracted_pages"), none.alias("chunk_count"),
    )


def ingest_documents(raw: DataFrame, provider: embedding.Provider | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Chunks and one outcome row per raw document."""
    embedded = embedded_chunks(raw, provider, **options)
    return embedded, outcomes(raw, embedded)


def start_ingest(
    stream: DataFrame, out: str, checkpoint: str, provider: embedding.Provider | None = None, **options
) -> StreamingQuery:
    """Ingest all raw rows (columns of :data:`RAW_SCHEMA`, and ``arrived`` if there is an order) that arrived since the last run.

    Chunks are written first and read back for the outcomes, so each goes to the provider once and
    tags agree with the vectors stored; a document counts only once its chunks are there.
    """
    if ARRIVED not in stream.columns:
        try:
            stream = stream.withColumn(ARRIVED, F.col("_metadata.file_modification_time"))
        except AnalysisException:  # not a stream of files
            stream = stream.withColumn(ARRIVED, F.lit(None).cast("timestamp"))

    def run(batch: DataFrame, batch_id: int) -> None:
        newest, older = newest_uploads(batch)
        tables.write_version(embedded_chunks(newest, provider, **options), f"{out}/chunks", batch_id)
        stored = tables.read_version(batch.sparkSession, f"{out}/chunks", CHUNKS, batch_id)
        tables.write_version(outcomes(newest, stored).unionByName(superseded(older)), f"{out}/runs", batch_id)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The searchable chunks after all ingested batches."""
    chunks = tables.read_log(spark, f"{out}/chunks", CHUNKS)
    return tables.current_chunks(chunks, tables.read_log(spark, f"{out}/runs", RUNS))
