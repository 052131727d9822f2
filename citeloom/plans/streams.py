"""Registered queries: the streaming forms, each equal to its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citeloom.functions import files
from citeloom.plans import facility_search, ingest, operations
from citeloom.plans.views import CHUNK_OVERLAP, CHUNK_SIZE, oracle, table, view
from citeloom.session import shared_dir
from citeloom.sources import tables
from citeloom.streaming import conversation as conversation_stream
from citeloom.streaming import imports as import_stream
from citeloom.streaming import ingest as ingest_stream
from citeloom.streaming import parts as parts_stream

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _stream(spark, sf, name):
    """A given table as a file stream."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _fresh(spark):
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


@query
def stream_ingest(spark, sf):
    """Documents arriving as files, ingested to searchable chunks."""
    docs = view(spark, sf, "docs", documents=_stream(spark, sf, "documents"))
    raw = docs.select(
        "workspace_id", "document_id", F.concat("document_id", F.lit(".txt")).alias("file_name"),
        F.lit("text/plain").alias("mime_type"), F.encode("text", "UTF-8").alias("content"),
    )
    out = _fresh(spark)
    ingest_stream.start_ingest(raw, out, f"{out}/checkpoint", dim=8, size=CHUNK_SIZE, overlap=CHUNK_OVERLAP).awaitTermination()
    return ingest_stream.read_chunks(spark, out).select(ingest._CHUNK_COLUMNS)


ORACLES["stream_ingest"] = ingest.ORACLES["chunk_documents"]


@query
def stream_runs(spark, sf):
    """Run records of uploads that arrive over several micro-batches: files of unknown type fail, every seventh document comes twice."""
    docs = view(spark, sf, "docs")
    known = F.col("doc_id") % 5 != 4
    rows = docs.select(
        "doc_id", "workspace_id", "document_id", F.concat("document_id", F.when(known, ".txt").otherwise(".xyz")).alias("file_name"),
        F.when(known, "text/plain").otherwise("").alias("mime_type"), F.encode("text", "UTF-8").alias("content"), F.lit(2).alias("arrived"),
    )
    older = rows.filter("doc_id % 7 = 0").withColumn("content", F.encode(F.lit("first version"), "UTF-8")).withColumn("arrived", F.lit(1))
    out = _fresh(spark)
    # both uploads of a document lie in one file
    rows.unionByName(older).drop("doc_id").repartition(6, "document_id").write.parquet(f"{out}/arriving")
    schema = f"{ingest_stream.RAW_SCHEMA}, arrived int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/arriving")
    ingest_stream.start_ingest(stream, out, f"{out}/checkpoint", dim=8, size=CHUNK_SIZE, overlap=CHUNK_OVERLAP).awaitTermination()
    runs = tables.read_log(spark, f"{out}/runs", ingest_stream.RUNS)
    return runs.select("document_id", "status", "reason", F.array_join("tags", ",").alias("tags"), "extracted_pages", "chunk_count")


_OTHER, _OTHER_TAGS = files.UNSUPPORTED["other"]
ORACLES["stream_runs"] = oracle(f"""
    SELECT document_id, 'ready' AS status, NULL AS reason, 'EMBED_FALLBACK' AS tags, 1 AS extracted_pages, CAST(n AS INT) AS chunk_count
    FROM docs JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY document_id) USING (document_id) WHERE doc_id % 5 <> 4
    UNION ALL SELECT document_id, 'failed', '{_OTHER}', '{",".join(_OTHER_TAGS)}', 0, 0 FROM docs WHERE doc_id % 5 = 4
    UNION ALL SELECT document_id, 'superseded', '{ingest_stream.SUPERSEDED}', '', 0, 0 FROM docs WHERE doc_id % 7 = 0""")


def _arriving_parts(spark, sf, out, lost):
    """Scanned pages and paragraphs of documents as a stream of parts: those of a document spread over files, every sixth twice.

    With ``lost``, every ninth document misses its first page; a day later one more document comes.
    """
    at = lambda day: F.timestamp_seconds(F.lit(1_700_000_000 + day * 86_400) + F.col("no"))
    count = lambda rows, key: rows.join(rows.groupBy(key).agg(F.count("*").cast("int").alias("parts")), key)
    none = F.lit(None).cast("string")
    pages = count(view(spark, sf, "scans"), "document_id").join(view(spark, sf, "scan_ocr"), "document_id").select(
        F.lit("ws0").alias("workspace_id"), "document_id", F.lit("page").alias("kind"), F.col("page").alias("no"), "parts", "raw_text", "ocr_text",
        none.alias("style"), F.col("doc_ocr_text").alias("whole_ocr"),
    )
    paragraphs = count(view(spark, sf, "paragraphs"), "document_id").select(
        F.lit("ws0").alias("workspace_id"), F.concat(F.lit("p"), "document_id").alias("document_id"), F.lit("paragraph").alias("kind"),
        F.col("ordinal").alias("no"), "parts", F.col("text").alias("raw_text"), none.alias("ocr_text"), "style", none.alias("whole_ocr"),
    )
    rows = pages.unionByName(paragraphs).withColumn("arrived", at(0))
    if lost:
        rows = rows.filter(~((F.col("kind") == "page") & (F.col("no") == 1) & (F.col("document_id").cast("long") % 9 == 4)))
    older = rows.filter("no % 6 = 2").withColumn("arrived", at(-1)).withColumn("raw_text", F.lit("superseded"))
    rows.unionByName(older).repartition(6, "document_id", "no").write.parquet(f"{out}/arriving")
    if lost:
        late = rows.filter("kind = 'paragraph'").orderBy("document_id", "no").limit(1).withColumn("document_id", F.lit("late")).withColumn("parts", F.lit(1))
        late.withColumn("arrived", at(1)).withColumn("style", F.lit("Normal")).coalesce(1).write.mode("append").parquet(f"{out}/arriving")
    stream = spark.readStream.schema(parts_stream.PARTS).option("maxFilesPerTrigger", 2).parquet(f"{out}/arriving")
    parts_stream.start_parts(stream, out, f"{out}/checkpoint", dim=8, size=300, overlap=40).awaitTermination()


@query
def stream_pages(spark, sf):
    """Chunks of scanned documents whose pages arrive over several micro-batches."""
    out = _fresh(spark)
    _arriving_parts(spark, sf, out, lost=False)
    chunks = parts_stream.read_chunks(spark, out).filter("page_start is not null or section_title = 'Document OCR'")
    return chunks.select("document_id", "chunk_index", "text", "page_start", "page_end", "section_title")


ORACLES["stream_pages"] = ingest.ORACLES["chunk_scans"]


@query
def stream_page_runs(spark, sf):
    """Run records of documents that arrive in pages and paragraphs; those that miss one are given up."""
    out = _fresh(spark)
    _arriving_parts(spark, sf, out, lost=True)
    runs = parts_stream.read_runs(spark, out)
    failed = F.array_join(F.transform("failed_pages", lambda p: F.concat_ws("=", p["page"], p["reason"])), ",")
    return runs.select(
        "document_id", "status", "reason", F.array_join("tags", ",").alias("tags"), "page_count", "extracted_pages", failed.alias("failed_pages"),
        F.array_join(F.col("ocr_used_pages").cast("array<string>"), ",").alias("ocr_used_pages"), F.col("log")["stage"].alias("stage"),
        F.date_format("started_at", "yyyy-MM-dd").alias("started"),
    )


_LOST = "EXISTS (SELECT 1 FROM scans s WHERE s.document_id = r.document_id AND s.page = 1) AND CAST(document_id AS BIGINT) % 9 = 4"
ORACLES["stream_page_runs"] = oracle(
    f"""
    SELECT document_id, CASE WHEN lost AND page_count > 1 THEN 'failed' WHEN chunked THEN 'ready' ELSE 'failed' END AS status,
           CASE WHEN lost AND page_count > 1 THEN (page_count - 1) || ' of ' || page_count || ' parts arrived' WHEN NOT chunked THEN '{parts_stream.NO_CHUNKS}' END AS reason,
           CASE WHEN lost AND page_count > 1 THEN '' ELSE array_to_string(list_sort(list_filter(list_concat([CASE WHEN chunked THEN 'EMBED_FALLBACK' END], string_split(tags, ',')), lambda x: x <> '')), ',') END AS tags,
           CASE WHEN NOT lost THEN page_count END AS page_count, CASE WHEN lost THEN 0 ELSE extracted_pages END AS extracted_pages,
           CASE WHEN lost THEN '' ELSE failed_pages END AS failed_pages, CASE WHEN lost THEN '' ELSE ocr_used_pages END AS ocr_used_pages,
           CASE WHEN lost OR NOT chunked THEN 'failed' ELSE 'completed' END AS stage, first AS started
    FROM (SELECT r.*, {_LOST} AS lost, document_id IN (SELECT document_id FROM scan_units) AS chunked,
                 CASE WHEN {_LOST} AND r.page_count = 1 THEN NULL ELSE '2023-11-14' END AS first FROM reported r)
    WHERE first IS NOT NULL
    UNION ALL
    SELECT 'p' || document_id, CASE WHEN n > 0 THEN 'ready' ELSE 'failed' END, CASE WHEN n = 0 THEN '{parts_stream.NO_CHUNKS}' END,
           CASE WHEN n > 0 THEN 'EMBED_FALLBACK' ELSE '' END, NULL, CAST(n > 0 AS INT), '', '', CASE WHEN n > 0 THEN 'completed' ELSE 'failed' END, '2023-11-14'
    FROM (SELECT document_id, count(*) FILTER (lower(coalesce(style, '')) NOT LIKE 'heading%' AND trim(text) <> '') AS n FROM paragraphs GROUP BY document_id)
    UNION ALL SELECT 'late', 'ready', NULL, 'EMBED_FALLBACK', NULL, 1, '', '', 'completed', '2023-11-15'""",
    **ingest._SCAN_VIEWS,
)


@query
def stream_conversation(spark, sf):
    """Turns arriving as files, resolved with state per conversation and answered."""
    facilities = facility_search.facility_table(spark, sf)
    turns = view(spark, sf, "turns", events=_stream(spark, sf, "events")).select("conv_id", "turn", "query_text")
    out = _fresh(spark)
    conversation_stream.start_prepare(turns, facilities, f"{out}/prepared", f"{out}/checkpoint1").awaitTermination()
    conversation_stream.start_resolve(spark, f"{out}/prepared", facilities, f"{out}/answers", f"{out}/checkpoint2").awaitTermination()
    return spark.read.parquet(f"{out}/answers").select("conv_id", "turn", "outcome", "answer")


ORACLES["stream_conversation"] = facility_search.ORACLES["converse"]


@query
def stream_imports(spark, sf):
    """Listings arriving as files, reconciled with the documents table."""
    out = _fresh(spark)
    tables.write_version(operations.drive_documents_table(spark, sf), f"{out}/documents", 0)
    listing = view(spark, sf, "listing", part=_stream(spark, sf, "part")).drop("trashed")
    import_stream.start_imports(listing, out, f"{out}/checkpoint").awaitTermination()
    after = import_stream.read_documents(spark, out)
    return after.groupBy("workspace_id", "status").agg(F.count("*").alias("documents"), F.count("fail_reason").alias("reasons"))


ORACLES["stream_imports"] = operations.ORACLES["apply_import"]
