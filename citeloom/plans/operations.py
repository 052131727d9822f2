"""Registered queries: sources, sinks and catalogue work."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citeloom.operators import catalogue
from citeloom.plans.ingest import corpus_chunks, joined
from citeloom.plans.views import oracle, table, view
from citeloom.session import shared_dir
from citeloom.sources import readers, tables

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark, sf):
    rows = view(spark, sf, "docs").drop("text", "lang", "doc_id", "size")
    return rows.withColumn("tags", F.array("tag")).drop("tag")


def drive_documents_table(spark, sf):
    return view(spark, sf, "drive_docs").withColumn("tags", F.array("tag")).drop("tag")


def all_tables(spark, sf):
    """Catalogue, runs (as table keyed by document) and chunk keys."""
    docs = documents(spark, sf)
    chunks = corpus_chunks(spark, sf).select("chunk_id", "document_id")
    runs = view(spark, sf, "runs").select("run_id", "document_id")
    return {"workspaces": view(spark, sf, "workspaces"), "documents": docs, "runs": runs, "chunks": chunks}


def _sizes(left, purge):
    """Rows left in each table and keys to purge, as one small table."""
    parts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in left.items()]
    parts.append(purge.agg(F.count("*").alias("rows")).select(F.lit("purge"), "rows"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _sizes_sql(gone: str, workspaces_gone: str = "false") -> str:
    return oracle(
        f"""
        SELECT 'workspaces' AS "table", count(*) AS rows FROM workspaces WHERE NOT ({workspaces_gone})
        UNION ALL SELECT 'documents', count(*) FROM docs WHERE NOT ({gone})
        UNION ALL SELECT 'runs', count(*) FROM runs WHERE document_id NOT IN (SELECT document_id FROM docs WHERE {gone})
        UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE document_id NOT IN (SELECT document_id FROM docs WHERE {gone})
        UNION ALL SELECT 'purge', count(*) FROM docs WHERE ({gone}) AND storage_key NOT LIKE 'drive://%'"""
    )


# -- sources -----------------------------------------------------------------


@query
def shape_facilities(spark, sf):
    """The facility reader's cleaning over the facility view."""
    raw = view(spark, sf, "facilities").select(
        "ordinal", F.concat(F.lit("  "), "facility_id").alias("id"), F.concat("name", F.lit("\t")).alias("name"), "prefecture", "city",
        "service_type", "address", "phone", "business_hours", F.col("raw_features").alias("features"), "last_updated", "source_url",
    )
    return readers.shape_facilities(raw).withColumn("features", F.array_join("features", "|"))


_FEATURES = "array_to_string(list_filter(list_transform(string_split(raw_features, '|'), lambda x: trim(x)), lambda x: x <> ''), '{0}')"
ORACLES["shape_facilities"] = oracle(f"SELECT * EXCLUDE (raw_features), {_FEATURES.format('|')} AS features FROM facilities")


@query
def listing(spark, sf):
    """Listing pages written as JSON lines and read without trashed files."""
    path = f"{shared_dir(spark)}/listings/{uuid.uuid4().hex}"
    view(spark, sf, "listing").select("id", "name", "mimeType", "size", "trashed").write.json(path)
    return readers.read_listing(spark, path).select("id", "name", "mimeType", "size")


ORACLES["listing"] = oracle("SELECT id, name, mimeType, size FROM listing WHERE NOT trashed")


@query
def replace_by_document(spark, sf):
    """Chunks of ready documents replaced by one-chunk versions."""
    old = corpus_chunks(spark, sf).select("chunk_id", "document_id", F.length("text").cast("bigint").alias("chars"))
    new = view(spark, sf, "docs").filter("status = 'ready'").select(
        F.concat("document_id", F.lit(":new")).alias("chunk_id"), "document_id", F.length("text").cast("bigint").alias("chars")
    )
    return tables.replace_by_document(old, new)


ORACLES["replace_by_document"] = oracle("""
    SELECT chunk_id, document_id, length(text) AS chars FROM chunks WHERE document_id NOT IN (SELECT document_id FROM docs WHERE status = 'ready')
    UNION ALL SELECT document_id || ':new', document_id, length(text) FROM docs WHERE status = 'ready'""")


@query
def append_runs(spark, sf):
    """Run rows as the sink stores them, with their ends."""
    docs = documents(spark, sf)
    done, failed = catalogue.apply_success(docs, _reports(spark, sf))[1], catalogue.apply_failure(docs, _errors(spark, sf))[1]
    both = done.select("document_id", "chunk_count", F.col("log")["stage"].alias("stage")).unionByName(
        failed.select("document_id", "chunk_count", F.col("log")["stage"].alias("stage"))
    )
    path = f"{shared_dir(spark)}/runs/{uuid.uuid4().hex}"
    for stage in ("completed", "failed"):  # two attempts to add to the table
        tables.append_runs(both.filter(F.col("stage") == stage), path)
    return spark.read.schema(both.schema).parquet(path)


ORACLES["append_runs"] = oracle("""
    SELECT document_id, CAST(1 AS INT) AS chunk_count, 'completed' AS stage FROM docs WHERE status = 'processing'
    UNION ALL SELECT document_id, 0, 'failed' FROM docs WHERE status = 'failed'""")


@query
def inventory_lines(spark, sf):
    return catalogue.inventory_lines(view(spark, sf, "workspaces"), documents(spark, sf))


ORACLES["inventory_lines"] = oracle("""
    SELECT workspace_id, '' AS document_id, 0 AS line_no, 'Workspace: ' || name || ' (' || workspace_id || ')' AS line FROM workspaces
    UNION ALL SELECT workspace_id, '', 1, '  No documents.' FROM workspaces WHERE workspace_id NOT IN (SELECT workspace_id FROM docs)
    UNION ALL SELECT workspace_id, document_id, 0, '  Doc: ' || file_name || ' (ID: ' || document_id || ')' FROM docs
    UNION ALL SELECT workspace_id, document_id, 1, '    Status: ' || status || ', Mime: ' || coalesce(mime_type, 'None') FROM docs
    UNION ALL SELECT workspace_id, document_id, 2, '    Fail Reason: ' || fail_reason FROM docs WHERE fail_reason <> ''""")


# -- workspaces --------------------------------------------------------------


@query
def list_workspaces(spark, sf):
    return catalogue.list_workspaces(view(spark, sf, "workspaces"))


ORACLES["list_workspaces"] = oracle("SELECT * FROM workspaces ORDER BY created_at DESC, workspace_id")


@query
def default_workspace(spark, sf):
    return catalogue.default_workspace(view(spark, sf, "workspaces"))


ORACLES["default_workspace"] = oracle("SELECT * FROM workspaces ORDER BY created_at, workspace_id LIMIT 1")


@query
def create_workspaces(spark, sf):
    """Conversation turns as requested names: trimmed, empty or too long."""
    name = F.when(F.col("turn") % 4 == 0, F.lit(" 　 ")).otherwise(F.concat(F.lit("　 "), "text"))
    accepted, rejected = catalogue.create_workspaces(table(spark, sf, "conversations").select("conv_id", "turn", name.alias("name")))
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected)


ORACLES["create_workspaces"] = """
    SELECT conv_id, turn, CASE WHEN reason IS NULL THEN trim(name, ' 　\n') ELSE name END AS name, reason
    FROM (SELECT *, CASE WHEN length(name) > 255 THEN 'name is too long' WHEN trim(name, ' 　\n') = '' THEN 'name is required' END AS reason
          FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN ' 　 ' ELSE '　 ' || text END AS name FROM conversations))"""


@query
def delete_workspaces(spark, sf):
    """One workspace and everything below it."""
    ids = view(spark, sf, "workspaces").filter("workspace_id = 'ws1'")
    return _sizes(*catalogue.delete_workspaces(all_tables(spark, sf), ids))


ORACLES["delete_workspaces"] = _sizes_sql("workspace_id = 'ws1'", "workspace_id = 'ws1'")


# -- documents ---------------------------------------------------------------


@query
def list_documents(spark, sf):
    out = catalogue.list_documents(documents(spark, sf), view(spark, sf, "workspaces"))
    return out.select("workspace_id", "document_id", "created_at")


ORACLES["list_documents"] = oracle("SELECT workspace_id, document_id, created_at FROM docs ORDER BY workspace_id, created_at DESC, document_id")


@query
def docs_by_update(spark, sf):
    return catalogue.docs_by_update(documents(spark, sf)).select("workspace_id", "document_id", "updated_at")


ORACLES["docs_by_update"] = oracle("SELECT workspace_id, document_id, updated_at FROM docs ORDER BY workspace_id, updated_at DESC, document_id")


def _asked_keys(spark, sf):
    """Order keys as asked documents: some unknown, some in another workspace."""
    return table(spark, sf, "orders").select(
        F.concat(F.lit("ws"), (F.col("o_custkey") % 4).cast("string")).alias("workspace_id"), F.col("o_orderkey").cast("string").alias("document_id")
    )


@query
def get_documents(spark, sf):
    return catalogue.get_documents(documents(spark, sf), _asked_keys(spark, sf)).select("workspace_id", "document_id", "file_name", "found")


ORACLES["get_documents"] = oracle("""
    SELECT k.workspace_id, k.document_id, d.file_name, d.document_id IS NOT NULL AS found
    FROM (SELECT 'ws' || o_custkey % 4 AS workspace_id, CAST(o_orderkey AS VARCHAR) AS document_id FROM orders) k
    LEFT JOIN docs d ON d.document_id = k.document_id AND d.workspace_id = k.workspace_id""")


@query
def find_documents(spark, sf):
    """Ids and names: order keys as ids, and every document's own name."""
    keys = _asked_keys(spark, sf).select(F.col("document_id").alias("key")).unionAll(documents(spark, sf).select("file_name"))
    return catalogue.find_documents(documents(spark, sf), keys)


ORACLES["find_documents"] = oracle("""
    SELECT key, document_id, file_name, status, document_id IS NOT NULL AS found
    FROM (SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders UNION SELECT file_name FROM docs)
    LEFT JOIN (SELECT document_id AS key, document_id, file_name, status FROM docs UNION ALL SELECT file_name, document_id, file_name, status FROM docs) USING (key)""")


@query
def get_chunks(spark, sf):
    keys = _asked_keys(spark, sf).select("workspace_id", F.concat("document_id", F.lit(":0")).alias("chunk_id"))
    return catalogue.get_chunks(corpus_chunks(spark, sf), keys).select("workspace_id", "chunk_id", "snippet", "found")


ORACLES["get_chunks"] = oracle("""
    SELECT k.workspace_id, k.chunk_id, c.snippet, c.chunk_id IS NOT NULL AS found
    FROM (SELECT 'ws' || o_custkey % 4 AS workspace_id, o_orderkey || ':0' AS chunk_id FROM orders) k
    LEFT JOIN chunks c ON c.chunk_id = k.chunk_id AND c.workspace_id = k.workspace_id""")


@query
def delete_documents(spark, sf):
    """Documents that have a toxic label."""
    gone = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id"))
    keys = documents(spark, sf).join(gone, "document_id").select("workspace_id", "document_id")
    return _sizes(*catalogue.delete_documents(all_tables(spark, sf), keys))


ORACLES["delete_documents"] = _sizes_sql("document_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)")


@query
def purge_ready(spark, sf):
    return _sizes(*catalogue.purge_by_status(all_tables(spark, sf)))


ORACLES["purge_ready"] = _sizes_sql("status = 'ready'")


@query
def reset_failed(spark, sf):
    return catalogue.reset_failed(documents(spark, sf)).select("document_id", "status", "fail_reason")


ORACLES["reset_failed"] = oracle("""
    SELECT document_id, CASE WHEN status = 'failed' THEN 'processing' ELSE status END AS status, CASE WHEN status <> 'failed' THEN fail_reason END AS fail_reason FROM docs""")


@query
def status_counts(spark, sf):
    return catalogue.status_counts(view(spark, sf, "workspaces"), documents(spark, sf))


ORACLES["status_counts"] = oracle("""
    SELECT w.workspace_id, status, count(document_id) AS documents FROM workspaces w LEFT JOIN docs d ON d.workspace_id = w.workspace_id GROUP BY ALL""")


@query
def has_processing(spark, sf):
    return catalogue.has_processing(documents(spark, sf))


ORACLES["has_processing"] = oracle("SELECT workspace_id, bool_or(status = 'processing') AS has_processing FROM docs GROUP BY workspace_id")


@query
def problem_docs(spark, sf):
    return catalogue.problem_docs(documents(spark, sf))


ORACLES["problem_docs"] = oracle("""
    SELECT workspace_id, document_id, file_name, status, CASE WHEN status = 'failed' THEN fail_reason END AS fail_reason FROM docs WHERE status IN ('failed', 'processing')""")


@query
def drive_documents(spark, sf):
    return catalogue.drive_documents(documents(spark, sf))


ORACLES["drive_documents"] = oracle("SELECT document_id, file_name, status, storage_key FROM docs WHERE storage_key LIKE 'drive://%'")


@query
def reconcile_counts(spark, sf):
    """Documents against documents that have a label."""
    return catalogue.reconcile_counts(table(spark, sf, "documents"), table(spark, sf, "labels"))


ORACLES["reconcile_counts"] = """
    SELECT *, left_rows = right_rows AS matches FROM (SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows)"""


# -- runs --------------------------------------------------------------------


@query
def latest_report(spark, sf):
    return catalogue.latest_report(view(spark, sf, "runs")).select("document_id", "run_id", "event_type")


ORACLES["latest_report"] = oracle("""
    SELECT document_id, run_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY started_at DESC, run_id DESC) AS n FROM runs) WHERE n = 1""")


@query
def run_history(spark, sf):
    return catalogue.run_history(documents(spark, sf), view(spark, sf, "runs")).select("document_id", "file_name", "run_id", "run_no")


ORACLES["run_history"] = oracle("""
    SELECT d.document_id, d.file_name, r.run_id, r.run_no FROM docs d LEFT JOIN
    (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY started_at DESC, run_id DESC) AS INT) AS run_no FROM runs) r ON r.document_id = d.document_id""")


def _reports(spark, sf):
    """Reports of all documents in processing."""
    return view(spark, sf, "docs").filter("status = 'processing'").select(
        "document_id", F.lit(7).alias("page_count"), F.lit(6).alias("extracted_pages"),
        F.array(F.struct(F.lit(2).alias("page"), F.lit("image_only_or_no_text").alias("reason"))).alias("failed_pages"),
        F.array(F.lit(1)).alias("ocr_used_pages"), F.array(F.lit("SHORT_TEXT_INCLUDED"), F.lit("OCR_USED")).alias("tags"), F.lit(1).alias("chunk_count"),
    )


def _errors(spark, sf):
    """New errors of all failed documents, of three kinds."""
    kind = F.element_at(F.array(F.lit("ingest"), F.lit("embedding"), F.lit("unexpected")), (F.col("doc_id") % 3 + 1).cast("int"))
    return view(spark, sf, "docs").filter("status = 'failed'").select(
        "document_id", kind.alias("kind"), F.concat(F.lit("broken "), "lang").alias("message"), F.array(F.lit("UNSUPPORTED_TYPE")).alias("tags"),
        F.lit(0).alias("extracted_pages"), F.array().cast("array<struct<page:int,reason:string>>").alias("failed_pages"),
        F.array().cast("array<int>").alias("ocr_used_pages"),
    )


@query
def apply_success(spark, sf):
    """Every report comes after an older one with other pages and tags."""
    last = _reports(spark, sf).withColumn("finished_at", F.lit(2))
    older = last.withColumn("finished_at", F.lit(1)).withColumn("page_count", F.lit(99)).withColumn("tags", F.array(F.lit("OLD")))
    out = catalogue.apply_success(documents(spark, sf), older.unionByName(last))[0]
    return out.select("document_id", "status", "page_count", joined("tags"), "fail_reason")


ORACLES["apply_success"] = oracle("""
    SELECT document_id, CASE WHEN status = 'processing' THEN 'ready' ELSE status END AS status, CASE WHEN status = 'processing' THEN 7 ELSE page_count END AS page_count,
           CASE WHEN status = 'processing' THEN array_to_string(list_sort(list_distinct([tag, 'SHORT_TEXT_INCLUDED', 'OCR_USED'])), ',') ELSE tag END AS tags,
           CASE WHEN status <> 'processing' THEN fail_reason END AS fail_reason FROM docs""")


@query
def apply_failure(spark, sf):
    """A third of the errors have no message; each comes after an older one of another kind."""
    last = _errors(spark, sf).withColumn("finished_at", F.lit(2))
    last = last.withColumn("message", F.when(F.col("document_id").cast("long") % 4 > 0, F.col("message")))
    older = last.withColumn("finished_at", F.lit(1)).withColumn("kind", F.lit("ingest")).withColumn("message", F.lit("older"))
    out = catalogue.apply_failure(documents(spark, sf), last.unionByName(older))[0]
    return out.select("document_id", "status", joined("tags"), "fail_reason")


ORACLES["apply_failure"] = oracle("""
    SELECT document_id, status, CASE WHEN status = 'failed' THEN array_to_string(list_sort([tag, 'UNSUPPORTED_TYPE']), ',') ELSE tag END AS tags,
           CASE WHEN status = 'failed' THEN CASE doc_id % 3 WHEN 1 THEN 'embedding_error: ' WHEN 2 THEN 'unexpected_error: ' ELSE '' END || CASE WHEN doc_id % 4 > 0 THEN 'broken ' || lang ELSE '' END ELSE fail_reason END AS fail_reason
    FROM docs""")


@query
def merge_tags(spark, sf):
    """Event types and user groups of each user's neighbours, merged."""
    from citeloom.functions import text

    a, b = F.array("event_type", F.lit("z"), "event_type"), F.when(F.col("event_id") % 3 > 0, F.array(F.lit("Z"), F.lit("é"), "event_type"))
    return table(spark, sf, "events").select("event_id", F.array_join(text.merge_tags(a, b), ",").alias("tags"))


ORACLES["merge_tags"] = """
    SELECT event_id, array_to_string(list_sort(list_distinct(CASE WHEN event_id % 3 > 0 THEN [event_type, 'z', 'Z', 'é'] ELSE [event_type, 'z'] END)), ',') AS tags FROM events"""


# -- imports -----------------------------------------------------------------


@query
def video_files(spark, sf):
    return catalogue.video_files(view(spark, sf, "listing")).select("item_no", "id", "name")


_IS_VIDEO = "(coalesce(mimeType, '') LIKE 'video/%' OR regexp_matches(lower(name), '^.+[.](mp4|mov|avi|mkv|m4v|webm)$'))"
ORACLES["video_files"] = oracle(f"SELECT item_no, id, name FROM listing WHERE {_IS_VIDEO}")


@query
def smallest_files(spark, sf):
    return catalogue.smallest_files(view(spark, sf, "listing").withColumn("id", F.col("item_no").cast("string"))).select("item_no", "size_int")


ORACLES["smallest_files"] = oracle("""
    SELECT item_no, coalesce(CAST(size AS BIGINT), 0) AS size_int FROM listing WHERE mimeType LIKE 'video/%' ORDER BY size_int, CAST(item_no AS VARCHAR) LIMIT 3""")


def _actions(spark, sf):
    return catalogue.reconcile_import(catalogue.video_files(view(spark, sf, "listing")), drive_documents_table(spark, sf))


@query
def reconcile_import(spark, sf):
    return _actions(spark, sf).select("workspace_id", "item_no", "action", "document_id", "file_name", "mime_type", "storage_key", joined("tags"))


_ACTIONS = f"""
    SELECT l.workspace_id, l.item_no, 'drive://' || l.file_id AS storage_key, l.name AS file_name,
           CASE WHEN l.mimeType <> '' THEN l.mimeType WHEN lower(l.name) LIKE '%.mp4' THEN 'video/mp4' WHEN l.name LIKE '%.webm' THEN 'video/webm' ELSE 'application/octet-stream' END AS mime_type,
           CASE WHEN l.file_id = '' OR l.nth > 1 THEN 'skip' WHEN d.document_id IS NULL THEN 'insert' WHEN d.status = 'failed' THEN 'requeue' ELSE 'skip' END AS action,
           d.document_id AS known_id, d.status
    FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, file_id ORDER BY item_no) AS nth FROM (SELECT *, trim(id) AS file_id FROM listing WHERE {_IS_VIDEO})) l
    LEFT JOIN drive_docs d ON d.workspace_id = l.workspace_id AND d.storage_key = 'drive://' || l.file_id"""
ORACLES["reconcile_import"] = oracle(
    """
    SELECT workspace_id, item_no, action, CASE WHEN action <> 'skip' THEN coalesce(known_id, sha256(workspace_id || '|' || storage_key)) END AS document_id,
           file_name, mime_type, storage_key, CASE action WHEN 'insert' THEN 'folder-import,google-drive' WHEN 'requeue' THEN 'folder-import,google-drive,kept' END AS tags
    FROM actions""",
    actions=_ACTIONS,
)


@query
def import_counts(spark, sf):
    return catalogue.import_counts(_actions(spark, sf))


ORACLES["import_counts"] = oracle(
    """
    SELECT workspace_id, count(*) FILTER (action <> 'skip') AS queued_count, count(*) FILTER (action = 'skip') AS skipped_count FROM actions GROUP BY workspace_id""",
    actions=_ACTIONS,
)


@query
def apply_import(spark, sf):
    out = catalogue.apply_import(drive_documents_table(spark, sf), _actions(spark, sf))
    return out.groupBy("workspace_id", "status").agg(F.count("*").alias("documents"), F.count("fail_reason").alias("reasons"))


ORACLES["apply_import"] = oracle(
    """
    SELECT workspace_id, status, count(*) AS documents, count(fail_reason) AS reasons FROM (
      SELECT d.workspace_id, CASE WHEN a.known_id IS NOT NULL THEN 'processing' ELSE d.status END AS status, CASE WHEN a.known_id IS NULL THEN d.fail_reason END AS fail_reason
      FROM drive_docs d LEFT JOIN (SELECT known_id FROM actions WHERE action = 'requeue') a ON a.known_id = d.document_id
      UNION ALL SELECT workspace_id, 'processing', NULL FROM actions WHERE action = 'insert') GROUP BY ALL""",
    actions=_ACTIONS,
)


@query
def pilot_kpis(spark, sf):
    """Documents of the catalogue; events as answers, their value as seconds."""
    answers = table(spark, sf, "events").select(
        (F.col("value") / 10).alias("latency_sec"), (F.col("event_type") != "error").alias("assertive"), (F.col("event_id") % 25 > 0).alias("cited")
    )
    out = catalogue.pilot_kpis(documents(spark, sf), answers)
    numbers = ["ingest_success", "ingest_failure", "answer_p95_sec", "citation_rate", "uncited_rate"]
    return out.select(*[F.round(c, 6).alias(c) for c in numbers], "targets_met", "abort")


ORACLES["pilot_kpis"] = oracle("""
    SELECT round(s, 6) AS ingest_success, round(f, 6) AS ingest_failure, round(p, 6) AS answer_p95_sec, round(c, 6) AS citation_rate, round(1 - c, 6) AS uncited_rate,
           s >= 0.9 AND p <= 8 AND c >= 0.95 AS targets_met, f > 0.3 OR c < 0.95 AS abort
    FROM (SELECT avg(CAST(status = 'ready' AS INT)) AS s, avg(CAST(status = 'failed' AS INT)) AS f FROM docs WHERE status <> 'processing'),
         (SELECT quantile_cont(value / 10, 0.95) AS p, avg(CAST(event_id % 25 > 0 AS INT)) FILTER (event_type <> 'error') AS c FROM events)""")
