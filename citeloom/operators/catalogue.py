"""Catalogue work over workspaces, documents, runs and chunks.

Every change returns new tables; :mod:`citeloom.sources.tables` writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import files, text
from citeloom.operators.running import running_number

IMPORT_TAGS = ["google-drive", "folder-import"]
STATUSES = ["processing", "ready", "failed"]
Tables = dict[str, DataFrame]


def _tags(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names])


# -- workspaces --------------------------------------------------------------


def list_workspaces(workspaces: DataFrame) -> DataFrame:
    return workspaces.orderBy(F.desc("created_at"), "workspace_id")


def default_workspace(workspaces: DataFrame) -> DataFrame:
    """The oldest workspace."""
    return workspaces.orderBy("created_at", "workspace_id").limit(1)


def create_workspaces(requests: DataFrame, max_chars: int = 255) -> tuple[DataFrame, DataFrame]:
    """Accepted rows with their trimmed name, and rejected rows with the reason."""
    name = text.strip(F.coalesce("name", F.lit("")))
    checked = requests.withColumn(
        "reason",
        F.when(F.length("name") > max_chars, "name is too long").when(name == "", "name is required"),
    )
    accepted = checked.filter("reason IS NULL").withColumn("name", name).drop("reason")
    return accepted, checked.filter("reason IS NOT NULL")


def delete_workspaces(tables: Tables, ids: DataFrame) -> tuple[Tables, DataFrame]:
    """Tables without the workspaces and everything below them, and the object keys to purge."""
    gone = ids.select("workspace_id").distinct()
    documents = tables["documents"].join(gone, "workspace_id", "left_semi")
    left = _without_documents(tables, documents.select("document_id"))
    left["workspaces"] = tables["workspaces"].join(gone, "workspace_id", "left_anti")
    return left, _purge_keys(documents)


# -- documents ---------------------------------------------------------------


def list_documents(documents: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Documents of the given workspaces, newest first in each: one range sort."""
    chosen = documents.join(workspaces.select("workspace_id"), "workspace_id", "left_semi")
    return chosen.orderBy("workspace_id", F.desc("created_at"), "document_id")


def docs_by_update(documents: DataFrame) -> DataFrame:
    """Documents of each workspace, last updated first."""
    return documents.orderBy("workspace_id", F.desc("updated_at"), "document_id")


def get_documents(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per asked ``(workspace_id, document_id)`` with ``found``."""
    marked = documents.withColumn("_hit", F.lit(True))
    joined = keys.join(marked, ["workspace_id", "document_id"], "left")
    return joined.withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def find_documents(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose id or exact file name equals an asked ``key``; misses stay with null ids."""
    columns = ["document_id", "file_name", "status"]
    by_id = documents.select(F.col("document_id").alias("key"), *columns)
    by_name = documents.select(F.col("file_name").alias("key"), *columns)
    either = by_id.unionByName(by_name)
    return keys.select("key").distinct().join(either, "key", "left").withColumn("found", F.col("document_id").isNotNull())


def get_chunks(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    """Asked ``(workspace_id, chunk_id)`` with the chunk, or ``found`` false."""
    marked = chunks.withColumn("_hit", F.lit(True))
    joined = keys.join(marked, ["workspace_id", "chunk_id"], "left")
    return joined.withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def _purge_keys(documents: DataFrame) -> DataFrame:
    """Object keys to delete; drive-held files are not ours to delete."""
    return documents.filter(~F.col("storage_key").startswith(files.DRIVE)).select("document_id", "storage_key")


def _without_documents(tables: Tables, gone: DataFrame) -> Tables:
    return {
        name: table.join(gone, "document_id", "left_anti") if name != "workspaces" else table
        for name, table in tables.items()
    }


def delete_documents(tables: Tables, keys: DataFrame) -> tuple[Tables, DataFrame]:
    """Tables without the documents, their runs and chunks, and the object keys to purge."""
    wanted = keys.select("workspace_id", "document_id").distinct()
    gone = tables["documents"].join(wanted, ["workspace_id", "document_id"], "left_semi")
    return _without_documents(tables, gone.select("document_id")), _purge_keys(gone)


def purge_by_status(tables: Tables, status: str = "ready") -> tuple[Tables, DataFrame]:
    keys = tables["documents"].filter(F.col("status") == status)
    return delete_documents(tables, keys)


def reset_failed(documents: DataFrame) -> DataFrame:
    """Failed documents go back to processing, without their reason."""
    failed = F.col("status") == "failed"
    return documents.withColumn("fail_reason", F.when(~failed, F.col("fail_reason"))).withColumn(
        "status", F.when(failed, "processing").otherwise(F.col("status"))
    )


def status_counts(workspaces: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents per workspace and status; workspaces without documents show 0."""
    counted = documents.groupBy("workspace_id", "status").agg(F.count("*").alias("documents"))
    return workspaces.select("workspace_id").join(counted, "workspace_id", "left").withColumn(
        "documents", F.coalesce("documents", F.lit(0).cast("bigint"))
    )


def has_processing(documents: DataFrame) -> DataFrame:
    return documents.groupBy("workspace_id").agg(F.bool_or(F.col("status") == "processing").alias("has_processing"))


def problem_docs(documents: DataFrame) -> DataFrame:
    """Failed documents with their reason, and documents in processing."""
    return documents.filter(F.col("status").isin("failed", "processing")).select(
        "workspace_id",
        "document_id",
        "file_name",
        "status",
        F.when(F.col("status") == "failed", F.col("fail_reason")).alias("fail_reason"),
    )


def drive_documents(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("storage_key").startswith(files.DRIVE)).select(
        "document_id", "file_name", "status", "storage_key"
    )


def reconcile_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts of two reads of one table, side by side."""
    sides = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    zero = F.lit(0).cast("bigint")
    counts = sides.agg(F.coalesce(F.sum("l"), zero).alias("left_rows"), F.coalesce(F.sum("r"), zero).alias("right_rows"))
    return counts.withColumn("matches", F.col("left_rows") == F.col("right_rows"))


def inventory_lines(workspaces: DataFrame, documents: DataFrame) -> DataFrame:
    """Report lines ``workspace_id, document_id, line_no, line`` in report order."""
    label = F.concat(
        F.lit("Workspace: "), F.coalesce("name", "workspace_id"), F.lit(" ("), F.col("workspace_id"), F.lit(")")
    )
    heads = workspaces.select("workspace_id", F.lit("").alias("document_id"), F.lit(0).alias("line_no"), label.alias("line"))
    empty = workspaces.join(documents.select("workspace_id"), "workspace_id", "left_anti").select(
        "workspace_id", F.lit("").alias("document_id"), F.lit(1).alias("line_no"), F.lit("  No documents.").alias("line")
    )
    detail = F.array(
        F.concat(F.lit("  Doc: "), "file_name", F.lit(" (ID: "), "document_id", F.lit(")")),
        F.concat(F.lit("    Status: "), "status", F.lit(", Mime: "), F.coalesce("mime_type", F.lit("None"))),
        F.when(F.col("fail_reason") != "", F.concat(F.lit("    Fail Reason: "), "fail_reason")),
    )
    rows = documents.select("workspace_id", "document_id", F.posexplode(F.array_compact(detail)).alias("line_no", "line"))
    return heads.unionByName(empty).unionByName(rows)


# -- runs --------------------------------------------------------------------


def latest_report(runs: DataFrame) -> DataFrame:
    """The run of each document that started last."""
    newest = runs.groupBy("document_id").agg(F.max_by(F.struct("*"), F.struct("started_at", "run_id")).alias("_r"))
    return newest.select("_r.*")


def run_history(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """All runs of each document, newest first; documents without a run stay."""
    numbered = running_number(runs, ["document_id"], [F.desc("started_at"), F.desc("run_id")], "run_no")
    return documents.select("document_id", "file_name", "status").join(numbered, "document_id", "left")


def _last_of_each(rows: DataFrame) -> DataFrame:
    """One row per document: the one finished last, started last, of the greatest run_id, where there are such columns; then the one that is greatest as JSON."""
    first = [c for c in ("finished_at", "started_at", "run_id") if c in rows.columns]
    order = F.struct(*first, F.to_json(F.struct(*rows.columns)))
    return rows.groupBy("document_id").agg(F.max_by(F.struct("*"), order).alias("_r")).select("_r.*")


def apply_success(documents: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents marked ready by their report, and the finished run rows.

    ``reports(document_id, page_count, extracted_pages, failed_pages, ocr_used_pages, tags, chunk_count)``;
    of several reports of one document the last one counts for the document, each gives a run.
    """
    new = _last_of_each(reports).select("document_id", F.col("page_count").alias("_pages"), F.col("tags").alias("_tags"))
    joined = documents.join(new.withColumn("_done", F.lit(True)), "document_id", "left")
    done = F.col("_done").isNotNull()
    updated = (
        joined.withColumn("status", F.when(done, "ready").otherwise(F.col("status")))
        .withColumn("page_count", F.when(done, F.col("_pages")).otherwise(F.col("page_count")))
        .withColumn("tags", F.when(done, text.merge_tags(F.col("tags"), F.col("_tags"))).otherwise(F.col("tags")))
        .withColumn("fail_reason", F.when(~done, F.col("fail_reason")))
    )
    log = F.create_map(
        F.lit("stage"), F.lit("completed"),
        F.lit("message"), F.lit("ingestion finished"),
        F.lit("chunk_count"), F.col("chunk_count").cast("string"),
        F.lit("tags"), F.array_join("merged", ","),
    )
    merged = updated.filter(done).select("document_id", F.col("tags").alias("merged"))
    finished = reports.join(merged, "document_id").select(
        "document_id",
        "extracted_pages",
        F.size("failed_pages").alias("failed_pages_count"),
        "failed_pages",
        "ocr_used_pages",
        F.col("chunk_count").cast("int").alias("chunk_count"),
        log.alias("log"),
    )
    return updated.select(*documents.columns), finished


def failure_reason(kind: Column, message: Column) -> Column:
    """Reason text of an error kind: embedding and unexpected errors carry a prefix; a missing message is empty."""
    message = F.coalesce(message, F.lit(""))
    return (
        F.when(kind == "embedding", F.concat(F.lit("embedding_error: "), message))
        .when(kind == "unexpected", F.concat(F.lit("unexpected_error: "), message))
        .otherwise(message)
    )


def apply_failure(documents: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents marked failed, and the run rows with the totals reached so far.

    ``errors(document_id, kind, message, tags, extracted_pages, failed_pages, ocr_used_pages)``; of
    several errors of one document the last one counts for the document, each gives a run.
    """
    reasoned = errors.withColumn("reason", failure_reason(F.col("kind"), F.col("message")))
    new = _last_of_each(reasoned).select("document_id", F.col("reason").alias("_reason"), F.col("tags").alias("_tags"))
    joined = documents.join(new.withColumn("_hit", F.lit(True)), "document_id", "left")
    hit = F.col("_hit").isNotNull()
    updated = (
        joined.withColumn("status", F.when(hit, "failed").otherwise(F.col("status")))
        .withColumn("fail_reason", F.when(hit, F.col("_reason")).otherwise(F.col("fail_reason")))
        .withColumn("tags", F.when(hit, text.merge_tags(F.col("tags"), F.col("_tags"))).otherwise(F.col("tags")))
    )
    log = F.create_map(
        F.lit("stage"), F.lit("failed"),
        F.lit("reason"), F.col("reason"),
        F.lit("tags"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ","),
    )
    ended = reasoned.select(
        "document_id",
        "extracted_pages",
        F.coalesce(F.size("failed_pages"), F.lit(0)).alias("failed_pages_count"),
        "failed_pages",
        "ocr_used_pages",
        F.lit(0).alias("chunk_count"),
        log.alias("log"),
    )
    return updated.select(*documents.columns), ended


# -- folder import -----------------------------------------------------------


def video_files(listing: DataFrame) -> DataFrame:
    return listing.filter(files.is_listed_video(F.col("name"), F.col("mimeType")))


def smallest_files(listing: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` smallest videos by MIME type; a missing size counts as 0."""
    sized = listing.filter(F.coalesce("mimeType", F.lit("")).startswith("video/")).withColumn(
        "size_int", F.coalesce(F.col("size").try_cast("bigint"), F.lit(0).cast("bigint"))
    )
    return sized.orderBy("size_int", "id").limit(k)


def reconcile_import(listing: DataFrame, documents: DataFrame) -> DataFrame:
    """The action for each listed file: insert, requeue or skip, with its resulting document row.

    ``listing(workspace_id, item_no, id, name, mimeType)``. An id listed twice in one
    workspace acts once, at its first position; later ones are skipped.
    """
    file_id = text.strip(F.coalesce("id", F.lit("")))
    name = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.concat(F.lit("drive-file-"), F.col("file_id")))
    items = (
        listing.withColumn("file_id", file_id)
        .withColumn("file_name", name)
        .withColumn("mime_type", files.resolve_mime(F.col("file_name"), F.col("mimeType")))
        .withColumn("storage_key", F.concat(F.lit(files.DRIVE), "file_id"))
    )
    first = items.filter("file_id <> ''").groupBy("workspace_id", "file_id").agg(F.min("item_no").alias("_first"))
    known = documents.select(
        "workspace_id",
        "storage_key",
        F.col("document_id").alias("known_id"),
        F.col("status").alias("known_status"),
        F.col("tags").alias("known_tags"),
    )
    joined = items.join(first, ["workspace_id", "file_id"], "left").join(known, ["workspace_id", "storage_key"], "left")
    action = (
        F.when(F.col("file_id") == "", "skip")
        .when(F.col("item_no") > F.col("_first"), "skip")
        .when(F.col("known_id").isNull(), "insert")
        .when(F.col("known_status") == "failed", "requeue")
        .otherwise("skip")
    )
    fresh = F.sha2(F.concat_ws("|", "workspace_id", "storage_key"), 256)
    return joined.withColumn("action", action).select(
        "workspace_id",
        "item_no",
        "action",
        F.when(F.col("action") != "skip", F.coalesce("known_id", fresh)).alias("document_id"),
        "file_name",
        "mime_type",
        "storage_key",
        F.when(F.col("action") != "skip", text.merge_tags(F.col("known_tags"), _tags(*IMPORT_TAGS))).alias("tags"),
    )


def import_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("workspace_id").agg(
        F.count_if(F.col("action") != "skip").alias("queued_count"),
        F.count_if(F.col("action") == "skip").alias("skipped_count"),
    )


def apply_import(documents: DataFrame, actions: DataFrame) -> DataFrame:
    """The documents table after the import."""
    queued = actions.filter("action <> 'skip'")
    new = queued.filter("action = 'insert'").select(
        "document_id",
        "workspace_id",
        "file_name",
        "mime_type",
        "storage_key",
        F.lit("processing").alias("status"),
        "tags",
    )
    again = queued.filter("action = 'requeue'").select(
        "document_id",
        F.col("file_name").alias("_name"),
        F.col("mime_type").alias("_mime"),
        F.col("tags").alias("_tags"),
    )
    joined = documents.join(again, "document_id", "left")
    hit = F.col("_tags").isNotNull()
    kept = (
        joined.withColumn("file_name", F.when(hit, F.col("_name")).otherwise(F.col("file_name")))
        .withColumn("mime_type", F.when(hit, F.col("_mime")).otherwise(F.col("mime_type")))
        .withColumn("tags", F.when(hit, F.col("_tags")).otherwise(F.col("tags")))
        .withColumn("status", F.when(hit, "processing").otherwise(F.col("status")))
        .withColumn("fail_reason", F.when(~hit, F.col("fail_reason")))
    )
    return kept.select(*documents.columns).unionByName(new, allowMissingColumns=True).select(*documents.columns)


# -- pilot figures -----------------------------------------------------------


def pilot_kpis(documents: DataFrame, answers: DataFrame) -> DataFrame:
    """Success rates, latency and citation rate against the pilot's limits.

    ``answers(latency_sec, assertive, cited)``.
    """
    ended = documents.filter(F.col("status") != "processing")
    ingest = ended.agg(
        F.avg((F.col("status") == "ready").cast("double")).alias("ingest_success"),
        F.avg((F.col("status") == "failed").cast("double")).alias("ingest_failure"),
    )
    assertive = F.when(F.col("assertive"), F.col("cited").cast("double"))
    # equal latencies are counted first, so that the exact percentile sees each once
    counted = answers.groupBy("latency_sec").agg(
        F.count("*").alias("answers"), F.sum(assertive).alias("cited"), F.count(assertive).alias("assertive")
    )
    answered = counted.agg(
        F.percentile("latency_sec", F.lit(0.95), F.col("answers")).alias("answer_p95_sec"),
        (F.sum("cited") / F.sum("assertive")).alias("citation_rate"),
    )
    # one row on each side
    both = ingest.join(answered, F.lit(True))
    return both.select(
        "*",
        (1 - F.col("citation_rate")).alias("uncited_rate"),
        (
            (F.col("ingest_success") >= 0.9)
            & (F.col("answer_p95_sec") <= 8)
            & (F.col("citation_rate") >= 0.95)
        ).alias("targets_met"),
        ((F.col("ingest_failure") > 0.3) | (F.col("citation_rate") < 0.95)).alias("abort"),
    )
