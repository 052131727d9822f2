"""Tolerant readers of raw JSON lines (``value`` column) with drifting shapes.

Missing, renamed or wrongly typed members become defaults; nothing fails the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ["ready", "processing", "failed"]
REF_TYPES = ["page", "slide", "sheet", "video"]


def _node(raw: DataFrame) -> DataFrame:
    return raw.withColumn("_n", F.try_parse_json("value"))


def _get(node: Column, path: str) -> Column:
    """Member as variant; null when missing or JSON null."""
    found = F.try_variant_get(node, path, "variant")
    return F.when(found.isNotNull() & ~F.is_variant_null(found), found)


def _kind(node: Column) -> Column:
    return F.schema_of_variant(node)


def _is_number(node: Column) -> Column:
    kind = _kind(node)
    return F.coalesce(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.lit(False))


def _as_text(node: Column) -> Column:
    """Text of a scalar; JSON text of anything else."""
    return F.coalesce(F.try_variant_get(node, "$", "string"), F.to_json(node))


def _text(node: Column, *paths: str) -> Column:
    """First member that is neither missing nor null, as text, else empty."""
    return F.coalesce(*[_as_text(_get(node, p)) for p in paths], F.lit(""))


def _number(node: Column, path: str, as_type: str) -> Column:
    """Member only when it really is a number."""
    found = _get(node, path)
    return F.when(_is_number(found), F.try_variant_get(found, "$", as_type))


def _numeric(node: Column) -> Column:
    """A number, or text that reads as one; blank text and JSON null read as 0, booleans as 0/1."""
    plain = F.try_variant_get(node, "$", "string")
    text = F.trim(plain)
    value = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    scalar = (
        F.when(F.is_variant_null(node), F.lit(0.0))
        .when(_is_number(node), F.try_variant_get(node, "$", "double"))
        .when(_kind(node) == "BOOLEAN", F.when(plain == "true", F.lit(1.0)).otherwise(F.lit(0.0)))
        .when(_kind(node) == "STRING", value)
    )
    return F.when(scalar.isNotNull() & ~F.isnan(scalar) & (F.abs(scalar) != float("inf")), scalar)


def _array(node: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(node, path, "array<variant>"), F.array().cast("array<variant>"))


def _is_true_array(node: Column, path: str) -> Column:
    return F.coalesce(_kind(_get(node, path)).startswith("ARRAY"), F.lit(False))


def _texts(node: Column, path: str) -> Column:
    items = F.transform(_array(node, path), lambda x: F.when(F.is_variant_null(x), F.lit("null")).otherwise(_as_text(x)))
    return F.when(_is_true_array(node, path), items).otherwise(F.array().cast("array<string>"))


def normalize_workspaces(raw: DataFrame) -> DataFrame:
    node = F.col("_n")
    rows = _node(raw).select(_text(node, "$.id").alias("workspace_id"), _text(node, "$.name").alias("name"))
    return rows.filter("workspace_id <> ''")


def normalize_docs(raw: DataFrame) -> DataFrame:
    node = F.col("_n")
    status = F.lower(F.coalesce(_as_text(_get(node, "$.status")), F.lit("failed")))
    reason = _text(node, "$.fail_reason")
    rows = _node(raw).select(
        _text(node, "$.doc_id", "$.id").alias("document_id"),
        _text(node, "$.file_name").alias("file_name"),
        _text(node, "$.mime", "$.mime_type").alias("mime_type"),
        F.when(status.isin(STATUSES), status).otherwise("failed").alias("status"),
        _number(node, "$.page_count", "double").alias("page_count"),
        _texts(node, "$.tags").alias("tags"),
        F.coalesce(_as_text(_get(node, "$.updated_at")), _as_text(_get(node, "$.created_at"))).alias("updated_at"),
        F.when(reason != "", reason).alias("fail_reason"),
    )
    return rows.filter("document_id <> ''")


def normalize_reports(raw: DataFrame) -> DataFrame:
    node = F.col("_n")
    page = lambda f: F.coalesce(_numeric(F.try_variant_get(f, "$.page", "variant")), F.lit(float("nan")))
    failed = F.filter(
        F.transform(
            _array(node, "$.failed_pages"),
            lambda f: F.struct(page(f).alias("page"), _text(f, "$.reason").alias("reason")),
        ),
        lambda f: ~F.isnan(f["page"]) & (f["reason"] != ""),
    )
    used = F.filter(F.transform(_array(node, "$.ocr_used_pages"), _numeric), lambda x: x.isNotNull())
    zero = F.lit(0.0)
    return _node(raw).select(
        _text(node, "$.doc_id", "$.document_id").alias("document_id"),
        F.coalesce(_number(node, "$.extracted_pages", "double"), zero).alias("extracted_pages"),
        failed.alias("failed_pages"),
        used.alias("ocr_used_pages"),
        F.coalesce(_number(node, "$.chunk_count", "double"), zero).alias("chunk_count"),
        _number(node, "$.estimated_cost", "double").alias("estimated_cost"),
    )


def normalize_imports(raw: DataFrame) -> DataFrame:
    node = F.col("_n")
    zero = F.lit(0.0)
    return _node(raw).select(
        _text(node, "$.folder_id").alias("folder_id"),
        F.coalesce(_number(node, "$.queued_count", "double"), zero).alias("queued_count"),
        F.coalesce(_number(node, "$.skipped_count", "double"), zero).alias("skipped_count"),
        _texts(node, "$.doc_ids").alias("doc_ids"),
    )


def _plain(node: Column, path: str) -> Column:
    """Text of a member that is a string or a number, else null."""
    found = _get(node, path)
    return F.when((_kind(found) == "STRING") | _is_number(found), _as_text(found))


def _citation(c: Column) -> Column:
    url = _get(c, "$.url")
    link = F.when(_kind(url) == "STRING", _as_text(url))
    ref_type = _plain(c, "$.ref_type")
    return F.struct(
        _plain(c, "$.doc_id").alias("doc_id"),
        _plain(c, "$.file_name").alias("file_name"),
        F.when(ref_type.isin(REF_TYPES), ref_type).alias("ref_type"),
        _plain(c, "$.ref").alias("ref"),
        _plain(c, "$.snippet").alias("snippet"),
        _number(c, "$.score", "double").alias("score"),
        _as_text(_get(c, "$.chunk_id")).alias("chunk_id"),
        _as_text(_get(c, "$.mime_type")).alias("mime_type"),
        F.when(link != "", link).alias("url"),
    )


def normalize_answers(raw: DataFrame) -> DataFrame:
    """Answer texts and the citations that have every required field and a known type."""
    node = F.col("_n")
    required = ["doc_id", "file_name", "ref_type", "ref", "snippet"]

    def complete(c: Column) -> Column:
        test = F.lit(True)
        for name in required:
            test = test & c[name].isNotNull()
        return test

    cites = F.filter(F.transform(_array(node, "$.citations"), _citation), complete)
    keep = [c for c in raw.columns if c != "value"]
    return _node(raw).select(
        *keep,
        _text(node, "$.answer.conclusion").alias("conclusion"),
        _text(node, "$.answer.details").alias("details"),
        _text(node, "$.answer.notes").alias("notes"),
        _texts(node, "$.answer.next_actions").alias("next_actions"),
        cites.alias("citations"),
    )
