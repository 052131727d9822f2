"""Page triage: native text, recognised text, or failure, and the document roll-up.

Input ``pages(document_id, page, raw_text, ocr_text)``; ``ocr_text`` is what a
recogniser would return for that page, null or empty when it returns nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import files, text
from citeloom.operators.running import running_sum

FAIL_REASON = "image_only_or_no_text"


def _judged(pages: DataFrame, min_chars: int) -> DataFrame:
    native = text.strip(F.coalesce(F.col("raw_text"), F.lit("")))
    return (
        pages.withColumn("native", native)
        .withColumn("is_garbled", text.is_garbled(F.col("native")))
        .withColumn("is_low", (F.length("native") < min_chars) | F.col("is_garbled"))
    )


def apply_ocr_budget(pages: DataFrame, max_pages: int = 20, min_chars: int = 40) -> DataFrame:
    """Keep ``ocr_text`` on the first ``max_pages`` pages of a document that need it."""
    low = F.col("is_low").cast("int")
    tried = running_sum(_judged(pages, min_chars), ["document_id"], [F.col("page")], low, "_attempt")
    allowed = F.col("is_low") & (F.col("_attempt") <= max_pages)
    return tried.withColumn("ocr_text", F.when(allowed, F.col("ocr_text"))).select(*pages.columns)


def triage_pages(pages: DataFrame, min_chars: int = 40) -> DataFrame:
    """One outcome per page: native, ocr, short_ocr, short_native or failed."""
    judged = _judged(pages, min_chars).withColumn("ocr", text.strip(F.coalesce("ocr_text", F.lit(""))))
    judged = judged.withColumn("ocr_ok", (F.col("ocr") != "") & ~text.is_garbled(F.col("ocr")))
    outcome = (
        F.when(~F.col("is_low"), "native")
        .when(F.col("ocr_ok") & (F.length("ocr") >= min_chars), "ocr")
        .when(F.col("ocr_ok"), "short_ocr")
        .when((F.col("native") != "") & ~F.col("is_garbled"), "short_native")
        .otherwise("failed")
    )
    judged = judged.withColumn("outcome", outcome)
    chosen = (
        F.when(F.col("outcome").isin("native", "short_native"), F.col("native"))
        .when(F.col("outcome").isin("ocr", "short_ocr"), F.col("ocr"))
    )
    return judged.select(
        "document_id",
        "page",
        chosen.alias("text"),
        "outcome",
        "is_low",
        "is_garbled",
        F.col("outcome").isin("ocr", "short_ocr").alias("used_ocr"),
        F.col("outcome").isin("short_ocr", "short_native").alias("is_short"),
        (F.col("outcome") == "failed").alias("is_failed"),
    )


def parse_report(triage: DataFrame, doc_ocr: DataFrame | None = None, image_ratio: float = 0.5) -> DataFrame:
    """Page counts, failed and recognised pages and tags of each document.

    ``doc_ocr(document_id, doc_ocr_text)`` replaces everything for a document with
    no usable page at all.
    """
    failed = F.when(F.col("is_failed"), F.struct("page", F.lit(FAIL_REASON).alias("reason")))
    report = triage.groupBy("document_id").agg(
        F.count("*").cast("int").alias("page_count"),
        F.count_if(~F.col("is_failed")).cast("int").alias("extracted_pages"),
        F.sort_array(F.collect_list(failed)).alias("failed_pages"),
        F.sort_array(F.collect_list(F.when(F.col("used_ocr"), F.col("page")))).alias("ocr_used_pages"),
        F.count_if("is_low").alias("_low"),
        F.bool_or("is_short").alias("_short"),
        F.bool_or("is_garbled").alias("_garbled"),
    )
    if doc_ocr is None:
        report = report.withColumn("doc_ocr_text", F.lit(None).cast("string"))
    else:
        report = report.join(doc_ocr.select("document_id", "doc_ocr_text"), "document_id", "left")
    whole = text.strip(F.coalesce("doc_ocr_text", F.lit("")))
    report = report.withColumn(
        "used_doc_ocr", (F.col("extracted_pages") == 0) & (whole != "") & ~text.is_garbled(whole)
    ).withColumn("_whole", F.when(F.col("used_doc_ocr"), whole))
    use = F.col("used_doc_ocr")
    report = (
        report.withColumn("failed_pages", F.when(use, F.slice("failed_pages", 1, 0)).otherwise(F.col("failed_pages")))
        .withColumn(
            "ocr_used_pages",
            F.when(use, F.sequence(F.lit(1), F.col("page_count"))).otherwise(F.col("ocr_used_pages")),
        )
        .withColumn("extracted_pages", F.when(use, F.col("page_count")).otherwise(F.col("extracted_pages")))
    )
    tags = text.tag_list(
        (use, "DOC_OCR"),
        (F.col("_low") / F.col("page_count") >= image_ratio, "IMAGE_ONLY_PDF"),
        (F.col("_short"), "SHORT_TEXT_INCLUDED"),
        (F.col("_garbled"), "POSSIBLE_MOJIBAKE"),
        (F.size("ocr_used_pages") > 0, "OCR_USED"),
        (F.col("extracted_pages") == 0, "OCR_REQUIRED"),
    )
    return report.select(
        "document_id",
        "page_count",
        "extracted_pages",
        "failed_pages",
        "ocr_used_pages",
        tags.alias("tags"),
        "used_doc_ocr",
        F.col("_whole").alias("doc_text"),
    )


def page_blocks(triage: DataFrame, report: DataFrame) -> DataFrame:
    """Blocks of the usable pages, or the single page-less block of a recognised document."""
    pages = triage.filter(~F.col("is_failed")).select(
        "document_id",
        F.col("page").alias("block_no"),
        "text",
        F.col("page").cast("int").alias("page"),
        F.lit(None).cast("string").alias("section_title"),
    )
    whole = report.filter("used_doc_ocr").select(
        "document_id",
        F.lit(0).alias("block_no"),
        F.col("doc_text").alias("text"),
        F.lit(None).cast("int").alias("page"),
        F.lit("Document OCR").alias("section_title"),
    )
    return pages.unionByName(whole)


def image_candidates(images: DataFrame, k: int = 3, min_bytes: int = 128) -> DataFrame:
    """The ``k`` largest real images of each page, from ``document_id, page, image_no, name, content``."""
    mime = files.image_mime(F.col("name"), F.col("content"))
    sized = images.withColumn("mime", mime).withColumn("size", F.length("content"))
    order = Window.partitionBy("document_id", "page").orderBy(F.desc("size"), "image_no")
    return (
        sized.filter((F.col("size") >= min_bytes) & F.col("mime").startswith("image/"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )
