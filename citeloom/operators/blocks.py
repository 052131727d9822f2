"""Text blocks of decoded documents, paragraph tables and videos.

A document is one row, so its blocks are built inside that row and exploded:
no shuffle, and order is the array position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import files, text
from citeloom.operators.running import running_last


def line_array(value: Column) -> Column:
    """Stripped non-blank lines."""
    stripped = F.transform(text.lines(value), text.strip)
    return F.filter(stripped, lambda x: x != "")


def _section_lines(section: Column) -> Column:
    rows = F.transform(F.split(section, "\n"), text.strip)
    head = F.element_at(rows, 1)
    has_heading = head.startswith("#")
    title = F.when(has_heading, text.strip(F.ltrim(head, F.lit("#"))))
    body = F.when(has_heading, F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)
    kept = F.filter(body, lambda x: x != "")
    return F.transform(kept, lambda x: F.struct(x.alias("text"), title.alias("section_title")))


def markdown_array(value: Column) -> Column:
    """``array<struct<text, section_title>>``: heading lines name what follows them.

    The text is cut before every heading line, so each piece starts with its heading.
    """
    normal = F.regexp_replace(value, text.LINE_BREAK, "\n")
    sections = F.split(normal, f"\n(?=[{text.INLINE_WS_CLASS}]*#)")
    return F.flatten(F.transform(sections, _section_lines))


def text_blocks(docs: DataFrame) -> DataFrame:
    keep = [c for c in docs.columns if c != "text"]
    return docs.select(*keep, F.posexplode(line_array(F.col("text"))).alias("block_no", "text"))


def markdown_blocks(docs: DataFrame) -> DataFrame:
    keep = [c for c in docs.columns if c != "text"]
    exploded = docs.select(*keep, F.posexplode(markdown_array(F.col("text"))).alias("block_no", "_b"))
    return exploded.select(*keep, "block_no", "_b.text", "_b.section_title")


def paragraph_blocks(paragraphs: DataFrame) -> DataFrame:
    """Blocks of a ``document_id, ordinal, style, text`` table, under their last heading."""
    body = paragraphs.withColumn("text", text.strip(F.col("text"))).filter("text <> ''")
    heading = F.lower(F.coalesce(F.col("style"), F.lit(""))).startswith("heading")
    titled = running_last(body, ["document_id"], [F.col("ordinal")], F.when(heading, F.col("text")), "section_title")
    return (
        titled.filter(~heading)
        .select("document_id", "ordinal", "text", "section_title")
    )


def flag_empty(docs: DataFrame, blocks: DataFrame, reason: str = "Text document is empty") -> DataFrame:
    """Failure rows of documents without any block."""
    return docs.join(blocks.select("document_id"), "document_id", "left_anti").select(
        "document_id", F.lit(reason).alias("reason")
    )


def video_blocks(docs: DataFrame) -> DataFrame:
    """One title block per video, with its tags."""
    route = files.route_type(F.col("file_name"), F.col("mime_type"))
    return docs.filter(route == "video").select(
        "document_id",
        F.concat(F.lit("Video Title: "), F.col("file_name")).alias("text"),
        F.lit("Video Information").alias("section_title"),
        files.video_tags().alias("tags"),
    )
