"""Registered queries: routing, decoding, blocks, triage, chunking, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import files, text, vectors
from citeloom.operators import blocks, chunking, decoding, embedding, retrieval, triage
from citeloom.plans.views import CHUNK_OVERLAP, CHUNK_SIZE, NL, oracle, re2, table, view

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def joined(column: str):
    """Array column as one comma text, so that both engines compare plain values."""
    return F.array_join(column, ",").alias(column)


DIM = 64


def doc_files(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "docs")


def doc_texts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "docs").select("workspace_id", "document_id", "text")


def corpus_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(doc_texts(spark, sf), CHUNK_SIZE, CHUNK_OVERLAP)


# -- routing -----------------------------------------------------------------


@query
def route_corpus(spark, sf):
    routed = decoding.route_corpus(doc_files(spark, sf))
    return routed.select("document_id", "route", "reason", joined("route_tags"), "charset", "resolved_mime")


_EXT = "lower(regexp_extract(file_name, '^.+([.][^.]+)$', 1))"
_M = "lower(coalesce(mime_type, ''))"
_ROUTE = f"""CASE WHEN {_EXT} = '.pdf' OR {_M} = 'application/pdf' THEN 'pdf'
    WHEN {_EXT} = '.docx' OR {_M} IN ('application/msword', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document') THEN 'docx'
    WHEN {_EXT} IN ('.txt', '.md') OR {_M} LIKE 'text/%' THEN 'text'
    WHEN {_EXT} IN ('.ppt', '.pptx') THEN 'ppt' WHEN {_EXT} IN ('.xls', '.xlsx') THEN 'xls'
    WHEN {_EXT} IN ('.png', '.jpg', '.jpeg', '.webp', '.tif', '.tiff') THEN 'image'
    WHEN {_EXT} IN ('.mp4', '.mov', '.avi', '.mkv') OR {_M} LIKE 'video/%' THEN 'video' ELSE 'other' END"""
ORACLES["route_corpus"] = oracle(f"""
    SELECT document_id, route,
      CASE route WHEN 'ppt' THEN 'PPT/PPTX is not supported in MVP' WHEN 'xls' THEN 'XLS/XLSX is not supported in MVP'
        WHEN 'image' THEN 'Image file requires OCR (not enabled in MVP)' WHEN 'other' THEN 'Unsupported file type' END AS reason,
      CASE route WHEN 'ppt' THEN 'UNSUPPORTED_PPT,OCR_CANDIDATE' WHEN 'xls' THEN 'UNSUPPORTED_XLS,TABLE_EXTRACT_FAILED'
        WHEN 'image' THEN 'OCR_REQUIRED' WHEN 'other' THEN 'UNSUPPORTED_TYPE' END AS route_tags,
      CASE lower(regexp_extract(mime_type, 'charset=[''"]?([A-Za-z0-9._-]+)', 1)) WHEN 'shift_jis' THEN 'shift_jis' WHEN 'utf-8' THEN 'utf-8' END AS charset,
      CASE WHEN mime_type <> '' THEN mime_type ELSE CASE ext WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
        WHEN '.xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN '.mov' THEN 'video/quicktime'
        ELSE 'application/octet-stream' END END AS resolved_mime
    FROM (SELECT *, {_EXT} AS ext, {_ROUTE} AS route FROM docs)""")


@query
def route_audit(spark, sf):
    return decoding.route_audit(doc_files(spark, sf))


ORACLES["route_audit"] = oracle(f"""
    SELECT ext, ext IN ('.pdf', '.docx', '.pptx', '.xlsx', '.txt', '.md', '.png', '.jpg', '.jpeg') AS accepted, route, count(*) AS files
    FROM (SELECT {_EXT} AS ext, {_ROUTE} AS route FROM docs) GROUP BY ALL""")


@query
def upload_keys(spark, sf):
    accepted, rejected = decoding.split_uploads(doc_files(spark, sf))
    columns = ["document_id", "storage_key", "reason"]
    return (
        accepted.withColumn("reason", F.lit(None).cast("string"))
        .select(columns)
        .unionByName(rejected.withColumn("storage_key", F.lit(None).cast("string")).select(columns))
    )


ORACLES["upload_keys"] = oracle("""
    SELECT document_id, CASE WHEN size > 0 THEN 'workspaces/' || workspace_id || '/documents/' || document_id || '/' || file_name END AS storage_key,
           CASE WHEN size = 0 THEN 'Uploaded file is empty' END AS reason FROM docs""")


# -- decoding ----------------------------------------------------------------


def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page bytes in several encodings, some with a byte-order mark, some empty."""
    html, kind = F.col("html"), F.col("page_id") % 6
    mark = lambda h: F.unhex(F.lit(h))
    content = (
        F.when(kind == 0, F.encode(html, "UTF-8"))
        .when(kind == 1, F.concat(mark("EFBBBF"), F.encode(html, "UTF-8")))
        .when(kind == 2, F.concat(mark("FFFE"), F.encode(html, "UTF-16LE")))
        .when(kind == 3, F.concat(mark("0000FEFF"), F.encode(html, "UTF-32")))
        .when(kind == 4, F.encode(F.translate(html, "\0", ""), "UTF-8"))
        .otherwise(F.lit(b""))
    )
    mime = F.when(kind == 4, "text/html; charset=utf8").otherwise("text/html")
    return table(spark, sf, "pages").select("page_id", content.alias("content"), mime.alias("mime_type"))


@query
def detect_bom(spark, sf):
    return raw_pages(spark, sf).select("page_id", files.detect_bom(F.col("content")).alias("bom"))


ORACLES["detect_bom"] = "SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'utf-8-sig' WHEN 2 THEN 'utf-16' WHEN 3 THEN 'utf-32' END AS bom FROM pages"


@query
def decode_corpus(spark, sf):
    out = decoding.decode_corpus(raw_pages(spark, sf))
    return out.select("page_id", "encoding", "replaced", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"), joined("decode_tags"))


_HITS = "len(regexp_extract_all({0}, 'Ã[^\\n]|Â[^\\n]|ã[^\\n]|â[^\\n]|ð[^\\n]|�'))"


def _count(column: str, char_class: str) -> str:
    return f"(length({column}) - length(regexp_replace({column}, '[{re2(char_class)}]', '', 'g')))"


def _mojibake(c: str) -> str:
    hits = _HITS.format(c)
    return f"({hits} >= 8 OR ({hits} >= 3 AND {hits} / greatest(length({c}), 1) >= 0.03))"


def _garbled(c: str) -> str:
    allowed = f"({_count(c, text.ALLOWED_CLASS)} / length({c}))"
    suspicious = _count(c, text.SUSPICIOUS_CLASS)
    control = _count(c, text.CONTROL_CLASS)
    return (
        f"CASE WHEN coalesce({c}, '') = '' THEN false WHEN {_mojibake(c)} THEN true WHEN {control} > 0 AND {allowed} < 0.85 THEN true "
        f"WHEN {suspicious} >= 4 AND {suspicious} / length({c}) >= 0.05 THEN true ELSE {allowed} < 0.45 END"
    )


ORACLES["decode_corpus"] = f"""
    SELECT page_id, CASE page_id % 6 WHEN 2 THEN 'utf-16' WHEN 3 THEN 'utf-32' WHEN 4 THEN 'utf-8' WHEN 5 THEN 'utf-8' ELSE 'utf-8-sig' END AS encoding,
           false AS replaced, CASE WHEN page_id % 6 = 5 THEN 0 ELSE length(html) END AS chars,
           md5(CASE WHEN page_id % 6 = 5 THEN '' ELSE html END) AS digest,
           CASE WHEN page_id % 6 <> 5 AND {_mojibake('html')} THEN 'POSSIBLE_MOJIBAKE' ELSE '' END AS decode_tags
    FROM pages"""


@query
def garble_scan(spark, sf):
    """Page scans: clean, damaged and control-laden texts."""
    out = decoding.garble_scan(view(spark, sf, "scans"), "raw_text")
    return out.select("document_id", "page", "penalty", "mojibake", "garbled")


ORACLES["garble_scan"] = oracle(f"""
    SELECT document_id, page,
           20 * {_count('raw_text', text.CONTROL_CLASS)} + 30 * (length(raw_text) - length(replace(raw_text, chr(0), ''))) + 8 * {_HITS.format('raw_text')} AS penalty,
           {_mojibake('raw_text')} AS mojibake, {_garbled('raw_text')} AS garbled FROM scans""")


# -- blocks ------------------------------------------------------------------


@query
def text_blocks(spark, sf):
    out = blocks.text_blocks(doc_texts(spark, sf))
    return out.select("document_id", F.col("block_no").cast("bigint").alias("block_no"), "text")


ORACLES["text_blocks"] = oracle("SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1 AS block_no, line AS text FROM doc_lines")


@query
def markdown_blocks(spark, sf):
    out = blocks.markdown_blocks(view(spark, sf, "markdown"))
    return out.select("document_id", F.col("block_no").cast("bigint").alias("block_no"), "text", "section_title")


_MD_LINES = f"""
    SELECT document_id, pos, trim(s, '{text.WS_CHARS}') AS line
    FROM (SELECT document_id, unnest(range(len(a))) AS pos, unnest(a) AS s
          FROM (SELECT document_id, regexp_split_to_array(text, '{re2(text.LINE_BREAK)}') AS a FROM markdown))
    WHERE trim(s, '{text.WS_CHARS}') <> ''"""
ORACLES["markdown_blocks"] = oracle(
    f"""
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1 AS block_no, line AS text, section_title
    FROM (SELECT *, last_value(CASE WHEN line LIKE '#%' THEN trim(ltrim(line, '#'), '{text.WS_CHARS}') END IGNORE NULLS)
             OVER (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section_title FROM md_lines)
    WHERE line NOT LIKE '#%'""",
    md_lines=_MD_LINES,
)


@query
def paragraph_blocks(spark, sf):
    return blocks.paragraph_blocks(view(spark, sf, "paragraphs"))


ORACLES["paragraph_blocks"] = oracle(f"""
    SELECT document_id, ordinal, text, section_title
    FROM (SELECT document_id, ordinal, style, trim(text, '{text.WS_CHARS}') AS text,
                 last_value(CASE WHEN lower(coalesce(style, '')) LIKE 'heading%' THEN trim(text, '{text.WS_CHARS}') END IGNORE NULLS)
                   OVER (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS section_title
          FROM paragraphs WHERE trim(text, '{text.WS_CHARS}') <> '')
    WHERE lower(coalesce(style, '')) NOT LIKE 'heading%'""")


@query
def flag_empty(spark, sf):
    """Scans as plain documents: pages without any line."""
    pages = view(spark, sf, "scans").select(F.concat_ws(":", "document_id", "page").alias("document_id"), F.col("raw_text").alias("text"))
    return blocks.flag_empty(pages, blocks.text_blocks(pages))


ORACLES["flag_empty"] = oracle(f"""
    SELECT document_id || ':' || page AS document_id, 'Text document is empty' AS reason FROM scans
    WHERE trim(raw_text, '{text.WS_CHARS}') = ''""")


@query
def video_blocks(spark, sf):
    return blocks.video_blocks(doc_files(spark, sf)).select("document_id", "text", "section_title", joined("tags"))


ORACLES["video_blocks"] = oracle(f"""
    SELECT document_id, 'Video Title: ' || file_name AS text, 'Video Information' AS section_title, 'VIDEO_CONTENT,TITLE_ONLY' AS tags
    FROM docs WHERE {_ROUTE} = 'video'""")


# -- triage ------------------------------------------------------------------


@query
def ocr_budget(spark, sf):
    out = triage.apply_ocr_budget(view(spark, sf, "scans"), max_pages=2)
    return out.select("document_id", "page", F.col("ocr_text").isNotNull().alias("kept"))


_JUDGED = f"""
    SELECT *, length(native) < 40 OR is_garbled AS is_low FROM (
      SELECT *, {_garbled('native')} AS is_garbled FROM (SELECT *, trim(raw_text, '{text.WS_CHARS}') AS native FROM scans))"""
ORACLES["ocr_budget"] = oracle(
    """
    SELECT document_id, page, is_low AND ocr_text IS NOT NULL AND
           sum(CAST(is_low AS INT)) OVER (PARTITION BY document_id ORDER BY page) <= 2 AS kept FROM judged""",
    judged=_JUDGED,
)

_TRIAGED = f"""
    SELECT document_id, page, is_low, is_garbled, outcome,
           CASE WHEN outcome IN ('native', 'short_native') THEN native WHEN outcome IN ('ocr', 'short_ocr') THEN ocr END AS text
    FROM (SELECT *, CASE WHEN NOT is_low THEN 'native' WHEN ocr_ok AND length(ocr) >= 40 THEN 'ocr' WHEN ocr_ok THEN 'short_ocr'
                    WHEN native <> '' AND NOT is_garbled THEN 'short_native' ELSE 'failed' END AS outcome
          FROM (SELECT *, ocr <> '' AND NOT ({_garbled('ocr')}) AS ocr_ok
                FROM (SELECT *, trim(coalesce(ocr_text, ''), '{text.WS_CHARS}') AS ocr FROM judged)))"""


@query
def triage_pages(spark, sf):
    return triage.triage_pages(view(spark, sf, "scans"))


ORACLES["triage_pages"] = oracle(
    """
    SELECT *, outcome IN ('ocr', 'short_ocr') AS used_ocr, outcome IN ('short_ocr', 'short_native') AS is_short, outcome = 'failed' AS is_failed
    FROM triaged""",
    judged=_JUDGED,
    triaged=_TRIAGED,
)


@query
def parse_report(spark, sf):
    out = triage.parse_report(triage.triage_pages(view(spark, sf, "scans")), view(spark, sf, "scan_ocr"))
    failed = F.array_join(F.transform("failed_pages", lambda p: F.concat_ws("=", p["page"], p["reason"])), ",")
    return out.select(
        "document_id", "page_count", "extracted_pages", failed.alias("failed_pages"),
        F.array_join(F.col("ocr_used_pages").cast("array<string>"), ",").alias("ocr_used_pages"), joined("tags"), "doc_text",
    )


_REPORTED = f"""
    SELECT document_id, CAST(page_count AS INT) AS page_count, CAST(CASE WHEN whole THEN page_count ELSE extracted END AS INT) AS extracted_pages,
           CASE WHEN whole THEN '' ELSE coalesce(failed, '') END AS failed_pages,
           CASE WHEN whole THEN array_to_string(range(1, page_count + 1), ',') ELSE coalesce(used, '') END AS ocr_used_pages,
           array_to_string(list_filter([CASE WHEN whole THEN 'DOC_OCR' END, CASE WHEN low / page_count >= 0.5 THEN 'IMAGE_ONLY_PDF' END,
             CASE WHEN short THEN 'SHORT_TEXT_INCLUDED' END, CASE WHEN garbled THEN 'POSSIBLE_MOJIBAKE' END,
             CASE WHEN whole OR used IS NOT NULL THEN 'OCR_USED' END, CASE WHEN extracted = 0 AND NOT whole THEN 'OCR_REQUIRED' END], lambda x: x IS NOT NULL), ',') AS tags,
           CASE WHEN whole THEN doc_ocr_text END AS doc_text
    FROM (SELECT *, extracted = 0 AND NOT ({_garbled('doc_ocr_text')}) AS whole
          FROM (SELECT document_id, count(*) AS page_count, count(*) FILTER (outcome <> 'failed') AS extracted,
                       string_agg(page || '=image_only_or_no_text', ',' ORDER BY page) FILTER (outcome = 'failed') AS failed,
                       string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FILTER (outcome IN ('ocr', 'short_ocr')) AS used,
                       count(*) FILTER (is_low) AS low, bool_or(outcome IN ('short_ocr', 'short_native')) AS short, bool_or(is_garbled) AS garbled
                FROM triaged GROUP BY document_id) JOIN scan_ocr USING (document_id))"""
ORACLES["parse_report"] = oracle("SELECT * FROM reported", judged=_JUDGED, triaged=_TRIAGED, reported=_REPORTED)


@query
def page_blocks(spark, sf):
    pages = triage.triage_pages(view(spark, sf, "scans"))
    report = triage.parse_report(pages, view(spark, sf, "scan_ocr"))
    return triage.page_blocks(pages, report).drop("block_no")


ORACLES["page_blocks"] = oracle(
    """
    SELECT document_id, text, page, CAST(NULL AS VARCHAR) AS section_title FROM triaged WHERE outcome <> 'failed'
    UNION ALL SELECT document_id, doc_text, NULL, 'Document OCR' FROM reported WHERE doc_text IS NOT NULL""",
    judged=_JUDGED,
    triaged=_TRIAGED,
    reported=_REPORTED,
)


@query
def image_candidates(spark, sf):
    """Page bodies as images: six kinds of leading bytes and names, five images to a page."""
    kind = F.col("page_id") % 6
    magic = (
        F.when(kind == 0, F.unhex(F.lit("FFD8FF"))).when(kind == 1, F.unhex(F.lit("89504E470D0A1A0A")))
        .when(kind == 2, F.unhex(F.lit("49492A00"))).when(kind == 3, F.encode(F.lit("GIF89a"), "UTF-8"))
        .when(kind == 4, F.encode(F.lit("RIFF0000WEBP"), "UTF-8")).otherwise(F.encode(F.lit("none"), "UTF-8"))
    )
    name = F.when(F.col("page_id") % 10 == 5, "scan.TIFF").otherwise("im")
    body = F.when(F.col("page_id") % 7 == 0, F.lit(b"x")).otherwise(F.encode("html", "UTF-8"))
    images = table(spark, sf, "pages").select(
        F.floor(F.col("page_id") / 50).cast("string").alias("document_id"),
        F.floor(F.col("page_id") % 50 / 5).cast("int").alias("page"),
        F.col("page_id").alias("image_no"),
        name.alias("name"),
        F.concat(magic, body).alias("content"),
    )
    return triage.image_candidates(images).select("document_id", "page", "image_no", "mime", F.col("size").cast("bigint").alias("size"), "rank")


ORACLES["image_candidates"] = """
    SELECT document_id, page, image_no, mime, size, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY size DESC, image_no) AS rank FROM (
        SELECT CAST(page_id // 50 AS VARCHAR) AS document_id, CAST(page_id % 50 // 5 AS INT) AS page, page_id AS image_no,
          CASE WHEN page_id % 10 = 5 THEN 'image/tiff' ELSE CASE page_id % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/tiff'
               WHEN 3 THEN 'image/gif' WHEN 4 THEN 'image/webp' ELSE 'application/octet-stream' END END AS mime,
          CASE page_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 8 WHEN 2 THEN 4 WHEN 3 THEN 6 WHEN 4 THEN 12 ELSE 4 END
            + CASE WHEN page_id % 7 = 0 THEN 1 ELSE octet_length(encode(html)) END AS size FROM pages)
      WHERE size >= 128 AND mime LIKE 'image/%') WHERE rank <= 3"""


# -- chunking ----------------------------------------------------------------


@query
def split_paragraphs(spark, sf):
    """Pages as markdown text: blank lines separate paragraphs."""
    rows = view(spark, sf, "markdown").select("document_id", F.posexplode(chunking.split_paragraphs(F.col("text"))).alias("n", "paragraph"))
    return rows.select("document_id", F.col("n").cast("bigint").alias("n"), "paragraph")


_PARAGRAPHS = f"""
    SELECT document_id, pos, trim(s, '{text.WS_CHARS}') AS paragraph
    FROM (SELECT document_id, unnest(range(len(a))) AS pos, unnest(a) AS s
          FROM (SELECT document_id, string_split(replace(replace(text, '\r\n', '\n'), '\r', '\n'), '\n\n') AS a FROM markdown))
    WHERE trim(s, '{text.WS_CHARS}') <> ''"""
ORACLES["split_paragraphs"] = oracle(
    "SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1 AS n, paragraph FROM paras",
    paras=_PARAGRAPHS,
)


@query
def hard_split(spark, sf):
    rows = doc_texts(spark, sf).select("document_id", F.posexplode(chunking.hard_split(F.col("text"), 1000)).alias("n", "piece"))
    return rows.select("document_id", F.col("n").cast("bigint").alias("n"), "piece")


ORACLES["hard_split"] = oracle("""
    SELECT document_id, n, substr(text, n * 1000 + 1, 1000) AS piece
    FROM (SELECT document_id, text, unnest(range(CAST(ceil(length(text) / 1000.0) AS INT))) AS n FROM docs)""")


@query
def build_units(spark, sf):
    """Whole documents as single blocks, cut at 500 characters."""
    rows = doc_texts(spark, sf).withColumn("block_no", F.lit(0))
    out = chunking.build_units(rows, 500)
    return out.select("document_id", F.col("unit_no").cast("bigint").alias("unit_no"), "text")


ORACLES["build_units"] = oracle(
    f"""
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY pos, n) - 1 AS unit_no, unit AS text
    FROM (SELECT document_id, pos, n, trim(substr(p, n * 500 + 1, 500), '{text.WS_CHARS}') AS unit
          FROM (SELECT *, unnest(range(CAST(ceil(length(p) / 500.0) AS INT))) AS n FROM whole))
    WHERE unit <> ''""",
    whole=f"""
    SELECT document_id, pos, trim(s, '{text.WS_CHARS}') AS p
    FROM (SELECT document_id, unnest(range(len(a))) AS pos, unnest(a) AS s
          FROM (SELECT document_id, string_split(replace(replace(text, '\r\n', '\n'), '\r', '\n'), '\n\n') AS a FROM docs))
    WHERE trim(s, '{text.WS_CHARS}') <> ''""",
)

_CHUNK_COLUMNS = ["chunk_id", "workspace_id", "document_id", "chunk_index", "text", "snippet"]


@query
def chunk_documents(spark, sf):
    return corpus_chunks(spark, sf).select(_CHUNK_COLUMNS)


ORACLES["chunk_documents"] = oracle("SELECT * FROM chunks")


@query
def build_chunks(spark, sf):
    """The same chunks from a unit table: one shuffle by document, then a streaming fold."""
    lines = blocks.text_blocks(doc_texts(spark, sf))
    none = F.lit(None)
    units = chunking.build_units(lines, CHUNK_SIZE).withColumns({"page": none.cast("int"), "section_title": none.cast("string")})
    return chunking.build_chunks(units, CHUNK_SIZE, CHUNK_OVERLAP).select(_CHUNK_COLUMNS)


ORACLES["build_chunks"] = ORACLES["chunk_documents"]


@query
def chunk_scans(spark, sf):
    """Page blocks of scanned documents packed into chunks with their page span."""
    pages = triage.triage_pages(view(spark, sf, "scans"))
    report = triage.parse_report(pages, view(spark, sf, "scan_ocr"))
    rows = triage.page_blocks(pages, report).withColumn("workspace_id", F.lit("ws0"))
    out = chunking.build_chunks(chunking.build_units(rows, 300), 300, 40)
    return out.select("document_id", "chunk_index", "text", "page_start", "page_end", "section_title")


_SCAN_VIEWS = {
    "judged": _JUDGED,
    "triaged": _TRIAGED,
    "reported": _REPORTED,
    "scan_blocks": """
        SELECT document_id, page AS block_no, text, page, CAST(NULL AS VARCHAR) AS section FROM triaged WHERE outcome <> 'failed'
        UNION ALL SELECT document_id, 0, doc_text, NULL, 'Document OCR' FROM reported WHERE doc_text IS NOT NULL""",
    "scan_paras": f"""
        SELECT document_id, block_no, page, section, pos, trim(s, '{text.WS_CHARS}') AS p
        FROM (SELECT *, unnest(range(len(a))) AS pos, unnest(a) AS s
              FROM (SELECT *, string_split(replace(replace(text, '\r\n', '\n'), '\r', '\n'), '\n\n') AS a FROM scan_blocks))
        WHERE trim(s, '{text.WS_CHARS}') <> ''""",
    "scan_units": f"""
        SELECT document_id, page, section, unit, row_number() OVER (PARTITION BY document_id ORDER BY block_no, pos, n) AS unit_no
        FROM (SELECT *, trim(substr(p, n * 300 + 1, 300), '{text.WS_CHARS}') AS unit
              FROM (SELECT *, unnest(range(CAST(ceil(length(p) / 300.0) AS INT))) AS n FROM scan_paras)) WHERE unit <> ''""",
    "scan_fold": f"""
        SELECT document_id, unit_no, length(unit) AS cur_len, unit AS body, page AS lo, page AS hi, section, 0 AS chunk_index,
               CAST(NULL AS VARCHAR) AS done, CAST(NULL AS INT) AS done_lo, CAST(NULL AS INT) AS done_hi
        FROM scan_units WHERE unit_no = 1
        UNION ALL
        SELECT document_id, unit_no, CASE WHEN cut THEN least(length(body), 40) ELSE cur_len END + length(unit) + 1,
               CASE WHEN cut THEN trim(right(body, 40), '{text.WS_CHARS}') ELSE body END || chr(10) || unit,
               least(CASE WHEN cut THEN hi ELSE lo END, page), greatest(hi, page), coalesce(section, next_section),
               chunk_index + CAST(cut AS INT), CASE WHEN cut THEN body END, CASE WHEN cut THEN lo END, CASE WHEN cut THEN hi END
        FROM (SELECT f.document_id, u.unit_no, f.cur_len, f.body, f.lo, f.hi, f.section, u.section AS next_section, f.chunk_index, u.unit, u.page,
                     f.cur_len + length(u.unit) + 1 > 300 AS cut
              FROM scan_fold f JOIN scan_units u ON u.document_id = f.document_id AND u.unit_no = f.unit_no + 1)""",
}
ORACLES["chunk_scans"] = oracle(
    """
    SELECT document_id, chunk_index - 1 AS chunk_index, done AS text, done_lo AS page_start, done_hi AS page_end, section AS section_title FROM scan_fold WHERE done IS NOT NULL
    UNION ALL SELECT document_id, chunk_index, body, lo, hi, section FROM scan_fold
    QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY unit_no DESC) = 1""",
    **_SCAN_VIEWS,
)


@query
def snippets(spark, sf):
    return doc_texts(spark, sf).select("document_id", text.snippet(F.col("text")).alias("snippet"))


ORACLES["snippets"] = oracle(f"SELECT document_id, substr(regexp_replace(text, '[{re2(text.WS_CLASS)}]+', ' ', 'g'), 1, 300) AS snippet FROM docs")


# -- vectors -----------------------------------------------------------------


_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_LETTER_SQL = "concat_ws(',', " + ", ".join(f"length({{text}}) - length(replace({{text}}, '{c}', ''))" for c in _ALPHABET) + ")"


def _letters(texts: list[str]) -> list[list[float]]:
    """A provider that SQL can state: how often a text has each small letter; shorter than asked for."""
    return [[float(t.count(c)) for c in _ALPHABET] for t in texts]


def _counts(vec: str) -> list:
    seen = F.transform(F.slice(vec, 1, len(_ALPHABET)), lambda x: x.cast("int").cast("string"))
    return [F.size(vec).alias("dim"), F.array_join(seen, ",").alias("letters")]


@query
def embed_chunks(spark, sf):
    """Vectors of every chunk by a provider that counts letters."""
    out = embedding.embed_chunks(corpus_chunks(spark, sf), _letters, DIM)
    return out.select("chunk_id", *_counts("embedding"))


ORACLES["embed_chunks"] = oracle(f"SELECT chunk_id, {DIM} AS dim, {_LETTER_SQL.format(text='text')} AS letters FROM chunks")


@query
def embed_queries(spark, sf):
    out = embedding.embed_queries(view(spark, sf, "queries"), _letters, DIM)
    return out.select("query_id", *_counts("query_vec"))


ORACLES["embed_queries"] = oracle(f"SELECT query_id, {DIM} AS dim, {_LETTER_SQL.format(text='query_text')} AS letters FROM queries")


def _summary(vec: str) -> list:
    total = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return [F.size(vec).cast("bigint").alias("dim"), F.round(total, 4).alias("total")]


@query
def fit_dimension(spark, sf):
    rows = table(spark, sf, "embeddings")
    both = [rows.select("vec_id", F.lit(n).alias("asked"), vectors.fit_dimension(F.col("embedding"), n).alias("v")) for n in (16, 64, 100)]
    return both[0].unionAll(both[1]).unionAll(both[2]).select("vec_id", "asked", *_summary("v"))


ORACLES["fit_dimension"] = """
    SELECT vec_id, CAST(asked AS INT) AS asked, asked AS dim, round(list_sum(list_transform(embedding[1:asked], lambda x: CAST(x AS DOUBLE))), 4) AS total
    FROM embeddings CROSS JOIN (SELECT unnest([16, 64, 100]) AS asked)"""


@query
def zero_fallback(spark, sf):
    """Stored vectors joined onto documents; documents without one get zeros."""
    docs = view(spark, sf, "docs").select("document_id", F.col("doc_id").alias("vec_id"))
    out = embedding.attach_vectors(docs, table(spark, sf, "embeddings"), ["vec_id"], DIM)
    return out.select("document_id", vectors.is_zero(F.col("embedding")).alias("is_zero"), *_summary("embedding"))


ORACLES["zero_fallback"] = oracle("""
    SELECT document_id, vec_id IS NULL AS is_zero, 64 AS dim,
           coalesce(round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4), 0) AS total
    FROM docs LEFT JOIN embeddings ON vec_id = doc_id""")


@query
def embed_fallback_tag(spark, sf):
    """Sources whose documents lack a vector."""
    docs = view(spark, sf, "docs").select(F.col("workspace_id").alias("document_id"), F.col("doc_id").alias("vec_id"))
    out = embedding.embed_fallback_tag(embedding.attach_vectors(docs, table(spark, sf, "embeddings"), ["vec_id"], DIM))
    return out.select("document_id", joined("tags"))


ORACLES["embed_fallback_tag"] = oracle("""
    SELECT workspace_id AS document_id, CASE WHEN bool_or(vec_id IS NULL) THEN 'EMBED_FALLBACK' ELSE '' END AS tags
    FROM docs LEFT JOIN embeddings ON vec_id = doc_id GROUP BY workspace_id""")


@query
def check_embedding_counts(spark, sf):
    """Labels as documents: turns stand for chunks, vectors for vectors."""
    chunks = table(spark, sf, "conversations").select((F.col("conv_id") % 12).alias("document_id"))
    found = table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("document_id"))
    return embedding.check_embedding_counts(chunks, found)


ORACLES["check_embedding_counts"] = """
    SELECT document_id, coalesce(chunks, 0) AS chunks, coalesce(vectors, 0) AS vectors, 'Embedding count mismatch' AS reason
    FROM (SELECT conv_id % 12 AS document_id, count(*) AS chunks FROM conversations GROUP BY 1)
    FULL JOIN (SELECT label AS document_id, count(*) AS vectors FROM embeddings GROUP BY 1) USING (document_id)
    WHERE coalesce(chunks, 0) <> coalesce(vectors, 0)"""


@query
def build_postings(spark, sf):
    """Occurrences of each term per workspace, from the positional full-text table."""
    out = retrieval.build_postings(corpus_chunks(spark, sf))
    return out.groupBy("workspace_id", "term").agg(
        F.count("*").alias("occurrences"), F.sum(F.col("pos").cast("bigint")).alias("positions"), F.count_distinct("chunk_id").alias("chunks")
    )


_POSTINGS = """
    SELECT workspace_id, chunk_id, unnest(range(1, len(a) + 1)) AS pos, unnest(a) AS term
    FROM (SELECT workspace_id, chunk_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS a FROM chunks)"""
ORACLES["build_postings"] = oracle(
    """
    SELECT workspace_id, term, count(*) AS occurrences, CAST(sum(pos) AS BIGINT) AS positions, count(DISTINCT chunk_id) AS chunks
    FROM postings GROUP BY workspace_id, term""",
    postings=_POSTINGS,
)
