"""Column functions over folder references, citation references and source URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.files import DRIVE
from citeloom.functions.text import strip

# --- fixed values -----------------------------------------------------------
DRIVE_HOST = "drive.google.com"
RAW_ID = "^[A-Za-z0-9_-]{10,}$"
DRIVE_VIEW = "https://drive.google.com/file/d/"
DRIVE_DOWNLOAD = "https://drive.google.com/uc?export=download&id="
# Patterns for the page of a reference; the first one that matches wins.
PAGE_PATTERNS = [r"(?i)p\.?\s*(\d+)", r"(?i)page\s*(\d+)", r"(?i)slide\s*(\d+)"]
# ----------------------------------------------------------------------------


def _blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def folder_request(value: Column) -> Column:
    """``struct(folder_id, error)`` of a folder id or folder URL."""
    text = strip(F.coalesce(value, F.lit("")))
    raw = text.rlike(RAW_ID)
    host = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    at = F.array_position(parts, F.lit("folders"))
    in_path = F.when(at > 0, F.try_element_at(parts, (at + 1).cast("int")))
    in_query = strip(F.regexp_extract(text, r"^[^?#]*\?(?:[^#]*&)?id=([^&#]+)", 1))
    query_id = F.when(in_query.rlike(RAW_ID), in_query)
    is_file = F.array_contains(parts, "file")
    error = (
        F.when(text == "", "blank")
        .when(raw, F.lit(None).cast("string"))
        .when(~host.contains(DRIVE_HOST), "foreign_host")
        .when(is_file, "file_url")
        .when(in_path.isNull() & query_id.isNull(), "no_id")
    )
    found = F.when(raw, text).otherwise(F.coalesce(in_path, query_id))
    return F.struct(F.when(error.isNull(), found).alias("folder_id"), error.alias("error"))


def source_url(storage_key: Column, base_url: str) -> Column:
    """View URL of a drive key; base URL and key for anything else."""
    drive_id = F.substring(storage_key, F.lit(len(DRIVE) + 1), F.length(storage_key))
    return (
        F.when(storage_key.startswith(DRIVE), F.concat(F.lit(DRIVE_VIEW), drive_id, F.lit("/view")))
        .when(storage_key != "", F.concat(F.lit(base_url.rstrip("/") + "/"), storage_key))
    )


def page_no(ref: Column) -> Column:
    found = [_blank_to_null(F.regexp_extract(ref, p, 1)) for p in PAGE_PATTERNS]
    return F.coalesce(*found).try_cast("bigint")


def seconds(ref: Column) -> Column:
    pattern = r"(\d{1,2}):(\d{2})"
    minutes = _blank_to_null(F.regexp_extract(ref, pattern, 1)).cast("int")
    return minutes * 60 + _blank_to_null(F.regexp_extract(ref, pattern, 2)).cast("int")


def anchored_url(url: Column, page: Column) -> Column:
    mark = F.when(url.contains("#"), F.lit("&page=")).otherwise(F.lit("#page="))
    pdf = url.rlike(r"(?i)\.pdf($|\?)")
    return F.when(pdf & page.isNotNull() & (page != 0), F.concat(url, mark, page.cast("string"))).otherwise(url)


def is_drive_url(url: Column) -> Column:
    return F.coalesce(url.contains(DRIVE_HOST), F.lit(False))


def download_url(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    in_path = _blank_to_null(F.regexp_extract(path, "/file/d/([^/]+)", 1))
    in_query = _blank_to_null(F.regexp_extract(url, r"^[^?#]*\?(?:[^#]*&)?id=([^&#]+)", 1))
    file_id = F.coalesce(in_path, F.try_url_decode(in_query))
    # a space is %20 here, not the + of form encoding
    encoded = F.replace(F.url_encode(file_id), F.lit("+"), F.lit("%20"))
    usable = is_drive_url(url) & file_id.isNotNull()
    return F.when(usable, F.concat(F.lit(DRIVE_DOWNLOAD), encoded)).otherwise(url)


def is_video(mime: Column, ref_type: Column) -> Column:
    return F.coalesce(ref_type == "video", F.lit(False)) | F.coalesce(mime.startswith("video/"), F.lit(False))


def timed_url(url: Column, secs: Column) -> Column:
    mark = F.when(url.contains("?"), F.lit("&t=")).otherwise(F.lit("?t="))
    return F.when(secs.isNotNull(), F.concat(url, mark, secs.cast("string"))).otherwise(url)


def embed_url(url: Column, secs: Column) -> Column:
    """Preview form of a drive URL (first ``/view`` only); other URLs unchanged."""
    at = F.locate("/view", url)
    preview = F.when(
        at > 0,
        F.concat(F.substring(url, F.lit(1), at - 1), F.lit("/preview"), F.substring(url, at + 5, F.length(url))),
    ).otherwise(url)
    return F.when(is_drive_url(url), timed_url(preview, secs)).otherwise(url)


def citation_ref(mime: Column, page_start: Column, page_end: Column, section: Column) -> Column:
    """``struct(ref_type, ref)`` of a chunk."""
    video = mime.startswith("video/")
    clock = F.format_string("%02d:%02d", (F.floor(page_start / 60)).cast("int"), (page_start % 60).cast("int"))
    pages = F.when(
        (page_end != 0) & (page_end != page_start), F.format_string("p.%d-%d", page_start, page_end)
    ).otherwise(F.format_string("p.%d", page_start))
    ref = (
        F.when(video & page_start.isNotNull(), clock)
        .when(video, F.lit("冒頭"))
        .when(page_start.isNotNull(), pages)
        .when(section != "", F.concat(F.lit("section:"), section))
        .otherwise("section:unknown")
    )
    return F.struct(F.when(video, "video").otherwise("page").alias("ref_type"), ref.alias("ref"))
