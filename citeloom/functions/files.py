"""Column functions over file names, MIME types, storage keys and leading bytes."""

from __future__ import annotations

import codecs
from encodings.aliases import aliases

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.text import tag_list

# --- fixed values -----------------------------------------------------------
DOCX_MIMES = [
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/msword",
]
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff"]
ROUTED_VIDEO = [".mp4", ".mov", ".avi", ".mkv"]
LISTED_VIDEO = [".mp4", ".mov", ".avi", ".mkv", ".m4v", ".webm"]
UPLOAD_EXTENSIONS = [".pdf", ".docx", ".pptx", ".xlsx", ".txt", ".md", ".png", ".jpg", ".jpeg"]
# route -> (failure reason, tags)
UNSUPPORTED = {
    "ppt": ("PPT/PPTX is not supported in MVP", ["UNSUPPORTED_PPT", "OCR_CANDIDATE"]),
    "xls": ("XLS/XLSX is not supported in MVP", ["UNSUPPORTED_XLS", "TABLE_EXTRACT_FAILED"]),
    "image": ("Image file requires OCR (not enabled in MVP)", ["OCR_REQUIRED"]),
    "other": ("Unsupported file type", ["UNSUPPORTED_TYPE"]),
}
GUESSED_MIMES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".doc": "application/msword",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".ppt": "application/vnd.ms-powerpoint",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".xls": "application/vnd.ms-excel",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".csv": "text/csv",
    ".html": "text/html",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".gif": "image/gif",
    ".webp": "image/webp",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".mp4": "video/mp4",
    ".mov": "video/quicktime",
    ".avi": "video/x-msvideo",
    ".mkv": "video/x-matroska",
    ".m4v": "video/x-m4v",
    ".webm": "video/webm",
}
OCTET_STREAM = "application/octet-stream"
DRIVE = "drive://"
# ----------------------------------------------------------------------------


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in pairs.items() for part in pair])


def base_name(name: Column) -> Column:
    return F.substring_index(F.regexp_replace(name, "/+$", ""), "/", -1)


def suffix(name: Column) -> Column:
    """Last extension with its dot; a leading or trailing dot starts none."""
    return F.regexp_extract(base_name(name), r"(?s)^.+(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(base_name(name), r"(?s)^(.+)\.[^.]+$", "$1")


def _extension(name: Column) -> Column:
    return F.lower(suffix(name))


def route_type(name: Column, mime: Column) -> Column:
    """pdf, docx, text, ppt, xls, image, video or other; the first rule wins."""
    ext, kind = _extension(name), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when((ext == ".pdf") | (kind == "application/pdf"), "pdf")
        .when((ext == ".docx") | kind.isin(DOCX_MIMES), "docx")
        .when(ext.isin(".txt", ".md") | kind.startswith("text/"), "text")
        .when(ext.isin(".ppt", ".pptx"), "ppt")
        .when(ext.isin(".xls", ".xlsx"), "xls")
        .when(ext.isin(IMAGE_EXTENSIONS), "image")
        .when(ext.isin(ROUTED_VIDEO) | kind.startswith("video/"), "video")
        .otherwise("other")
    )


def unsupported_reason(route: Column) -> Column:
    return F.try_element_at(_literal_map({r: why for r, (why, _) in UNSUPPORTED.items()}), route)


def unsupported_tags(route: Column) -> Column:
    out = None
    for name, (_, tags) in UNSUPPORTED.items():
        value = F.array(*[F.lit(t) for t in tags])
        out = F.when(route == name, value) if out is None else out.when(route == name, value)
    return out


def upload_accepts(name: Column) -> Column:
    return _extension(name).isin(UPLOAD_EXTENSIONS)


def is_listed_video(name: Column, mime: Column) -> Column:
    return F.lower(F.coalesce(mime, F.lit(""))).startswith("video/") | _extension(
        F.coalesce(name, F.lit(""))
    ).isin(LISTED_VIDEO)


def resolve_mime(name: Column, declared: Column) -> Column:
    guessed = F.try_element_at(_literal_map(GUESSED_MIMES), _extension(name))
    return F.coalesce(F.when(declared != "", declared), guessed, F.lit(OCTET_STREAM))


def storage_key(workspace: Column, document: Column, name: Column) -> Column:
    return F.concat(
        F.lit("workspaces/"), workspace, F.lit("/documents/"), document, F.lit("/"), base_name(name)
    )


def _charset_names() -> dict[str, str]:
    """Alias to codec name, for every text codec the Python runtime knows."""
    names = {}
    for alias in sorted(set(aliases) | set(aliases.values())):
        try:
            names[alias.replace(".", "_")] = codecs.lookup(alias).name
        except LookupError:
            continue
    return names


def charset_from_mime(mime: Column) -> Column:
    """Codec name declared in a MIME parameter; null when absent or unknown."""
    found = F.regexp_extract(mime, r"(?i)charset\s*=\s*['\"]?([a-zA-Z0-9._\-]+)", 1)
    key = F.regexp_replace(F.lower(found), "[^0-9a-z]+", "_")
    return F.try_element_at(_literal_map(_charset_names()), key)


def _starts(content: Column, *prefixes: str) -> Column:
    """True when the bytes start with one of the given hex strings."""
    head = F.hex(F.substring(content, 1, 16))
    test = head.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        test = test | head.startswith(prefix)
    return test


def detect_bom(content: Column) -> Column:
    return (
        F.when(_starts(content, "EFBBBF"), "utf-8-sig")
        .when(_starts(content, "FFFE0000", "0000FEFF"), "utf-32")
        .when(_starts(content, "FFFE", "FEFF"), "utf-16")
    )


def image_mime(name: Column, content: Column) -> Column:
    """By name suffix, then by leading bytes, else octet-stream."""
    low = F.lower(F.coalesce(name, F.lit("")))
    webp = _starts(content, "52494646") & F.hex(F.substring(content, 1, 16)).rlike("^(..)*57454250")
    return (
        F.when(low.endswith(".jpg") | low.endswith(".jpeg"), "image/jpeg")
        .when(low.endswith(".png"), "image/png")
        .when(low.endswith(".webp"), "image/webp")
        .when(low.endswith(".tif") | low.endswith(".tiff"), "image/tiff")
        .when(low.endswith(".gif"), "image/gif")
        .when(_starts(content, "FFD8FF"), "image/jpeg")
        .when(_starts(content, "89504E470D0A1A0A"), "image/png")
        .when(_starts(content, "49492A00", "4D4D002A"), "image/tiff")
        .when(_starts(content, "474946383761", "474946383961"), "image/gif")
        .when(webp, "image/webp")
        .otherwise(OCTET_STREAM)
    )


def video_tags() -> Column:
    return tag_list((F.lit(True), "VIDEO_CONTENT"), (F.lit(True), "TITLE_ONLY"))
