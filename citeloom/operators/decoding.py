"""Routing and decoding of raw documents."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import files, text

# --- fixed values: encodings tried in turn after BOM and declared charset ----
FALLBACK_ENCODINGS = [
    "utf-8-sig",
    "utf-8",
    "cp932",
    "shift_jis",
    "euc_jp",
    "iso2022_jp",
    "utf-16",
    "utf-16-le",
    "utf-16-be",
    "cp1252",
]
# ----------------------------------------------------------------------------

_CONTROL = re.compile(f"[{text.CONTROL_CLASS}]")
_MOJIBAKE = re.compile(text.MOJIBAKE)


def route_corpus(docs: DataFrame) -> DataFrame:
    """Add route, failure reason and tags, declared charset and resolved MIME type."""
    route = files.route_type(F.col("file_name"), F.col("mime_type"))
    return (
        docs.withColumn("route", route)
        .withColumn("reason", files.unsupported_reason(F.col("route")))
        .withColumn("route_tags", files.unsupported_tags(F.col("route")))
        .withColumn("charset", files.charset_from_mime(F.col("mime_type")))
        .withColumn("resolved_mime", files.resolve_mime(F.col("file_name"), F.col("mime_type")))
    )


def route_audit(docs: DataFrame) -> DataFrame:
    """Counts per extension of what the upload list accepts against where it is routed."""
    return (
        docs.select(
            F.lower(files.suffix(F.col("file_name"))).alias("ext"),
            files.upload_accepts(F.col("file_name")).alias("accepted"),
            files.route_type(F.col("file_name"), F.col("mime_type")).alias("route"),
        )
        .groupBy("ext", "accepted", "route")
        .agg(F.count("*").alias("files"))
    )


def split_uploads(uploads: DataFrame, size_col: str = "size") -> tuple[DataFrame, DataFrame]:
    """Uploads with their storage key, and the rejected (empty) ones."""
    key = files.storage_key(F.col("workspace_id"), F.col("document_id"), F.col("file_name"))
    accepted = uploads.filter(F.col(size_col) > 0).withColumn("storage_key", key)
    rejected = uploads.filter(F.coalesce(F.col(size_col), F.lit(0)) == 0)
    return accepted, rejected.withColumn("reason", F.lit("Uploaded file is empty"))


def _penalty(value: str) -> int:
    hits = len(_MOJIBAKE.findall(value))
    return 20 * len(_CONTROL.findall(value)) + 30 * value.count("\0") + 8 * hits


def _best_decoding(data: bytes, first: list[str | None]) -> tuple[str, str, bool]:
    """Strict decoding with the lowest penalty; the earliest candidate wins ties."""
    best = None
    for name in dict.fromkeys([n for n in first if n] + [codecs.lookup(n).name for n in FALLBACK_ENCODINGS]):
        try:
            value = data.decode(name)
        except UnicodeDecodeError:
            continue
        score = _penalty(value)
        if best is None or score < best[0]:
            best = (score, value, name)
        if score == 0:  # nothing later can be lower
            break
    if best is None:
        return data.decode("utf-8", errors="replace"), "utf-8(replace)", True
    return best[1], best[2], False


_DECODED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("encoding", T.StringType()),
        T.StructField("replaced", T.BooleanType()),
    ]
)


@F.pandas_udf(_DECODED)
def _decode_batch(content: pd.Series, bom: pd.Series, declared: pd.Series) -> pd.DataFrame:
    rows = [
        (None, None, None) if data is None else _best_decoding(bytes(data), [b, d])
        for data, b, d in zip(content, bom, declared)
    ]
    return pd.DataFrame(rows, columns=["text", "encoding", "replaced"])


def _clean_utf8(content: Column, declared: Column) -> Column:
    """Rows whose first candidate already decodes without penalty as UTF-8."""
    value = content.cast("string")
    return (
        F.is_valid_utf8(value)
        & (F.coalesce(declared, F.lit("utf-8")) == "utf-8")
        & files.detect_bom(content).isNull()
        & (text.decode_quality(value) == 0)
    )


def decode_corpus(raw: DataFrame) -> DataFrame:
    """Add text, encoding, replaced, mojibake and decode tags to ``content, mime_type`` rows.

    Clean UTF-8 is decoded in the JVM. Only the remaining rows carry their bytes to
    Python, for codecs Spark does not have; the others travel as nulls.
    """
    content = F.coalesce(F.col("content"), F.lit(b""))
    declared = files.charset_from_mime(F.col("mime_type"))
    simple = _clean_utf8(content, declared) | (F.length(content) == 0)
    staged = raw.withColumn("_simple", simple).withColumn("_declared", declared)
    hard = F.when(~F.col("_simple"), F.col("content"))
    staged = staged.withColumn("_hard", _decode_batch(hard, files.detect_bom(hard), F.col("_declared")))
    name = F.when((F.length(content) == 0) | F.col("_declared").isNotNull(), "utf-8").otherwise("utf-8-sig")
    out = (
        staged.withColumn("text", F.when(F.col("_simple"), content.cast("string")).otherwise(F.col("_hard.text")))
        .withColumn("encoding", F.when(F.col("_simple"), name).otherwise(F.col("_hard.encoding")))
        .withColumn("replaced", F.when(F.col("_simple"), False).otherwise(F.col("_hard.replaced")))
        .withColumn("mojibake", text.looks_like_mojibake(F.col("text")))
    )
    tags = text.decode_tags(F.col("replaced"), F.col("mojibake"))
    return out.withColumn("decode_tags", tags).drop("_simple", "_declared", "_hard")


def garble_scan(rows: DataFrame, column: str = "text") -> DataFrame:
    """Add quality penalty, mojibake flag and garbled flag of a text column."""
    value = F.col(column)
    return (
        rows.withColumn("penalty", text.decode_quality(value))
        .withColumn("mojibake", text.looks_like_mojibake(value))
        .withColumn("garbled", text.is_garbled(value))
    )
