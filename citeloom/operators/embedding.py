"""Vectors of chunks and queries through an injected provider."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import text, vectors

Provider = Callable[[list[str]], list[list[float]]]


def hashing_provider(dim: int = 64) -> Provider:
    """Deterministic signed word-hash vectors, for tests and for runs without a model."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, value in enumerate(texts):
            for word in value.lower().split():
                code = zlib.crc32(word.encode())
                out[row, code % dim] += 1.0 if code & 0x10000 else -1.0
        return out.tolist()

    return embed


def _vectors(texts: list[str], provider: Provider) -> list:
    """A provider's vectors; none at all where it fails or returns another number of them."""
    try:
        found = list(provider(texts))
    except Exception:  # a failing provider means zero vectors, not a failed job
        found = []
    return found if len(found) == len(texts) else [None] * len(texts)


def _embed(rows: DataFrame, column: str, unit: str, provider: Provider | None, dim: int, output: str) -> DataFrame:
    """One call of the provider for each ``unit`` of a batch, so that an error stays with it."""
    if provider is None:
        return rows.withColumn(output, vectors.zeros(dim))
    schema = T.StructType([*rows.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[column].fillna("")
            found = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            for _, part in texts.groupby(batch[unit], sort=False, dropna=False):
                found.loc[part.index] = pd.Series(_vectors(part.tolist(), provider), index=part.index, dtype=object)
            batch[output] = found
            yield batch

    embedded = rows.mapInPandas(run, schema)
    fitted = vectors.fit_dimension(vectors.zero_fallback(F.col(output), dim), dim)
    return embedded.withColumn(output, fitted)


def embed_chunks(chunks: DataFrame, provider: Provider | None, dim: int = 1536) -> DataFrame:
    """Add ``embedding``; zero vectors for the documents for which the provider is missing or fails."""
    return _embed(chunks, "text", "document_id", provider, dim, "embedding")


def embed_queries(queries: DataFrame, provider: Provider | None, dim: int = 1536) -> DataFrame:
    return _embed(queries, "query_text", "query_id", provider, dim, "query_vec")


def attach_vectors(chunks: DataFrame, found: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Join stored vectors onto chunks, fitted to ``dim``; zero where none is stored."""
    joined = chunks.join(found.select(*keys, F.col("embedding")), keys, "left")
    fitted = vectors.fit_dimension(vectors.zero_fallback(F.col("embedding"), dim), dim)
    return joined.withColumn("embedding", fitted)


def embed_fallback_tag(chunks: DataFrame) -> DataFrame:
    """Documents with at least one all-zero vector, with their tag."""
    return (
        chunks.groupBy("document_id")
        .agg(F.bool_or(vectors.is_zero(F.col("embedding"))).alias("_zero"))
        .select("document_id", text.tag_list((F.col("_zero"), "EMBED_FALLBACK")).alias("tags"))
    )


def check_embedding_counts(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Documents whose number of vectors differs from their number of chunks."""
    have = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    got = found.groupBy("document_id").agg(F.count("*").alias("vectors"))
    zero = F.lit(0).cast("bigint")
    return (
        have.join(got, "document_id", "full")
        .select("document_id", F.coalesce("chunks", zero).alias("chunks"), F.coalesce("vectors", zero).alias("vectors"))
        .filter("chunks <> vectors")
        .withColumn("reason", F.lit("Embedding count mismatch"))
    )
