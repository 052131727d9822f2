"""Units and overlapping chunks.

Packing cuts the units of one document by their running lengths. It runs over Arrow
batches and holds the units of one document at a time.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate, groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text
from citeloom.operators import blocks as B

CHUNK_SCHEMA = (
    "workspace_id string, document_id string, chunk_index int, text string, "
    "page_start int, page_end int, section_title string"
)
_ARROW_SCHEMA = pa.schema(
    [
        ("workspace_id", pa.string()),
        ("document_id", pa.string()),
        ("chunk_index", pa.int32()),
        ("text", pa.string()),
        ("page_start", pa.int32()),
        ("page_end", pa.int32()),
        ("section_title", pa.string()),
    ]
)
_FLUSH_ROWS = 4096


def split_paragraphs(value: Column) -> Column:
    """Stripped non-blank paragraphs; blank lines separate them."""
    normal = F.replace(F.replace(value, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.filter(F.transform(F.split(normal, "\n\n"), text.strip), lambda p: p != "")


def hard_split(value: Column, size: int) -> Column:
    """Consecutive pieces of at most ``size`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda i: F.substring(value, i, size))


def _limited(parts: Column, size: int) -> Column:
    pieces = F.flatten(
        F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(hard_split(p, size)))
    )
    return F.filter(F.transform(pieces, text.strip), lambda u: u != "")


def unit_array(value: Column, size: int) -> Column:
    return _limited(split_paragraphs(value), size)


def build_units(blocks: DataFrame, size: int = 4200) -> DataFrame:
    """Explode blocks into units; ``(block_no, unit_no)`` is their order in the document."""
    keep = [c for c in blocks.columns if c != "text"]
    units = blocks.select(*keep, F.posexplode(unit_array(F.col("text"), size)).alias("unit_no", "text"))
    return units


def _chunks_of(units: list[tuple], size: int, overlap: int) -> Iterator[tuple]:
    """Chunks of one document's ``(text, page, section)`` units.

    ``ends`` are running lengths with one line feed per unit, so the units that fit beside the
    tail of the chunk before are found by bisection; a chunk takes one unit at least.
    """
    ends = list(accumulate((len(body) + 1 for body, _, _ in units), initial=0))
    first, tail, before = 0, "", (None, None)
    while first < len(units):
        fitting = ends[first] + size - len(tail) + (0 if tail else 1)
        last = max(first + 1, bisect_right(ends, fitting) - 1)
        run = [(tail.strip(), *before)] if tail else []
        run += units[first:last]
        bodies, pages, titles = zip(*run)
        known = [p for p in pages if p is not None]
        body, title = "\n".join(bodies), next(filter(None, titles), None)
        yield body, min(known, default=None), max(known, default=None), title
        tail = body[-overlap:] if overlap else ""  # no tail at all for overlap 0
        if not tail.strip():
            tail = ""
        first, before = last, (max(known, default=None), title)


def _pack(units: Iterable[tuple], size: int, overlap: int) -> Iterator[tuple]:
    """Chunks of ``(workspace, document, text, page, section)`` rows, documents contiguous; one document is held at a time."""
    for owner, rows in groupby(units, key=itemgetter(0, 1)):
        for index, chunk in enumerate(_chunks_of([row[2:] for row in rows], size, overlap)):
            yield (*owner, index, *chunk)


def _as_batches(chunks: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    rows = []
    for chunk in chunks:
        rows.append(chunk)
        if len(rows) >= _FLUSH_ROWS:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    arrays = [pa.array(col, type=field.type) for col, field in zip(zip(*rows), _ARROW_SCHEMA)]
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW_SCHEMA)


def _finish(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        F.concat_ws(":", "document_id", "chunk_index").alias("chunk_id"),
        *chunks.columns,
        text.snippet(F.col("text")).alias("snippet"),
    )


def build_chunks(units: DataFrame, size: int = 4200, overlap: int = 500) -> DataFrame:
    """Chunks of a unit table ``workspace_id, document_id, block_no, unit_no, text, page, section_title``.

    One shuffle by document, then a streaming fold over the sorted partition.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        return _as_batches(_pack(rows, size, overlap))

    columns = ("workspace_id", "document_id", "text", "page", "section_title")
    ordered = units.repartition("workspace_id", "document_id").sortWithinPartitions(
        "workspace_id", "document_id", "block_no", "unit_no"
    )
    return _finish(ordered.select(*columns).mapInArrow(fold, CHUNK_SCHEMA))


def chunk_documents(docs: DataFrame, size: int = 4200, overlap: int = 500, markdown: Column | None = None) -> DataFrame:
    """Chunks of decoded documents ``workspace_id, document_id, text``, without any shuffle.

    ``markdown`` tells which rows read ``#`` lines as headings.
    """
    body = F.col("text")
    none = F.lit(None).cast("string")
    plain = F.transform(
        _limited(B.line_array(body), size),
        lambda u: F.struct(u.alias("text"), none.alias("section_title")),
    )
    if markdown is None:
        units = plain
    else:
        headed = F.flatten(
            F.transform(
                B.markdown_array(body),
                lambda b: F.transform(
                    _limited(F.array(b["text"]), size),
                    lambda u: F.struct(u.alias("text"), b["section_title"].alias("section_title")),
                ),
            )
        )
        units = F.when(markdown, headed).otherwise(plain)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                workspaces = batch.column(0).to_pylist()
                documents = batch.column(1).to_pylist()
                flat = batch.column(2).flatten()
                parents = pc.list_parent_indices(batch.column(2)).to_pylist()
                titles = flat.field("section_title").to_pylist()
                for at, body, title in zip(parents, flat.field("text").to_pylist(), titles):
                    yield workspaces[at], documents[at], body, None, title

        return _as_batches(_pack(rows(), size, overlap))

    packed = docs.select("workspace_id", "document_id", units.alias("units")).mapInArrow(fold, CHUNK_SCHEMA)
    return _finish(packed)
