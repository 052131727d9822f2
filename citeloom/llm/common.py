"""What the training-data operators share: tables, words, components, running totals."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.session import staged

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0d]")

#: Bytes of one text that are split into words at a time.
PIECE = 1 << 20
#: Nodes with more than one link in so many are joined from memory; there are fewer than twice as many of them.
HUB = 1000
#: Bits of a sieve: 2 MB, whatever the corpus, as at most 2^18 rows of 64 bits.
SIEVE = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``PIECE`` bytes that end at white space, so that a long one is never split whole."""
    at = 0
    while len(data) - at > PIECE:
        found = _SPACE.search(data, at + PIECE)
        if not found:
            break
        yield data[at : found.start()]
        at = found.start()
    yield data[at:]


def packed(rows: DataFrame, **keys: Column) -> DataFrame:
    """``rows`` as one column ``row`` beside ``keys``, so that no column of theirs can clash with an internal name."""
    return rows.select(F.struct("*").alias("row"), *[key.alias(name) for name, key in keys.items()])


def _held(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_hit``: whether the sieve of the keys of ``wanted`` lets the row through."""
    cell = F.pmod(F.xxhash64(key), F.lit(SIEVE))
    bit = F.expr("shiftleft(1L, cast(_cell % 64 as int))")
    place = F.expr("cast(_cell div 64 as int)")
    bits = wanted.select(cell.alias("_cell")).groupBy(place.alias("_at")).agg(F.bit_or(bit).alias("_bits"))
    held = rows.withColumn("_cell", cell).withColumn("_at", place).join(F.broadcast(bits), "_at", "left")
    return held.select(*rows.columns, F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)).alias("_hit"))


def sieved(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is no ``key`` of ``wanted``, nulls being equal; an exact join may follow.

    The sieve is of a fixed size, so it is sent to all tasks however many keys are wanted; from
    some 16 million distinct keys on it lets most rows through.
    """
    return _held(rows, wanted, key).where("_hit").drop("_hit")


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose ``keys`` are not in ``gone`` (the same columns, nulls being equal).

    Rows that the sieve of ``gone`` stops are kept where they are; only the others are exchanged
    for the exact join.
    """
    held = _held(rows, gone, keys[0])
    same = " and ".join(f"r.{k} <=> g.{k}" for k in keys)
    suspects = held.where("_hit").alias("r").join(gone.alias("g"), F.expr(same), "left_anti")
    return held.where("not _hit").unionByName(suspects).select(*rows.columns)


def _beside(rows: DataFrame, least: DataFrame, links: int) -> DataFrame:
    """``u, v, m``: ``rows`` (u, v) with their ``least`` (u, m, n); rows of hubs, n of them each, stay where they are."""
    hubs = least.where(F.col("n") * HUB > links).select("u", "m")
    found = rows.join(F.broadcast(hubs), "u", "left").select("u", "v", "m")
    others = least.where(F.col("n") * HUB <= links).select("u", "m")
    return found.where("m is not null").unionByName(found.where("m is null").drop("m").join(others, "u").select("u", "v", "m"))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node that ``links`` (a long, b long) names: root is the least node it reaches.

    Alternating large-star and small-star rounds: each hangs a node's larger, then its smaller
    neighbours under the least, so no round makes more rows than there are links and no node's
    neighbours are gathered: those of a node with a large share of all links stay spread. Each round is a written table, until one changes nothing.
    """
    edges = staged(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _beside(both.where("v > u"), least, mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        pairs = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        edges = staged(_beside(large, least, mark[0]).select(pairs.alias("p")).select("p.*").where("u != v").distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def running_before(rows: DataFrame, by: list[str], segment: Column, order: list[Column], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the group that come earlier.

    ``segment`` must rise with ``order`` and cut each group, however large, into parts of a few
    rows each: a part is summed by itself and starts from the total of the parts before it.
    """
    rows = rows.withColumn("_segment", segment)
    totals = rows.groupBy(*by, "_segment").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_segment", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*by, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(starts, [*by, "_segment"]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_segment", "_start", "_inside")


__all__ = ["WORD", "SPACE", "table", "packed", "pieces", "sieved", "without", "components", "running_before", "staged"]
