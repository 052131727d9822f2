"""Exact matching joins that never pair everything with everything.

A match needs all of its keys (every query term, every substring of a fragment),
so only the rarest key has to find candidates; the candidates are then verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text
from citeloom.session import staged

#: Lengths of the substrings by which terms are looked up: the greatest that a term holds, at least half of it up to 48.
GRAMS = (1, 2, 3, 6, 12, 24)
#: Rows and bytes a key table may have to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Dictionaries up to this size are tried term by term.
FEW_TERMS = 64
#: Bits of a sieve: 4 MB, whatever the tables, as rows of 64 bits.
SIEVE = 1 << 25


def rarest_key(wanted: DataFrame, frequency: DataFrame, owner: list[str], key: list[str]) -> DataFrame:
    """One row of ``wanted`` per owner: the one whose key has the lowest ``df``."""
    order = Window.partitionBy(*owner).orderBy("df", *key)
    ranked = wanted.join(frequency, key).withColumn("_rank", F.row_number().over(order))
    return ranked.filter("_rank = 1").drop("_rank", "df")


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], spread: Column, salts: int) -> DataFrame:
    """Inner equi-join whose hot keys are spread over ``salts`` tasks.

    ``large`` is split by a hash of ``spread``; ``small`` is repeated once per salt.
    """
    # a shuffle join: the large side must not become a hash table
    left = large.hint("merge").withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def fits_broadcast(rows: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has at most ``limit`` rows and ``BROADCAST_BYTES`` bytes."""
    width = F.length(F.to_json(F.struct("*")))
    size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= limit and size["bytes"] <= BROADCAST_BYTES


def sieved(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without most of those whose ``keys`` are not in ``wanted``; an exact join follows.

    The sieve is of a fixed size, so it is sent to all tasks however many keys are wanted.
    """
    cell = F.pmod(F.xxhash64(*keys), F.lit(SIEVE))
    bit = F.expr("shiftleft(1L, cast(_cell % 64 as int))")
    place = F.expr("cast(_cell div 64 as int)")
    bits = wanted.select(cell.alias("_cell")).groupBy(place.alias("_at")).agg(F.bit_or(bit).alias("_bits"))
    held = rows.withColumn("_cell", cell).withColumn("_at", place).join(F.broadcast(bits), "_at")
    return held.where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def substring_pairs(
    texts: DataFrame,
    terms: DataFrame,
    text_id: str,
    text_col: str,
    term_col: str,
    by: list[str],
    salts: int = 8,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Distinct ``(*by, text_id, term)`` with the term contained in the text.

    ``texts(*by, text_id, text_col)`` and ``terms(*by, term_col)``. Each term is looked
    up by its rarest substring of the greatest length of ``GRAMS`` that it holds; a term with a
    substring that no text has is dropped before. Up to ``broadcast_rows`` terms the texts are
    read in place; beyond that both sides shuffle, the texts' substrings behind a sieve.
    A dictionary of a few terms is tried term by term instead.
    """
    terms = terms.select(*by, term_col).filter(F.length(term_col) > 0).distinct()
    if not by and broadcast_rows:
        few = [r[0] for r in terms.limit(FEW_TERMS + 1).collect()]
        if len(few) <= FEW_TERMS:
            every = F.array(*[F.lit(t) for t in sorted(few)]).cast("array<string>")
            inside = F.filter(every, lambda t: F.col(text_col).contains(t))
            return texts.select(text_id, F.explode(inside).alias(term_col))
    longest = [F.when(F.length(term_col) >= n, text.grams(F.col(term_col), n)) for n in reversed(GRAMS)]
    parts = terms.withColumn("_parts", F.coalesce(*longest)).withColumn("_n", F.size("_parts"))
    wanted = staged(parts.withColumn("_gram", F.explode("_parts")).drop("_parts"))
    # only the gram lengths that occur
    sizes = sorted(r[0] for r in wanted.select(F.length("_gram")).distinct().collect())
    grams = F.explode(F.concat(*[text.grams(F.col(text_col), n) for n in sizes or [1]])).alias("_gram")
    # counted where the texts are: what travels is one row per gram and task
    offered = sieved(texts.select(*by, grams), wanted, [*by, "_gram"])
    frequency = offered.groupBy(*by, "_gram").agg(F.count("*").alias("df"))
    of_term = Window.partitionBy(*by, term_col)
    met = wanted.join(frequency, [*by, "_gram"]).withColumn("_met", F.count("*").over(of_term)).filter("_met = _n")
    rarest = F.row_number().over(of_term.orderBy("df", *by, "_gram"))
    anchors = staged(met.withColumn("_rank", rarest).filter("_rank = 1").select(*by, term_col, "_gram"))
    if fits_broadcast(anchors, broadcast_rows):
        carried = texts.select(*by, text_id, F.col(text_col).alias("_text"), grams)
        candidates = carried.join(F.broadcast(anchors), [*by, "_gram"])
    else:
        offered = sieved(texts.select(*by, text_id, grams), anchors, [*by, "_gram"])
        found = salted_join(offered, anchors, [*by, "_gram"], F.col(text_id), salts)
        body = texts.select(*by, text_id, F.col(text_col).alias("_text"))
        candidates = found.join(body, [*by, text_id])
    return candidates.filter(F.col("_text").contains(F.col(term_col))).select(*by, text_id, term_col)
