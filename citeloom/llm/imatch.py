"""Document fingerprints by I-Match with randomised lexicons, in DataFrame operations only.

Terms whose share of documents lies within a band make up the lexicon; common and single terms
say nothing about which text this is. Shares are those of distinct texts, so that copies of a text
don't push its terms out of the band, and are counted term by term. Several random parts of the lexicon, of four densities so
that texts of any length have parts with a term or two, each give one hash of the text's sorted
distinct terms in them. The likeness of two fingerprints is the share of equal hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import HUB, staged

#: The band: terms of two texts at least and of this share of all distinct texts, or ``MOST_LEAST``, at most.
MOST_SHARE, MOST_LEAST = 0.2, 3
#: Lexicons: (bits, parts): the first parts of 2^bits random parts of the band.
LEVELS = ((2, 4), (4, 8), (6, 8), (8, 8))
#: Bits of a term's hash below those that choose its parts.
FIRST_BIT = 24

# A word's letters at the start of a text, and at its end (the look behind keeps the search linear in long words).
FIRST_RUN = r"^[\p{L}\p{N}]*+"
LAST_RUN = r"(?<![\p{L}\p{N}])[\p{L}\p{N}]*+\z"


def _hash(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def terms(text: Column) -> Column:
    """Hashes of the distinct words of a text: runs of letters and digits, in lower case."""
    words = F.split(text, r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), _hash))


def _none() -> Column:
    return F.array().cast("array<bigint>")


def vocabulary(texts: DataFrame) -> DataFrame:
    """``term, n, h``: in how many distinct texts each term is, and the hash of one of them.

    Each of the copies of a text (equal h) counts as its part of one. Texts stay in place while the
    list of repeated hashes is small; beyond, they move by hash, but for the copies of the fewer than
    ``HUB`` hashes with the most rows, which are joined from memory and dealt out anew.
    Terms are counted within tasks before they are exchanged.
    """
    copies = staged(texts.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1"))
    bound = F.col("rows") * HUB > (copies.agg(F.sum("rows").alias("all")).first()["all"] or 0)
    hot = F.broadcast(copies.where(bound).select("h", F.col("rows").alias("hot")))
    key = F.when(F.col("hot").isNull(), F.col("h")).otherwise(F.xxhash64("id", "h"))
    dealt = texts.join(hot, "h", "left").withColumn("key", key)
    each = dealt.join(copies.where(~bound).select(F.col("h").alias("key"), "rows"), "key", "left").withColumn("rows", F.coalesce("hot", "rows"))
    each = each.select("h", (1 / F.coalesce("rows", F.lit(1))).alias("part"), F.explode(terms(F.col("text"))).alias("term"))
    return each.groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("n"), F.min("h").alias("h"))


def common(texts: DataFrame, counted: DataFrame) -> Column:
    """The terms above the band as a constant array.

    Their number is at most the mean number of terms of a text by ``MOST_SHARE``, whatever the
    number of texts.
    """
    most = texts.agg(F.greatest(F.lit(MOST_LEAST), F.ceil(F.count_distinct("h") * MOST_SHARE)).alias("most")).first()["most"]
    found = counted.where(F.col("n") > most).agg(F.array_sort(F.collect_list("term")).alias("terms")).first()["terms"]
    return F.split(F.lit(",".join(map(str, found))), ",").cast("array<bigint>") if found else _none()


def single(counted: DataFrame) -> DataFrame:
    """``h, single``: the terms that no other text has, by text; a list is no longer than its text."""
    return counted.where("n = 1").groupBy("h").agg(F.collect_list("term").alias("single"))


def signature(text: Column, outside: Column) -> Column:
    """One 32-bit hash per lexicon, null where the text has no term in it; ``outside`` lists its terms that the band leaves out.

    A text without any term of the band has the hash of all its terms everywhere, so that it is
    like texts of the same terms alone.
    """
    short = lambda found: F.shiftright(F.xxhash64(found), 32).cast("int")

    def level(kept: Column, bits: int, parts: int, at: int) -> Column:
        part = lambda t: F.shiftright(t, at).bitwiseAND((1 << bits) - 1)
        hashed = lambda chosen: F.when(F.size(chosen) > 0, short(chosen))
        of_some = F.filter(kept, lambda t: part(t) < parts)
        # an array of one entry, so that the narrowed list is made once and not once for each part
        return F.flatten(F.transform(F.array(of_some), lambda some: F.transform(F.array(*map(F.lit, range(parts))), lambda p: hashed(F.filter(some, lambda t: part(t) == p)))))

    def levels(kept: Column) -> Column:
        places = [FIRST_BIT + sum(b for b, _ in LEVELS[:i]) for i in range(len(LEVELS))]
        return F.concat(*(level(kept, bits, parts, at) for (bits, parts), at in zip(LEVELS, places)))

    def signed(found: Column) -> Column:
        alone = F.array_repeat(short(F.array_sort(found)), sum(parts for _, parts in LEVELS))
        kept = F.array(F.array_sort(F.array_except(found, outside)))
        return F.flatten(F.transform(kept, lambda some: F.when(F.size(some) > 0, levels(some)).otherwise(alone)))

    return F.flatten(F.transform(F.array(terms(text)), signed))


def written(signatures: Column) -> Column:
    """A fingerprint as text: eight hex digits per lexicon, dashes where it is null."""
    eight = lambda x: F.coalesce(F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0"), F.lit("-" * 8))
    return F.array_join(F.transform(signatures, eight), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the lexicons in which either text has terms that have the same hash."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.size(F.filter(pairs, lambda x: x["a"].isNotNull() | x["b"].isNotNull()))
    same = F.size(F.filter(pairs, lambda x: x["a"] == x["b"]))
    return F.when(either == 0, F.lit(1.0)).otherwise(same / either)


def _texts(docs: DataFrame) -> DataFrame:
    """``id, h, text``: a document is told by its doc_id as text (null: empty) and its text's hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    return docs.select(key.alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def _number(key: Column) -> Column:
    return F.when(key != "", key.cast("long"))


def _outside(known: Column, *more: str) -> Column:
    return F.concat(known, *(F.coalesce(F.col(c), _none()) for c in more))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row of ``docs`` (doc_id, text); a null text counts as empty."""
    texts = _texts(docs)
    counted = staged(vocabulary(texts))
    known = common(texts, counted)
    own = staged(texts.select("id", "h").distinct().join(single(counted), "h"))
    sig = signature(F.col("text"), _outside(known, "single"))
    return texts.join(own, ["id", "h"], "left").select(_number(F.col("id")).alias("doc_id"), written(sig).alias("fingerprint"))


def followers(texts: DataFrame) -> DataFrame:
    """``id, h`` of each document and whose edited text ends with its beginning: ``to_id, to_h, half``.

    Order: descending doc_id, null last, then hash; the first follows the last. Only these narrow
    columns are sorted, by range; a range's last row takes the first of the next range.
    """
    ids = texts.select("id", "h", F.expr("char_length(text) div 2").cast("int").alias("half")).distinct()
    ids = ids.withColumn("doc_id", _number(F.col("id")))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    rows = staged(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    own = F.struct("id", "h")
    firsts = rows.groupBy("part").agg(F.min_by(own, F.struct(F.col("doc_id").isNull().alias("n"), (-F.col("doc_id")).alias("d"), F.col("h"))).alias("first"))
    by_part = Window.orderBy("part")  # one row per range
    start = F.first("first").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(by_part), start).alias("onward"))
    inside = F.lead(own).over(Window.partitionBy("part").orderBy(*order))
    linked = rows.withColumn("next", inside).join(F.broadcast(firsts), "part").withColumn("next", F.coalesce("next", "onward"))
    return linked.select("next.id", "next.h", F.col("id").alias("to_id"), F.col("h").alias("to_h"), "half")


def cut_words(base: DataFrame, texts: DataFrame, counted: DataFrame) -> DataFrame:
    """``id, h, foreign``: the words made by cutting a document's text and the next one's, where the band has no such term.

    An edited text's words are the document's and the next one's but for two: that over the seam
    and the last. ``base`` holds the next documents with ``to_id, to_h, head``.
    """
    run = lambda text, which: F.regexp_extract(text, which, 0)
    first, last = run(F.col("head"), FIRST_RUN), run(F.col("head"), LAST_RUN)
    whole = F.char_length(first) == F.char_length("head")
    heads = base.select(F.col("to_id").alias("id"), F.col("to_h").alias("h"), first.alias("first"), F.when(whole, "").otherwise(last).alias("last"))
    left = texts.select("id", "h", run(_left(F.col("text")), LAST_RUN).alias("before"))
    both = heads.dropDuplicates(["id", "h"]).join(left.dropDuplicates(["id", "h"]), ["id", "h"])
    made = F.filter(F.array(F.concat("before", "first"), F.col("last")), lambda w: w != "")
    asked = both.select("id", "h", F.explode(F.transform(made, _hash)).alias("term"))
    foreign = asked.join(counted.where("n > 1").select("term"), "term", "left_anti")
    return foreign.groupBy("id", "h").agg(F.collect_set("term").alias("foreign"))


def _left(text: Column) -> Column:
    """What an edited text keeps of its document's."""
    return F.substring(text, F.lit(1), F.char_length(text) - F.floor(F.char_length(text) / 2).cast("int"))


def edited(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or
    all, of the next document's, in the order of ``followers``. A null text is an empty one. A
    null doc_id comes last. A repeated row (equal doc_id and text) is one document, which gives a
    row each time; rows of one doc_id with different texts are different documents. A document
    alone is its own next. Other columns are not looked at; no rows give no rows. Equal texts have
    equal fingerprints, edited ones too: the words that an edit makes are looked up in the vocabulary.

    All joins of texts use one exchange of them; besides, beginnings and the narrow lists of single terms move.
    """
    texts = _texts(docs)
    counted = staged(vocabulary(texts))
    known = common(texts, counted)
    onward = staged(followers(texts).join(single(counted), "h", "left"))
    base = texts.join(onward, ["id", "h"]).withColumn("head", F.substring(F.col("text"), F.lit(1), F.col("half")))
    sig = signature(F.col("text"), _outside(known, "single"))
    heads = base.select(F.col("to_id").alias("id"), F.col("to_h").alias("h"), F.col("head").alias("end"), sig.alias("next_sig"), F.col("single").alias("next_single"))
    pairs = base.join(heads.dropDuplicates(["id", "h"]), ["id", "h"]).join(cut_words(base, texts, counted), ["id", "h"], "left")
    made = pairs.select(
        _number(F.col("id")).alias("doc_id"), F.char_length("text").cast("long").alias("n_chars"), F.concat(_left(F.col("text")), F.col("end")).alias("edited"),
        sig.alias("sig"), "next_sig", "single", "next_single", "foreign",
    )
    signed = made.withColumn("edited_sig", signature(F.col("edited"), _outside(known, "single", "next_single", "foreign")))
    return signed.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written(F.col("sig")).alias("fingerprint"),
        written(F.col("edited_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
