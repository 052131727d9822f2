"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents, in shuffled order, form one stream of words, repeated as often as the mix
may take it and cut into blocks of equally many words, however small the source. The schedule has one
slot for each block of the mix: golden-ratio points, mapped through the cumulative target shares,
give slot n its source, and the slot's rank among those of its source gives the block. What a source
still lacks of its target when the slots are dealt out, or has beyond it, is settled at the end, so
that each source's words are its target to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.common import SPACE, WORD, packed, running_before, staged

#: Weights by place of the source, repeating.
WEIGHTS = (5, 2, 1)
#: Most times that a word is taken.
EPOCHS = 3
#: Slots of the schedule: blocks hold 1/SLOTS of all words. It sets how finely sources alternate, not what they get.
SLOTS = 1 << 20
SEED = "mix"
#: Fixed point: points are multiples of 1 / 2^31; STEP is 2^31 over the golden ratio, made odd.
ONE, STEP = 1 << 31, 1327217885
#: The unit interval is cut into 2^10 cells to look up the source of a point.
CELL = 1 << 21
#: Slots are ranked in runs of 2^12.
RUN = 1 << 12
#: Hex digits of the shuffle key that cut a source's stream into parts.
PART = 3


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, key`` of every row: words of the whole text and place in the shuffled order."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{SEED}")).cast("binary"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key"))


def targets(sized: DataFrame) -> DataFrame:
    """One row per source: ``source, place, source_size, target`` and its interval ``[low, high)`` of the unit, in 1 / ``ONE``.

    Level filling: every source gets weight x level, at most ``EPOCHS`` times its size, with the
    level at which all add up to the corpus. This is a table of one row per source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place - 1) % len(WEIGHTS) + 1).cast("double")
    rows = by_source.select("source", "source_size", place.alias("place"), weight.alias("w"), (F.col("source_size") * EPOCHS).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "place")
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum(
        "w"
    ).over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    rows = rows.withColumn("target", F.least(F.col("cap").cast("double"), F.col("w") * F.coalesce(F.max(fits).over(everything), F.lit(0.0))))
    up_to = F.sum("target").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("target").over(everything)
    rows = rows.withColumn("high", F.coalesce(F.when(total > 0, F.round(up_to / total * ONE)), F.lit(0.0)).cast("long"))
    low = F.coalesce(F.lag("high").over(Window.orderBy("place")), F.lit(0))
    return rows.select("source", "place", "source_size", "target", low.alias("low"), "high")


def block_words(total: int, slots: int) -> int:
    """Words of a block: ``total`` words fill at most ``slots`` of them."""
    return max(1, -(-total // slots))


def schedule(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``slot, place, rank, block_words``: the source of every slot and the slot's rank among those of its source."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    words = block_words(total, slots)
    points = spark.range(-(-total // words)).select(F.col("id").alias("slot"), (F.col("id") % ONE * STEP % ONE).alias("point"))
    cells = sources.where("high > low").select("place", "low", "high", F.explode(F.expr(f"sequence(low div {CELL}, (high - 1) div {CELL})")).alias("cell"))
    owned = points.withColumn("cell", F.expr(f"point div {CELL}")).join(cells, "cell").where("point >= low and point < high")
    owned = owned.select("slot", "place", F.expr(f"slot div {RUN}").alias("run"))
    inside = F.row_number().over(Window.partitionBy("place", "run").orderBy("slot")) - 1
    per_run = owned.groupBy("place", "run").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per_run.select("place", "run", before.alias("start"))
    ranked = owned.withColumn("inside", inside).join(starts, ["place", "run"])
    return ranked.select("slot", "place", (F.col("start") + F.col("inside")).alias("rank"), F.lit(words).cast("long").alias("block_words"))


def settled(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``place, rank, slot, words``: the blocks that each source gives to the mix.

    A source's words are its target, rounded; its last block is cut to that. Slots beyond are
    dropped, and blocks that the schedule lacks, a few per source, follow it with a null slot.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    words = block_words(total, slots)
    wanted = sources.select("place", F.least(F.round("target").cast("long"), F.col("source_size") * EPOCHS).alias("words"))
    wanted = wanted.select("place", "words", F.expr(f"(words + {words - 1}) div {words}").alias("blocks"))
    given = staged(schedule(sources, slots).select("slot", "place", "rank").join(wanted, "place").where("rank < blocks"))
    had = given.groupBy(F.col("place").alias("of")).agg(F.count("*").alias("n"))
    short = wanted.join(had, F.col("place") == F.col("of"), "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < blocks")
    late = short.select(F.lit(None).cast("long").alias("slot"), "place", F.explode(F.sequence("n", F.col("blocks") - 1)).alias("rank"), "words")
    both = given.select("slot", "place", "rank", "words").unionByName(late)
    return both.select("place", "rank", "slot", F.least(F.lit(words).cast("long"), F.col("words") - F.col("rank") * words).alias("words"))


def mixed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs`` (doc_id, text, source).

    size counts words of the whole text (null: 0); targets are those of ``targets``; taken counts
    the document's words in the mix, repeats counted, at most ``EPOCHS`` times its size; those of a
    source add up to its target, rounded. Null sources are one source, the last. The shuffled order
    is by a hash of doc_id, then doc_id, then size; rows equal in all these are interchangeable, so
    reruns agree. Rows of size 0 have taken 0; without words nothing is scheduled; no rows give no
    rows. Other columns are not looked at.
    """
    sized = staged(sizes(docs))
    sources = staged(targets(sized))
    words = block_words(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"], slots)
    blocks = settled(sources, slots).select("place", F.col("rank").alias("block"), F.col("words").alias("given"))
    placed = sized.join(sources.select(F.col("source").alias("_s"), "place", "source_size", "target"), sized["source"].eqNullSafe(F.col("_s"))).drop("_s")
    order: list[Column] = [F.col("key"), F.col("doc_id"), F.col("size")]
    laid = running_before(placed, ["place"], F.substring("key", 1, PART), order, "size", "start")
    # where the document stands each time that the stream goes round, as far as the target reaches
    last = F.least(F.lit(EPOCHS - 1), F.expr("cast(floor(target / source_size) as int)"))
    turns = F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0), last), lambda e: F.col("start") + e * F.col("source_size")))
    laid = laid.withColumn("at", F.explode(F.coalesce(turns, F.array(F.lit(-1).cast("long")))))
    met = F.when(F.col("at") >= 0, F.expr(f"sequence(at div {words}, (at + size - 1) div {words})"))
    parts = laid.withColumn("block", F.explode(F.coalesce(met, F.array(F.lit(-1).cast("long")))))
    parts = parts.join(blocks, ["place", "block"], "left")
    first = F.col("block") * words
    overlap = F.greatest(F.least(F.col("at") + F.col("size"), first + F.col("given")) - F.greatest(F.col("at"), first), F.lit(0))
    # rows of size 0 can share a start; as many come back as went in
    taken = F.sum(F.when(F.col("given").isNotNull(), overlap).otherwise(F.lit(0))).alias("taken")
    summed = parts.groupBy("place", "key", "start", "doc_id", "size", "source_size", "target").agg(taken, F.count_if(F.col("at") == -1).alias("_empty"))
    return summed.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), F.explode(F.sequence(F.lit(1), F.greatest("_empty", F.lit(1)))).alias("_n")).drop("_n")


def materialise(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``docs`` as the mix has them: each row as often as the mix takes it, all columns kept.

    Whole documents only: the one document of a source that the mix's last round cuts counts as
    taken if at least half of it is. Rows without words are in no mix.
    """
    found = mixed(docs, slots).where("size > 0").select(
        F.col("doc_id").alias("of"), F.col("size").alias("of_size"), F.expr("cast(floor(taken / size + 0.5) as int)").alias("times")
    ).where("times > 0")
    # rows of one doc_id and size share the takes of all of them evenly enough: the most of any
    found = found.groupBy("of", "of_size").agg(F.max("times").alias("times"))
    rows = packed(docs, id=F.col("doc_id").cast("long"), words=F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("words") == F.col("of_size")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


#: The same mix in DuckDB's SQL.
ORACLE = f"""
with sized as (
  select doc_id, source, case when text is null then 0 else len(list_filter(regexp_split_to_array(text, '{SPACE}'), lambda x: x <> '')) end::bigint as size,
         md5(coalesce(doc_id::varchar, '') || ':{SEED}') as key
  from documents),
by_source as (select source, sum(size)::bigint as source_size from sized group by source),
placed as (select *, row_number() over (order by source asc nulls last) as place from by_source),
weighed as (select *, [{', '.join(map(str, WEIGHTS))}][(place - 1) % {len(WEIGHTS)} + 1]::double as w, source_size * {EPOCHS} as cap from placed),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, place rows between unbounded preceding and 1 preceding), 0))
            / sum(w) over (order by cap / w, place rows between current row and unbounded following) as level
  from weighed),
filled as (select *, least(cap::double, w * coalesce(max(case when level <= cap / w then level end) over (), 0)) as target from levels),
sources as (select source, place, source_size, target, least(round(target)::bigint, cap)::bigint as words from filled),
laid as (
  select s.*, source_size, target, words,
         coalesce(sum(size) over (partition by place order by key, s.doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from sized s join sources t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
       case when size = 0 then 0 else words // source_size * size + greatest(0, least(size, words % source_size - start)) end::bigint as taken
from laid
"""
