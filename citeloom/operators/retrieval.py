"""Hybrid retrieval over a table of queries: candidates, fusion, ranking, citations.

``queries(query_id, workspace_id, query_text, query_vec)``,
``chunks(chunk_id, workspace_id, document_id, chunk_index, text, page_start, page_end,
section_title, snippet, embedding)``,
``documents(document_id, file_name, mime_type, storage_key, status)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import files, links, text
from citeloom.operators import matching
from citeloom.operators.vector_search import vector_topk
from citeloom.session import staged

SOURCES = {"vector": 0, "keyword": 1, "title": 2}
BONUS_CAP, HIT_BONUS, HIT_CAP, TITLE_BONUS, SECTION_BONUS = 0.45, 0.06, 0.24, 0.18, 0.06
GARBLE_PENALTY, SCORE_CAP = 0.35, 1.5


def searchable(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of ready documents, with the document's columns."""
    ready = documents.filter("status = 'ready'").select("document_id", "file_name", "mime_type", "storage_key")
    return chunks.join(ready, "document_id")


# -- keyword -----------------------------------------------------------------


def build_postings(chunks: DataFrame) -> DataFrame:
    """Full-text table ``workspace_id, chunk_id, term, pos`` (positions from 1)."""
    exploded = chunks.select("workspace_id", "chunk_id", F.posexplode(text.tokens(F.col("text"))).alias("_p", "term"))
    return exploded.select("workspace_id", "chunk_id", "term", (F.col("_p") + 1).alias("pos"))


def term_index(chunks: DataFrame) -> DataFrame:
    """Distinct terms of each chunk; store it bucketed by term."""
    terms = F.array_distinct(text.tokens(F.col("text")))
    return chunks.select("workspace_id", "chunk_id", F.explode(terms).alias("term"))


def _term_sets(queries: DataFrame) -> DataFrame:
    terms = F.sort_array(F.array_distinct(text.tokens(F.col("query_text"))))
    return queries.withColumn("terms", terms).filter(F.size("terms") > 0)


def _cover_density(words: Column, terms: Column) -> Column:
    """Cover density of a text's words."""
    hits = F.filter(
        F.transform(words, lambda w, i: F.struct(i.alias("pos"), F.array_position(terms, w).cast("int").alias("term"))),
        lambda h: h["term"] > 0,
    )
    # of one term every place is an interval
    places = F.filter(words, lambda w: w == terms[0])
    return F.when(F.size(terms) == 1, F.size(places) * 0.1).otherwise(_density(hits, terms))


def _density(hits: Column, terms: Column) -> Column:
    """Sum over minimal intervals holding every term of 0.1 / (1 + other words inside), from the terms' places in order."""
    # fold over the hits: latest (pos, ordinal) per term, start of the last counted interval, score
    never = F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("nth"))
    start = F.struct(
        F.transform(terms, lambda t: never).alias("last"),
        F.lit(-1).alias("counted"),
        F.lit(0).alias("nth"),
        F.lit(0.0).alias("score"),
    )

    def step(acc: Column, hit: Column) -> Column:
        here = F.struct(hit["pos"].alias("pos"), acc["nth"].alias("nth"))
        latest = F.transform(acc["last"], lambda x, i: F.when(i == hit["term"] - 1, here).otherwise(x))
        return text.bind(
            F.struct(latest.alias("last"), F.array_min(latest).alias("first")), lambda now: advance(acc, hit, now)
        )

    def advance(acc: Column, hit: Column, now: Column) -> Column:
        first = now["first"]
        fresh = (first["pos"] >= 0) & (first["pos"] != acc["counted"])
        others = (hit["pos"] - first["pos"]) - (acc["nth"] - first["nth"])
        gain = F.when(fresh, F.lit(0.1) / (others + 1)).otherwise(F.lit(0.0))
        return F.struct(
            now["last"].alias("last"),
            F.when(fresh, first["pos"]).otherwise(acc["counted"]).alias("counted"),
            (acc["nth"] + 1).alias("nth"),
            (acc["score"] + gain).alias("score"),
        )

    return F.aggregate(hits, start, step, lambda acc: acc["score"])


def _keyword_sets(
    queries: DataFrame, chunks: DataFrame, index: DataFrame | None, salts: int, broadcast_rows: int
) -> DataFrame:
    """Scored matches per distinct ``(workspace, term set)``: equal questions are searched once.

    The rarest term of a set finds its candidate chunks. Up to ``broadcast_rows`` sets
    the chunks are read in place; beyond that, or with a stored ``index``, by joins.
    """
    sets = staged(_term_sets(queries).select("workspace_id", "terms").distinct())
    wanted = sets.withColumn("term", F.explode("terms"))
    asked = wanted.select("workspace_id", "term").distinct()
    # the indexed terms that some query uses, counted per workspace
    offered = (term_index(chunks) if index is None else index).join(asked, ["workspace_id", "term"], "left_semi")
    frequency = offered.groupBy("workspace_id", "term").agg(F.count("*").alias("df"))
    anchors = staged(
        matching.rarest_key(wanted, frequency, ["workspace_id", "terms"], ["workspace_id", "term"])
    )
    small = matching.fits_broadcast(anchors, broadcast_rows)
    words = chunks.select("workspace_id", "chunk_id", text.tokens(F.col("text")).alias("words"))
    if small and index is None:
        terms = words.withColumn("term", F.explode(F.array_distinct("words")))
        found = terms.join(F.broadcast(anchors), ["workspace_id", "term"])
    else:
        if small:
            candidates = offered.join(F.broadcast(anchors), ["workspace_id", "term"])
        else:
            candidates = matching.salted_join(offered, anchors, ["workspace_id", "term"], F.col("chunk_id"), salts)
        found = candidates.select("workspace_id", "chunk_id", "terms").join(words, ["workspace_id", "chunk_id"])
    matched = found.filter(F.size(F.array_except("terms", "words")) == 0)
    return matched.select(
        "workspace_id",
        "terms",
        "chunk_id",
        F.round(_cover_density(F.col("words"), F.col("terms")), 9).alias("score"),
    )


def keyword_match(
    queries: DataFrame,
    chunks: DataFrame,
    index: DataFrame | None = None,
    salts: int = 8,
    broadcast_rows: int = matching.BROADCAST_ROWS,
) -> DataFrame:
    """All chunks of the query's workspace holding every query token, with their cover density."""
    scored = _keyword_sets(queries, chunks, index, salts, broadcast_rows)
    asked = _term_sets(queries).select("query_id", "workspace_id", "terms")
    return asked.join(scored, ["workspace_id", "terms"]).select("query_id", "chunk_id", "score")


def keyword_topk(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 30,
    index: DataFrame | None = None,
    salts: int = 8,
    broadcast_rows: int = matching.BROADCAST_ROWS,
) -> DataFrame:
    order = Window.partitionBy("workspace_id", "terms").orderBy(F.desc("score"), "chunk_id")
    scored = _keyword_sets(queries, chunks, index, salts, broadcast_rows)
    scored = scored.withColumn("rank", F.row_number().over(order))
    asked = _term_sets(queries).select("query_id", "workspace_id", "terms")
    best = scored.filter(F.col("rank") <= k)
    return asked.join(best, ["workspace_id", "terms"]).select("query_id", "chunk_id", "score", "rank")


def keyword_topk_indexed(queries: DataFrame, postings: DataFrame, k: int = 30) -> DataFrame:
    """As :func:`keyword_topk`, from stored positions ``workspace_id, term, chunk_id, pos`` alone.

    Only the postings of asked terms are read. The rarest term of a set finds its candidates; a
    set with a term that no chunk has is dropped at once. Texts are never touched.
    """
    by_term, owner = ["workspace_id", "term"], ["workspace_id", "terms"]
    asked = _term_sets(queries).select("query_id", *owner)
    wanted = asked.select(*owner).distinct().withColumn("term", F.explode("terms"))
    places = postings.join(wanted.select(*by_term).distinct(), by_term, "left_semi")
    # places of one term in one chunk: bounded by the chunk
    lists = staged(places.groupBy(*by_term, "chunk_id").agg(F.collect_list("pos").alias("places")))
    frequency = lists.groupBy(*by_term).agg(F.count("*").alias("df"))
    known = wanted.join(frequency.select(*by_term), by_term).groupBy(*owner).agg(F.count("*").alias("n")).filter(F.col("n") == F.size("terms"))
    anchors = matching.rarest_key(wanted.join(known.select(*owner), owner, "left_semi"), frequency, owner, by_term)
    candidates = lists.join(anchors, by_term).select(*owner, "chunk_id").withColumn("term", F.explode("terms"))
    found = candidates.join(lists, [*by_term, "chunk_id"]).groupBy(*owner, "chunk_id").agg(F.collect_list(F.struct("term", "places")).alias("_found"))
    one = lambda f: F.transform(f["places"], lambda p: F.struct((p - 1).alias("pos"), F.array_position("terms", f["term"]).cast("int").alias("term")))
    hits = F.array_sort(F.flatten(F.transform("_found", one)))
    whole = found.filter(F.size("_found") == F.size("terms")).select(*owner, "chunk_id", F.round(_density(hits, F.col("terms")), 9).alias("score"))
    order = Window.partitionBy(*owner).orderBy(F.desc("score"), "chunk_id")
    best = whole.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return asked.join(best, owner).select("query_id", "chunk_id", "score", "rank")


# -- title -------------------------------------------------------------------


def title_topk(queries: DataFrame, chunks: DataFrame, documents: DataFrame, k: int = 12, salts: int = 8) -> DataFrame:
    """Chunks of ready documents whose file name contains a query fragment; score 1."""
    ready = documents.filter("status = 'ready'").join(chunks.select("document_id"), "document_id", "left_semi")
    names = ready.select("workspace_id", "document_id", F.lower("file_name").alias("_name"))
    asked = queries.select(
        "query_id", "workspace_id", F.explode(text.query_fragments(F.col("query_text"))).alias("fragment")
    )
    pairs = matching.substring_pairs(names, asked, "document_id", "_name", "fragment", ["workspace_id"], salts)
    # a document has at least one chunk, so k documents per fragment hold the first k chunks
    order = Window.partitionBy("workspace_id", "fragment").orderBy("document_id")
    pairs = pairs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")
    hits = asked.join(pairs, ["workspace_id", "fragment"]).select("query_id", "document_id").distinct()
    found = hits.join(chunks.select("document_id", "chunk_id", "chunk_index"), "document_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("document_id", "chunk_index", "chunk_id"))
    return (
        found.withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select("query_id", "chunk_id", F.lit(1.0).alias("score"), "rank")
    )


# -- fusion ------------------------------------------------------------------


def minmax(scored: DataFrame, by: list[str]) -> DataFrame:
    """Add ``norm``: scores scaled to [0, 1] per group, 1 when all are equal."""
    # bounds first, with map-side combine: a window would hold a whole group in one task
    bounds = scored.groupBy(*by).agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    low, high = F.col("_low"), F.col("_high")
    span = F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0)))
    return scored.join(bounds, by).withColumn("norm", span).drop("_low", "_high")


def tag_sources(vector: DataFrame, keyword: DataFrame, title: DataFrame) -> DataFrame:
    parts = [
        hits.select("query_id", "chunk_id", "score", "rank").withColumn("source", F.lit(name))
        for name, hits in (("vector", vector), ("keyword", keyword), ("title", title))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fuse(candidates: DataFrame) -> DataFrame:
    """Best normalised and best raw score of each (query, chunk) over its sources."""
    normed = minmax(staged(candidates), ["query_id", "source"])
    is_title, is_vector = F.col("source") == "title", F.col("source") == "vector"
    score = F.when(is_title, F.greatest("norm", "score")).otherwise(F.col("norm"))
    clamped = F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))
    raw = F.when(is_vector, F.col("score")).otherwise(clamped)
    position = (
        F.when(is_vector, F.lit(SOURCES["vector"]))
        .when(F.col("source") == "keyword", F.lit(SOURCES["keyword"]))
        .otherwise(F.lit(SOURCES["title"]))
    )
    first = F.min(F.struct(position.alias("source_order"), F.col("rank").alias("source_rank")))
    fused = normed.groupBy("query_id", "chunk_id").agg(
        F.max(score).alias("score"), F.max(raw).alias("raw_score"), first.alias("_first")
    )
    return fused.select("query_id", "chunk_id", "score", "raw_score", "_first.source_order", "_first.source_rank")


def _alignment(m: Column) -> Column:
    """Bonus from normalised query ``asked``, ``title``, ``heading``, ``haystack`` and query ``words``."""
    title, heading, words = m["title"], m["heading"], m["words"]
    hits = F.size(F.filter(words, lambda w: m["haystack"].contains(w)))
    in_title = (title != "") & (m["asked"].contains(title) | F.exists(words, lambda w: title.contains(w)))
    in_heading = (heading != "") & F.exists(words, lambda w: heading.contains(w))
    bonus = (
        F.least(F.lit(HIT_CAP), hits * HIT_BONUS)
        + F.when(in_title, F.lit(TITLE_BONUS)).otherwise(F.lit(0.0))
        + F.when(in_heading, F.lit(SECTION_BONUS)).otherwise(F.lit(0.0))
    )
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.least(F.lit(BONUS_CAP), bonus))


def alignment_bonus(query: Column, file_name: Column, section: Column, snippet: Column) -> Column:
    normal = F.struct(
        text.normalize_match(query).alias("asked"),
        text.normalize_match(files.stem(file_name)).alias("title"),
        text.normalize_match(section).alias("heading"),
        text.normalize_match(snippet).alias("short"),
    )

    def matched(n: Column) -> Column:
        parts = F.filter(F.array(n["title"], n["heading"], n["short"]), lambda p: p != "")
        whole = F.struct(
            n["asked"].alias("asked"),
            n["title"].alias("title"),
            n["heading"].alias("heading"),
            F.array_join(parts, " ").alias("haystack"),
            text.significant_tokens(n["asked"]).alias("words"),
        )
        return text.bind(whole, _alignment)

    return text.bind(normal, matched)


def garble_penalty(file_name: Column, snippet: Column, body: Column) -> Column:
    shown = F.concat_ws("\n", file_name, snippet, F.substring(body, 1, 800))
    return F.when(text.is_garbled(shown), F.lit(GARBLE_PENALTY)).otherwise(F.lit(0.0))


def snippet_or_text(snippet: Column, body: Column, size: int = 300) -> Column:
    return F.coalesce(F.when(snippet != "", snippet), F.substring(body, 1, size))


def rank_final(fused: DataFrame, scope: DataFrame, queries: DataFrame, k: int = 12) -> DataFrame:
    """Bonus, penalty, clip and final top-k; the rows carry their citation reference."""
    rows = fused.join(scope.drop("embedding"), "chunk_id").join(queries.select("query_id", "query_text"), "query_id")
    rows = rows.withColumn("snippet", snippet_or_text(F.col("snippet"), F.col("text")))
    bonus = alignment_bonus(F.col("query_text"), F.col("file_name"), F.col("section_title"), F.col("snippet"))
    penalty = garble_penalty(F.col("file_name"), F.col("snippet"), F.col("text"))
    final = F.greatest(F.lit(0.0), F.least(F.lit(SCORE_CAP), F.col("score") + bonus - penalty))
    rows = rows.withColumn("score", F.round(final, 6)).withColumn("raw_score", F.round("raw_score", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "source_order", "source_rank", "chunk_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    ref = links.citation_ref(F.col("mime_type"), F.col("page_start"), F.col("page_end"), F.col("section_title"))
    return rows.withColumn("_ref", ref).select(
        "query_id",
        "rank",
        "chunk_id",
        "document_id",
        "workspace_id",
        "file_name",
        "_ref.ref_type",
        "_ref.ref",
        "snippet",
        "text",
        "page_start",
        "page_end",
        "section_title",
        "score",
        "raw_score",
        "storage_key",
        "mime_type",
    )


def hybrid_retrieve(
    queries: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    vector_k: int = 30,
    keyword_k: int = 30,
    final_k: int = 12,
    index: DataFrame | None = None,
) -> DataFrame:
    """Vector, keyword and title candidates, fused and re-ranked, for every query."""
    scope = searchable(chunks, documents)
    candidates = tag_sources(
        vector_topk(queries, scope, vector_k),
        keyword_topk(queries, scope, keyword_k, index),
        title_topk(queries, scope, documents, max(final_k, 8)),
    )
    return rank_final(fuse(candidates), scope, queries, final_k)
