"""Registered queries: vector, keyword and title search, fusion, ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from citeloom.functions import links, text, vectors
from citeloom.operators import embedding, retrieval, vector_search
from citeloom.plans.ingest import _POSTINGS, DIM, _garbled, corpus_chunks
from citeloom.plans.views import oracle, table, view
from citeloom.session import shared_dir, staged
from citeloom.sources import tables

QUERIES = {}
ORACLES = {}
K = 10


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# -- tables ------------------------------------------------------------------


def stored_chunks(spark, sf):
    """Corpus chunks with the stored vector of (document id + chunk number)."""
    chunks = corpus_chunks(spark, sf).withColumn("vec_id", F.col("document_id").cast("bigint") + F.col("chunk_index"))
    return staged(embedding.attach_vectors(chunks, table(spark, sf, "embeddings"), ["vec_id"], DIM).drop("vec_id"))


def stored_queries(spark, sf):
    rows = view(spark, sf, "queries").withColumn("vec_id", F.col("item_id") * 31 + F.col("pos"))
    found = embedding.attach_vectors(rows, table(spark, sf, "embeddings"), ["vec_id"], DIM)
    return staged(found.withColumnRenamed("embedding", "query_vec").select("query_id", "workspace_id", "query_text", "query_vec"))


def labelled(spark, sf):
    """Every stored vector as item and as query, within its label."""
    rows = table(spark, sf, "embeddings").withColumn("workspace_id", F.col("label").cast("string"))
    items = rows.select("workspace_id", F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    queries = rows.select("workspace_id", F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("query_vec"))
    return queries, items


_SIM = "coalesce(round(CASE WHEN isnan({s}) THEN 0 ELSE {s} END, 9), 0)"


def similarity(a: str, b: str) -> str:
    return _SIM.format(s=f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))")


_ZERO = "list_transform(range(64), lambda x: CAST(0 AS FLOAT))"
#: Views of the oracle, by name.
O = {  # noqa: E741
    "postings": _POSTINGS.replace("FROM chunks", "FROM scope"),
    "scope": """
        SELECT c.*, d.file_name, d.mime_type, d.storage_key FROM chunks c JOIN docs d ON d.document_id = c.document_id WHERE d.status = 'ready'""",
    "qterms": """
        SELECT query_id, workspace_id, unnest(list_distinct(regexp_extract_all(lower(query_text), '[\\p{L}\\p{N}]+'))) AS term FROM queries""",
    "qsize": "SELECT query_id, count(*) AS n FROM qterms GROUP BY query_id",
    "matched": """
        SELECT t.query_id, p.chunk_id FROM qterms t JOIN postings p ON p.workspace_id = t.workspace_id AND p.term = t.term
        JOIN qsize USING (query_id) GROUP BY t.query_id, p.chunk_id HAVING count(DISTINCT p.term) = any_value(n)""",
    "hits": """
        SELECT m.query_id, m.chunk_id, p.term, p.pos, row_number() OVER (PARTITION BY m.query_id, m.chunk_id ORDER BY p.pos) AS nth
        FROM matched m JOIN qterms t ON t.query_id = m.query_id JOIN postings p ON p.chunk_id = m.chunk_id AND p.term = t.term""",
    "covers": """
        SELECT query_id, chunk_id, e, min(latest) AS s
        FROM (SELECT a.query_id, a.chunk_id, a.pos AS e, b.term, max(b.pos) AS latest
              FROM hits a JOIN hits b ON b.query_id = a.query_id AND b.chunk_id = a.chunk_id AND b.pos <= a.pos GROUP BY ALL)
        JOIN qsize USING (query_id) GROUP BY query_id, chunk_id, e HAVING count(*) = any_value(n)""",
    "keyword_scores": """
        SELECT c.query_id, c.chunk_id, round(sum(0.1 / (1 + (c.e - c.s + 1) - (y.nth - x.nth + 1))), 9) AS score
        FROM (SELECT query_id, chunk_id, s, min(e) AS e FROM covers GROUP BY ALL) c
        JOIN hits x ON x.query_id = c.query_id AND x.chunk_id = c.chunk_id AND x.pos = c.s
        JOIN hits y ON y.query_id = c.query_id AND y.chunk_id = c.chunk_id AND y.pos = c.e GROUP BY ALL""",
    "keyword_best": """
        SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
        FROM keyword_scores QUALIFY rank <= 30""",
    "normed": "SELECT query_id, workspace_id, query_text, regexp_replace(lower(query_text), '[^0-9a-zぁ-んァ-ヶ一-龠]+', '', 'g') AS norm FROM queries",
    "frags": """
        SELECT query_id, workspace_id, frag FROM (SELECT query_id, workspace_id, unnest([
          trim(replace(replace(replace(replace(replace(replace(replace(replace(replace(norm, 'について', ''), '教えて', ''), 'ください', ''), '流れ', ''), '手順', ''), '方法', ''), '確認', ''), 'とは', ''), 'ですか', ''), 'のをはがにへと'), norm]) AS frag FROM normed)
        WHERE length(frag) >= 2 GROUP BY ALL""",
    "title_best": """
        SELECT query_id, chunk_id, CAST(1 AS DOUBLE) AS score, rank FROM (
          SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY document_id, chunk_index, chunk_id) AS rank
          FROM (SELECT DISTINCT f.query_id, s.chunk_id, s.document_id, s.chunk_index FROM frags f JOIN scope s
                ON s.workspace_id = f.workspace_id AND contains(lower(s.file_name), f.frag))) WHERE rank <= 12""",
    "qvec": f"""
        SELECT q.query_id, q.workspace_id, coalesce(e.embedding, {_ZERO}) AS v FROM queries q LEFT JOIN embeddings e ON e.vec_id = q.item_id * 31 + q.pos""",
    "cvec": f"""
        SELECT s.chunk_id, s.workspace_id, coalesce(e.embedding, {_ZERO}) AS v FROM scope s
        LEFT JOIN embeddings e ON e.vec_id = CAST(s.document_id AS BIGINT) + s.chunk_index""",
    "vector_best": f"""
        SELECT query_id, chunk_id, score, rank FROM (
          SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
          FROM (SELECT q.query_id, c.chunk_id, {similarity('q.v', 'c.v')} AS score FROM qvec q JOIN cvec c USING (workspace_id)))
        WHERE rank <= 30""",
    "candidates": """
        SELECT *, 'vector' AS source, 0 AS source_order FROM vector_best UNION ALL SELECT *, 'keyword', 1 FROM keyword_best
        UNION ALL SELECT *, 'title', 2 FROM title_best""",
    "scaled": """
        SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0
                       ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm
        FROM candidates WINDOW w AS (PARTITION BY query_id, source)""",
    "fused": """
        SELECT query_id, chunk_id, max(CASE WHEN source = 'title' THEN greatest(norm, score) ELSE norm END) AS score,
               max(CASE WHEN source = 'vector' THEN score ELSE least(greatest(score, 0), 1) END) AS raw_score,
               min(source_order) AS source_order, arg_min(rank, source_order) AS source_rank
        FROM scaled GROUP BY query_id, chunk_id""",
    "parts": """
        SELECT f.*, s.file_name, s.mime_type, s.storage_key, s.document_id, s.workspace_id, s.text, n.norm, n.query_text,
               CASE WHEN s.snippet <> '' THEN s.snippet ELSE substr(s.text, 1, 300) END AS snippet,
               regexp_replace(lower(regexp_replace(s.file_name, '^(.+)[.][^.]+$', '\\1')), '[^0-9a-zぁ-んァ-ヶ一-龠]+', '', 'g') AS title
        FROM fused f JOIN scope s USING (chunk_id) JOIN normed n USING (query_id)""",
    "bonused": f"""
        SELECT *, CASE WHEN length(norm) < 2 OR norm IN ('について', 'ください', '教えて', '流れ', '手順', '方法', '確認', 'こと') THEN 0 ELSE
                 CASE WHEN contains(title || ' ' || regexp_replace(lower(snippet), '[^0-9a-zぁ-んァ-ヶ一-龠]+', '', 'g'), norm) THEN 0.06 ELSE 0 END
                 + CASE WHEN title <> '' AND (contains(norm, title) OR contains(title, norm)) THEN 0.18 ELSE 0 END END AS bonus,
               CASE WHEN {_garbled("(file_name || chr(10) || snippet || chr(10) || substr(text, 1, 800))")} THEN 0.35 ELSE 0 END AS penalty
        FROM parts""",
    "final": """
        SELECT query_id, chunk_id, document_id, file_name, CASE WHEN mime_type LIKE 'video/%' THEN 'video' ELSE 'page' END AS ref_type,
               CASE WHEN mime_type LIKE 'video/%' THEN '冒頭' ELSE 'section:unknown' END AS ref, score, round(raw_score, 6) AS raw_score,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_order, source_rank, chunk_id) AS rank, snippet, text, storage_key
        FROM (SELECT * REPLACE (round(greatest(0, least(1.5, score + bonus - penalty)), 6) AS score) FROM bonused) QUALIFY rank <= 12""",
}


def search_oracle(sql: str) -> str:
    return oracle(sql, **O)


# -- vectors -----------------------------------------------------------------


@query
def cosine(spark, sf):
    """Each vector against its successor."""
    rows = table(spark, sf, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return rows.join(after, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 6).alias("score"))


ORACLES["cosine"] = """
    SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


@query
def vector_topk(spark, sf):
    queries, items = labelled(spark, sf)
    return _shown(vector_search.vector_topk(queries, items, K))


def _shown(hits):
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


ORACLES["vector_topk"] = f"""
    SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(c.vec_id AS VARCHAR) AS chunk_id, {similarity('q.embedding', 'c.embedding')} AS score
        FROM embeddings q JOIN embeddings c USING (label))) WHERE rank <= {K}"""


@query
def vector_topk_blocks(spark, sf):
    """The distributed product, used when the query vectors are too large to broadcast."""
    queries, items = labelled(spark, sf)
    return _shown(vector_search.vector_topk(queries, items, K, broadcast_bytes=0))


ORACLES["vector_topk_blocks"] = ORACLES["vector_topk"]


def _one_space(spark, sf):
    """All vectors as one space, each asked."""
    queries, items = labelled(spark, sf)
    return queries.withColumn("workspace_id", F.lit("all")), items.withColumn("workspace_id", F.lit("all"))


def _clustered(spark, items):
    """Vectors stored by cluster, and the centres."""
    centres = vector_search.ivf_fit(items, lists=16)
    path = f"{shared_dir(spark)}/clusters/{uuid.uuid4().hex}"
    vector_search.write_clusters(vector_search.ivf_assign(items, centres), path)
    return spark.read.parquet(path), centres


@query
def ivf_topk(spark, sf):
    """Clustered search over all vectors as one space: lists are probed until their bounds can't do better."""
    queries, items = _one_space(spark, sf)
    assigned, centres = _clustered(spark, items)
    return _shown(vector_search.ivf_search(queries, assigned, centres, K))


ORACLES["ivf_topk"] = ORACLES["vector_topk"].replace("JOIN embeddings c USING (label)", "CROSS JOIN embeddings c")


@query
def ivf_topk_all(spark, sf):
    """Within each label, the clustered search with every list probed is exact."""
    queries, items = labelled(spark, sf)
    assigned, centres = _clustered(spark, items)
    return _shown(vector_search.ivf_topk(queries, assigned, centres, K, 16))


ORACLES["ivf_topk_all"] = ORACLES["vector_topk"]


# -- scope and keyword -------------------------------------------------------


@query
def searchable(spark, sf):
    scope = retrieval.searchable(corpus_chunks(spark, sf), view(spark, sf, "docs"))
    return scope.select("chunk_id", "workspace_id", "document_id", "file_name", "storage_key")


ORACLES["searchable"] = search_oracle("SELECT chunk_id, workspace_id, document_id, file_name, storage_key FROM scope")


def _scope(spark, sf):
    return retrieval.searchable(staged(corpus_chunks(spark, sf)), view(spark, sf, "docs"))


@query
def keyword_match(spark, sf):
    """All matches with their cover density."""
    hits = retrieval.keyword_match(view(spark, sf, "queries"), _scope(spark, sf))
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


ORACLES["keyword_match"] = search_oracle("SELECT query_id, chunk_id, round(score, 6) AS score FROM keyword_scores")


@query
def keyword_topk(spark, sf):
    return _shown(retrieval.keyword_topk(view(spark, sf, "queries"), _scope(spark, sf)))


@query
def keyword_topk_indexed(spark, sf):
    """The same from stored postings: only folders of asked terms are read, and no chunk text."""
    path = f"{shared_dir(spark)}/postings/{uuid.uuid4().hex}"
    # the chunks are read once, so they aren't stored before
    scope = retrieval.searchable(corpus_chunks(spark, sf), view(spark, sf, "docs"))
    tables.write_postings(retrieval.build_postings(scope), path)
    asked = view(spark, sf, "queries")
    terms = asked.select(F.explode(text.tokens(F.col("query_text"))).alias("term"))
    return _shown(retrieval.keyword_topk_indexed(asked, tables.read_postings(spark, path, terms)))


ORACLES["keyword_topk"] = search_oracle("SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM keyword_best")
ORACLES["keyword_topk_indexed"] = ORACLES["keyword_topk"]


# -- title -------------------------------------------------------------------


@query
def query_fragments(spark, sf):
    rows = view(spark, sf, "queries")
    return rows.select("query_id", F.explode(text.query_fragments(F.col("query_text"))).alias("fragment"))


ORACLES["query_fragments"] = search_oracle("SELECT query_id, frag AS fragment FROM frags")


@query
def match_text(spark, sf):
    """Normalised text and significant tokens of every conversation turn."""
    norm = text.normalize_match(F.col("text"))
    words = text.significant_tokens(F.lower("text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", norm.alias("norm"), F.size(words).cast("bigint").alias("tokens"), F.array_join(F.array_sort(words), " ").alias("words")
    )


ORACLES["match_text"] = """
    SELECT conv_id, turn, regexp_replace(lower(text), '[^0-9a-zぁ-んァ-ヶ一-龠]+', '', 'g') AS norm, len(w) AS tokens, array_to_string(list_sort(w), ' ') AS words
    FROM (SELECT *, list_distinct(regexp_extract_all(lower(text), '[0-9a-zぁ-んァ-ヶ一-龠]{2,}')) AS w FROM conversations)"""


@query
def title_topk(spark, sf):
    return _shown(retrieval.title_topk(view(spark, sf, "queries"), _scope(spark, sf), view(spark, sf, "docs")))


ORACLES["title_topk"] = search_oracle("SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM title_best")


# -- fusion ------------------------------------------------------------------


def _candidates(spark, sf):
    scope, queries = retrieval.searchable(stored_chunks(spark, sf), view(spark, sf, "docs")), stored_queries(spark, sf)
    return retrieval.tag_sources(
        vector_search.vector_topk(queries, scope, 30),
        retrieval.keyword_topk(queries, scope, 30),
        retrieval.title_topk(queries, scope, view(spark, sf, "docs"), 12),
    )


@query
def minmax(spark, sf):
    """Event values scaled per user and type."""
    rows = table(spark, sf, "events").withColumn("score", F.col("value"))
    out = retrieval.minmax(rows, ["user_id", "event_type"])
    return out.select("event_id", F.round("norm", 6).alias("norm"))


ORACLES["minmax"] = """
    SELECT event_id, round(CASE WHEN max(value) OVER w = min(value) OVER w THEN 1.0 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6) AS norm
    FROM events WINDOW w AS (PARTITION BY user_id, event_type)"""


@query
def fuse(spark, sf):
    out = retrieval.fuse(_candidates(spark, sf))
    return out.select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), F.round("raw_score", 6).alias("raw_score"), "source_order", "source_rank"
    )


ORACLES["fuse"] = search_oracle("""
    SELECT query_id, chunk_id, round(score, 6) AS score, round(raw_score, 6) AS raw_score, CAST(source_order AS INT) AS source_order,
           CAST(source_rank AS INT) AS source_rank FROM fused""")


@query
def alignment_bonus(spark, sf):
    """Questions against the titles of the documents found by title, with a section of the question's words."""
    queries, docs = view(spark, sf, "queries"), view(spark, sf, "docs")
    scope = _scope(spark, sf)
    found = retrieval.title_topk(queries, scope, docs).join(scope, "chunk_id").join(queries.select("query_id", "query_text"), "query_id")
    section = F.when(F.col("chunk_index") % 2 == 0, F.concat(F.lit("About "), "query_text"))
    bonus = retrieval.alignment_bonus(F.col("query_text"), F.col("file_name"), section, F.col("snippet"))
    penalty = retrieval.garble_penalty(F.col("file_name"), F.col("snippet"), F.col("text"))
    return found.select("query_id", "chunk_id", F.round(bonus, 6).alias("bonus"), penalty.alias("penalty"))


_BONUS = f"""
    SELECT query_id, chunk_id, round(CASE WHEN length(norm) < 2 THEN 0 ELSE
             CASE WHEN contains(title || ' ' || section || ' ' || short, norm) THEN 0.06 ELSE 0 END
             + CASE WHEN title <> '' AND (contains(norm, title) OR contains(title, norm)) THEN 0.18 ELSE 0 END
             + CASE WHEN section <> '' AND contains(section, norm) THEN 0.06 ELSE 0 END END, 6)::DOUBLE AS bonus,
           CAST(CASE WHEN {_garbled("(file_name || chr(10) || snippet || chr(10) || substr(text, 1, 800))")} THEN 0.35 ELSE 0 END AS DOUBLE) AS penalty
    FROM (SELECT t.query_id, t.chunk_id, n.norm, s.file_name, s.snippet, s.text,
                 CASE WHEN s.chunk_index % 2 = 0 THEN 'about' || n.norm ELSE '' END AS section,
                 regexp_replace(lower(s.snippet), '[^0-9a-zぁ-んァ-ヶ一-龠]+', '', 'g') AS short,
                 regexp_replace(lower(regexp_replace(s.file_name, '^(.+)[.][^.]+$', '\\1')), '[^0-9a-zぁ-んァ-ヶ一-龠]+', '', 'g') AS title
          FROM title_best t JOIN scope s USING (chunk_id) JOIN normed n USING (query_id))"""
ORACLES["alignment_bonus"] = search_oracle(_BONUS)


@query
def citation_ref(spark, sf):
    """References of event rows read as chunks: videos, page spans, sections."""
    kind = F.col("event_id") % 6
    mime = F.when(kind < 2, "video/mp4").otherwise("application/pdf")
    start = F.when(kind != 1, F.when(kind < 4, F.col("user_id") * 37).cast("int"))
    end = F.when(kind == 2, F.col("user_id") * 37 + 2).when(kind == 3, F.col("user_id") * 37).cast("int")
    section = F.when(kind == 4, F.col("event_type"))
    ref = links.citation_ref(mime, start, end, section)
    return table(spark, sf, "events").select("event_id", ref.alias("r")).select("event_id", "r.ref_type", "r.ref")


ORACLES["citation_ref"] = """
    SELECT event_id, CASE WHEN event_id % 6 < 2 THEN 'video' ELSE 'page' END AS ref_type,
           CASE event_id % 6 WHEN 0 THEN printf('%02d:%02d', user_id * 37 // 60, user_id * 37 % 60)
             WHEN 1 THEN '冒頭' WHEN 2 THEN 'p.' || user_id * 37 || '-' || (user_id * 37 + 2) WHEN 3 THEN 'p.' || user_id * 37
             WHEN 4 THEN 'section:' || event_type ELSE 'section:unknown' END AS ref FROM events"""


@query
def snippet_or_text(spark, sf):
    """Turns whose snippet is missing for every third row."""
    short = F.when(F.col("turn") % 3 == 0, F.lit("")).when(F.col("turn") % 3 == 1, F.substring("text", 1, 20))
    return table(spark, sf, "conversations").select("conv_id", "turn", retrieval.snippet_or_text(short, F.col("text")).alias("snippet"))


ORACLES["snippet_or_text"] = "SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN substr(text, 1, 20) ELSE substr(text, 1, 300) END AS snippet FROM conversations"


@query
def hybrid_retrieve(spark, sf):
    """Every question over the whole corpus: the best passages with their citation reference."""
    out = retrieval.hybrid_retrieve(stored_queries(spark, sf), stored_chunks(spark, sf), view(spark, sf, "docs"))
    return out.select("query_id", "rank", "chunk_id", "document_id", "file_name", "ref_type", "ref", "score", "raw_score", "snippet", "storage_key")


ORACLES["hybrid_retrieve"] = search_oracle("""
    SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, document_id, file_name, ref_type, ref, score, raw_score, snippet, storage_key FROM final""")
