"""Registered queries: facility search and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions.text import soft_fragments
from citeloom.operators import conversation, embedding, facilities
from citeloom.plans.ingest import joined
from citeloom.plans.operations import _FEATURES
from citeloom.plans.views import oracle, table, view
from citeloom.session import staged
from citeloom.sources.readers import strip

QUERIES = {}
ORACLES = {}
DIM = 64


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def facility_table(spark, sf):
    listed = F.filter(F.transform(F.split("raw_features", r"\|"), strip), lambda x: x != "")
    return view(spark, sf, "facilities").withColumn("features", listed).drop("raw_features")


def asked(spark, sf):
    return view(spark, sf, "turns").filter("query_text <> '/reset'")


def _intents(spark, sf):
    return staged(facilities.parse_intent(asked(spark, sf), facility_table(spark, sf)))


_WORDS = ", ".join(f"'{w}'" for w in facilities.FEATURE_KEYWORDS)
_KNOWN = ", ".join(f"('{a}', '{c}')" for c, names in facilities.SERVICE_SYNONYMS.items() for a in names)
O = {  # noqa: E741
    "fac": f"""
        SELECT *, concat_ws(' ', name, prefecture, city, service_type, address, business_hours, nullif(features_text, '')) AS blob FROM (
          SELECT * EXCLUDE (raw_features), {_FEATURES.format(' ')} AS features_text, {_FEATURES.format(', ')} AS features_list FROM facilities)""",
    "aliases": f"""
        SELECT alias, canonical FROM (VALUES {_KNOWN}) t(alias, canonical)
        UNION SELECT service_type, service_type FROM facilities WHERE service_type NOT IN (SELECT a FROM (VALUES {_KNOWN}) k(a, c))""",
    "words": f"SELECT unnest([{_WORDS}]) AS word",
    "ask": "SELECT * FROM turns WHERE query_text <> '/reset'",
    "slots": """
        SELECT t.query_id, t.conv_id, t.turn, t.query_text,
               (SELECT arg_min(x, (-length(x), x)) FROM (SELECT DISTINCT prefecture AS x FROM facilities) WHERE contains(t.query_text, x)) AS prefecture,
               (SELECT arg_min(x, (-length(x), x)) FROM (SELECT DISTINCT city AS x FROM facilities) WHERE contains(t.query_text, x)) AS city,
               (SELECT arg_min(canonical, (-length(alias), alias)) FROM aliases WHERE contains(t.query_text, alias)) AS service_type,
               coalesce((SELECT list(word ORDER BY word) FROM words WHERE contains(t.query_text, word)), []) AS keywords,
               regexp_matches(t.query_text, '電話|連絡先|問い合わせ|問合せ|TEL') AS contact_requested
        FROM turns t""",
    "intents": "SELECT * FROM slots WHERE query_text <> '/reset'",
    "pairs": """
        SELECT i.*, f.facility_id, f.ordinal, f.name, f.prefecture AS fp, f.city AS fc, f.service_type AS fs, f.blob,
               coalesce(f.city = i.city, false) AS city_hit, coalesce(f.service_type = i.service_type, false) AS service_hit
        FROM {INTENTS} i CROSS JOIN fac f""",
    "in_city": "SELECT * FROM (SELECT *, bool_or(city_hit) OVER (PARTITION BY query_id) AS any_city FROM pairs) WHERE city_hit OR NOT any_city",
    "in_scope": "SELECT * FROM (SELECT *, bool_or(service_hit) OVER (PARTITION BY query_id) AS any_service FROM in_city) WHERE service_hit OR NOT any_service",
    "hit": """
        SELECT *, list_filter(keywords, lambda w: contains(blob, w)) AS found, coalesce(fp = prefecture, false) AS near, contains(query_text, name) AS named FROM in_scope""",
    "scored": """
        SELECT *, base + CASE WHEN soft THEN 0.5 ELSE 0 END AS score FROM (
          SELECT *, base = 0 AND len(list_filter(regexp_split_to_array(translate(query_text, '。、？?！!', '      '), '[ \\x{3000}]+'), lambda x: length(x) >= 2 AND contains(blob, x))) > 0 AS soft
          FROM (SELECT *, CASE WHEN near THEN 1.0 ELSE 0 END + CASE WHEN city_hit THEN 3.0 ELSE 0 END + CASE WHEN service_hit THEN 4.0 ELSE 0 END
                  + CASE WHEN named THEN 2.0 ELSE 0 END + 1.2 * len(found) AS base FROM hit))""",
    "ranked": """
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, ordinal) AS INT) AS rank FROM scored QUALIFY rank <= 3""",
    "reasoned": """
        SELECT r.*, f.* EXCLUDE (facility_id, ordinal, name, prefecture, city, service_type, blob), list_filter([
            CASE WHEN near THEN '地域一致: ' || fp END, CASE WHEN city_hit THEN '市区一致: ' || fc END, CASE WHEN service_hit THEN 'サービス一致: ' || fs END,
            CASE WHEN named THEN '事業所名一致' END, CASE WHEN soft THEN '部分一致' END], lambda x: x IS NOT NULL)
            || list_transform(found, lambda w: '条件一致: ' || w) AS reasons
        FROM ranked r JOIN fac f ON f.facility_id = r.facility_id""",
}


def facility_oracle(sql: str, source: str = "intents", **extra: str) -> str:
    return oracle(sql, **{k: v.replace("{INTENTS}", source) for k, v in O.items()}, **extra)


# -- intent ------------------------------------------------------------------


@query
def search_blob(spark, sf):
    return facility_table(spark, sf).select("facility_id", facilities.search_blob().alias("blob"))


ORACLES["search_blob"] = facility_oracle("SELECT facility_id, blob FROM fac")


@query
def service_aliases(spark, sf):
    return facilities.service_aliases(facility_table(spark, sf))


ORACLES["service_aliases"] = facility_oracle("SELECT alias, canonical AS service_type FROM aliases")


@query
def longest_match(spark, sf):
    """City named in each turn."""
    return facilities.longest_match(asked(spark, sf), facility_table(spark, sf).select("city"), "city")


ORACLES["longest_match"] = facility_oracle("SELECT query_id, city AS term FROM intents WHERE city IS NOT NULL")


@query
def match_service(spark, sf):
    return facilities.match_service(asked(spark, sf), facility_table(spark, sf))


ORACLES["match_service"] = facility_oracle("SELECT query_id, service_type FROM intents WHERE service_type IS NOT NULL")


@query
def parse_intent(spark, sf):
    out = _intents(spark, sf)
    return out.select("query_id", "prefecture", "city", "service_type", joined("keywords"), "contact_requested", facilities.needs_clarification().alias("clarify"))


ORACLES["parse_intent"] = facility_oracle("""
    SELECT query_id, prefecture, city, service_type, array_to_string(keywords, ',') AS keywords, contact_requested,
           city IS NULL AND service_type IS NULL AND len(keywords) = 0 AS clarify FROM intents""")


@query
def merge_state(spark, sf):
    """Each turn with the slots of the user's previous turn as state."""
    intents = _intents(spark, sf)
    before = view(spark, sf, "turns").select("query_id", F.lag("query_id").over(_by_turn()).alias("previous"))
    slots = intents.select(F.col("query_id").alias("previous"), "prefecture", "city", "service_type", "keywords")
    states = before.join(slots, "previous").drop("previous")
    out = facilities.merge_state(intents, states)
    return out.select("query_id", "prefecture", "city", "service_type", joined("keywords"))


def _by_turn():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("turn")


ORACLES["merge_state"] = facility_oracle("""
    SELECT i.query_id, coalesce(i.prefecture, p.prefecture) AS prefecture, coalesce(i.city, p.city) AS city, coalesce(i.service_type, p.service_type) AS service_type,
           array_to_string(list_sort(list_distinct(i.keywords || coalesce(p.keywords, []))), ',') AS keywords
    FROM intents i LEFT JOIN (SELECT query_id, lag(query_id) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM turns) t ON t.query_id = i.query_id
    LEFT JOIN intents p ON p.query_id = t.previous""")


@query
def soft_fragment_words(spark, sf):
    return asked(spark, sf).select("query_id", F.explode(soft_fragments(F.col("query_text"))).alias("fragment"))


ORACLES["soft_fragment_words"] = facility_oracle("""
    SELECT DISTINCT query_id, fragment FROM (SELECT query_id, unnest(regexp_split_to_array(translate(query_text, '。、？?！!', '      '), '[ \\x{3000}]+')) AS fragment FROM ask)
    WHERE length(fragment) >= 2""")


# -- rule search -------------------------------------------------------------


@query
def soft_filter(spark, sf):
    out = facilities.soft_filter(_intents(spark, sf), facility_table(spark, sf))
    return out.select("query_id", "scope_kind")


ORACLES["soft_filter"] = facility_oracle("""
    SELECT query_id, CASE WHEN b THEN 'both' WHEN c THEN 'city' WHEN s THEN 'service' ELSE 'all' END AS scope_kind FROM (
      SELECT query_id, (city, service_type) IN (SELECT (city, service_type) FROM facilities) AS b, city IN (SELECT city FROM facilities) AS c,
             service_type IN (SELECT service_type FROM facilities) AS s FROM intents)""")


@query
def rule_topk(spark, sf):
    out = facilities.rule_topk(_intents(spark, sf), facility_table(spark, sf))
    return out.select("query_id", "facility_id", "score", "rank")


ORACLES["rule_topk"] = facility_oracle("SELECT query_id, facility_id, CAST(round(score, 6) AS DOUBLE) AS score, rank FROM ranked")


def _explained(spark, sf):
    intents, rows = _intents(spark, sf), facility_table(spark, sf)
    return facilities.explain_candidates(facilities.rule_topk(intents, rows), intents, rows)


@query
def rule_reasons(spark, sf):
    return _explained(spark, sf).select("query_id", "rank", "facility_id", F.array_join("reasons", " / ").alias("reasons"))


ORACLES["rule_reasons"] = facility_oracle("SELECT query_id, rank, facility_id, array_to_string(reasons, ' / ') AS reasons FROM reasoned")


@query
def strong_candidates(spark, sf):
    ranked = facilities.rule_topk(_intents(spark, sf), facility_table(spark, sf))
    return facilities.strong_candidates(ranked).select("query_id", "facility_id", "rank")


ORACLES["strong_candidates"] = facility_oracle("SELECT query_id, facility_id, rank FROM ranked WHERE round(score, 6) >= 2")


@query
def render_answer(spark, sf):
    out = facilities.render_answer(facilities.strong_candidates(_explained(spark, sf)))
    return out


_ANSWER = """
    SELECT query_id, '候補を' || count(*) || '件見つけました。' || chr(10) || string_agg(rank || '. ' || name || '（' || fs || '）' || chr(10) || '   地域: ' || fp || fc || chr(10)
        || '   住所: ' || address || chr(10) || '   営業: ' || business_hours || chr(10) || '   特徴: ' || features_list || chr(10) || '   根拠: ' || array_to_string(reasons, ' / ') || chr(10)
        || '   ソース: ' || source_url || ' (ID: ' || facility_id || ')' || CASE WHEN contact_requested THEN chr(10) || '   連絡先: ' || phone ELSE '' END, chr(10) ORDER BY rank)
        || chr(10) || '注意: 最終的な空き状況・費用・受入可否は各事業所へ直接確認してください。' AS answer
    FROM reasoned WHERE round(score, 6) >= 2 GROUP BY query_id"""
ORACLES["render_answer"] = facility_oracle(_ANSWER)


@query
def render_facility(spark, sf):
    return facility_table(spark, sf).select("facility_id", facilities.render_facility().alias("doc"))


_DOC = """'[ID:' || facility_id || ']' || chr(10) || '名称: ' || name || chr(10) || 'サービス: ' || service_type || chr(10) || '地域: ' || prefecture || city || chr(10) || '住所: ' || address
    || chr(10) || '営業時間: ' || business_hours || chr(10) || '特徴: ' || features_list || chr(10) || '連絡先: ' || phone || chr(10) || '更新日: ' || last_updated || chr(10) || 'ソース: ' || source_url"""
ORACLES["render_facility"] = facility_oracle(f"SELECT facility_id, {_DOC} AS doc FROM fac")


# -- semantic search ---------------------------------------------------------


def _facility_vectors(spark, sf):
    """Stored vectors as facility vectors, by customer key; zeros beyond them."""
    rows = facility_table(spark, sf).select("facility_id", F.col("ordinal").alias("vec_id"))
    return embedding.attach_vectors(rows, table(spark, sf, "embeddings"), ["vec_id"], DIM)


def _question_vectors(spark, sf):
    """One vector question per nation and region pair of stored vectors."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("query_vec"))


@query
def semantic_topk(spark, sf):
    out = facilities.semantic_topk(_question_vectors(spark, sf), _facility_vectors(spark, sf))
    return out.select("query_id", "facility_id", F.round("score", 6).alias("score"), "rank", F.array_join("reasons", ",").alias("reason"))


_ZERO = "list_transform(range(64), lambda x: CAST(0 AS FLOAT))"
_SEMANTIC = f"""
    SELECT query_id, facility_id, score, CAST(rank AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, facility_id) AS rank FROM (
        SELECT CAST(q.vec_id AS VARCHAR) AS query_id, f.facility_id,
               CASE WHEN e.vec_id IS NULL THEN 0 ELSE round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) END AS score
        FROM embeddings q CROSS JOIN fac f LEFT JOIN embeddings e ON e.vec_id = f.ordinal)) WHERE rank <= 3"""
ORACLES["semantic_topk"] = facility_oracle(
    "SELECT query_id, facility_id, round(score, 6) AS score, rank, '意味類似: ' || printf('%.3f', score) AS reason FROM semantic", semantic=_SEMANTIC
)


@query
def semantic_recommend(spark, sf):
    out = facilities.semantic_recommend(facilities.semantic_topk(_question_vectors(spark, sf), _facility_vectors(spark, sf)))
    return out.select("query_id", "facility_id", "rank", "reason", "accepted")


ORACLES["semantic_recommend"] = facility_oracle(
    """
    SELECT query_id, facility_id, rank, '意味類似スコア: ' || printf('%.3f', score) AS reason, max(score) OVER (PARTITION BY query_id) > 0 AS accepted FROM semantic""",
    semantic=_SEMANTIC,
)


def _merged(spark, sf):
    """Rule candidates of turns and semantic candidates of the vector with the turn's number."""
    strong = facilities.strong_candidates(_explained(spark, sf)).select(F.split_part("query_id", F.lit(":"), F.lit(2)).alias("query_id"), "facility_id", "score", "rank", "reasons")
    semantic = facilities.semantic_topk(_question_vectors(spark, sf), _facility_vectors(spark, sf))
    return facilities.merge_candidates(semantic, strong)


@query
def merge_candidates(spark, sf):
    out = _merged(spark, sf)
    return out.select("query_id", "facility_id", "score", "rank", F.array_join("reasons", " / ").alias("reasons"))


_MERGED = """
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, late, at_rank) AS INT) AS rank FROM (
      SELECT coalesce(s.query_id, b.query_id) AS query_id, coalesce(s.facility_id, b.facility_id) AS facility_id, round(coalesce(s.score * 5, 0) + coalesce(b.score, 0), 6) AS score,
             s.rank IS NULL AS late, coalesce(s.rank, b.rank) AS at_rank,
             CASE WHEN s.rank IS NULL THEN [] ELSE ['意味類似: ' || printf('%.3f', s.score)] END || coalesce(b.reasons, []) AS reasons
      FROM semantic s FULL JOIN (SELECT split_part(query_id, ':', 2) AS query_id, facility_id, CAST(round(score, 6) AS DOUBLE) AS score, rank, reasons FROM reasoned WHERE round(score, 6) >= 2) b
        ON b.query_id = s.query_id AND b.facility_id = s.facility_id) QUALIFY rank <= 3"""
ORACLES["merge_candidates"] = facility_oracle(
    "SELECT query_id, facility_id, score, rank, array_to_string(reasons, ' / ') AS reasons FROM merged", semantic=_SEMANTIC, merged=_MERGED
)


# -- texts -------------------------------------------------------------------


@query
def last_turns(spark, sf):
    return facilities.last_turns(table(spark, sf, "conversations"))


ORACLES["last_turns"] = """
    SELECT conv_id, string_agg('- ' || CASE role WHEN 'user' THEN 'ユーザー' ELSE 'アシスタント' END || ': ' || text, chr(10) ORDER BY turn) AS history
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6 GROUP BY conv_id"""


@query
def facility_prompt(spark, sf):
    intents, rows = _intents(spark, sf), facility_table(spark, sf)
    ranked = facilities.strong_candidates(facilities.rule_topk(intents, rows))
    return facilities.facility_prompt(intents, ranked, rows)


ORACLES["facility_prompt"] = facility_oracle(f"""
    SELECT i.query_id, '- 都道府県: ' || coalesce(i.prefecture, '不明') || chr(10) || '- 市区: ' || coalesce(i.city, '不明') || chr(10) || '- サービス種別: ' || coalesce(i.service_type, '不明') || chr(10)
           || '- キーワード: ' || CASE WHEN len(i.keywords) > 0 THEN array_to_string(i.keywords, ', ') ELSE 'なし' END || chr(10) || '- 連絡先表示希望: ' || CASE WHEN i.contact_requested THEN 'はい' ELSE 'いいえ' END AS conditions, context
    FROM intents i JOIN (SELECT query_id, string_agg(doc, chr(10) || chr(10) ORDER BY rank) AS context
      FROM ranked JOIN (SELECT facility_id, {_DOC} AS doc FROM fac) d USING (facility_id) WHERE round(score, 6) >= 2 GROUP BY query_id) c ON c.query_id = i.query_id""")


@query
def whole_prompt(spark, sf):
    """Prompts with the question and the six turns before it."""
    turns = view(spark, sf, "turns").withColumn("role", F.when(F.col("turn") % 3 == 0, "assistant").otherwise("user"))
    turns = turns.select("query_id", "conv_id", "turn", "role", F.col("query_text").alias("text"))
    return facilities.whole_prompt(facility_prompt(spark, sf), turns)


_PARTS = facilities.PROMPT_PARTS
ORACLES["whole_prompt"] = oracle(
    f"""
    SELECT query_id, '{_PARTS[0]}' || chr(10) || query_text || chr(10) || chr(10) || '{_PARTS[1]}' || chr(10) || coalesce(history, '{facilities.NONE_LABEL}') || chr(10) || chr(10)
           || '{_PARTS[2]}' || chr(10) || conditions || chr(10) || chr(10) || '{_PARTS[3]}' || chr(10) || context AS prompt
    FROM prompts JOIN (
      SELECT query_id, query_text, string_agg('- ' || CASE WHEN turn % 3 = 0 THEN '{facilities.ASSISTANT_LABEL}' ELSE '{facilities.USER_LABEL}' END || ': ' || query_text, chr(10))
             OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS history FROM turns) USING (query_id)""",
    prompts=ORACLES["facility_prompt"],
)


# -- conversations -----------------------------------------------------------


@query
def converse_outcomes(spark, sf):
    """Every turn of every conversation with its outcome and resolved slots."""
    rows = facility_table(spark, sf)
    resolved = conversation.fold_turns(conversation.prepare_turns(view(spark, sf, "turns"), rows), conversation.coverage(rows))
    return resolved.select("conv_id", "turn", "outcome", "prefecture", "city", "service_type", joined("keywords"))


# The fold as a recursive query: state moves only on turns with strong candidates.
_FOLD = """
    SELECT conv_id, n, turn, outcome, p, c, s, k, CASE WHEN outcome = 'answer' THEN p END AS sp, CASE WHEN outcome = 'answer' THEN c END AS sc,
           CASE WHEN outcome = 'answer' THEN s END AS ss, CASE WHEN outcome = 'answer' THEN k ELSE [] END AS sk
    FROM (SELECT conv_id, n, turn, prefecture AS p, city AS c, service_type AS s, keywords AS k, {OUTCOME0} AS outcome FROM numbered WHERE n = 1)
    UNION ALL
    SELECT conv_id, n, turn, outcome, p, c, s, k,
           CASE outcome WHEN 'answer' THEN p WHEN 'reset' THEN NULL ELSE sp END, CASE outcome WHEN 'answer' THEN c WHEN 'reset' THEN NULL ELSE sc END,
           CASE outcome WHEN 'answer' THEN s WHEN 'reset' THEN NULL ELSE ss END, CASE outcome WHEN 'answer' THEN k WHEN 'reset' THEN [] ELSE sk END
    FROM (SELECT *, {OUTCOME1} AS outcome FROM (
            SELECT t.conv_id, t.n, t.turn, t.query_text, t.named, coalesce(t.prefecture, f.sp) AS p, coalesce(t.city, f.sc) AS c, coalesce(t.service_type, f.ss) AS s,
                   list_sort(list_distinct(t.keywords || f.sk)) AS k, f.sp, f.sc, f.ss, f.sk
            FROM talk f JOIN numbered t ON t.conv_id = f.conv_id AND t.n = f.n + 1))"""
_OUTCOME = """CASE WHEN query_text = '/reset' THEN 'reset' WHEN {c} IS NULL AND {s} IS NULL AND len({k}) = 0 THEN 'clarify'
    WHEN {c} IS NOT NULL OR {s} IN (SELECT service_type FROM facilities) OR named
      OR (SELECT max(len(list_intersect(ws, {k})) * 1.2 + CASE WHEN prefecture = {p} THEN 1 ELSE 0 END) FROM profiles) >= 2 THEN 'answer' ELSE 'unknown' END"""
_TALK = _FOLD.replace("{OUTCOME0}", _OUTCOME.format(p="numbered.prefecture", c="city", s="service_type", k="keywords")).replace(
    "{OUTCOME1}", _OUTCOME.format(p="p", c="c", s="s", k="k")
)
_NUMBERED = """
    SELECT s.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
           EXISTS (SELECT 1 FROM facilities f WHERE f.name = regexp_extract(s.query_text, 'Customer#[0-9]{9}')) AS named
    FROM slots s"""
_PROFILES = f"SELECT DISTINCT prefecture, list_filter([{_WORDS}], lambda w: contains(blob, w)) AS ws FROM fac"
_TALK_VIEWS = {"numbered": _NUMBERED, "profiles": _PROFILES, "talk": _TALK}
ORACLES["converse_outcomes"] = facility_oracle(
    """
    SELECT conv_id, turn, outcome, CASE WHEN outcome <> 'reset' THEN p END AS prefecture, CASE WHEN outcome <> 'reset' THEN c END AS city,
           CASE WHEN outcome <> 'reset' THEN s END AS service_type, CASE WHEN outcome <> 'reset' THEN array_to_string(k, ',') ELSE '' END AS keywords FROM talk""",
    **_TALK_VIEWS,
)


@query
def converse(spark, sf):
    """Every turn answered: the listing, the clarification or the unknown text."""
    return conversation.converse(view(spark, sf, "turns"), facility_table(spark, sf))[0]


_RESOLVED = """
    SELECT t.conv_id || ':' || t.turn AS query_id, x.query_text, p AS prefecture, c AS city, s AS service_type, k AS keywords, x.contact_requested
    FROM talk t JOIN slots x ON x.conv_id = t.conv_id AND x.turn = t.turn WHERE outcome = 'answer'"""
ORACLES["converse"] = facility_oracle(
    f"""
    SELECT conv_id, turn, outcome, CASE outcome WHEN 'clarify' THEN '条件が不足しているため候補を絞れませんでした。' || chr(10) || '地域（例: 世田谷区）かサービス種別（例: デイサービス）を教えてください。'
             WHEN 'unknown' THEN '該当候補を十分な根拠で提示できませんでした（不明）。' || chr(10) || '地域やサービス種別を具体化して再度お試しください。' ELSE answer END AS answer
    FROM talk LEFT JOIN ({_ANSWER}) a ON a.query_id = conv_id || ':' || turn""",
    source="resolved_turns",
    resolved_turns=_RESOLVED,
    **_TALK_VIEWS,
)
