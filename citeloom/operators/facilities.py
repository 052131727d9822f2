"""Rule and semantic search of a facility table for a table of questions.

A question is never scored against every facility. Facilities that agree on
prefecture, city, service and the fifteen feature keywords score the same for any
question, so each such class keeps only its first ``k`` facilities; names and free
words are found through substring keys. The result equals scoring everything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text
from citeloom.operators.matching import FEW_TERMS, substring_pairs
from citeloom.operators.vector_search import vector_topk
from citeloom.session import staged

# --- fixed values -----------------------------------------------------------
SERVICE_SYNONYMS = {
    "デイサービス": ["デイサービス", "通所介護", "通所サービス"],
    "訪問介護": ["訪問介護", "ホームヘルプ", "ヘルパー"],
    "ショートステイ": ["ショートステイ", "短期入所"],
    "グループホーム": ["グループホーム", "認知症対応型共同生活介護"],
    "有料老人ホーム": ["有料老人ホーム", "介護付き有料", "住宅型有料"],
    "居宅介護支援": ["居宅介護支援", "ケアマネ", "ケアマネジャー"],
}
FEATURE_KEYWORDS = [
    "認知症",
    "送迎",
    "入浴",
    "機能訓練",
    "リハビリ",
    "看護師",
    "医療連携",
    "夜間",
    "24時間",
    "土日",
    "短時間",
    "女性スタッフ",
    "男性スタッフ",
    "要支援",
    "要介護",
]
CONTACT_KEYWORDS = ["電話", "連絡先", "問い合わせ", "問合せ", "TEL"]
CLARIFY_TEXT = (
    "条件が不足しているため候補を絞れませんでした。\n"
    "地域（例: 世田谷区）かサービス種別（例: デイサービス）を教えてください。"
)
UNKNOWN_TEXT = (
    "該当候補を十分な根拠で提示できませんでした（不明）。\n地域やサービス種別を具体化して再度お試しください。"
)
REJECT_TEXT = "該当候補を十分な根拠で提示できませんでした（不明）。地域やサービス種別を具体化して再度お試しください。"
CLOSING_LINE = "注意: 最終的な空き状況・費用・受入可否は各事業所へ直接確認してください。"
PREFECTURE_SCORE, CITY_SCORE, SERVICE_SCORE, NAME_SCORE, KEYWORD_SCORE, SOFT_SCORE = 1.0, 3.0, 4.0, 2.0, 1.2, 0.5
STRONG_SCORE, SEMANTIC_WEIGHT, HISTORY_TURNS = 2.0, 5.0, 6
USER_LABEL, ASSISTANT_LABEL, NONE_LABEL = "ユーザー", "アシスタント", "なし"
PROMPT_PARTS = ("相談内容:", "会話履歴(直近):", "抽出条件:", "参照データ:")
# ----------------------------------------------------------------------------


def search_blob() -> Column:
    return F.concat_ws(
        " ", "name", "prefecture", "city", "service_type", "address", "business_hours", "features"
    )


# -- intent ------------------------------------------------------------------


def service_aliases(facilities: DataFrame) -> DataFrame:
    """``alias, service_type``: the fixed synonyms first, then every service in the data."""
    spark = facilities.sparkSession
    fixed = [(a, name) for name, names in SERVICE_SYNONYMS.items() for a in [*names, name]]
    known = spark.createDataFrame(sorted(set(fixed)), "alias string, service_type string")
    own = facilities.select(F.col("service_type").alias("alias"), "service_type").distinct()
    either = known.withColumn("_p", F.lit(0)).unionByName(own.withColumn("_p", F.lit(1)))
    return either.groupBy("alias").agg(F.min_by("service_type", "_p").alias("service_type"))


def longest_match(queries: DataFrame, terms: DataFrame, term_col: str) -> DataFrame:
    """``query_id, term``: the longest term inside each query text, the first in order on ties."""
    found = substring_pairs(queries, terms, "query_id", "query_text", term_col, [])
    best = F.min(F.struct((-F.length(term_col)).alias("n"), F.col(term_col).alias("term")))
    return found.groupBy("query_id").agg(best.alias("_b")).select("query_id", F.col("_b.term").alias("term"))


def feature_keywords(query: Column) -> Column:
    every = F.array(*[F.lit(k) for k in FEATURE_KEYWORDS])
    return F.sort_array(F.filter(every, lambda k: query.contains(k)))


def contact_requested(query: Column) -> Column:
    return reduce(lambda a, b: a | b, [query.contains(k) for k in CONTACT_KEYWORDS])


def match_service(queries: DataFrame, facilities: DataFrame) -> DataFrame:
    aliases = service_aliases(facilities)
    hit = longest_match(queries, aliases, "alias")
    return hit.join(aliases, hit["term"] == aliases["alias"]).select("query_id", "service_type")


def own_intent(queries: DataFrame, facilities: DataFrame) -> DataFrame:
    """Slots named in ``queries(query_id, query_text)`` itself, all dictionaries in one pass."""
    aliases = service_aliases(facilities)
    terms = (
        facilities.select(F.col("prefecture").alias("term"), F.lit("prefecture").alias("slot"), F.col("prefecture").alias("value"))
        .unionAll(facilities.select("city", F.lit("city"), "city"))
        .distinct()
        .unionAll(aliases.select("alias", F.lit("service"), "service_type"))
    )
    query = F.col("query_text")
    spoken = [feature_keywords(query).alias("keywords"), contact_requested(query).alias("contact_requested")]
    few = terms.filter(F.length("term") > 0).limit(FEW_TERMS + 1).collect()
    if len(few) <= FEW_TERMS:
        # a small dictionary is tried in place, the best term first: no turn is exchanged
        ranked = sorted(few, key=lambda r: (-len(r["term"]), r["term"], r["value"]))

        def first(slot: str) -> Column:
            tried = [F.when(query.contains(r["term"]), F.lit(r["value"])) for r in ranked if r["slot"] == slot]
            return F.when(F.col("query_id").isNotNull(), F.coalesce(*tried, F.lit(None).cast("string")))

        slots = [first("prefecture").alias("prefecture"), first("city").alias("city"), first("service").alias("service_type")]
        return queries.select(*queries.columns, *slots, *spoken)
    found = substring_pairs(queries, terms, "query_id", "query_text", "term", []).join(terms, "term")
    rank = F.struct((-F.length("term")).alias("n"), F.col("term").alias("t"), F.col("value").alias("v"))

    def best(slot: str) -> Column:
        return F.min(F.when(F.col("slot") == slot, rank))["v"]

    slots = found.groupBy("query_id").agg(
        best("prefecture").alias("prefecture"), best("city").alias("city"), best("service").alias("service_type")
    )
    return queries.join(slots, "query_id", "left").select(*queries.columns, "prefecture", "city", "service_type", *spoken)


def merge_state(intents: DataFrame, states: DataFrame) -> DataFrame:
    """Fill missing slots from ``states(query_id, prefecture, city, service_type, keywords)``."""
    slots = ["prefecture", "city", "service_type"]
    old = states.select("query_id", *[F.col(c).alias(f"_{c}") for c in [*slots, "keywords"]])
    joined = intents.join(old, "query_id", "left")
    for slot in slots:
        joined = joined.withColumn(slot, F.coalesce(slot, f"_{slot}"))
    none = F.array().cast("array<string>")
    both = F.sort_array(F.array_union("keywords", F.coalesce("_keywords", none)))
    return joined.withColumn("keywords", both).select(*intents.columns)


def parse_intent(queries: DataFrame, facilities: DataFrame, states: DataFrame | None = None) -> DataFrame:
    intents = own_intent(queries, facilities)
    return intents if states is None else merge_state(intents, states)


def needs_clarification() -> Column:
    return F.col("city").isNull() & F.col("service_type").isNull() & (F.size("keywords") == 0)


# -- rule search -------------------------------------------------------------


def _mask(has: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(has)])


def dealt_blobs(facilities: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and ``blob``, dealt to all cores: a facility table comes in few splits, and its texts are made once but read often."""
    cores = facilities.sparkSession.sparkContext.defaultParallelism
    return facilities.select(*columns, search_blob().alias("blob")).repartition(2 * cores, "facility_id", "ordinal")


def keyword_mask() -> Column:
    """Which ``FEATURE_KEYWORDS`` are in ``blob``, as bits."""
    return _mask([F.col("blob").contains(k) for k in FEATURE_KEYWORDS])


def _profiles(facilities: DataFrame) -> DataFrame:
    columns = ["facility_id", "ordinal", "name", "prefecture", "city", "service_type"]
    return dealt_blobs(facilities, *columns).withColumn("mask", keyword_mask())


def _scope(kind: str, *columns: str) -> Column:
    return F.to_json(F.array(F.lit(kind), *[F.col(c) for c in columns]))


#: Candidate sets a question can be narrowed to: city and service, city, service, everything.
_SCOPES = {
    "both": ("city", "service_type"),
    "city": ("city",),
    "service": ("service_type",),
    "all": (),
}


def soft_filter(intents: DataFrame, facilities: DataFrame) -> DataFrame:
    """Add ``scope_kind`` and ``scope``: city if any facility matches, then service within that."""
    rows = intents
    for kind in ("both", "city", "service"):
        keys = list(_SCOPES[kind])
        known = facilities.select(*keys).distinct().withColumn(f"_{kind}", F.lit(True))
        rows = rows.join(known, keys, "left")
    kind = (
        F.when(F.col("_both"), "both").when(F.col("_city"), "city").when(F.col("_service"), "service").otherwise("all")
    )
    rows = rows.withColumn("scope_kind", kind)
    scope = F.when(F.col("scope_kind") == "both", _scope("both", "city", "service_type"))
    scope = scope.when(F.col("scope_kind") == "city", _scope("city", "city"))
    scope = scope.when(F.col("scope_kind") == "service", _scope("service", "service_type")).otherwise(_scope("all"))
    return rows.withColumn("scope", scope).select(*intents.columns, "scope_kind", "scope")


def _classes(profiles: DataFrame, k: int, *extra: str) -> DataFrame:
    """First ``k`` facilities of every class of equal score, per candidate set."""
    scopes = F.array(*[_scope(kind, *cols) for kind, cols in _SCOPES.items()])
    spread = profiles.withColumn("scope", F.explode(scopes))
    order = Window.partitionBy("scope", *extra, "prefecture", "mask").orderBy("ordinal", "facility_id")
    first = spread.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
    return first.select("scope", *extra, "facility_id", "ordinal", F.col("prefecture").alias("f_prefecture"), F.col("mask").alias("f_mask"))


def _base_score() -> Column:
    bits = F.bit_count(F.col("f_mask").bitwiseAND(F.col("q_mask")))
    near = F.when(F.col("f_prefecture") == F.col("prefecture"), PREFECTURE_SCORE).otherwise(0.0)
    city = F.when(F.col("scope_kind").isin("both", "city"), CITY_SCORE).otherwise(0.0)
    service = F.when(F.col("scope_kind").isin("both", "service"), SERVICE_SCORE).otherwise(0.0)
    return near + city + service + bits * KEYWORD_SCORE


def rule_topk(intents: DataFrame, facilities: DataFrame, k: int = 3) -> DataFrame:
    """Best ``k`` facilities by rule score: ``query_id, facility_id, score, soft, rank``.

    ``intents(query_id, query_text, prefecture, city, service_type, keywords)``.
    """
    profiles = staged(_profiles(facilities))
    scoped = soft_filter(intents, facilities).withColumn(
        "q_mask", _mask([F.array_contains("keywords", word) for word in FEATURE_KEYWORDS])
    )
    # equal intents are scored once
    parts = ["scope", "scope_kind", "prefecture", "q_mask"]
    scoped = scoped.withColumn("shape", F.to_json(F.struct(*parts))).select("query_id", "query_text", "shape", *parts)
    scoped = staged(scoped)
    shapes = scoped.select("shape", *parts).distinct()
    scored = shapes.join(_classes(profiles, k), "scope").withColumn("score", _base_score())
    order = Window.partitionBy("shape").orderBy(F.desc("score"), "ordinal", "facility_id")
    base = scored.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
    base = base.select("shape", "scope_kind", "facility_id", "ordinal", "score", F.lit(False).alias("soft"))
    found = ["query_id", "facility_id", "ordinal", "score", "soft"]
    owned = scoped.select("query_id", "shape").join(base, "shape").select(found)
    # facilities named in the question
    names = substring_pairs(
        scoped.select("query_id", "query_text"), profiles.select("name"), "query_id", "query_text", "name", []
    )
    named = (
        scoped.join(names, "query_id")
        .join(_classes(profiles, k, "name"), ["scope", "name"])
        .withColumns({"score": _base_score() + NAME_SCORE, "soft": F.lit(False)})
        .select(found)
    )
    # free words, only where nothing narrows the question and fewer than k facilities score
    weak = base.filter("scope_kind = 'all'").groupBy("shape").agg(F.count_if(F.col("score") > 0).alias("_hits"))
    weak = weak.filter(F.col("_hits") < k).select("shape")
    words = scoped.join(weak, "shape").select(
        "query_id", "shape", "prefecture", "q_mask", F.explode(text.soft_fragments(F.col("query_text"))).alias("fragment")
    )
    blobs = profiles.select("facility_id", "blob")
    inside = substring_pairs(blobs, words, "facility_id", "blob", "fragment", []).join(profiles, "facility_id")
    first = Window.partitionBy("fragment", "prefecture", "mask").orderBy("ordinal", "facility_id")
    inside = inside.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k).select(
        "fragment", "facility_id", "ordinal", F.col("prefecture").alias("f_prefecture"), F.col("mask").alias("f_mask")
    )
    unscored = (F.col("f_mask").bitwiseAND(F.col("q_mask")) == 0) & ~F.col("f_prefecture").eqNullSafe(F.col("prefecture"))
    lead = Window.partitionBy("shape", "fragment").orderBy("ordinal", "facility_id")
    loose = (
        words.select("shape", "prefecture", "q_mask", "fragment")
        .distinct()
        .join(inside, "fragment")
        .filter(unscored)
        .withColumn("_n", F.row_number().over(lead))
        .filter(F.col("_n") <= k)
        .select("shape", "fragment", "facility_id", "ordinal", F.lit(SOFT_SCORE).alias("score"), F.lit(True).alias("soft"))
    )
    soft = words.select("query_id", "shape", "fragment").join(loose, ["shape", "fragment"]).select(found)
    # one exchange for the candidates and for their order
    every = owned.unionByName(named).unionByName(soft).repartition("query_id")
    best = every.groupBy("query_id", "facility_id", "ordinal").agg(
        F.max("score").alias("score"), F.max_by("soft", "score").alias("soft")
    )
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal", "facility_id")
    return (
        best.withColumn("score", F.round("score", 6))
        .withColumn("rank", F.row_number().over(last))
        .filter(F.col("rank") <= k)
        .select("query_id", "facility_id", "score", "soft", "rank")
    )


def rule_reasons(blob: Column) -> Column:
    """Reasons in fixed order, for rows holding the intent (``q_`` columns) and the facility."""

    def named(label: str, column: str) -> Column:
        return F.when(F.col(f"q_{column}") == F.col(column), F.concat(F.lit(label), column))

    matched = F.filter("keywords", lambda w: blob.contains(w))
    fixed = F.array_compact(
        F.array(
            named("地域一致: ", "prefecture"),
            named("市区一致: ", "city"),
            named("サービス一致: ", "service_type"),
            F.when(F.col("query_text").contains(F.col("name")), F.lit("事業所名一致")),
        )
    )
    reasons = F.concat(fixed, F.transform(matched, lambda w: F.concat(F.lit("条件一致: "), w)))
    return F.when(F.size(reasons) > 0, reasons).when(F.col("soft"), F.array(F.lit("部分一致"))).otherwise(reasons)


def explain_candidates(ranked: DataFrame, intents: DataFrame, facilities: DataFrame) -> DataFrame:
    """Ranked rows with the facility's columns and the reasons of their score."""
    slots = ["prefecture", "city", "service_type"]
    asked = intents.select("query_id", "query_text", "keywords", "contact_requested", *[F.col(c).alias(f"q_{c}") for c in slots])
    rows = ranked.join(facilities, "facility_id").join(asked, "query_id")
    return rows.withColumn("reasons", rule_reasons(search_blob()))


def strong_candidates(ranked: DataFrame, minimum: float = STRONG_SCORE) -> DataFrame:
    return ranked.filter(F.col("score") >= minimum)


# -- semantic search ---------------------------------------------------------


def render_facility(contact_label: str = "連絡先") -> Column:
    """Facility text for embedding and prompts."""
    return F.concat(
        F.lit("[ID:"), F.col("facility_id"),
        F.lit("]\n名称: "), F.col("name"),
        F.lit("\nサービス: "), F.col("service_type"),
        F.lit("\n地域: "), F.col("prefecture"), F.col("city"),
        F.lit("\n住所: "), F.col("address"),
        F.lit("\n営業時間: "), F.col("business_hours"),
        F.lit("\n特徴: "), F.array_join("features", ", "),
        F.lit(f"\n{contact_label}: "), F.col("phone"),
        F.lit("\n更新日: "), F.col("last_updated"),
        F.lit("\nソース: "), F.col("source_url"),
    )


def semantic_topk(queries: DataFrame, vectors: DataFrame, k: int = 3) -> DataFrame:
    """Nearest facilities of ``queries(query_id, query_vec)`` among ``vectors(facility_id, embedding)``."""
    one = F.lit("all").alias("space")
    items = vectors.select(one, F.col("facility_id").alias("chunk_id"), "embedding")
    hits = vector_topk(queries.select(one, "query_id", "query_vec"), items, max(k, 3), key="space")
    reason = F.concat(F.lit("意味類似: "), F.format_number("score", 3))
    return hits.select("query_id", F.col("chunk_id").alias("facility_id"), "score", "rank", F.array(reason).alias("reasons"))


def merge_candidates(semantic: DataFrame, strong: DataFrame, k: int = 3) -> DataFrame:
    """Weighted semantic plus rule score, reasons of both in order, best ``k``."""
    left = semantic.select(
        "query_id", "facility_id", (F.col("score") * SEMANTIC_WEIGHT).alias("_s"), F.col("rank").alias("_sr"), F.col("reasons").alias("_sx")
    )
    right = strong.select(
        "query_id", "facility_id", F.col("score").alias("_b"), F.col("rank").alias("_br"), F.col("reasons").alias("_bx")
    )
    none = F.array().cast("array<string>")
    both = left.join(right, ["query_id", "facility_id"], "full").select(
        "query_id",
        "facility_id",
        F.round(F.coalesce("_s", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0)), 6).alias("score"),
        F.array_distinct(F.concat(F.coalesce("_sx", none), F.coalesce("_bx", none))).alias("reasons"),
        # semantic hits come first on equal scores, then rule hits
        F.struct(F.col("_sr").isNull().alias("late"), F.coalesce("_sr", "_br").alias("at")).alias("_order"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "_order")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("_order")


def semantic_recommend(semantic: DataFrame, k: int = 3) -> DataFrame:
    """Semantic-only recommendation; a query whose best score is not positive is rejected."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    label = F.concat(F.lit("意味類似スコア: "), F.format_number("score", 3))
    return (
        semantic.filter(F.col("rank") <= k)
        .withColumn("accepted", best > 0)
        .select("query_id", "facility_id", "score", "rank", label.alias("reason"), "accepted")
    )


# -- texts -------------------------------------------------------------------


def _spoken() -> Column:
    speaker = F.when(F.col("role") == "user", USER_LABEL).otherwise(ASSISTANT_LABEL)
    return F.concat(F.lit("- "), speaker, F.lit(": "), F.col("text"))


def last_turns(turns: DataFrame, count: int = HISTORY_TURNS) -> DataFrame:
    """``conv_id, history``: the last turns of each conversation as lines."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = turns.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= count)
    line = _spoken()
    rows = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return recent.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("history"))


def facility_prompt(intents: DataFrame, candidates: DataFrame, facilities: DataFrame) -> DataFrame:
    """Conditions and reference texts of each query, candidates in rank order."""
    shown = candidates.join(facilities.select("facility_id", render_facility().alias("_doc")), "facility_id")
    docs = F.sort_array(F.collect_list(F.struct("rank", "_doc")))
    context = shown.groupBy("query_id").agg(F.array_join(F.transform(docs, lambda d: d["_doc"]), "\n\n").alias("context"))
    unknown = F.lit("不明")
    words = F.when(F.size("keywords") > 0, F.array_join("keywords", ", ")).otherwise("なし")
    conditions = F.concat(
        F.lit("- 都道府県: "), F.coalesce("prefecture", unknown),
        F.lit("\n- 市区: "), F.coalesce("city", unknown),
        F.lit("\n- サービス種別: "), F.coalesce("service_type", unknown),
        F.lit("\n- キーワード: "), words,
        F.lit("\n- 連絡先表示希望: "), F.when(F.col("contact_requested"), "はい").otherwise("いいえ"),
    )
    return intents.join(context, "query_id").select("query_id", conditions.alias("conditions"), "context")


def whole_prompt(prompts: DataFrame, turns: DataFrame, count: int = HISTORY_TURNS) -> DataFrame:
    """``query_id, prompt``: question, the turns before it, conditions and reference texts.

    ``prompts`` are those of :func:`facility_prompt`; ``turns(query_id, conv_id, turn, role, text)``
    hold the questions among all turns. A null text is an empty one.
    """
    turns = turns.withColumn("text", F.coalesce("text", F.lit("")))
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-count, -1)
    said = turns.withColumn("_history", F.array_join(F.collect_list(_spoken()).over(earlier), "\n"))
    history = F.when(F.col("_history") == "", NONE_LABEL).otherwise(F.col("_history"))
    parts = zip(PROMPT_PARTS, (F.col("text"), history, F.col("conditions"), F.col("context")))
    body = F.concat_ws("\n\n", *(F.concat(F.lit(label + "\n"), part) for label, part in parts))
    return prompts.join(said.select("query_id", "text", "_history"), "query_id").select("query_id", body.alias("prompt"))


def render_answer(explained: DataFrame) -> DataFrame:
    """The listing text of each query's candidates; phone numbers only when asked for."""
    why = F.when(F.size("reasons") > 0, F.array_join("reasons", " / ")).otherwise("一致条件なし")
    entry = F.concat(
        F.col("rank").cast("string"), F.lit(". "), F.col("name"),
        F.lit("（"), F.col("service_type"),
        F.lit("）\n   地域: "), F.col("prefecture"), F.col("city"),
        F.lit("\n   住所: "), F.col("address"),
        F.lit("\n   営業: "), F.col("business_hours"),
        F.lit("\n   特徴: "), F.array_join("features", ", "),
        F.lit("\n   根拠: "), why,
        F.lit("\n   ソース: "), F.col("source_url"), F.lit(" (ID: "), F.col("facility_id"), F.lit(")"),
        F.when(F.col("contact_requested"), F.concat(F.lit("\n   連絡先: "), F.col("phone"))).otherwise(""),
    )
    rows = F.sort_array(F.collect_list(F.struct("rank", entry.alias("entry"))))
    grouped = explained.groupBy("query_id").agg(rows.alias("_rows"))
    head = F.concat(F.lit("候補を"), F.size("_rows").cast("string"), F.lit("件見つけました。"))
    body = F.array_join(F.transform("_rows", lambda r: r["entry"]), "\n")
    return grouped.select("query_id", F.concat_ws("\n", head, body, F.lit(CLOSING_LINE)).alias("answer"))
