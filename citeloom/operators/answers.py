"""Grounded answers over tables of contexts and model responses.

``contexts`` is what :func:`citeloom.operators.retrieval.hybrid_retrieve` returns;
``responses(query_id, attempt, raw)`` holds the generator's outputs in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import links
from citeloom.functions.text import strip
from citeloom.session import staged

MIN_SCORE = 0.15
ATTEMPTS = 3
FALLBACK_ROWS = 12

# --- fixed values: answer texts and hints -----------------------------------
DEFAULT_CONCLUSION = "ソースから結論を確定できませんでした。"
NOT_FOUND = {
    "conclusion": "ソース内に該当情報が見つかりませんでした。",
    "details": "現在の資料群には質問に直接対応する根拠がありません。",
    "notes": "断定を避けるため回答を保留しました。",
    "next_actions": [
        "該当規程名やマニュアル章を含む資料を追加してください。",
        "対象部署・期間・対象サービスを明示して再質問してください。",
        "表データが必要な場合はCSV/XLSX原本または抽出済みTXTを追加してください。",
    ],
}
EXTRACTIVE = {
    "conclusion": "該当しうる情報をソースから抽出しました。断定が必要な場合は原文確認が必要です。",
    "notes": "LLM応答器の代わりに抽出ベースで回答しました。",
    "next_actions": ["引用元ドキュメントを確認し、必要なら追加資料をアップロードしてください。"],
}
FAILED = {
    "conclusion": "ソース内に該当情報が見つかりませんでした。",
    "details": "検索または回答処理に失敗したため、断定を避けて回答を保留しました。",
    "next_actions": [
        "少し表現を変えて再質問してください。",
        "必要な資料が未投入ならアップロードしてください。",
    ],
}
NO_EVIDENCE_HINTS = ["見つからない", "不明", "情報不足", "根拠なし", "not found"]
# ----------------------------------------------------------------------------

ANSWER = ["conclusion", "details", "notes", "next_actions"]
CITATION = [
    "document_id",
    "chunk_id",
    "file_name",
    "ref_type",
    "ref",
    "snippet",
    "score",
    "storage_key",
    "mime_type",
]


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _fixed(texts: dict, **columns: Column) -> list[Column]:
    """The four answer columns, from fixed texts unless given as columns."""
    made = {k: _texts(v) if isinstance(v, list) else F.lit(v) for k, v in texts.items()} | columns
    return [made[name].alias(name) for name in ANSWER]


# -- gate and prompt ---------------------------------------------------------


def evidence_gate(queries: DataFrame, contexts: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``query_id, best_score, has_evidence`` for every query."""
    best = contexts.groupBy("query_id").agg(F.max("raw_score").alias("best_score"))
    return queries.select("query_id").join(best, "query_id", "left").withColumn(
        "has_evidence", F.coalesce(F.col("best_score") >= min_score, F.lit(False))
    )


def prompt_context(contexts: DataFrame, text_chars: int = 2400) -> DataFrame:
    """One context text per query, passages in rank order."""
    passage = F.concat(
        F.lit("[chunk_id="), F.col("chunk_id"),
        F.lit("]\nfile_name="), F.col("file_name"),
        F.lit("\nref="), F.col("ref"),
        F.lit("\nscore="), F.format_number("score", 3),
        F.lit("\nsnippet="), F.col("snippet"),
        F.lit("\ntext="), F.substring("text", 1, text_chars),
    )
    return contexts.groupBy("query_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", passage.alias("passage")))), lambda p: p["passage"]),
            "\n\n",
        ).alias("context"),
        F.count("*").alias("contexts_count"),
    )


# -- model output ------------------------------------------------------------


def strip_fence(raw: Column) -> Column:
    """Output without a surrounding code fence."""
    bare = strip(raw)
    opened = strip(F.regexp_replace(bare, "^```(?:json)?", ""))
    closed = strip(F.regexp_replace(opened, "```$", ""))
    return F.when(bare.startswith("```"), closed).otherwise(bare)


def _member(node: Column, path: str, default: str) -> Column:
    """A JSON member as text; the default when missing, ``None`` for JSON null."""
    found = F.try_variant_get(node, path, "variant")
    value = F.try_variant_get(node, path, "string")
    kind = F.schema_of_variant(found)
    truth = F.when(value == "true", "True").otherwise("False")
    return (
        F.when(found.isNull(), F.lit(default))
        .when(F.is_variant_null(found), F.lit("None"))
        .when(kind == "BOOLEAN", truth)
        .otherwise(F.coalesce(value, F.to_json(found)))
    )


def _items(node: Column, path: str) -> Column:
    """A JSON array member as an array of variants; empty when missing or not an array."""
    return F.coalesce(
        F.try_variant_get(node, path, "array<variant>"), F.array().cast("array<variant>")
    )


def _is_object(node: Column) -> Column:
    return F.coalesce(F.schema_of_variant(node).startswith("OBJECT"), F.lit(False))


def parse_answer(raw: Column) -> Column:
    """``struct(parsed, broken, conclusion, details, notes, next_actions, cited)``; null when not a JSON object.

    ``parsed`` is false for an empty object and ``broken`` true when ``answer`` is no object.
    """
    node = F.try_parse_json(strip_fence(raw))
    answer = F.try_variant_get(node, "$.answer", "variant")
    conclusion = _member(node, "$.answer.conclusion", "")
    cited = F.transform(
        F.filter(_items(node, "$.citations"), _is_object),
        lambda c: strip(_member(c, "$.chunk_id", "")),
    )
    actions = F.transform(_items(node, "$.answer.next_actions"), lambda a: _member(a, "$", ""))
    return F.when(
        _is_object(node),
        F.struct(
            (F.schema_of_variant(node) != "OBJECT<>").alias("parsed"),
            (answer.isNotNull() & ~_is_object(answer)).alias("broken"),
            F.when(conclusion == "", DEFAULT_CONCLUSION).otherwise(conclusion).alias("conclusion"),
            _member(node, "$.answer.details", "").alias("details"),
            _member(node, "$.answer.notes", "").alias("notes"),
            F.filter(actions, lambda a: strip(a) != "").alias("next_actions"),
            F.filter(cited, lambda c: c != "").alias("cited"),
        ),
    )


def pick_attempt(responses: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """The first response of each query that parses, among its first ``attempts``."""
    order = Window.partitionBy("query_id").orderBy("attempt")
    tried = responses.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= attempts)
    parsed = tried.withColumn("reply", parse_answer(F.col("raw"))).filter("reply IS NOT NULL")
    return parsed.groupBy("query_id").agg(
        F.min("attempt").alias("attempt"), F.min_by("reply", "attempt").alias("reply")
    )


def citations(picked: DataFrame, contexts: DataFrame) -> DataFrame:
    """Cited chunks that really are in the query's contexts, each once, in cited order."""
    named = picked.select("query_id", F.posexplode("reply.cited").alias("_pos", "chunk_id"))
    firsts = named.groupBy("query_id", "chunk_id").agg(F.min("_pos").alias("_pos"))
    found = firsts.join(contexts, ["query_id", "chunk_id"])
    order = Window.partitionBy("query_id").orderBy("_pos")
    return to_citation(found.withColumn("cite_no", F.row_number().over(order)))


def to_citation(rows: DataFrame) -> DataFrame:
    keep = [c for c in ("workspace_id",) if c in rows.columns]
    return rows.select("query_id", "cite_no", *keep, *CITATION)


# -- fallbacks ---------------------------------------------------------------


def not_found(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", *_fixed(NOT_FOUND))


def error_answers(errors: DataFrame) -> DataFrame:
    """Answer rows of queries whose processing failed with ``error_class``."""
    note = F.concat(F.lit("internal_error: "), F.col("error_class"))
    return errors.select("query_id", *_fixed(FAILED, notes=note))


def extractive_answer(contexts: DataFrame, rows: int = FALLBACK_ROWS) -> DataFrame:
    """Answers listing the best contexts, for queries without a usable response."""
    bullet = F.concat(F.lit("- "), "file_name", F.lit(" "), "ref", F.lit(": "), "snippet")
    top = contexts.filter(F.col("rank") <= rows).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", bullet.alias("bullet")))).alias("_rows")
    )
    details = F.array_join(F.transform("_rows", lambda r: r["bullet"]), "\n")
    return top.select("query_id", *_fixed(EXTRACTIVE, details=details))


def extractive_citations(contexts: DataFrame, rows: int = FALLBACK_ROWS) -> DataFrame:
    return to_citation(contexts.filter(F.col("rank") <= rows).withColumn("cite_no", F.col("rank")))


def validate_citations(cites: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations whose chunk still exists in the citation's workspace."""
    return cites.join(chunks.select("workspace_id", "chunk_id"), ["workspace_id", "chunk_id"], "left_semi")


def attach_urls(cites: DataFrame, base_url: str) -> DataFrame:
    return cites.withColumn("url", links.source_url(F.col("storage_key"), base_url))


def no_evidence(answer_text: Column, citation_count: Column) -> Column:
    """True without citations or with a not-found phrase in the answer."""
    lowered = F.lower(answer_text)
    hinted = F.lit(False)
    for hint in NO_EVIDENCE_HINTS:
        hinted = hinted | lowered.contains(hint)
    return (citation_count == 0) | hinted


def flag_no_evidence(answers: DataFrame, cites: DataFrame) -> DataFrame:
    counted = cites.groupBy("query_id").agg(F.count("*").alias("citations"))
    joined = answers.join(counted, "query_id", "left").withColumn("citations", F.coalesce("citations", F.lit(0).cast("bigint")))
    shown = F.concat_ws(" ", "conclusion", "details", "notes")
    return joined.withColumn("no_evidence", no_evidence(shown, F.col("citations")))


# -- composite ---------------------------------------------------------------


def answer_queries(
    queries: DataFrame,
    contexts: DataFrame,
    responses: DataFrame,
    chunks: DataFrame,
    base_url: str,
    min_score: float = MIN_SCORE,
) -> tuple[DataFrame, DataFrame]:
    """Answers (one row per query, with its ``kind``) and their citations."""
    gate = evidence_gate(queries, contexts, min_score)
    usable = contexts.join(gate.filter("has_evidence").select("query_id"), "query_id", "left_semi")
    replies = pick_attempt(responses)
    state = gate.join(replies, "query_id", "left")
    kind = (
        F.when(~F.col("has_evidence"), "not_found")
        .when(F.coalesce(~F.col("reply.parsed"), F.lit(True)), "extractive")
        .when(F.col("reply.broken"), "error")
        .otherwise("grounded")
    )
    state = staged(state.withColumn("kind", kind))

    def of(name: str) -> DataFrame:
        return state.filter(F.col("kind") == name)

    grounded = citations(of("grounded"), usable)
    extractive = usable.join(of("extractive").select("query_id"), "query_id", "left_semi")
    cites = staged(validate_citations(grounded.unionByName(extractive_citations(extractive)), chunks))
    # a grounded or extractive answer that keeps no citation becomes a not-found answer
    cited = cites.select("query_id").distinct().withColumn("_cited", F.lit(True))
    final = state.join(cited, "query_id", "left").withColumn(
        "kind",
        F.when(F.col("kind").isin("grounded", "extractive") & F.col("_cited").isNull(), "not_found").otherwise(
            F.col("kind")
        ),
    )
    written = extractive_answer(extractive).select("query_id", F.col("details").alias("_details"))
    final = final.join(written, "query_id", "left")

    def pick(name: str) -> Column:
        def fixed(texts: dict) -> Column:
            value = texts.get(name)
            return _texts(value) if isinstance(value, list) else F.lit(value)

        extracted = F.col("_details") if name == "details" else fixed(EXTRACTIVE)
        failed = F.lit("internal_error: AttributeError") if name == "notes" else fixed(FAILED)
        return (
            F.when(F.col("kind") == "not_found", fixed(NOT_FOUND))
            .when(F.col("kind") == "extractive", extracted)
            .when(F.col("kind") == "error", failed)
            .otherwise(F.col(f"reply.{name}"))
            .alias(name)
        )

    return final.select("query_id", "kind", *[pick(n) for n in ANSWER]), attach_urls(cites, base_url)


def to_response_json(answers: DataFrame, cites: DataFrame) -> DataFrame:
    """One JSON text per query: the answer and its citations in order."""
    payload = F.struct(
        "cite_no",
        F.col("document_id").alias("doc_id"),
        *[c for c in cites.columns if c not in ("query_id", "cite_no", "workspace_id", "document_id", "storage_key")],
    )
    listed = cites.groupBy("query_id").agg(F.sort_array(F.collect_list(payload)).alias("_cites"))
    shown = F.transform(
        F.coalesce("_cites", F.array().cast(listed.schema["_cites"].dataType)), lambda c: c.dropFields("cite_no")
    )
    body = F.struct(F.struct(*ANSWER).alias("answer"), shown.alias("citations"))
    return answers.join(listed, "query_id", "left").select("query_id", F.to_json(body).alias("response"))
