"""Registered queries: grounded answers, citations, links, JSON readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions.text import WS_CHARS
from citeloom.operators import answers, link_jobs, normalisers, retrieval
from citeloom.plans import search
from citeloom.plans.ingest import joined
from citeloom.plans.views import oracle, table, view
from citeloom.session import staged

QUERIES = {}
ORACLES = {}
BASE_URL = "https://files.example.com"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _contexts(spark, sf):
    return view(spark, sf, "contexts")


def _known_chunks(spark, sf):
    """Chunks that still exist: the second turn of every third conversation is gone."""
    turn = F.split_part("chunk_id", F.lit(":"), F.lit(2))
    gone = (F.col("query_id").cast("int") % 3 == 0) & (turn == "1")
    return _contexts(spark, sf).filter(~gone).select("workspace_id", "chunk_id")


O = {  # noqa: E741
    "known": "SELECT workspace_id, chunk_id FROM contexts WHERE NOT (CAST(query_id AS INT) % 3 = 0 AND rank = 2)",
    "gate": "SELECT query_id, max(raw_score) AS best_score, max(raw_score) >= 0.15 AS has_evidence FROM contexts GROUP BY query_id",
    "kinds": "SELECT query_id, conv_id, attempt, (conv_id + attempt) % 8 AS v FROM asked CROSS JOIN (SELECT unnest(range(1, 5)) AS attempt)",
    "picked": "SELECT query_id, min(attempt) AS attempt, arg_min(v, attempt) AS v FROM kinds WHERE attempt <= 3 AND v NOT IN (2, 6) GROUP BY query_id",
    "cited": """
        SELECT query_id, n AS cite_no, query_id || ':' || t AS chunk_id FROM (
          SELECT query_id, unnest(range(1, len(a) + 1)) AS n, unnest(a) AS t
          FROM (SELECT query_id, CASE v WHEN 0 THEN ['1', '0'] WHEN 1 THEN ['0'] WHEN 5 THEN ['0'] ELSE [] END AS a FROM picked))""",
    "outcome": """
        SELECT query_id, v, CASE WHEN NOT has_evidence THEN 'not_found' WHEN v IS NULL OR v = 3 THEN 'extractive' WHEN v = 7 THEN 'error' ELSE 'grounded' END AS kind
        FROM gate LEFT JOIN picked USING (query_id)""",
    "kept": """
        SELECT o.query_id, c.cite_no, x.chunk_id, x.document_id, x.file_name, x.ref, x.score, x.storage_key FROM outcome o JOIN cited c USING (query_id) JOIN contexts x ON x.query_id = o.query_id AND x.chunk_id = c.chunk_id
        WHERE o.kind = 'grounded' AND x.chunk_id IN (SELECT chunk_id FROM known)
        UNION ALL
        SELECT query_id, rank, chunk_id, document_id, file_name, ref, score, storage_key FROM outcome JOIN contexts USING (query_id) WHERE kind = 'extractive' AND rank <= 12 AND chunk_id IN (SELECT chunk_id FROM known)""",
    "ended": """
        SELECT query_id, v, CASE WHEN kind IN ('grounded', 'extractive') AND query_id NOT IN (SELECT query_id FROM kept) THEN 'not_found' ELSE kind END AS kind FROM outcome""",
    "listed": "SELECT query_id, string_agg('- ' || file_name || ' ' || ref || ': ' || snippet, chr(10) ORDER BY rank) AS details FROM contexts WHERE rank <= 12 GROUP BY query_id",
}


def answer_oracle(sql: str) -> str:
    return oracle(sql, **O)


@query
def evidence_gate(spark, sf):
    return answers.evidence_gate(view(spark, sf, "asked"), _contexts(spark, sf))


ORACLES["evidence_gate"] = answer_oracle("SELECT * FROM gate")


@query
def prompt_context(spark, sf):
    return answers.prompt_context(_contexts(spark, sf))


ORACLES["prompt_context"] = answer_oracle("""
    SELECT query_id, count(*) AS contexts_count, string_agg('[chunk_id=' || chunk_id || ']' || chr(10) || 'file_name=' || file_name || chr(10) || 'ref=' || ref || chr(10)
      || 'score=' || printf('%.3f', score) || chr(10) || 'snippet=' || snippet || chr(10) || 'text=' || substr(text, 1, 2400), chr(10) || chr(10) ORDER BY rank) AS context
    FROM contexts GROUP BY query_id""")


@query
def strip_fence(spark, sf):
    return view(spark, sf, "responses").select("query_id", "attempt", answers.strip_fence(F.col("raw")).alias("bare"))


ORACLES["strip_fence"] = answer_oracle("""
    SELECT query_id, attempt, CASE WHEN raw LIKE '```%' THEN trim(regexp_replace(regexp_replace(raw, '^```(json)?', ''), '```$', '')) ELSE raw END AS bare
    FROM responses""")


@query
def parse_answer(spark, sf):
    rows = view(spark, sf, "responses").withColumn("r", answers.parse_answer(F.col("raw"))).filter("r IS NOT NULL")
    flat = rows.select("query_id", "attempt", "r.*")
    return flat.select("query_id", "attempt", "parsed", "broken", "conclusion", "details", "notes", joined("next_actions"), joined("cited"))


ORACLES["parse_answer"] = answer_oracle("""
    SELECT query_id, attempt, v <> 3 AS parsed, v = 7 AS broken,
           CASE v WHEN 0 THEN 'c' || query_id WHEN 4 THEN 'x' WHEN 5 THEN 'y' ELSE 'ソースから結論を確定できませんでした。' END AS conclusion,
           CASE v WHEN 0 THEN 'd' WHEN 1 THEN '7' ELSE '' END AS details, CASE v WHEN 0 THEN 'n' WHEN 5 THEN 'None' ELSE '' END AS notes,
           CASE v WHEN 0 THEN 'a,b' ELSE '' END AS next_actions,
           CASE v WHEN 0 THEN query_id || ':1,' || query_id || ':0,' || query_id || ':1' WHEN 1 THEN query_id || ':0' WHEN 4 THEN 'foreign' WHEN 5 THEN query_id || ':0' ELSE '' END AS cited
    FROM kinds WHERE v NOT IN (2, 6)""")


@query
def pick_attempt(spark, sf):
    return answers.pick_attempt(view(spark, sf, "responses")).select("query_id", "attempt")


ORACLES["pick_attempt"] = answer_oracle("SELECT query_id, attempt FROM picked")


@query
def citations(spark, sf):
    """Valid citations with everything a citation shows."""
    picked = answers.pick_attempt(view(spark, sf, "responses"))
    return answers.citations(picked, _contexts(spark, sf)).drop("workspace_id")


ORACLES["citations"] = answer_oracle("""
    SELECT x.query_id, CAST(cite_no AS INT) AS cite_no, document_id, x.chunk_id, file_name, ref_type, ref, snippet, score, storage_key, mime_type
    FROM cited c JOIN contexts x ON x.query_id = c.query_id AND x.chunk_id = c.chunk_id""")


def _answer(rows, *extra):
    return rows.select("query_id", *extra, "conclusion", "details", "notes", joined("next_actions"))


_NOT_FOUND = """'ソース内に該当情報が見つかりませんでした。' AS conclusion, '現在の資料群には質問に直接対応する根拠がありません。' AS details, '断定を避けるため回答を保留しました。' AS notes,
    '該当規程名やマニュアル章を含む資料を追加してください。,対象部署・期間・対象サービスを明示して再質問してください。,表データが必要な場合はCSV/XLSX原本または抽出済みTXTを追加してください。' AS next_actions"""
_EXTRACTIVE = """'該当しうる情報をソースから抽出しました。断定が必要な場合は原文確認が必要です。' AS conclusion, details, 'LLM応答器の代わりに抽出ベースで回答しました。' AS notes,
    '引用元ドキュメントを確認し、必要なら追加資料をアップロードしてください。' AS next_actions"""
_FAILED = """'ソース内に該当情報が見つかりませんでした。' AS conclusion, '検索または回答処理に失敗したため、断定を避けて回答を保留しました。' AS details, {0} AS notes,
    '少し表現を変えて再質問してください。,必要な資料が未投入ならアップロードしてください。' AS next_actions"""


@query
def not_found(spark, sf):
    gate = answers.evidence_gate(view(spark, sf, "asked"), _contexts(spark, sf))
    return _answer(answers.not_found(gate.filter("NOT has_evidence")))


ORACLES["not_found"] = answer_oracle(f"SELECT query_id, {_NOT_FOUND} FROM gate WHERE NOT has_evidence")


@query
def error_answers(spark, sf):
    """Failed requests: error events."""
    errors = table(spark, sf, "events").filter("event_type = 'error'").select(
        F.col("event_id").cast("string").alias("query_id"), F.concat(F.lit("Error"), F.col("user_id")).alias("error_class")
    )
    return _answer(answers.error_answers(errors))


_NOTE = "'internal_error: Error' || user_id"
ORACLES["error_answers"] = f"SELECT CAST(event_id AS VARCHAR) AS query_id, {_FAILED.format(_NOTE)} FROM events WHERE event_type = 'error'"


@query
def extractive_answer(spark, sf):
    return _answer(answers.extractive_answer(_contexts(spark, sf)))


ORACLES["extractive_answer"] = answer_oracle(f"SELECT query_id, {_EXTRACTIVE} FROM listed")


@query
def validate_citations(spark, sf):
    every = answers.extractive_citations(_contexts(spark, sf))
    return answers.validate_citations(every, _known_chunks(spark, sf)).select("query_id", "cite_no", "chunk_id")


ORACLES["validate_citations"] = answer_oracle("SELECT query_id, rank AS cite_no, chunk_id FROM contexts WHERE rank <= 12 AND chunk_id IN (SELECT chunk_id FROM known)")


@query
def attach_urls(spark, sf):
    every = answers.extractive_citations(_contexts(spark, sf))
    return answers.attach_urls(every, BASE_URL).select("query_id", "cite_no", "url")


_URL = f"CASE WHEN storage_key LIKE 'drive://%' THEN 'https://drive.google.com/file/d/' || substr(storage_key, 9) || '/view' ELSE '{BASE_URL}/' || storage_key END"
ORACLES["attach_urls"] = answer_oracle(f"SELECT query_id, rank AS cite_no, {_URL} AS url FROM contexts WHERE rank <= 12")


def _answered(spark, sf):
    return answers.answer_queries(
        view(spark, sf, "asked"), _contexts(spark, sf), view(spark, sf, "responses"), _known_chunks(spark, sf), BASE_URL
    )


@query
def answer_queries(spark, sf):
    return _answer(_answered(spark, sf)[0], "kind")


_GROUNDED = """CASE v WHEN 0 THEN 'c' || query_id WHEN 5 THEN 'y' ELSE 'ソースから結論を確定できませんでした。' END AS conclusion,
    CASE v WHEN 0 THEN 'd' WHEN 1 THEN '7' ELSE '' END AS details, CASE v WHEN 0 THEN 'n' WHEN 5 THEN 'None' ELSE '' END AS notes, CASE v WHEN 0 THEN 'a,b' ELSE '' END AS next_actions"""
_ALL_ANSWERS = f"""
    SELECT query_id, kind, {_NOT_FOUND} FROM ended WHERE kind = 'not_found'
    UNION ALL SELECT query_id, kind, {_EXTRACTIVE} FROM ended JOIN listed USING (query_id) WHERE kind = 'extractive'
    UNION ALL SELECT query_id, kind, {_FAILED.format("'internal_error: AttributeError'")} FROM ended WHERE kind = 'error'
    UNION ALL SELECT query_id, kind, {_GROUNDED} FROM ended WHERE kind = 'grounded'"""
ORACLES["answer_queries"] = answer_oracle(_ALL_ANSWERS)


@query
def answer_citations(spark, sf):
    return _answered(spark, sf)[1].select("query_id", "cite_no", "chunk_id", "file_name", "ref", "score", "url")


ORACLES["answer_citations"] = answer_oracle(f"SELECT query_id, CAST(cite_no AS INT) AS cite_no, chunk_id, file_name, ref, score, {_URL} AS url FROM kept")


@query
def no_evidence(spark, sf):
    replies, cites = _answered(spark, sf)
    return answers.flag_no_evidence(replies, cites).select("query_id", "citations", "no_evidence")


ORACLES["no_evidence"] = answer_oracle("""
    SELECT e.query_id, count(k.chunk_id) AS citations, count(k.chunk_id) = 0 AS no_evidence
    FROM ended e LEFT JOIN kept k USING (query_id) GROUP BY e.query_id""")


@query
def to_response_json(spark, sf):
    """Serialised responses, read back for their size and first citation."""
    replies, cites = _answered(spark, sf)
    out = answers.to_response_json(replies, cites)
    return out.select(
        "query_id",
        F.get_json_object("response", "$.answer.conclusion").alias("conclusion"),
        F.get_json_object("response", "$.citations[0].chunk_id").alias("first_chunk"),
        F.get_json_object("response", "$.citations[0].doc_id").alias("first_doc"),
    )


ORACLES["to_response_json"] = answer_oracle(f"""
    SELECT query_id, conclusion, first_chunk, first_doc FROM ({_ALL_ANSWERS})
    LEFT JOIN (SELECT query_id, arg_min(chunk_id, cite_no) AS first_chunk, arg_min(document_id, cite_no) AS first_doc FROM kept GROUP BY query_id) USING (query_id)""")


# -- question to cited answer --------------------------------------------------

# Replies by the document of a question's best hit: good with two citations; broken, then good; none; foreign.
_TOPS = """
    SELECT query_id, max(CASE WHEN rank = 1 THEN chunk_id END) AS r1, coalesce(max(CASE WHEN rank = 2 THEN chunk_id END), max(CASE WHEN rank = 1 THEN chunk_id END)) AS r2,
           CAST(max(CASE WHEN rank = 1 THEN CAST(document_id AS INT) END) % 4 AS INT) AS v, max(raw_score) AS best
    FROM {hits} GROUP BY query_id"""
def _reply(first: str, second: str) -> str:
    return f"""'{{"answer":{{"conclusion":"c' || query_id || '","details":"d","notes":"n","next_actions":["a","b"]}},"citations":[{{"chunk_id":"' || {first} || '"}},{{"chunk_id":"' || {second} || '"}}]}}'"""


_FIRST_REPLY = f"""CASE v WHEN 0 THEN {_reply("r2", "r1")} WHEN 1 THEN 'not json' ELSE {_reply("'foreign'", "'other'")} END AS raw"""
_NEXT_REPLY = f"""'```json ' || {_reply("r1", "r1")} || ' ```' AS raw"""


@query
def cited_answers(spark, sf):
    """Questions answered from what the search finds: gate, replies that name real hits, citations with URLs."""
    asked, chunks = search.stored_queries(spark, sf), search.stored_chunks(spark, sf)
    hits = staged(retrieval.hybrid_retrieve(asked, chunks, view(spark, sf, "docs")))
    tops = spark.sql(_TOPS.format(hits="{hits}"), hits=hits)
    replies = tops.filter("v <> 2").selectExpr("query_id", "1 AS attempt", _FIRST_REPLY).unionByName(tops.filter("v = 1").selectExpr("query_id", "2 AS attempt", _NEXT_REPLY))
    found, cites = answers.answer_queries(asked, hits, replies, chunks, BASE_URL)
    shown = F.struct("cite_no", F.concat_ws(" ", "chunk_id", "ref", F.format_string("%.6f", "score"), "url").alias("c"))
    listed = cites.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["c"]), ", ").alias("cites"))
    return _answer(found.join(listed, "query_id", "left"), "kind", F.coalesce("cites", F.lit("")).alias("cites"))


ORACLES["cited_answers"] = oracle(
    f"""
    SELECT e.query_id, kind, coalesce(cites, '') AS cites, conclusion, details, notes, next_actions FROM (
      SELECT query_id, kind, {_NOT_FOUND} FROM answered WHERE kind = 'not_found'
      UNION ALL SELECT query_id, kind, {_EXTRACTIVE} FROM answered JOIN written USING (query_id) WHERE kind = 'extractive'
      UNION ALL SELECT query_id, kind, 'c' || query_id, 'd', 'n', 'a,b' FROM answered WHERE kind = 'grounded') e
    LEFT JOIN (SELECT query_id, string_agg(chunk_id || ' ' || ref || ' ' || printf('%.6f', score) || ' ' || {_URL}, ', ' ORDER BY cite_no) AS cites FROM shown GROUP BY query_id) USING (query_id)""",
    **search.O,
    **{
        "tops": _TOPS.format(hits="final"),
        "wanted": """
            SELECT query_id, CASE WHEN coalesce(best, 0) < 0.15 THEN 'not_found' WHEN v = 2 THEN 'extractive' ELSE 'grounded' END AS kind, v, r1, r2 FROM queries LEFT JOIN tops USING (query_id)""",
        "named": """
            SELECT query_id, 1 AS cite_no, CASE WHEN v = 0 THEN r2 ELSE r1 END AS chunk_id FROM wanted WHERE kind = 'grounded' AND v IN (0, 1)
            UNION ALL SELECT query_id, 2, r1 FROM wanted WHERE kind = 'grounded' AND v = 0 AND r1 <> r2
            UNION ALL SELECT query_id, rank, chunk_id FROM wanted JOIN final USING (query_id) WHERE kind = 'extractive'""",
        "shown": "SELECT n.query_id, n.cite_no, f.chunk_id, f.ref, f.score, f.storage_key FROM named n JOIN final f ON f.query_id = n.query_id AND f.chunk_id = n.chunk_id",
        "answered": "SELECT query_id, CASE WHEN query_id IN (SELECT query_id FROM shown) THEN kind ELSE 'not_found' END AS kind FROM wanted",
        "written": "SELECT query_id, string_agg('- ' || file_name || ' ' || ref || ': ' || snippet, chr(10) ORDER BY rank) AS details FROM final GROUP BY query_id",
    },
)


# -- links -------------------------------------------------------------------

_FOLDER_VALUES = """
    SELECT event_id, CASE CAST(event_id % 8 AS INT)
      WHEN 0 THEN 'https://drive.google.com/drive/folders/Folder_' || CAST(event_id AS STRING) || '?usp=sharing'
      WHEN 1 THEN 'https://drive.google.com/open?usp=x&id=Folder-open-' || CAST(event_id AS STRING)
      WHEN 2 THEN ' rawfolder_' || CAST(event_id AS STRING) || ' '
      WHEN 3 THEN 'https://drive.google.com/file/d/F' || CAST(event_id AS STRING) || '/view'
      WHEN 4 THEN 'https://example.com/folders/F' || CAST(event_id AS STRING)
      WHEN 5 THEN '   ' WHEN 6 THEN 'https://drive.google.com/drive/my-drive' ELSE 'short' END AS value
    FROM {events}"""


@query
def parse_folder_requests(spark, sf):
    requests = spark.sql(_FOLDER_VALUES, events=table(spark, sf, "events"))
    good, bad = link_jobs.parse_folder_requests(requests)
    columns = ["event_id", "folder_id", "error"]
    return good.withColumn("error", F.lit(None).cast("string")).select(columns).unionByName(
        bad.withColumn("folder_id", F.lit(None).cast("string")).select(columns)
    )


ORACLES["parse_folder_requests"] = """
    SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'Folder_' || event_id WHEN 1 THEN 'Folder-open-' || event_id WHEN 2 THEN 'rawfolder_' || event_id END AS folder_id,
           CASE event_id % 8 WHEN 3 THEN 'file_url' WHEN 4 THEN 'foreign_host' WHEN 5 THEN 'blank' WHEN 6 THEN 'no_id' WHEN 7 THEN 'foreign_host' END AS error
    FROM events"""

_CITES = """
    SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'drive://id ' || CAST(user_id AS STRING) WHEN 1 THEN 'k/' || CAST(user_id AS STRING) || '.PDF'
             WHEN 2 THEN 'k/b.pdf?x=1#top' WHEN 3 THEN 'k/video.mp4?sig=1' ELSE 'k/notes.txt' END AS storage_key,
           CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'p.' || CAST(user_id AS STRING) || '-' || CAST(user_id + 1 AS STRING) WHEN 1 THEN '12:' || lpad(CAST(user_id % 60 AS STRING), 2, '0')
             WHEN 2 THEN 'Slide ' || CAST(user_id AS STRING) ELSE 'section:intro' END AS ref,
           CASE WHEN event_id % 5 = 3 THEN 'video/mp4' ELSE 'application/pdf' END AS mime_type,
           CASE WHEN event_id % 7 = 0 THEN 'video' ELSE 'page' END AS ref_type
    FROM EVENTS"""


@query
def enrich_citation_links(spark, sf):
    cites = spark.sql(_CITES.replace("EVENTS", "{events}"), events=table(spark, sf, "events"))
    return link_jobs.enrich_citation_links(cites, BASE_URL).drop("storage_key", "ref", "mime_type", "ref_type")


ORACLES["enrich_citation_links"] = f"""
    WITH cites AS ({_CITES.replace("EVENTS", "events")}), a AS (
      SELECT *, {_URL} AS source_url,
        CASE event_id % 4 WHEN 0 THEN CAST(regexp_extract(ref, '([0-9]+)', 1) AS BIGINT) WHEN 2 THEN CAST(regexp_extract(ref, '([0-9]+)', 1) AS BIGINT) END AS page_no,
        CASE WHEN event_id % 4 = 1 THEN 720 + CAST(substr(ref, 4) AS INT) END AS seconds FROM cites),
    b AS (SELECT *, CASE WHEN regexp_matches(lower(source_url), '[.]pdf($|[?])') AND page_no <> 0
                     THEN source_url || CASE WHEN contains(source_url, '#') THEN '&page=' ELSE '#page=' END || page_no ELSE source_url END AS anchored_url FROM a),
    c AS (SELECT *, contains(anchored_url, 'drive.google.com') AS is_drive, CASE WHEN contains(anchored_url, '?') THEN '&t=' ELSE '?t=' END AS mark FROM b)
    SELECT event_id, source_url, page_no, anchored_url, seconds, is_drive,
           CASE WHEN is_drive THEN 'https://drive.google.com/uc?export=download&id=' || replace(substr(storage_key, 9), ' ', '%20') ELSE anchored_url END AS download_url,
           ref_type = 'video' OR mime_type LIKE 'video/%' AS is_video,
           CASE WHEN seconds IS NULL THEN anchored_url ELSE anchored_url || mark || seconds END AS open_url,
           CASE WHEN NOT is_drive THEN anchored_url WHEN seconds IS NULL THEN replace(anchored_url, '/view', '/preview') ELSE replace(anchored_url, '/view', '/preview') || '?t=' || seconds END AS embed_url
    FROM c"""


# -- JSON readers ------------------------------------------------------------

_RAW_JSON = """
    SELECT event_id, CASE CAST(event_id % 4 AS INT)
      WHEN 0 THEN '{"id":' || CAST(event_id AS STRING) || ',"name":"n","file_name":"f.pdf","mime_type":"m","status":"READY","page_count":3,"tags":["a",1,null],"fail_reason":"","updated_at":"u","extracted_pages":2,"failed_pages":[{"page":"4","reason":"r"},{"page":"x","reason":"r"},{"page":5}],"ocr_used_pages":[1,"2","q"],"chunk_count":"9","estimated_cost":0.5,"folder_id":"F","queued_count":1,"doc_ids":["d",7]}'
      WHEN 1 THEN '{"doc_id":"d' || CAST(event_id AS STRING) || '","mime":"x","status":"odd","page_count":"7","tags":"none","fail_reason":"why","created_at":"c","failed_pages":{},"chunk_count":4,"folder_id":null,"queued_count":"1","skipped_count":2}'
      WHEN 2 THEN '[]' ELSE 'oops {' END AS value
    FROM {events}"""


def _raw_json(spark, sf):
    return spark.sql(_RAW_JSON.replace("{", "{{").replace("}", "}}").replace("{{events}}", "{events}"), events=table(spark, sf, "events"))


@query
def normalize_workspaces(spark, sf):
    return normalisers.normalize_workspaces(_raw_json(spark, sf))


ORACLES["normalize_workspaces"] = "SELECT CAST(event_id AS VARCHAR) AS workspace_id, 'n' AS name FROM events WHERE event_id % 4 = 0"


@query
def normalize_docs(spark, sf):
    return normalisers.normalize_docs(_raw_json(spark, sf)).withColumn("tags", F.array_join("tags", ","))


ORACLES["normalize_docs"] = """
    SELECT CAST(event_id AS VARCHAR) AS document_id, 'f.pdf' AS file_name, 'm' AS mime_type, 'ready' AS status, CAST(3 AS DOUBLE) AS page_count,
           'a,1,null' AS tags, 'u' AS updated_at, NULL AS fail_reason FROM events WHERE event_id % 4 = 0
    UNION ALL SELECT 'd' || event_id, '', 'x', 'failed', NULL, '', 'c', 'why' FROM events WHERE event_id % 4 = 1"""


@query
def normalize_reports(spark, sf):
    out = normalisers.normalize_reports(_raw_json(spark, sf))
    pages = F.array_join(F.transform("failed_pages", lambda p: F.concat_ws("=", p["page"].cast("int"), p["reason"])), ",")
    return out.withColumn("failed_pages", pages).withColumn("ocr_used_pages", F.array_join(F.col("ocr_used_pages").cast("array<int>").cast("array<string>"), ","))


ORACLES["normalize_reports"] = """
    SELECT CASE WHEN event_id % 4 = 1 THEN 'd' || event_id ELSE '' END AS document_id, CAST(CASE WHEN event_id % 4 = 0 THEN 2 ELSE 0 END AS DOUBLE) AS extracted_pages,
           CASE WHEN event_id % 4 = 0 THEN '4=r' ELSE '' END AS failed_pages, CASE WHEN event_id % 4 = 0 THEN '1,2' ELSE '' END AS ocr_used_pages,
           CAST(CASE WHEN event_id % 4 = 1 THEN 4 ELSE 0 END AS DOUBLE) AS chunk_count, CAST(CASE WHEN event_id % 4 = 0 THEN 0.5 END AS DOUBLE) AS estimated_cost FROM events"""


@query
def normalize_imports(spark, sf):
    return normalisers.normalize_imports(_raw_json(spark, sf)).withColumn("doc_ids", F.array_join("doc_ids", ","))


ORACLES["normalize_imports"] = """
    SELECT CASE WHEN event_id % 4 = 0 THEN 'F' ELSE '' END AS folder_id, CAST(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS queued_count,
           CAST(CASE WHEN event_id % 4 = 1 THEN 2 ELSE 0 END AS DOUBLE) AS skipped_count, CASE WHEN event_id % 4 = 0 THEN 'd,7' ELSE '' END AS doc_ids FROM events"""

_CHAT_JSON = """
    SELECT conv_id, turn, '{"answer":{"conclusion":"' || role || '","details":null,"next_actions":["x",' || CAST(turn AS STRING) || ']},"citations":['
      || '{"doc_id":' || CAST(conv_id AS STRING) || ',"file_name":"f","ref_type":"page","ref":"p.1","snippet":"s","score":0.25,"url":""},'
      || '{"doc_id":"d","file_name":"f","ref_type":"image","ref":"p.1","snippet":"s"},3,'
      || '{"doc_id":"e","file_name":"f","ref_type":"video","ref":"00:10","snippet":"","score":"1","chunk_id":5,"url":"u"},{"doc_id":"g","ref_type":"page"}]}' AS value
    FROM {conversations}"""


@query
def normalize_answers(spark, sf):
    sql = _CHAT_JSON.replace("{", "{{").replace("}", "}}").replace("{{conversations}}", "{conversations}")
    out = normalisers.normalize_answers(spark.sql(sql, conversations=table(spark, sf, "conversations")))
    cite = lambda c: F.concat_ws("|", c["doc_id"], c["ref_type"], c["ref"], c["snippet"], F.coalesce(c["score"].cast("string"), F.lit("-")), F.coalesce(c["chunk_id"], F.lit("-")), F.coalesce(c["url"], F.lit("-")))
    return out.select("conv_id", "turn", "conclusion", "details", joined("next_actions"), F.array_join(F.transform("citations", cite), ";").alias("citations"))


ORACLES["normalize_answers"] = """
    SELECT conv_id, turn, role AS conclusion, '' AS details, 'x,' || turn AS next_actions,
           conv_id || '|page|p.1|s|0.25|-|-;e|video|00:10||-|5|u' AS citations FROM conversations"""
