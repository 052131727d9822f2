"""The given tables seen through this package's schemas.

Each view is SQL that both Spark and the oracle engine can run; where their
dialects differ a view has one text for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from citeloom.functions.text import LINE_BREAK, WS_CHARS, WS_CLASS
from citeloom.session import spread

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHUNK_SIZE, CHUNK_OVERLAP = 800, 100
_SPREAD = {"documents": "doc_id", "pages": "page_id", "events": "event_id", "conversations": "conv_id", "embeddings": "vec_id"}
NL = "\n"


def re2(char_class: str) -> str:
    """A Java character class in the oracle's spelling."""
    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", char_class)


_EXT = (
    "CASE CAST(doc_id % 12 AS INT) WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' WHEN 3 THEN '.docx' "
    "WHEN 4 THEN '.pptx' WHEN 5 THEN '.XLSX' WHEN 6 THEN '.png' WHEN 7 THEN '.mp4' WHEN 8 THEN '.MOV' WHEN 9 THEN '' "
    "WHEN 10 THEN '.doc' ELSE '.bin' END"
)
_MIME = (
    "CASE CAST(doc_id % 12 AS INT) WHEN 0 THEN 'text/plain; charset=Shift_JIS' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'application/pdf' "
    "WHEN 3 THEN '' WHEN 4 THEN 'application/vnd.ms-powerpoint' WHEN 6 THEN 'image/png' WHEN 7 THEN 'video/mp4' "
    "WHEN 9 THEN 'text/plain; charset=\"UTF-8\"' WHEN 10 THEN 'application/msword' WHEN 11 THEN 'text/x; charset=klingon' END"
)

_RAW = """CASE CAST((conv_id + attempt) % 8 AS INT)
                 WHEN 0 THEN '{"answer":{"conclusion":"c' || query_id || '","details":"d","notes":"n","next_actions":["a"," ","b"]},"citations":[{"chunk_id":"' || query_id || ':1"},{"chunk_id":" ' || query_id || ':0 "},{"chunk_id":"' || query_id || ':1"}]}'
                 WHEN 1 THEN '```json {"answer":{"conclusion":"","details":7},"citations":[{"chunk_id":"' || query_id || ':0"}]} ```'
                 WHEN 2 THEN 'not json'
                 WHEN 3 THEN '{}'
                 WHEN 4 THEN '{"answer":{"conclusion":"x"},"citations":[{"chunk_id":"foreign"}]}'
                 WHEN 5 THEN '{"answer":{"conclusion":"y","notes":null},"citations":["z",3,{"chunk_id":"' || query_id || ':0"}]}'
                 WHEN 6 THEN '[1,2]'
                 ELSE '{"answer":"plain","citations":[]}' END AS raw"""

# name -> sql for both, or (spark sql, oracle sql)
VIEWS: dict[str, str | tuple[str, str]] = {
    # the catalogue: names, types, states and keys synthesised from the id
    "docs": f"""
        SELECT CAST(doc_id AS STRING) AS document_id, doc_id,
               'ws' || CAST(CAST(substr(source, 4) AS INT) % 4 AS STRING) AS workspace_id,
               regexp_extract(text, '[^ .,|;:!?{NL}]+', 0) || '-' || CAST(doc_id AS STRING) || {_EXT} AS file_name,
               {_MIME} AS mime_type,
               CASE WHEN doc_id % 5 = 0 THEN 'drive://file' || CAST(doc_id AS STRING)
                    ELSE 'workspaces/' || source || '/documents/' || CAST(doc_id AS STRING) || '/body' END AS storage_key,
               CASE WHEN doc_id % 7 = 3 THEN 'failed' WHEN doc_id % 11 = 4 THEN 'processing' ELSE 'ready' END AS status,
               CASE WHEN doc_id % 7 = 3 THEN 'unexpected_error: ' || lang END AS fail_reason,
               CASE WHEN doc_id % 3 = 0 THEN 'OCR_USED' ELSE 'google-drive' END AS tag,
               CAST(doc_id % 9 AS INT) AS page_count,
               doc_id * 7919 % 10007 AS created_at,
               doc_id * 104729 % 10009 AS updated_at,
               CASE WHEN doc_id % 17 = 0 THEN 0 ELSE n_chars END AS size,
               text, lang
        FROM documents""",
    "workspaces": """
        SELECT workspace_id, 'Workspace ' || workspace_id AS name, min(created_at) AS created_at
        FROM docs GROUP BY workspace_id
        UNION ALL
        SELECT 'empty' || CAST(n_nationkey AS STRING), n_name, CAST(20000 + n_nationkey AS BIGINT) FROM nation""",
    # ingestion attempts: one per event of a user taken as document
    "runs": """
        SELECT 'run' || CAST(event_id AS STRING) AS run_id, CAST(user_id AS STRING) AS document_id, ts AS started_at,
               event_type, value, event_id FROM events""",
    # every sentence of every benchmark passage, asked in each workspace
    "queries": (
        f"""
        SELECT concat(item_id, ':', pos, '@', w) AS query_id, w AS workspace_id, trim(s) AS query_text, item_id, pos
        FROM (SELECT item_id, posexplode(split(text, '[.{NL}]+')) AS (pos, s) FROM benchmark)
             LATERAL VIEW explode(array('ws0', 'ws1', 'ws2', 'ws3')) t AS w
        WHERE trim(s) <> ''""",
        f"""
        SELECT concat(item_id, ':', pos, '@', w) AS query_id, w AS workspace_id, trim(s) AS query_text, item_id, pos
        FROM (SELECT item_id, unnest(range(len(a))) AS pos, unnest(a) AS s
              FROM (SELECT item_id, regexp_split_to_array(text, '[.{NL}]+') AS a FROM benchmark))
             CROSS JOIN (SELECT unnest(['ws0', 'ws1', 'ws2', 'ws3']) AS w)
        WHERE trim(s) <> ''""",
    ),
    # conversations as pages of a scanned document, with damaged and missing text
    "scans": f"""
        SELECT CAST(conv_id AS STRING) AS document_id, CAST(turn + 1 AS INT) AS page,
               CASE CAST((conv_id + turn) % 5 AS INT) WHEN 0 THEN text WHEN 1 THEN ' {NL} '
                    WHEN 2 THEN replace(text, 'e', 'Ã©') WHEN 3 THEN substr(text, 1, 12)
                    ELSE chr(1) || replace(text, 'e', 'ł') END AS raw_text,
               CASE WHEN conv_id % 10 = 7 THEN NULL ELSE
               CASE CAST((conv_id * 3 + turn) % 4 AS INT) WHEN 1 THEN text WHEN 2 THEN ' ocr word ' WHEN 3 THEN '' END END AS ocr_text
        FROM conversations""",
    "scan_ocr": f"""
        SELECT document_id, CASE WHEN CAST(document_id AS INT) % 20 = 7 THEN 'Ã©Ã©Ã©Ã©Ã©Ã©Ã©Ã©Ã©' ELSE 'whole document ' || document_id END AS doc_ocr_text
        FROM (SELECT DISTINCT document_id FROM scans) x""",
    # paragraphs: user turns are headings
    "paragraphs": """
        SELECT CAST(conv_id AS STRING) AS document_id, CAST(turn AS INT) AS ordinal,
               CASE WHEN role = 'user' AND turn > 0 THEN 'Heading 1' WHEN turn = 0 THEN NULL ELSE 'Normal' END AS style,
               '  ' || text || ' ' AS text
        FROM conversations""",
    # web pages as markdown: h tags become # lines, other tags line breaks
    "markdown": f"""
        SELECT CAST(page_id AS STRING) AS document_id, 'ws0' AS workspace_id,
               regexp_replace(regexp_replace(html, '<h[1-6][^>]*>', '{NL} ## ', 'g'), '<[^>]*>', '{NL}', 'g') AS text
        FROM pages""",
    # listed files
    "listing": """
        SELECT 'ws' || CAST(p_partkey % 4 AS STRING) AS workspace_id, p_partkey AS item_no,
               CASE WHEN p_partkey % 19 = 0 THEN '  ' ELSE 'file' || CAST(p_partkey % 900 AS STRING) END AS id,
               p_name || CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '.MP4' WHEN 1 THEN '.webm' WHEN 2 THEN '.pdf' ELSE '' END AS name,
               CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'video/quicktime' WHEN 1 THEN 'application/octet-stream' END AS mimeType,
               CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(p_size * 1000 + p_partkey AS STRING) END AS size,
               p_partkey % 13 = 5 AS trashed
        FROM part""",
    # drive-held documents of the workspaces, as the import finds them
    "drive_docs": """
        SELECT 'd' || CAST(o_orderkey AS STRING) AS document_id, 'ws' || CAST(o_orderkey % 4 AS STRING) AS workspace_id,
               'old' || CAST(o_orderkey AS STRING) AS file_name, 'video/mp4' AS mime_type,
               'drive://file' || CAST(o_orderkey AS STRING) AS storage_key,
               CASE o_orderstatus WHEN 'O' THEN 'ready' WHEN 'P' THEN 'processing' ELSE 'failed' END AS status,
               CAST(NULL AS INT) AS page_count, 'kept' AS tag, CASE WHEN o_orderstatus = 'F' THEN 'late' END AS fail_reason
        FROM orders""",
    # contexts of answers: the turns of a conversation, ranked by turn
    "contexts": """
        SELECT CAST(conv_id AS STRING) AS query_id, CAST(turn + 1 AS INT) AS rank,
               CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING) AS chunk_id, 'doc' || CAST(conv_id AS STRING) AS document_id,
               'ws' || CAST(conv_id % 4 AS STRING) AS workspace_id, 'talk-' || CAST(conv_id AS STRING) || '.pdf' AS file_name,
               'page' AS ref_type, 'p.' || CAST(turn + 1 AS STRING) AS ref, substr(text, 1, 60) AS snippet, text,
               round(CAST(1 AS DOUBLE) / (turn + 1 + conv_id % 7), 4) AS score, round(CAST(1 AS DOUBLE) / (turn + 1 + conv_id % 9), 4) AS raw_score,
               CASE WHEN conv_id % 2 = 0 THEN 'drive://f' || CAST(conv_id AS STRING) ELSE 'k/' || CAST(conv_id AS STRING) END AS storage_key,
               'application/pdf' AS mime_type
        FROM conversations""",
    "asked": "SELECT DISTINCT CAST(conv_id AS STRING) AS query_id, conv_id FROM conversations",
    # generator outputs: good, fenced, broken, empty, foreign ids, odd members
    "responses": (
        f"SELECT query_id, attempt, {_RAW} FROM (SELECT query_id, conv_id, explode(sequence(1, 4)) AS attempt FROM asked)",
        f"SELECT query_id, attempt, {_RAW} FROM (SELECT query_id, conv_id, unnest(range(1, 5)) AS attempt FROM asked)",
    ),
    # facilities: customers with their nation as city and region as prefecture
    "facilities": """
        SELECT 'F' || CAST(c_custkey AS STRING) AS facility_id, c_custkey AS ordinal, c_name AS name, r_name AS prefecture,
               n_name AS city, CASE WHEN c_mktsegment = 'BUILDING' THEN 'デイサービス' ELSE c_mktsegment END AS service_type,
               'Street ' || CAST(c_custkey % 97 AS STRING) AS address, '0' || CAST(c_custkey AS STRING) AS phone,
               CASE WHEN c_custkey % 3 = 0 THEN '24時間' ELSE '9-17' END AS business_hours,
               ' ' || CASE WHEN c_acctbal < 0 THEN '送迎| ' WHEN c_acctbal < 3000 THEN '入浴|夜間' WHEN c_acctbal < 6000 THEN '看護師 |送迎|土日' ELSE '' END AS raw_features,
               '2024-01-01' AS last_updated, 'https://example.com/' || CAST(c_custkey AS STRING) AS source_url
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    # conversations about facilities: one per user, one turn per event
    "turns": """
        SELECT CAST(user_id AS STRING) AS conv_id, event_id AS turn,
               CAST(user_id AS STRING) || ':' || CAST(event_id AS STRING) AS query_id,
               CASE WHEN event_id % 29 = 0 THEN '/reset'
                    WHEN event_type = 'view' THEN n_name || ' near ' || r_name || '、送迎？'
                    WHEN event_type = 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'BUILDING 通所介護 TEL' ELSE 'any MACHINERY in ' || n_name END
                    WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN '入浴と夜間 電話' ELSE '看護師 ' || r_name END
                    WHEN event_type = 'purchase' THEN 'about Customer#' || lpad(CAST(event_id % 2000 AS STRING), 9, '0') || ' ヘルパー'
                    ELSE 'Street ' || CAST(event_id % 97 AS STRING) || ' 認知症 ok' END AS query_text
        FROM events JOIN nation ON event_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}

_WS = WS_CHARS
# Chunks as the oracle sees them: the packing rule as a recursive query.
_ORACLE_ONLY: dict[str, str] = {
    "doc_lines": f"""
        SELECT document_id, workspace_id, pos, trim(s, '{_WS}') AS line
        FROM (SELECT document_id, workspace_id, unnest(range(len(a))) AS pos, unnest(a) AS s
              FROM (SELECT document_id, workspace_id, regexp_split_to_array(text, '{re2(LINE_BREAK)}') AS a FROM docs))
        WHERE trim(s, '{_WS}') <> ''""",
    "units": f"""
        SELECT document_id, workspace_id, unit, row_number() OVER (PARTITION BY document_id ORDER BY pos, n) AS unit_no
        FROM (SELECT document_id, workspace_id, pos, n, trim(substr(line, n * {CHUNK_SIZE} + 1, {CHUNK_SIZE}), '{_WS}') AS unit
              FROM (SELECT *, unnest(range(CAST(ceil(length(line) / {CHUNK_SIZE}.0) AS INT))) AS n FROM doc_lines))
        WHERE unit <> ''""",
    "fold": f"""
        SELECT document_id, workspace_id, unit_no, length(unit) AS cur_len, unit AS body, 0 AS chunk_index, CAST(NULL AS VARCHAR) AS done
        FROM units WHERE unit_no = 1
        UNION ALL
        SELECT u.document_id, u.workspace_id, u.unit_no,
               CASE WHEN f.cur_len + length(u.unit) + 1 > {CHUNK_SIZE} THEN least(length(f.body), {CHUNK_OVERLAP}) ELSE f.cur_len END + length(u.unit) + 1,
               CASE WHEN f.cur_len + length(u.unit) + 1 > {CHUNK_SIZE} THEN trim(right(f.body, {CHUNK_OVERLAP}), '{_WS}') ELSE f.body END || '{NL}' || u.unit,
               f.chunk_index + CASE WHEN f.cur_len + length(u.unit) + 1 > {CHUNK_SIZE} THEN 1 ELSE 0 END,
               CASE WHEN f.cur_len + length(u.unit) + 1 > {CHUNK_SIZE} THEN f.body END
        FROM fold f JOIN units u ON u.document_id = f.document_id AND u.unit_no = f.unit_no + 1""",
    "chunks": f"""
        SELECT document_id || ':' || CAST(chunk_index AS VARCHAR) AS chunk_id, workspace_id, document_id, chunk_index, text,
               substr(regexp_replace(text, '[{re2(WS_CLASS)}]+', ' ', 'g'), 1, 300) AS snippet
        FROM (SELECT document_id, workspace_id, chunk_index - 1 AS chunk_index, done AS text FROM fold WHERE done IS NOT NULL
              UNION ALL
              SELECT document_id, workspace_id, chunk_index, body FROM fold
              QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY unit_no DESC) = 1)""",
}


_RECURSIVE = {"fold", "talk", "scan_fold"}


def _references(sql: str) -> Iterable[str]:
    return set(re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "''", sql)))


def _oracle_text(name: str) -> str:
    if name in _ORACLE_ONLY:
        return _ORACLE_ONLY[name]
    text = VIEWS[name]
    return text[1] if isinstance(text, tuple) else text


def oracle(sql: str, **extra: str) -> str:
    """``sql`` for the oracle engine, with the views it mentions (and ``extra`` ones) as CTEs."""
    known = {n: _oracle_text(n) for n in [*VIEWS, *_ORACLE_ONLY]} | extra
    needed: list[str] = []

    def visit(text: str, above: tuple) -> None:
        for name in known:
            if name in _references(text) and name not in above and name not in needed:
                visit(known[name], (*above, name))
                needed.append(name)

    visit(sql, ())
    if not needed:
        return sql
    ctes = []
    for name in needed:
        hint = "" if name in _RECURSIVE else "MATERIALIZED "
        ctes.append(f"{name} AS {hint}({known[name]})")
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the wide ones are spread when they come as one small file."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, _SPREAD[name]) if name in _SPREAD else rows


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A view over the given tables; ``given`` frames (a stream, say) stand in for tables of their name."""
    text = VIEWS[name]
    sql = text[0] if isinstance(text, tuple) else text
    sql = sql.replace(", 'g')", ")")  # Spark replaces every match without being told
    names = [n for n in [*BASE, *VIEWS] if n in _references(sql) and n != name and re.search(rf"(FROM|JOIN)\s+{n}\b", sql)]
    for n in names:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
    # braces of JSON text are not placeholders
    sql = re.sub(r"(\{(?:%s)\})|[{}]" % "|".join(names), lambda m: m.group(1) or m.group(0) * 2, sql)
    frames = {
        n: given[n] if n in given else view(spark, sf_dir, n, **given) if n in VIEWS else table(spark, sf_dir, n)
        for n in names
    }
    return spark.sql(sql, **frames)

