"""Archive tables derived from the benchmark tables, one SQL text for both engines.

Two tokens differ between engines: ``{SHA}`` and ``{G}``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TOKENS = {
    "spark": {"SHA": lambda x: f"sha2({x}, 256)", "G": ""},
    "duckdb": {"SHA": lambda x: f"sha256({x})", "G": ", 'g'"},
}

#: A text as the inside of a JSON string; chr() means the same to both engines, escapes in literals don't.
JSON_TEXT = "text"
for _code, _mark in ((92, "chr(92)"), (34, "chr(34)"), (10, "'n'"), (13, "'r'"), (9, "'t'")):
    JSON_TEXT = f"replace({JSON_TEXT}, chr({_code}), concat(chr(92), {_mark}))"

VIEWS = {
    "document": """
SELECT conv_id AS document_id, concat('owner', CAST(conv_id % 7 AS STRING)) AS owner_id,
       concat('Letter ', CAST(conv_id AS STRING)) AS title,
       CASE conv_id % 4 WHEN 0 THEN 'hi' WHEN 1 THEN 'TA-in' WHEN 2 THEN 'as' ELSE 'en' END AS language,
       CASE WHEN conv_id % 2 = 0 THEN 'family' ELSE 'work' END AS tag,
       CAST(1980 + conv_id % 10 AS INT) AS year,
       TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR AS created_at,
       CASE WHEN conv_id % 5 = 3 THEN NULL
            ELSE TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR
                 + ((conv_id * 37) % 500) * INTERVAL '1' MINUTE END AS completed_at
FROM (SELECT DISTINCT conv_id FROM conversations) c""",
    "page": """
SELECT p.document_id, p.page_no, p.status,
       CASE WHEN p.status = 'PENDING' OR (p.status = 'FAILED' AND p.page_no % 2 = 0) THEN NULL ELSE p.text END AS original_text,
       CASE WHEN p.status IN ('TRANSLATED','AUDIO_DONE','INDEXED') THEN concat('en: ', p.text) END AS translated_text
FROM (SELECT q.*, CASE q.document_id % 5
               WHEN 0 THEN 'AUDIO_DONE'
               WHEN 1 THEN CASE WHEN q.page_no % 3 IN (0, 2) THEN 'FAILED' ELSE 'AUDIO_DONE' END
               WHEN 2 THEN CASE WHEN q.page_no = 2 THEN 'CAPPED' ELSE 'AUDIO_DONE' END
               WHEN 3 THEN CASE q.page_no % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'OCR_DONE' ELSE 'TRANSLATED' END
               ELSE 'INDEXED' END AS status
      FROM (SELECT conv_id AS document_id, text,
                   CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS page_no
            FROM conversations) q) p""",
    "api_call": """
SELECT event_id AS call_id, user_id % 20 AS document_id,
       CASE event_id % 3 WHEN 0 THEN 'vision-submit' WHEN 1 THEN 'translate' ELSE 'tts' END AS endpoint,
       1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS units,
       CASE event_id % 3 WHEN 0 THEN 'PAGES' ELSE 'CHARACTERS' END AS unit_type,
       CAST(floor(value * 10) AS INT) AS latency_ms,
       CASE WHEN event_type <> 'error' THEN 200
            ELSE CASE event_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 0 ELSE 404 END END AS http_status,
       ts AS created_at
FROM events""",
    "word_claim": """
SELECT doc_id AS claim_id, source AS owner_id, CAST(doc_id % 3 AS INT) AS day, text
FROM documents""",
    "stage_task": """
SELECT idempotency_key, CAST(1 AS INT) AS attempts,
       CASE k % 4 WHEN 0 THEN 'DONE' WHEN 1 THEN 'PENDING' ELSE 'RUNNING' END AS status,
       CASE WHEN k % 4 = 0 THEN concat('result-', CAST(k AS STRING)) END AS result,
       CASE k % 4 WHEN 2 THEN TIMESTAMP '2024-01-01 00:00:00' WHEN 3 THEN TIMESTAMP '2024-01-03 00:00:00' END AS lease_until
FROM (SELECT {SHA}(trim(text)) AS idempotency_key, min(doc_id) AS k FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1) g""",
    "upload": """
SELECT doc_id AS document_id, source AS owner_id, lang AS language, CAST(1 + doc_id % 33 AS INT) AS total_pages,
       n_chars * 1000 AS file_bytes,
       CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 4 THEN 'text/plain' ELSE 'image/png' END AS content_type
FROM documents""",
    "ocr_entry": """
SELECT CAST(floor(doc_id / 10.0) AS BIGINT) AS archive_id, CAST(doc_id % 10 AS INT) AS ordinal,
       CASE doc_id % 4
         WHEN 0 THEN concat('{{"markdown": "', t, '"}}')
         WHEN 1 THEN concat('{{"result": {{"text": "', t, '"}}}}')
         WHEN 2 THEN concat('{{"markdown": 7, "text": "', t, '"}}')
         ELSE concat('{{"id": "x", "body": "', t, '"}}') END AS json
FROM (SELECT doc_id, """ + JSON_TEXT + """ AS t FROM documents) d""",
    "ocr_pair": """
SELECT doc_id AS sample_id, lang AS language, text AS reference,
       replace(replace(text, 'th', 't'), 'e ', 'a ') AS hypothesis
FROM documents""",
    "request": """
SELECT event_id AS request_id, concat('10.0.0.', CAST(user_id AS STRING)) AS ip,
       CASE event_type WHEN 'view' THEN '/api/search' WHEN 'click' THEN '/api/documents/1/events'
            WHEN 'signup' THEN '/login/google' WHEN 'error' THEN '/actuator/health' ELSE '/api/usage' END AS path, ts
FROM events""",
    "failure": """
SELECT event_id AS failure_id, CASE event_id % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'translate' WHEN 2 THEN 'tts' ELSE 'assemble' END AS queue,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4 AS attempt, event_id % 5 = 0 AS is_pause, ts
FROM events WHERE event_type = 'error'""",
    "outbox": """
SELECT event_id AS id, event_type AS topic, ts AS created_at,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts + (event_id % 60) * INTERVAL '1' MINUTE END AS published_at
FROM events""",
}


def view_sql(name: str, engine: str) -> str:
    """The adapter's SQL for ``spark`` or ``duckdb``."""
    tokens = TOKENS[engine]
    text = re.sub(r"\{SHA\}\((trim\(text\))\)", lambda m: tokens["SHA"](m.group(1)), VIEWS[name])
    text = text.replace("{G}", tokens["G"])
    return text.replace("{{", "{").replace("}}", "}").strip()


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def adapter(spark: SparkSession, sf_dir: str, name: str, source: DataFrame | None = None) -> DataFrame:
    """The adapter as a lazily read DataFrame, over its table or over ``source`` in its place."""
    sql = view_sql(name, "spark").replace("{", "{{").replace("}", "}}")
    wanted = re.compile(r"\bFROM (conversations|events|documents)\b")
    table = source if source is not None else base_table(spark, sf_dir, wanted.search(sql).group(1))
    return spark.sql(wanted.sub("FROM {source}", sql), source=table)


def with_views(*names: str) -> str:
    """``WITH`` clause that declares adapters for the other engine."""
    return "WITH " + ", ".join(f"{n} AS ({view_sql(n, 'duckdb')})" for n in names)
