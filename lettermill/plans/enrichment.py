"""Registered queries of exactly-once enrichment."""

from pyspark.sql import functions as F

from lettermill.functions.text import content_hash as hash_of
from lettermill.operators import enrichment as en
from lettermill.operators.chunks import explode_chunks
from lettermill.plans.common import NOW, chunk_ctes, content_hash, now, table, view, views
from lettermill.plans.text import CODES, PAGE_CHUNKS, SPOKEN

QUERIES, ORACLES = {}, {}


def say(text: str) -> str:
    """Stands in for the paid call: marks its input, and refuses some of it."""
    if "zz" in text:
        raise ValueError("refused")
    return f"en({text})"


def document_work(s, d):
    return table(s, d, "documents").select(
        "doc_id", F.sha2(F.trim("text"), 256).alias(en.KEY),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN 'translate' ELSE 'tts' END").alias("endpoint"),
        F.length("text").alias("units"))


WORK = """work AS (SELECT doc_id, sha256(trim(text)) AS idempotency_key,
  CASE WHEN doc_id % 2 = 0 THEN 'translate' ELSE 'tts' END AS endpoint, length(text) AS units FROM documents)"""
ACTION = f"""CASE WHEN t.status IS NULL THEN 'NEW' WHEN t.status = 'DONE' THEN 'REUSE'
  WHEN t.status = 'PENDING' OR t.lease_until < {NOW} THEN 'TAKEOVER' ELSE 'BUSY' END"""
PLANNED = f"""{views('stage_task')}, {WORK},
planned AS (SELECT w.*, {ACTION} AS action, t.attempts, t.result
            FROM work w LEFT JOIN stage_task t USING (idempotency_key))"""

QUERIES["e1_plan_calls"] = lambda s, d: en.plan_calls(document_work(s, d), view(s, d, "stage_task"), now()).select(
    "doc_id", "action", "next_attempt", "stored_result")
ORACLES["e1_plan_calls"] = f"""{PLANNED}
SELECT doc_id, action, CASE action WHEN 'NEW' THEN 1 WHEN 'TAKEOVER' THEN attempts + 1 END AS next_attempt,
       CASE WHEN action = 'REUSE' THEN result END AS stored_result FROM planned"""

QUERIES["e2_distinct_calls"] = lambda s, d: en.distinct_calls(document_work(s, d), ["doc_id"]).select(en.KEY, "doc_id")
ORACLES["e2_distinct_calls"] = f"WITH {WORK} SELECT idempotency_key, min(doc_id) AS doc_id FROM work GROUP BY 1"


def page_chunks(s, d):
    pages = view(s, d, "page").select("document_id", "page_no", "original_text")
    return explode_chunks(pages, "original_text", 120)


def e3_enrich(s, d):
    calls = page_chunks(s, d).select(
        F.concat_ws("/", "document_id", "page_no", "chunk_index").alias(en.KEY), F.lit(1).alias("next_attempt"), "chunk")
    return en.enrich(calls, say).select(en.KEY, "attempts", "status", "result", "last_error")


QUERIES["e3_enrich"] = e3_enrich
ORACLES["e3_enrich"] = f"""{views('page', recursive=True)}, {PAGE_CHUNKS}
SELECT concat(document_id, '/', page_no, '/', chunk_index) AS idempotency_key, 1 AS attempts,
       CASE WHEN contains(chunk, 'zz') THEN 'PENDING' ELSE 'DONE' END AS status,
       CASE WHEN NOT contains(chunk, 'zz') THEN concat('en(', chunk, ')') END AS result,
       CASE WHEN contains(chunk, 'zz') THEN 'ValueError: refused' END AS last_error FROM chunks"""


def e4_merge_ledger(s, d):
    calls = en.plan_calls(en.distinct_calls(document_work(s, d), ["doc_id"]), view(s, d, "stage_task"), now())
    finished = F.col("doc_id") % 3 > 0
    outcomes = calls.filter("action <> 'BUSY'").select(
        en.KEY, F.coalesce("next_attempt", F.lit(9)).alias("attempts"),
        F.when(finished, "DONE").otherwise("PENDING").alias("status"),
        F.when(finished, F.concat(F.lit("new-"), F.col("doc_id").cast("string"))).alias("result"),
        F.lit(None).cast("timestamp").alias("lease_until"))
    return en.merge_ledger(view(s, d, "stage_task"), outcomes)


QUERIES["e4_merge_ledger"] = e4_merge_ledger
ORACLES["e4_merge_ledger"] = f"""{PLANNED},
firsts AS (SELECT * FROM planned QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY doc_id) = 1),
outcomes AS (SELECT idempotency_key, CASE action WHEN 'NEW' THEN 1 WHEN 'TAKEOVER' THEN attempts + 1 ELSE 9 END AS attempts,
                    CASE WHEN doc_id % 3 > 0 THEN 'DONE' ELSE 'PENDING' END AS status,
                    CASE WHEN doc_id % 3 > 0 THEN concat('new-', doc_id) END AS result
             FROM firsts WHERE action <> 'BUSY')
SELECT idempotency_key,
       CASE WHEN t.status = 'DONE' OR o.status IS NULL THEN t.attempts ELSE o.attempts END AS attempts,
       CASE WHEN t.status = 'DONE' OR o.status IS NULL THEN t.status ELSE o.status END AS status,
       CASE WHEN t.status = 'DONE' OR o.status IS NULL THEN t.result ELSE o.result END AS result,
       CASE WHEN t.status = 'DONE' OR o.status IS NULL THEN t.lease_until END AS lease_until
FROM stage_task t FULL JOIN outcomes o USING (idempotency_key)"""

QUERIES["e5_reassemble"] = lambda s, d: en.reassemble(
    page_chunks(s, d).withColumn("result", F.concat(F.lit("en("), "chunk", F.lit(")"))), ["document_id", "page_no"])
ORACLES["e5_reassemble"] = f"""{views('page', recursive=True)}, {PAGE_CHUNKS}
SELECT document_id, page_no, string_agg(concat('en(', chunk, ')'), ' ' ORDER BY chunk_index) AS text FROM chunks GROUP BY 1, 2"""


def all_ready(s, d):
    """Every page with text, as OCR left it."""
    pages = view(s, d, "page").filter("original_text IS NOT NULL").withColumn("status", F.lit("OCR_DONE"))
    return pages.withColumn("text_hash", hash_of("original_text")).drop("translated_text")


def empty_ledger(s):
    return s.createDataFrame([], en.LEDGER_SCHEMA)


def mark(text: str) -> str:
    return f"en({text})"


QUERIES["e6_translate_pages"] = lambda s, d: en.translate_pages(
    all_ready(s, d), view(s, d, "document"), empty_ledger(s), mark, now(), limit=120).results
FOREIGN_CHUNKS = chunk_ctes("foreign_page", "document_id, page_no", "original_text", 120)
ORACLES["e6_translate_pages"] = f"""{views('document', 'page', recursive=True)},
ready AS (SELECT p.*, language FROM page p JOIN document USING (document_id) WHERE original_text IS NOT NULL),
foreign_page AS (SELECT * FROM ready WHERE language <> 'en'), {FOREIGN_CHUNKS},
translated AS (SELECT document_id, page_no, string_agg(concat('en(', chunk, ')'), ' ' ORDER BY chunk_index) AS t FROM chunks GROUP BY 1, 2)
SELECT document_id, page_no, {content_hash('original_text')} AS text_hash,
       CASE WHEN language = 'en' THEN original_text ELSE t END AS translated_text
FROM ready LEFT JOIN translated USING (document_id, page_no)"""


def e6_rerun_is_free(s, d):
    """Calls still due per action when the same work runs again on the ledger of the first run."""
    docs, pages = view(s, d, "document"), all_ready(s, d)
    first = en.translate_pages(pages, docs, empty_ledger(s), mark, now(), limit=120)
    again = en.plan_calls(en.translate_work(pages, docs, 120), first.ledger, now())
    return again.groupBy("action").agg(F.count(F.lit(1)).alias("chunks"))


QUERIES["e6_rerun_is_free"] = e6_rerun_is_free
ORACLES["e6_rerun_is_free"] = f"""{views('document', 'page', recursive=True)},
foreign_page AS (SELECT p.* FROM page p JOIN document USING (document_id) WHERE original_text IS NOT NULL AND language <> 'en'),
{FOREIGN_CHUNKS}
SELECT 'REUSE' AS action, count(*) AS chunks FROM chunks"""


QUERIES["e7_speech_requests"] = lambda s, d: en.speech_requests(view(s, d, "page"), view(s, d, "document"))
REQUESTS = f"""ready AS (SELECT p.*, owner_id, split_part(lower(language), '-', 1) AS base
                FROM page p JOIN document USING (document_id) WHERE status = 'TRANSLATED'),
requests AS (SELECT document_id, page_no, owner_id, 'en' AS track, translated_text AS text, 'en-IN' AS speech_language FROM ready
             UNION ALL SELECT document_id, page_no, owner_id, 'orig', original_text, concat(base, '-IN') FROM ready
             WHERE base <> 'en' AND base IN ({SPOKEN}) AND base IN ({CODES}))"""
ORACLES["e7_speech_requests"] = f"{views('document', 'page')}, {REQUESTS} SELECT * FROM requests"

QUERIES["e7_speak_pages"] = lambda s, d: en.speak_pages(
    view(s, d, "page"), view(s, d, "document"), empty_ledger(s), mark, now(), limit=150).results
ORACLES["e7_speak_pages"] = f"""{views('document', 'page', recursive=True)}, {REQUESTS},
{chunk_ctes('requests', 'document_id, page_no, track', 'text', 150)}
SELECT document_id, page_no, track, string_agg(concat('en(', chunk, ')'), ' ' ORDER BY chunk_index) AS segment_keys
FROM chunks GROUP BY 1, 2, 3"""

QUERIES["e8_cache_savings"] = lambda s, d: en.cache_savings(document_work(s, d), view(s, d, "stage_task"), now())
ORACLES["e8_cache_savings"] = f"""{PLANNED},
turns AS (SELECT *, row_number() OVER (PARTITION BY idempotency_key, endpoint ORDER BY doc_id) AS turn FROM planned)
SELECT endpoint, count(*) FILTER (WHERE action = 'REUSE' OR turn > 1) AS calls_avoided,
       CAST(coalesce(sum(units) FILTER (WHERE action = 'REUSE' OR turn > 1), 0) AS BIGINT) AS units_avoided,
       CAST(coalesce(sum(units) FILTER (WHERE action = 'REUSE' OR turn > 1), 0)
            * CASE endpoint WHEN 'translate' THEN 0.002 ELSE 0.003 END AS DECIMAL(20,4)) AS cost_avoided
FROM turns GROUP BY endpoint"""


def segments(s, d):
    pages = view(s, d, "page").select("document_id", "page_no", F.explode(F.array(F.lit("en"), F.lit("orig"))).alias("track"))
    return pages.filter("track = 'en' OR document_id % 3 <> 0").selectExpr(
        "document_id", "page_no", "track", "concat('k', page_no, track) AS key", "page_no * 100 AS frames",
        "CASE WHEN document_id % 7 = 2 AND page_no = 1 THEN 'pcm16' ELSE 'pcm22' END AS format")


SEGMENTS = """segments AS (
  SELECT document_id, page_no, track, concat('k', page_no, track) AS key, page_no * 100 AS frames,
         CASE WHEN document_id % 7 = 2 AND page_no = 1 THEN 'pcm16' ELSE 'pcm22' END AS format
  FROM page, (VALUES ('en'), ('orig')) v(track) WHERE track = 'en' OR document_id % 3 <> 0)"""


def manifest(s, d):
    return en.track_manifest(view(s, d, "page"), segments(s, d))


QUERIES["e9_track_manifest"] = lambda s, d: manifest(s, d).select(
    "document_id", "track", F.array_join(F.transform("segments", lambda x: x["key"]), ",").alias("keys"),
    "total_frames", "track_key")
MANIFEST = f"""{views('page')}, {SEGMENTS},
manifest AS (SELECT document_id, track, string_agg(key, ',' ORDER BY page_no) AS keys, CAST(sum(frames) AS BIGINT) AS total_frames,
                    concat('documents/', document_id, '/audio/', track, '.wav') AS track_key
             FROM segments JOIN page USING (document_id, page_no) WHERE status NOT IN ('FAILED', 'CAPPED') GROUP BY 1, 2)"""
ORACLES["e9_track_manifest"] = f"{MANIFEST} SELECT * FROM manifest"

QUERIES["e10_format_conflicts"] = lambda s, d: en.format_conflicts(segments(s, d))
ORACLES["e10_format_conflicts"] = f"""{views('page')}, {SEGMENTS}
SELECT document_id, track, count(*) AS segments, CAST(sum(frames) AS BIGINT) AS total_frames, count(DISTINCT format) > 1 AS conflict
FROM segments GROUP BY 1, 2"""

ASKED = """SELECT turn AS t, conv_id AS document_id, conv_id * 10 + turn AS request_id,
  CASE turn % 3 WHEN 0 THEN 'orig' WHEN 1 THEN 'en' ELSE 'fr' END AS lang,
  concat('owner', CAST((conv_id + CASE WHEN conv_id % 11 = 0 THEN 1 ELSE 0 END) % 7 AS STRING)) AS owner_id"""


def e11_resolve_track(s, d):
    asked = s.sql(ASKED + " FROM {source}", source=table(s, d, "conversations"))
    return en.resolve_track(asked, view(s, d, "document"), manifest(s, d))


QUERIES["e11_resolve_track"] = e11_resolve_track
ORACLES["e11_resolve_track"] = f"""{MANIFEST}, document AS (SELECT DISTINCT conv_id AS document_id, concat('owner', conv_id % 7) AS owner_id FROM conversations),
asked AS ({ASKED} FROM conversations),
decided AS (SELECT request_id, document_id, lang,
  CASE WHEN lang NOT IN ('orig', 'en') THEN 'INVALID' WHEN NOT exists(SELECT 1 FROM document o WHERE o.document_id = a.document_id AND o.owner_id = a.owner_id) THEN 'NOT_FOUND'
       WHEN exists(SELECT 1 FROM manifest m WHERE m.document_id = a.document_id AND m.track = a.lang) THEN 'FOUND'
       WHEN lang = 'orig' AND exists(SELECT 1 FROM manifest m WHERE m.document_id = a.document_id AND m.track = 'en') THEN 'FALLBACK'
       ELSE 'NOT_FOUND' END AS outcome FROM asked a)
SELECT *, CASE outcome WHEN 'FOUND' THEN concat('documents/', document_id, '/audio/', lang, '.wav')
                       WHEN 'FALLBACK' THEN concat('documents/', document_id, '/audio/en.wav') END AS track_key FROM decided"""
