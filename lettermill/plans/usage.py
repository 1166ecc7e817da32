"""Registered queries of the usage ledger."""

from pyspark.sql import functions as F

from lettermill.operators import usage
from lettermill.operators.chunks import explode_chunks
from lettermill.operators.ocr_planning import plan_batches
from lettermill.plans.common import now, view, views
from lettermill.plans.text import PAGE_CHUNKS

QUERIES, ORACLES = {}, {}

RATE = "CASE endpoint WHEN 'vision-submit' THEN 0.50 WHEN 'translate' THEN 0.002 WHEN 'tts' THEN 0.003 END"
COST = f"CAST(CASE WHEN http_status BETWEEN 200 AND 299 THEN CAST({RATE} AS DECIMAL(10,4)) * units ELSE 0 END AS DECIMAL(10,4))"
OUTCOME = """CASE WHEN http_status = 0 THEN 'io_error' WHEN http_status = 429 THEN 'rate_limited'
  WHEN http_status BETWEEN 200 AND 299 THEN 'success' WHEN http_status BETWEEN 400 AND 499 THEN 'client_error'
  ELSE 'server_error' END"""
CALLS = views("api_call")

QUERIES["u1_price_calls"] = lambda s, d: usage.price_calls(view(s, d, "api_call")).select(
    "call_id", "endpoint", "units", "est_cost")
ORACLES["u1_price_calls"] = f"{CALLS} SELECT call_id, endpoint, units, {COST} AS est_cost FROM api_call"

QUERIES["u2_classify_outcome"] = lambda s, d: usage.classify_calls(view(s, d, "api_call")).select(
    "call_id", "http_status", "outcome")
ORACLES["u2_classify_outcome"] = f"{CALLS} SELECT call_id, http_status, {OUTCOME} AS outcome FROM api_call"

REJECTED = "CASE call_id % 9 WHEN 1 THEN 'limiter' WHEN 2 THEN 'breaker' WHEN 3 THEN 'busy' END"
ANSWERED = "CASE WHEN http_status <> 0 THEN http_status END"
QUERIES["u3_billable_attempts"] = lambda s, d: usage.billable_attempts(
    view(s, d, "api_call").selectExpr("call_id", "endpoint", f"{ANSWERED} AS http_status", f"{REJECTED} AS rejected_by"))
ORACLES["u3_billable_attempts"] = f"""{CALLS}
SELECT call_id, endpoint, coalesce({ANSWERED}, 0) AS http_status FROM api_call WHERE ({REJECTED}) IS NULL"""

QUERIES["u4_usage_by_endpoint"] = lambda s, d: usage.usage_by_endpoint(view(s, d, "api_call"))
ORACLES["u4_usage_by_endpoint"] = f"""{CALLS}
SELECT document_id, endpoint, count(*) AS calls, CAST(sum(units) AS BIGINT) AS units,
       CAST(sum({COST}) AS DECIMAL(20,4)) AS cost, round(quantile_cont(latency_ms, 0.5), 4) AS p50_ms,
       round(quantile_cont(latency_ms, 0.95), 4) AS p95_ms
FROM api_call GROUP BY document_id, endpoint"""

QUERIES["u5_document_cost"] = lambda s, d: usage.document_cost(view(s, d, "document"), view(s, d, "api_call"))
ORACLES["u5_document_cost"] = f"""{views('document', 'api_call')}
SELECT document_id, CAST(coalesce(sum({COST}), 0) AS DECIMAL(20,4)) AS total_cost
FROM document LEFT JOIN api_call USING (document_id) GROUP BY document_id"""

FROM, TO = "TIMESTAMP '2024-01-03 00:00:00'", "TIMESTAMP '2024-01-20 00:00:00'"
QUERIES["u6_usage_by_owner_day"] = lambda s, d: usage.usage_by_owner_day(
    view(s, d, "api_call"), view(s, d, "document"), F.expr(FROM), F.expr(TO))
OWNER_DAY = f"""{views('document', 'api_call')}
SELECT owner_id, CAST(date_trunc('day', a.created_at) AS DATE) AS day, document_id, any_value(title) AS title,
       count(*) AS calls, CAST(sum({COST}) AS DECIMAL(20,4)) AS cost, round(quantile_cont(latency_ms, 0.95), 4) AS p95_ms
FROM api_call a JOIN document USING (document_id)
WHERE a.created_at >= {FROM} AND a.created_at < {TO}"""
ORACLES["u6_usage_by_owner_day"] = f"{OWNER_DAY} GROUP BY owner_id, day, document_id"
QUERIES["u6_usage_of_one_owner"] = lambda s, d: usage.usage_by_owner_day(
    view(s, d, "api_call"), view(s, d, "document"), F.expr(FROM), F.expr(TO), owner="owner3")
ORACLES["u6_usage_of_one_owner"] = f"{OWNER_DAY} AND owner_id = 'owner3' GROUP BY owner_id, day, document_id"


def u7_estimate_cost(s, d):
    pages = view(s, d, "page")
    batches = plan_batches(view(s, d, "upload"), now=now())
    ocr = batches.select("document_id", F.lit("vision-submit").alias("endpoint"),
                         F.expr("last_page - first_page + 1").alias("units"))
    chunks = explode_chunks(pages.select("document_id", "original_text"), "original_text", 120)
    translate = chunks.select("document_id", F.lit("translate").alias("endpoint"), F.length("chunk").alias("units"))
    return usage.estimate_cost(ocr.unionByName(translate), ["document_id"])


QUERIES["u7_estimate_cost"] = u7_estimate_cost
ORACLES["u7_estimate_cost"] = f"""
{views('page', 'upload', recursive=True)}, {PAGE_CHUNKS},
planned AS (SELECT document_id, 'vision-submit' AS endpoint, total_pages AS units FROM upload
            UNION ALL SELECT document_id, 'translate', length(chunk) FROM chunks)
SELECT document_id, endpoint, CAST(sum(units) AS BIGINT) AS units,
       CAST(sum(CAST(CAST({RATE} AS DECIMAL(10,4)) * units AS DECIMAL(18,4))) AS DECIMAL(20,4)) AS cost
FROM planned GROUP BY document_id, endpoint"""

QUERIES["u8_units_by_type"] = lambda s, d: usage.units_by_type(view(s, d, "api_call"))
ORACLES["u8_units_by_type"] = f"{CALLS} SELECT unit_type, CAST(sum(units) AS BIGINT) AS units FROM api_call GROUP BY 1"
