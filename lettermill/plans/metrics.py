"""Registered queries of the operations metrics."""

from pyspark.sql import functions as F

from lettermill.operators import limits, metrics, state
from lettermill.plans.common import NOW, budget_ctes, now, view, views, word_count
from lettermill.plans.usage import CALLS, COST, OUTCOME

QUERIES, ORACLES = {}, {}

QUERIES["m1_calls_per_minute"] = lambda s, d: metrics.calls_per_minute(view(s, d, "api_call"))
ORACLES["m1_calls_per_minute"] = f"""{CALLS}
SELECT date_trunc('minute', created_at) AS window_start, endpoint, {OUTCOME} AS outcome, count(*) AS calls
FROM api_call GROUP BY ALL"""

QUERIES["m2_latency_quantiles"] = lambda s, d: metrics.latency_quantiles(view(s, d, "api_call"))
ORACLES["m2_latency_quantiles"] = f"""{CALLS}
SELECT endpoint, round(quantile_cont(latency_ms, 0.5), 4) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 4) AS p95_ms
FROM api_call GROUP BY endpoint"""

QUERIES["m3_spend_cumulative"] = lambda s, d: metrics.spend_cumulative(view(s, d, "api_call"))
ORACLES["m3_spend_cumulative"] = f"""{CALLS},
steps AS (SELECT endpoint, date_trunc('minute', created_at) AS step_start, CAST(sum({COST}) AS DECIMAL(20,4)) AS cost
          FROM api_call GROUP BY 1, 2)
SELECT endpoint, step_start, cost,
       CAST(sum(cost) OVER (PARTITION BY endpoint ORDER BY step_start) AS DECIMAL(20,4)) AS cumulative_cost FROM steps"""

QUERIES["m4_spend_per_hour"] = lambda s, d: metrics.spend_per_hour(view(s, d, "api_call"))
ORACLES["m4_spend_per_hour"] = f"""{CALLS}
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, endpoint, CAST(sum(cost) AS DECIMAL(20,4)) AS cost
FROM (SELECT time_bucket(INTERVAL 5 MINUTE, created_at) - unnest(range(12)) * INTERVAL 5 MINUTE AS window_start,
             endpoint, {COST} AS cost FROM api_call) GROUP BY window_start, endpoint"""

QUERIES["m5_units_per_minute"] = lambda s, d: metrics.units_per_minute(view(s, d, "api_call"))
ORACLES["m5_units_per_minute"] = f"""{CALLS}
SELECT window_start, unit_type, CAST(sum(units) AS DOUBLE) / 5 AS units_per_minute
FROM (SELECT date_trunc('minute', created_at) - unnest(range(5)) * INTERVAL 1 MINUTE AS window_start, unit_type, units
      FROM api_call) GROUP BY window_start, unit_type"""

QUERIES["m6_endpoint_latency_p95"] = lambda s, d: metrics.endpoint_latency_p95(view(s, d, "api_call"), "translate")
ORACLES["m6_endpoint_latency_p95"] = f"""{CALLS}
SELECT endpoint, round(quantile_cont(latency_ms, 0.95), 4) AS p95_ms FROM api_call WHERE endpoint = 'translate' GROUP BY 1"""

BOX = views("outbox")
QUERIES["m7_outbox_backlog"] = lambda s, d: metrics.outbox_backlog(view(s, d, "outbox"))
ORACLES["m7_outbox_backlog"] = f"""{BOX}
SELECT topic, CAST(count(*) FILTER (WHERE published_at IS NULL) AS BIGINT) AS backlog FROM outbox GROUP BY topic"""
QUERIES["m7_outbox_backlog_as_of"] = lambda s, d: metrics.outbox_backlog_as_of(view(s, d, "outbox"), now())
ORACLES["m7_outbox_backlog_as_of"] = f"""{BOX}
SELECT topic, CAST(count(*) FILTER (WHERE created_at <= {NOW} AND (published_at IS NULL OR published_at > {NOW})) AS BIGINT)
       AS backlog FROM outbox GROUP BY topic"""
QUERIES["m7_outbox_backlog_over_time"] = lambda s, d: metrics.outbox_backlog_over_time(view(s, d, "outbox"))
ORACLES["m7_outbox_backlog_over_time"] = f"""{BOX},
steps AS (SELECT topic, step_start, sum(move) AS move FROM (
            SELECT topic, date_trunc('minute', created_at) AS step_start, 1 AS move FROM outbox
            UNION ALL SELECT topic, date_trunc('minute', published_at), -1 FROM outbox WHERE published_at IS NOT NULL)
          GROUP BY topic, step_start)
SELECT topic, step_start, CAST(sum(move) OVER (PARTITION BY topic ORDER BY step_start) AS BIGINT) AS backlog FROM steps"""

QUERIES["m8_next_to_publish"] = lambda s, d: metrics.next_to_publish(view(s, d, "outbox")).select(
    "id", "topic", "created_at")
ORACLES["m8_next_to_publish"] = f"""{BOX}
SELECT id, topic, created_at FROM outbox WHERE published_at IS NULL ORDER BY created_at, id LIMIT 50"""
LATER = "TIMESTAMP '2024-01-20 00:00:00'"
QUERIES["m8_purge_published"] = lambda s, d: metrics.purge_published(view(s, d, "outbox"), F.expr(LATER)).select(
    "id", "topic")
ORACLES["m8_purge_published"] = f"""{BOX}
SELECT id, topic FROM outbox WHERE published_at IS NULL OR published_at >= {LATER} - INTERVAL 7 DAY"""

LIMITED = "regexp_matches(path, '^/(api|oauth2|login)(/.*)?$') AND NOT regexp_matches(path, '^/api/documents/[^/]+/events$')"
DECIDED = f"""{views('request')},
decided AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY ip, date_trunc('hour', ts) ORDER BY ts, request_id) <= 1
                           THEN 'allowed' ELSE 'rejected' END AS outcome
            FROM request WHERE {LIMITED})"""
QUERIES["m9_limited_requests_per_minute"] = lambda s, d: metrics.limited_requests_per_minute(
    limits.limit_requests(view(s, d, "request"), 1, "1 hour"))
ORACLES["m9_limited_requests_per_minute"] = f"""{DECIDED}
SELECT date_trunc('minute', ts) AS window_start, outcome, count(*) AS requests FROM decided GROUP BY ALL"""


def settled_documents(s, d):
    settled = state.settle_documents(view(s, d, "page"))
    return view(s, d, "document").join(settled, "document_id").withColumnRenamed("outcome", "status")


SETTLED = f"""{views('document', 'page')},
settled AS (SELECT document_id, CASE WHEN bool_or(status IN ('PENDING', 'OCR_DONE', 'TRANSLATED')) THEN 'DEFERRED'
                        WHEN bool_or(status IN ('FAILED', 'CAPPED')) THEN 'PARTIAL' ELSE 'COMPLETE' END AS outcome
            FROM page GROUP BY document_id),
done AS (SELECT d.*, outcome AS status, date_diff('millisecond', created_at, completed_at) AS duration_ms
         FROM document d JOIN settled USING (document_id) WHERE completed_at IS NOT NULL)"""
QUERIES["m10_document_durations"] = lambda s, d: metrics.document_durations(settled_documents(s, d))
ORACLES["m10_document_durations"] = f"""{SETTLED}
SELECT status, count(*) AS documents, round(quantile_cont(duration_ms, 0.5) / 1000, 4) AS p50_s,
       round(quantile_cont(duration_ms, 0.95) / 1000, 4) AS p95_s, round(max(duration_ms) / 1000, 4) AS longest_s
FROM done GROUP BY status"""

QUERIES["m11_nearest_rank"] = lambda s, d: metrics.duration_nearest_rank(settled_documents(s, d))
ORACLES["m11_nearest_rank"] = f"""{SETTLED}
SELECT status, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95 FROM done GROUP BY status"""

QUERIES["m12_fifo_inversions"] = lambda s, d: metrics.fifo_inversions(view(s, d, "document"))
ORACLES["m12_fifo_inversions"] = f"""{views('document')},
placed AS (SELECT document_id, row_number() OVER (ORDER BY created_at, document_id) AS arrival,
                  row_number() OVER (ORDER BY completed_at, document_id) AS completion
           FROM document WHERE completed_at IS NOT NULL)
SELECT document_id, arrival, completion, completion - arrival AS moved FROM placed"""

CLAIMS = f"{views('word_claim')}, claims AS (SELECT claim_id, owner_id, day, {word_count('text')} AS words FROM word_claim)"
FOLDED = f"{CLAIMS}, {budget_ctes('claims', 'owner_id, day', 'claim_id', 3000)}"


def decided_claims(s, d):
    from lettermill.functions.text import word_count as words

    return limits.claim_budget(view(s, d, "word_claim").withColumn("words", words("text")), cap=3000)


QUERIES["m13_cap_words"] = lambda s, d: metrics.cap_words(decided_claims(s, d))
ORACLES["m13_cap_words"] = f"""{FOLDED}
SELECT CASE WHEN granted THEN 'allowed' ELSE 'rejected' END AS outcome, CAST(sum(greatest(words, 0)) AS BIGINT) AS words,
       count(*) AS claims FROM granted GROUP BY 1"""
