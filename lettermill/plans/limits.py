"""Registered queries of budgets, limits and routing."""

from lettermill.operators import limits
from lettermill.plans.common import view, views
from lettermill.plans.metrics import DECIDED, FOLDED, decided_claims
from lettermill.plans.usage import CALLS

QUERIES, ORACLES = {}, {}

QUERIES["b1_claim_budget"] = decided_claims
ORACLES["b1_claim_budget"] = f"{FOLDED} SELECT owner_id, day, claim_id, CAST(words AS INT) AS words, granted FROM granted"


def b2_remaining_budget(s, d):
    usage = limits.budget_used(decided_claims(s, d).filter("day = 0")).select("owner_id", "used")
    return limits.remaining_budget(view(s, d, "word_claim"), usage, 3000)


QUERIES["b2_remaining_budget"] = b2_remaining_budget
ORACLES["b2_remaining_budget"] = f"""{FOLDED},
used AS (SELECT owner_id, sum(CASE WHEN granted THEN greatest(words, 0) ELSE 0 END) AS used FROM granted WHERE day = 0 GROUP BY 1)
SELECT owner_id, CAST(coalesce(used, 0) AS BIGINT) AS used, CAST(greatest(3000 - coalesce(used, 0), 0) AS BIGINT) AS remaining,
       CAST(3000 AS BIGINT) AS daily_limit
FROM (SELECT DISTINCT owner_id FROM word_claim) LEFT JOIN used USING (owner_id)"""

QUERIES["b2_remaining_budget_by_day"] = lambda s, d: limits.remaining_budget(
    view(s, d, "word_claim"), limits.budget_used(decided_claims(s, d)), 3000, ["owner_id", "day"])
ORACLES["b2_remaining_budget_by_day"] = f"""{FOLDED},
used AS (SELECT owner_id, day, sum(CASE WHEN granted THEN greatest(words, 0) ELSE 0 END) AS used FROM granted GROUP BY 1, 2)
SELECT owner_id, day, CAST(coalesce(used, 0) AS BIGINT) AS used, CAST(greatest(3000 - coalesce(used, 0), 0) AS BIGINT) AS remaining,
       CAST(3000 AS BIGINT) AS daily_limit
FROM (SELECT DISTINCT owner_id, day FROM word_claim) LEFT JOIN used USING (owner_id, day)"""

QUERIES["b3_budget_reset_at"] = lambda s, d: limits.with_reset_at(view(s, d, "api_call"), "created_at").select(
    "call_id", "reset_at")
ORACLES["b3_budget_reset_at"] = f"""{CALLS}
SELECT call_id, date_trunc('day', created_at + INTERVAL 330 MINUTE) + INTERVAL 1 DAY - INTERVAL 330 MINUTE AS reset_at
FROM api_call"""

QUERIES["b5_limit_requests"] = lambda s, d: limits.limit_requests(view(s, d, "request"), 1, "1 hour").select(
    "request_id", "ip", "outcome")
ORACLES["b5_limit_requests"] = f"{DECIDED} SELECT request_id, ip, outcome FROM decided"

QUERIES["b7_route_failures"] = lambda s, d: limits.route_failures(view(s, d, "failure")).select(
    "failure_id", "route", "delay_s", "next_attempt", "target_queue")
ORACLES["b7_route_failures"] = f"""{views('failure')}
SELECT failure_id, CASE WHEN is_pause THEN 'pause' WHEN attempt < 2 THEN 'retry' ELSE 'dead_letter' END AS route,
       CASE WHEN is_pause THEN 5 WHEN attempt = 0 THEN 5 WHEN attempt = 1 THEN 30 END AS delay_s,
       CASE WHEN is_pause THEN attempt WHEN attempt < 2 THEN attempt + 1 END AS next_attempt,
       concat(queue, CASE WHEN is_pause OR attempt = 0 THEN '.retry.5s' WHEN attempt = 1 THEN '.retry.30s' ELSE '.dlq' END)
         AS target_queue
FROM failure"""

QUERIES["b8_endpoint_health"] = lambda s, d: limits.endpoint_health(view(s, d, "api_call"), chunk=1000)
ORACLES["b8_endpoint_health"] = f"""{CALLS},
rated AS (SELECT call_id, endpoint,
                 avg(CASE WHEN http_status = 0 OR http_status >= 500 THEN 1.0::DOUBLE ELSE 0.0 END) OVER w AS rate,
                 count(*) OVER w AS seen
          FROM api_call WINDOW w AS (PARTITION BY endpoint ORDER BY created_at, call_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT call_id, endpoint, CASE WHEN seen >= 5 THEN round(rate, 4) END AS failure_rate, seen >= 5 AND rate >= 0.5 AS unhealthy
FROM rated"""

