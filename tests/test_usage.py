import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lettermill.operators import metrics, usage


@pytest.fixture(scope="module")
def calls(spark):
    return spark.sql("""
        SELECT * FROM VALUES (1, 'd', 'translate', 500, 'CHARACTERS', 100, 200, TIMESTAMP '2024-01-01 00:00:10'),
          (2, 'd', 'translate', 500, 'CHARACTERS', 200, 500, TIMESTAMP '2024-01-01 00:00:20'),
          (3, 'd', 'tts', 900, 'CHARACTERS', 300, 200, TIMESTAMP '2024-01-01 00:01:10'),
          (4, 'd', 'vision-submit', 2, 'PAGES', 50, 429, TIMESTAMP '2024-01-01 00:02:10'),
          (5, 'd', 'vision-submit', 2, 'PAGES', 50, 0, TIMESTAMP '2024-01-02 00:02:10')
        AS t(call_id, document_id, endpoint, units, unit_type, latency_ms, http_status, created_at)""")


def test_only_success_costs(calls):
    got = {r["call_id"]: (r["est_cost"], r["outcome"]) for r in usage.calls_priced(calls).collect()}
    assert got == {1: (Decimal("1.0000"), "success"), 2: (Decimal("0.0000"), "server_error"), 3: (Decimal("2.7000"), "success"),
                   4: (Decimal("0.0000"), "rate_limited"), 5: (Decimal("0.0000"), "io_error")}


def test_unknown_endpoint_fails(spark):
    bad = spark.createDataFrame([(1, "other", 1, 200)], "call_id int, endpoint string, units int, http_status int")
    with pytest.raises(Exception, match="no price for endpoint other"):
        usage.price_calls(bad).collect()


def test_document_total_and_zero(spark, calls):
    docs = spark.createDataFrame([("d",), ("quiet",)], "document_id string")
    got = {r[0]: r[1] for r in usage.document_cost(docs, calls).collect()}
    assert got == {"d": Decimal("3.7000"), "quiet": Decimal("0.0000")}


def test_running_spend_counts_each_step_once(calls):
    got = [(r["endpoint"], str(r["cumulative_cost"])) for r in metrics.spend_cumulative(calls).orderBy("step_start", "endpoint").collect()]
    assert got[0] == ("translate", "1.0000") and ("tts", "2.7000") in got


def test_nearest_rank_of_twenty(spark):
    docs = spark.range(1, 21).selectExpr("id AS document_id", "'x' AS status", "TIMESTAMP '2024-01-01' AS created_at",
                                         "TIMESTAMP '2024-01-01' + id * INTERVAL '1' SECOND AS completed_at")
    got = metrics.duration_nearest_rank(docs).first()
    # The 95th of 20 is the second slowest.
    assert (got["p50"], got["p95"]) == (10_000, 19_000)


def test_fifo_inversions(spark):
    docs = spark.sql("""SELECT * FROM VALUES (1, TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-09'), (2, TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-03'),
        (3, TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-04'), (4, TIMESTAMP '2024-01-04', NULL) AS t(document_id, created_at, completed_at)""")
    assert {r["document_id"]: r["moved"] for r in metrics.fifo_inversions(docs).collect()} == {1: 2, 2: -1, 3: -1}


def test_merged_sketches_keep_ranks_within_the_bound(spark):
    rng = random.Random(9)
    rows = [("a", i % 3600, int(rng.expovariate(1 / 300))) for i in range(30000)] + [("b", 5, 7), ("b", 4000, 9), ("b", 6, None)]
    calls = spark.createDataFrame(rows, "endpoint string, second int, latency_ms int").withColumn(
        "created_at", F.timestamp_seconds(F.col("second") + 1704067200))
    hours = {(r["endpoint"], r["window_start"].hour): r for r in metrics.quantiles_of_sketches(metrics.latency_sketches(calls)).collect()}
    values = sorted(v for e, _, v in rows if e == "a")
    for column, p in (("p50_ms", 0.5), ("p95_ms", 0.95)):
        estimate = hours["a", 0][column]
        assert sum(v < estimate for v in values) / len(values) - metrics.RANK_ERROR <= p
        assert sum(v <= estimate for v in values) / len(values) + metrics.RANK_ERROR >= p
    assert hours["a", 0]["calls"] == 30000
    assert [(hours["b", h]["calls"], hours["b", h]["p50_ms"]) for h in (0, 1)] == [(1, 7), (1, 9)]
