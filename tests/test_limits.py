import random

import pytest
from pyspark.sql import functions as F

from lettermill.functions.calls import backoff_delay_ms, budget_reset_at
from lettermill.operators import limits
from lettermill.operators.ordering import flag_first, percentiles, with_position


def brute_claims(rows, cap, used=None):
    left = {k: cap - v for k, v in (used or {}).items()}
    out = {}
    for owner, claim, words in sorted(rows, key=lambda r: r[1]):
        have = max(left.get(owner, cap), 0)
        ok = words <= have or words <= 0
        if ok:
            left[owner] = have - max(words, 0)
        out[claim] = ok
    return out


@pytest.mark.parametrize("seed,cap", [(1, 50), (2, 7), (3, 1000), (4, 0)])
def test_claim_budget_is_the_ordered_fold_also_when_skewed(spark, seed, cap):
    rng = random.Random(seed)
    # One owner holds most claims, most of them of one size.
    rows = [("hot" if rng.random() < 0.7 else f"o{rng.randint(0, 5)}", i, rng.choice([0, -1, 1, 3, 3, 3, 3, 8, 20, 60, 2000]))
            for i in range(3000)]
    used = {"hot": 5, "o1": cap + 10}
    claims = spark.createDataFrame([(o, "2024-01-01", c, w) for o, c, w in rows], "owner_id string, day string, claim_id int, words int")
    taken = spark.createDataFrame([(o, "2024-01-01", u) for o, u in used.items()], "owner_id string, day string, used int")
    got = {r["claim_id"]: r["granted"] for r in limits.claim_budget(claims, taken, cap).collect()}
    assert got == brute_claims(rows, cap, used)


def test_refused_claim_takes_nothing(spark):
    claims = spark.createDataFrame([("o", 1, i, w) for i, w in enumerate([3, 3, 2, 1])], "owner_id string, day int, claim_id int, words int")
    got = [r["granted"] for r in limits.claim_budget(claims, cap=5).orderBy("claim_id").collect()]
    assert got == [True, False, True, False]


def test_fifty_equal_claims_grant_ten(spark):
    claims = spark.range(50).selectExpr("'o' AS owner_id", "1 AS day", "id AS claim_id", "100 AS words")
    assert limits.claim_budget(claims, cap=1000).filter("granted").count() == 10


def test_few_rows_of_a_hot_key_reach_the_fold(spark):
    """However many claims a key has, the candidates are bounded by the cap."""
    claims = spark.range(200_000).selectExpr("'o' AS owner_id", "1 AS day", "id AS claim_id", "CAST(1 + id % 50 AS INT) AS words")
    base = claims.withColumn("_available", F.lit(500))
    ranked = flag_first(base, ["owner_id", "day", "words"], ["claim_id"], F.floor(F.col("_available") / F.col("words")), "open")
    assert ranked.filter("open").count() == sum(500 // w for w in range(1, 51))
    decided = limits.claim_budget(claims, cap=500)
    assert decided.filter("granted").agg(F.sum("words")).first()[0] == 500


def test_budget_resets_at_local_midnight(one):
    at = budget_reset_at(F.expr("TIMESTAMP '2024-01-01 20:00:00'"))
    assert str(one(at)) == "2024-01-02 18:30:00"


def test_flag_first_keeps_exactly_the_first(spark):
    rows = spark.range(5000).selectExpr("id", "CAST(CASE WHEN id % 3 = 0 THEN 0 ELSE id % 40 END AS INT) AS k")
    got = flag_first(rows, ["k"], ["id"], 4, "first").filter("first")
    per_key = {r["k"]: r["ids"] for r in got.groupBy("k").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()}
    expected: dict = {}
    for i in range(5000):
        expected.setdefault(0 if i % 3 == 0 else i % 40, []).append(i)
    assert per_key == {k: v[:4] for k, v in expected.items()}


def test_with_position_is_dense_per_key(spark):
    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 7) END AS k", "(id * 7919) % 4001 AS o")
    got = with_position(rows, ["k"], ["o", "id"], "p", blocks=6).collect()
    by_key: dict = {}
    for r in got:
        by_key.setdefault(r["k"], []).append((r["o"], r["id"], r["p"]))
    for values in by_key.values():
        assert [p for *_, p in sorted(values)] == list(range(1, len(values) + 1))
    everything = with_position(rows, [], ["o", "id"], "p").orderBy("o", "id").select("p").collect()
    assert [r[0] for r in everything] == list(range(1, 4001))


def test_percentiles_interpolate(spark):
    rows = spark.createDataFrame([("a", v) for v in (100, 200, 300, 400)], "k string, v int")
    got = percentiles(rows, ["k"], "v", {"p50": 0.5, "p95": 0.95}, count="n").first()
    assert (got["n"], got["p50"], round(got["p95"], 6)) == (4, 250.0, 385.0)


@pytest.mark.parametrize("path,limited", [
    ("/api/search", True), ("/login", True), ("/oauth2/x", True), ("/apix", False), ("/api/documents/7/events", False),
    ("/api/documents/7/events/x", True), ("/actuator/health", False), ("/", False)])
def test_limited_paths(spark, path, limited):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(limits.limited_path()).first()[0] is limited


def test_limit_zero_switches_off(spark):
    df = spark.sql("SELECT id AS request_id, 'x' AS ip, '/api/a' AS path, TIMESTAMP '2024-01-01 00:00:00' AS ts FROM range(5)")
    assert limits.limit_requests(df, 0).filter("outcome = 'allowed'").count() == 5
    assert limits.limit_requests(df, 2).filter("outcome = 'allowed'").count() == 2


def test_route_failures(spark):
    df = spark.createDataFrame([(1, "ocr", 0, False), (2, "ocr", 1, False), (3, "ocr", 2, False), (4, "ocr", 2, True)],
                               "failure_id int, queue string, attempt int, is_pause boolean")
    got = {r["failure_id"]: (r["route"], r["delay_s"], r["next_attempt"]) for r in limits.route_failures(df).collect()}
    assert got == {1: ("retry", 5, 1), 2: ("retry", 30, 2), 3: ("dead_letter", None, None), 4: ("pause", 5, 2)}


@pytest.mark.parametrize("n,ms", [(1, 5000), (2, 7500), (3, 11250), (8, 60000), (30, 60000)])
def test_backoff(one, n, ms):
    assert one(backoff_delay_ms(F.lit(n))) == ms
    jittered = one(backoff_delay_ms(F.lit(n), F.lit("batch")))
    assert 0.8 * ms - 1 <= jittered <= 1.2 * ms + 1
    assert jittered == one(backoff_delay_ms(F.lit(n), F.lit("batch")))


@pytest.mark.parametrize("chunk", [10, 13, 1000])
def test_endpoint_health_does_not_depend_on_chunks(spark, chunk):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), rng.choice([200, 200, 429, 404, 500, 0]), i // 3) for i in range(400)]
    df = spark.createDataFrame(rows, "call_id int, endpoint string, http_status int, created_at int")
    got = {r["call_id"]: (r["failure_rate"], r["unhealthy"]) for r in limits.endpoint_health(df, chunk).collect()}
    seen: dict = {"a": [], "b": []}
    for call, endpoint, status, _ in rows:
        seen[endpoint].append(1 if status == 0 or status >= 500 else 0)
        last = seen[endpoint][-10:]
        rate = round(sum(last) / len(last), 4) if len(last) >= 5 else None
        assert got[call] == (rate, rate is not None and sum(last) / len(last) >= 0.5)
