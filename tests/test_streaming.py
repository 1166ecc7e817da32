import datetime
import random

import pandas as pd
from pyspark.sql import functions as F

from lettermill.operators import limits, metrics
from lettermill.sources.changes import change_stream, relay
from lettermill.streaming import budget, sinks, states


def feed(df, path, name):
    """Append one file, so that the next run sees it as its own micro-batch."""
    df.coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(path))


def run_parts(spark, tmp_path, df, part, n, make, idle_batches=True):
    """Each part as a run of its own: the query restarts from its checkpoint."""
    dropped = 0
    for i in range(n):
        feed(df.filter(part == i), tmp_path / "in", i)
        query = sinks.start_appends(make(stream(spark, tmp_path / "in", df.schema)), f"{tmp_path}/out", f"{tmp_path}/cp", idle_batches=idle_batches)
        query.awaitTermination()
        dropped += sinks.late_rows(query)
    return sinks.read_appended(spark, f"{tmp_path}/out").collect(), dropped


def test_budget_over_restarts_equals_one_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.6 else f"o{rng.randint(0, 3)}", 1, i, rng.choice([-1, 0, 1, 2, 5, 30, 80])) for i in range(900)]
    claims = spark.createDataFrame(rows, "owner_id string, day int, claim_id int, words int")
    found, _ = run_parts(spark, tmp_path, claims, F.floor(F.col("claim_id") / 300), 3, lambda s: budget.claim_budget_stream(s, cap=120), False)
    assert len(found) == 900 and {r["claim_id"]: r["granted"] for r in found} == {
        r["claim_id"]: r["granted"] for r in limits.claim_budget(claims, cap=120).collect()}


def test_an_expired_budget_starts_anew(spark, tmp_path):
    claims = spark.createDataFrame([("o", 1, i, 60) for i in range(4)], "owner_id string, day int, claim_id int, words int")
    make = lambda s: budget.claim_budget_stream(s, cap=120, kept=datetime.timedelta(milliseconds=1))
    found, _ = run_parts(spark, tmp_path, claims, F.floor(F.col("claim_id") / 2), 2, make, False)
    # The second run no longer knows the first one's claims.
    assert len(found) == 4 and all(r["granted"] for r in found)


class Kept:
    """A value state outside a stream."""
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_busy_key_holds_no_more_than_fits():
    """Frames of one key, as a large micro-batch brings them; the result is that of one sorted frame."""
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 3, 7, 50])) for i in range(5000)]
    rng.shuffle(rows)
    frames = [pd.DataFrame(rows[i:i + 100], columns=["claim_id", "words"]) for i in range(0, 5000, 100)]
    whole = budget.Budget(["owner_id"], "claim_id", 200, datetime.timedelta(days=1))
    pieces = budget.Budget(["owner_id"], "claim_id", 200, datetime.timedelta(days=1))
    whole.count, pieces.count = Kept(), Kept()
    one = pd.concat(whole.handleInputRows(("o",), iter([pd.concat(frames)]), None))
    many = list(pieces.handleInputRows(("o",), iter(frames), None))
    assert whole.count.value == pieces.count.value and max(map(len, many[1:])) < 1500
    key = lambda df: sorted(map(tuple, df[["claim_id", "words", "granted"]].values.tolist()))
    assert key(pd.concat(many)) == key(one) and len(one) == 5000


def test_request_limit_over_restarts(spark, tmp_path):
    requests = spark.range(600).selectExpr(
        "id AS request_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('ip', id % 20) END AS ip", "'/api/x' AS path",
        "TIMESTAMP '2024-01-01 00:00:00' + id * INTERVAL '1' SECOND AS ts")
    found, _ = run_parts(spark, tmp_path, requests, F.floor(F.col("request_id") / 200), 3, lambda s: budget.limit_requests_stream(s, 4), False)
    got = {r["request_id"]: r["outcome"] for r in found}
    assert len(found) == 600 and got == {r["request_id"]: r["outcome"] for r in limits.limit_requests(requests, 4).collect()}


def test_no_limit_allows_all(spark, tmp_path):
    requests = spark.range(5).selectExpr("id AS request_id", "'a' AS ip", "'/api/x' AS path", "TIMESTAMP '2024-01-01 00:00:00' AS ts")
    found, _ = run_parts(spark, tmp_path, requests, F.lit(0), 1, lambda s: budget.limit_requests_stream(s, 0))
    assert {r["outcome"] for r in found} == {"allowed"} and len(found) == 5


def test_windows_over_micro_batches_equal_batch(spark, tmp_path):
    calls = spark.range(500).selectExpr("id AS call_id", "CASE id % 2 WHEN 0 THEN 'tts' ELSE 'translate' END AS endpoint",
                                        "CAST(id AS INT) AS units", "'CHARACTERS' AS unit_type", "CAST(id AS INT) AS latency_ms",
                                        "CASE WHEN id % 9 = 0 THEN 500 ELSE 200 END AS http_status",
                                        "TIMESTAMP '2024-01-01 00:00:00' + id * INTERVAL '7' SECOND AS created_at")
    for part in range(3):
        feed(calls.filter(F.col("call_id") % 3 == part), tmp_path / "in", part)
        source = stream(spark, tmp_path / "in", calls.schema)
        sinks.start_upserts(metrics.calls_per_minute(source, "2 hours"), f"{tmp_path}/o1", f"{tmp_path}/c1").awaitTermination()
        sinks.start_upserts(metrics.units_per_minute(source, "2 hours"), f"{tmp_path}/o2", f"{tmp_path}/c2").awaitTermination()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    batch = metrics.calls_per_minute(calls)
    assert key(sinks.read_latest(spark, f"{tmp_path}/o1", ["window_start", "endpoint", "outcome"]).select(batch.columns)) == key(batch)
    batch = metrics.units_per_minute(calls)
    assert key(sinks.read_latest(spark, f"{tmp_path}/o2", ["window_start", "unit_type"]).select(batch.columns)) == key(batch)


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    calls = spark.sql("""SELECT 'tts' AS endpoint, 200 AS http_status, TIMESTAMP '2024-01-01 10:00:00' AS created_at""")
    old = calls.withColumn("created_at", F.expr("TIMESTAMP '2024-01-01 01:00:00'"))
    later = calls.withColumn("created_at", F.expr("TIMESTAMP '2024-01-01 11:00:00'"))
    dropped = 0
    for name, df in (("a", calls), ("b", later), ("c", old)):
        feed(df, tmp_path / "in", name)
        query = sinks.start_upserts(metrics.calls_per_minute(stream(spark, tmp_path / "in", calls.schema), "10 minutes"),
                                    f"{tmp_path}/out", f"{tmp_path}/cp")
        query.awaitTermination()
        dropped += sinks.late_rows(query)
    assert dropped == 1


def timed(changes):
    """One change a minute, with a heartbeat an hour after the last."""
    return changes.withColumn("ts", F.expr("TIMESTAMP '2024-01-01 00:00:00' + seq * INTERVAL '1' MINUTE"))


def test_page_changes_out_of_order_are_released_in_order(spark, tmp_path):
    rows = [(1, "ocr", "h1"), (2, "audio", None), (3, "translated", "h0"), (4, "translated", "h1"), (5, "translated", "h1"), (6, "edited", "h2"),
            (7, "translated", "h1"), (8, "translated", "h2"), (9, "audio", None), (10, "indexed", None), (11, "failed", None)]
    changes = timed(spark.createDataFrame([(7, 1, *r) for r in rows] + [(-1, -1, 100, "heartbeat", None), (7, 1, 12, "edited", "h3")],
                                          "document_id bigint, page_no int, seq bigint, kind string, text_hash string"))
    # Even ones first, then odd ones within the delay, a heartbeat, and one that is too late.
    part = F.when(F.col("kind") == "heartbeat", 2).when(F.col("seq") == 12, 3).otherwise(F.col("seq") % 2)
    found, late = run_parts(spark, tmp_path, changes, part, 4, lambda s: states.page_state_stream(s, "30 minutes"))
    assert sorted((r["seq"], r["status"], r["accepted"]) for r in found) == [
        (1, "OCR_DONE", True), (2, "OCR_DONE", False), (3, "OCR_DONE", False), (4, "TRANSLATED", True), (5, "TRANSLATED", False),
        (6, "OCR_DONE", True), (7, "OCR_DONE", False), (8, "TRANSLATED", True), (9, "AUDIO_DONE", True), (10, "INDEXED", True),
        (11, "INDEXED", False)]
    assert late == 1


def test_idle_pages_leave_the_state(spark, tmp_path):
    rows = [(7, 1, 1, "ocr", "h"), (-1, -1, 500, "heartbeat", None), (7, 1, 501, "translated", "h"), (-1, -1, 1000, "heartbeat", None)]
    changes = timed(spark.createDataFrame(rows, "document_id bigint, page_no int, seq bigint, kind string, text_hash string"))
    found, _ = run_parts(spark, tmp_path, changes, F.when(F.col("seq") < 2, 0).when(F.col("seq") < 501, 1).when(F.col("seq") < 502, 2).otherwise(3), 4,
                         lambda s: states.page_state_stream(s, "10 minutes", datetime.timedelta(hours=2)))
    # The page was forgotten, so its translation has no text to belong to.
    assert sorted((r["seq"], r["status"], r["accepted"]) for r in found) == [(1, "OCR_DONE", True), (501, "PENDING", False)]


def test_progress_snapshots(spark, tmp_path):
    rows = [(1, 1, "OCR_DONE", None, "change"), (2, 2, "OCR_DONE", None, "change"), (3, 1, "INDEXED", None, "change"), (4, None, None, "PARTIAL", "change"),
            (5, 2, "OCR_DONE", None, "change")]
    changes = timed(spark.createDataFrame([(7, *r) for r in rows] + [(-1, 100, None, None, None, "heartbeat")],
                                          "document_id bigint, seq bigint, page_no int, page_status string, document_status string, kind string"))
    part = F.when(F.col("seq") > 99, 2).otherwise(F.col("seq") % 2)
    found, _ = run_parts(spark, tmp_path, changes, part, 3, lambda s: states.progress_stream(s, "30 minutes"))
    assert sorted((r["seq"], r["status"], r["pages"], r["closed"]) for r in found) == [
        (1, "PROCESSING", "1:OCR_DONE", False), (2, "PROCESSING", "1:OCR_DONE,2:OCR_DONE", False),
        (3, "PROCESSING", "1:INDEXED,2:OCR_DONE", False), (4, "PARTIAL", "1:INDEXED,2:OCR_DONE", True), (5, "PROCESSING", "2:OCR_DONE", False)]


def test_relay_repeats_nothing(spark, tmp_path):
    changes = spark.range(30).selectExpr("concat('t', id % 2) AS topic", "CAST(id AS STRING) AS payload")
    for part in range(2):
        feed(changes.filter(F.col("payload").cast("int") % 2 == part), tmp_path / "in", part)
        source = change_stream(spark, f"{tmp_path}/in/*", changes.schema, 1)
        relay(source, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = sorted((r["topic"], r["payload"]) for r in spark.read.parquet(f"{tmp_path}/out").select("topic", "payload").collect())
    assert got == sorted((r["topic"], r["payload"]) for r in changes.collect())


def test_live_quantiles_of_few_rows_are_observed_values(spark, tmp_path):
    calls = spark.range(20).selectExpr(
        "'tts' AS endpoint", "CAST((id + 1) * 10 AS INT) AS latency_ms",
        "TIMESTAMP '2024-01-01 00:00:00' + (id % 10) * INTERVAL '10' SECOND + CAST(floor(id / 10) AS INT) * INTERVAL '5' MINUTE AS created_at")
    for part in range(2):
        feed(calls.filter(F.col("latency_ms") / 10 % 2 == part), tmp_path / "in", part)
        sinks.start_upserts(metrics.latency_quantiles_windowed(stream(spark, tmp_path / "in", calls.schema), watermark="1 hour"),
                            f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = sinks.read_latest(spark, f"{tmp_path}/out", ["window_start", "endpoint"]).orderBy("window_start").collect()
    # Windows hold 10..100 and 110..200.
    assert [(r["p50_ms"], r["p95_ms"]) for r in got] == [(50, 100), (150, 200)]


def state_rows(query):
    return max(op["numRowsTotal"] for progress in query.recentProgress for op in progress["stateOperators"])


def test_addresses_of_a_period_share_states(spark, tmp_path):
    requests = spark.range(600).selectExpr("id AS request_id", "CASE WHEN id % 300 > 0 THEN concat('ip', id % 300) END AS ip", "'/api/x' AS path",
                                           "TIMESTAMP '2024-01-01 00:00:00' AS ts")
    feed(requests, tmp_path / "in", 0)
    query = sinks.start_appends(budget.limit_requests_stream(stream(spark, tmp_path / "in", requests.schema), 1), f"{tmp_path}/out", f"{tmp_path}/cp", idle_batches=False)
    query.awaitTermination()
    found = {r["request_id"]: r["outcome"] for r in sinks.read_appended(spark, f"{tmp_path}/out").collect()}
    assert found == {i: "allowed" if i < 300 else "rejected" for i in range(600)}
    assert 0 < state_rows(query) <= 100


def test_pages_of_a_bucket_share_states(spark, tmp_path):
    rows = [(i, i % 2, i, "ocr", "h") for i in range(300)] + [(None, 1, 300, "ocr", "h")]
    changes = spark.createDataFrame([*rows, (-1, -1, 600, "heartbeat", None)],
                                    "document_id bigint, page_no int, seq bigint, kind string, text_hash string")
    feed(timed(changes), tmp_path / "in", 0)
    source = stream(spark, tmp_path / "in", timed(changes).schema)
    query = sinks.start_appends(states.page_state_stream(source, "30 minutes", buckets=8), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    found = sinks.read_appended(spark, f"{tmp_path}/out").collect()
    assert sorted(r["seq"] for r in found) == list(range(301)) and {(r["status"], r["accepted"]) for r in found} == {("OCR_DONE", True)}
    assert 0 < state_rows(query) <= 100
