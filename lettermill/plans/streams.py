"""Registered streams. Each consumes a whole table with ``availableNow`` and is compared with its batch form."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from lettermill.functions.text import word_count
from lettermill.operators import metrics
from lettermill.plans import limits as limit_queries
from lettermill.plans import metrics as metric_queries
from lettermill.session import scratch_dir
from lettermill.sources.adapters import adapter, base_table
from lettermill.sources.changes import change_stream, relay
from lettermill.streaming import budget, sinks, states

QUERIES, ORACLES = {}, {}


def stream_of(spark, sf_dir, table):
    """The table as a stream; a file source needs its schema up front."""
    schema = base_table(spark, sf_dir, table).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def live(spark, sf_dir, view, table):
    return adapter(spark, sf_dir, view, source=stream_of(spark, sf_dir, table))


def folders(spark):
    root = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{root}/out", f"{root}/checkpoint"


def upserted(spark, stream, keys):
    out, checkpoint = folders(spark)
    sinks.start_upserts(stream, out, checkpoint).awaitTermination()
    return sinks.read_latest(spark, out, keys)


LATE = "1 hour"
QUERIES["m1_calls_per_minute_stream"] = lambda s, d: upserted(
    s, metrics.calls_per_minute(live(s, d, "api_call", "events"), LATE), ["window_start", "endpoint", "outcome"])
ORACLES["m1_calls_per_minute_stream"] = metric_queries.ORACLES["m1_calls_per_minute"]
QUERIES["m2_latency_quantiles_stream"] = lambda s, d: upserted(
    s, metrics.latency_quantiles_windowed(live(s, d, "api_call", "events"), watermark=LATE), ["window_start", "endpoint"])
QUERIES["m4_spend_per_hour_stream"] = lambda s, d: upserted(
    s, metrics.spend_per_hour(live(s, d, "api_call", "events"), LATE), ["window_start", "window_end", "endpoint"])
ORACLES["m4_spend_per_hour_stream"] = metric_queries.ORACLES["m4_spend_per_hour"]
QUERIES["m5_units_per_minute_stream"] = lambda s, d: upserted(
    s, metrics.units_per_minute(live(s, d, "api_call", "events"), LATE), ["window_start", "unit_type"])
ORACLES["m5_units_per_minute_stream"] = metric_queries.ORACLES["m5_units_per_minute"]


def in_parts(spark, rows, part, n):
    """Rows written as ``n`` parts, one after the other, and read as a stream in that order, a file a micro-batch."""
    root = f"{scratch_dir(spark)}/parts-{uuid.uuid4().hex}"
    rows = rows.withColumn("_part", part)
    for i in range(n):
        rows.filter(F.col("_part") == i).drop("_part").coalesce(2).write.parquet(f"{root}/{i}")
    return spark.readStream.schema(rows.drop("_part").schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(root)


def fed(spark, rows, part, n, make, idle_batches=False):
    """What ``make(stream)`` appends while ``rows`` arrive in ``n`` parts, each a micro-batch however many files it has.

    A part is added to a folder and the query goes on from its checkpoint. ``idle_batches`` lets the last run
    move on by the watermark alone.
    """
    (out, checkpoint), arrived = folders(spark), f"{scratch_dir(spark)}/parts-{uuid.uuid4().hex}"
    rows = rows.withColumn("_part", part)
    schema = rows.drop("_part").schema
    for i in range(n):
        rows.filter(F.col("_part") == i).drop("_part").write.parquet(f"{arrived}/{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(arrived)
        sinks.start_appends(make(stream), out, checkpoint, idle_batches=idle_batches and i == n - 1).awaitTermination()
    return sinks.read_appended(spark, out)


def third(df, key):
    """Three parts of about equal length in order of a whole key."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = (high - low) // 3 + 1 if low is not None else 1
    return F.floor((F.col(key) - F.lit(low or 0)) / F.lit(width)).cast("int")


def m2_latency_sketches_stream(s, d):
    """Live sketches of five minutes over several micro-batches, merged to hours; whether each quantile's rank is right."""
    calls = adapter(s, d, "api_call").select("endpoint", "created_at", "latency_ms")
    by_time = calls.withColumn("_at", F.unix_timestamp(F.col("created_at").cast("timestamp")))
    live_calls = in_parts(s, by_time, third(by_time, "_at"), 3).drop("_at")
    # The files of a part may be read in either order: lateness covers the whole time.
    low, high = by_time.agg(F.min("_at"), F.max("_at")).first()
    late = f"{(high or 0) - (low or 0) + 3600} seconds"
    narrow = upserted(s, metrics.latency_sketches(live_calls, watermark=late), ["window_start", "endpoint"])
    hours = metrics.quantiles_of_sketches(narrow).withColumnRenamed("calls", "sketched")
    hour = F.window(F.col("created_at").cast("timestamp"), "1 hour")["start"].alias("window_start")
    ranked = calls.filter("latency_ms is not null").select(hour, "endpoint", "latency_ms").join(hours, ["window_start", "endpoint"])
    counts = ranked.groupBy("window_start", "endpoint").agg(
        F.count(F.lit(1)).alias("calls"), F.first("sketched").alias("sketched"),
        *(F.count_if(F.col("latency_ms") < F.col(q)).alias(f"{q}_below") for q in ("p50_ms", "p95_ms")),
        *(F.count_if(F.col("latency_ms") <= F.col(q)).alias(f"{q}_upto") for q in ("p50_ms", "p95_ms")))

    def holds(q, p):
        return (F.col(f"{q}_below") / F.col("calls") <= p + metrics.RANK_ERROR) & (F.col(f"{q}_upto") / F.col("calls") >= p - metrics.RANK_ERROR)

    return counts.select("window_start", "endpoint", "calls", "sketched", holds("p50_ms", 0.5).alias("p50_holds"), holds("p95_ms", 0.95).alias("p95_holds"))


QUERIES["m2_latency_sketches_stream"] = m2_latency_sketches_stream
ORACLES["m2_latency_sketches_stream"] = f"""{metric_queries.CALLS}
SELECT date_trunc('hour', created_at) AS window_start, endpoint, count(*) AS calls, count(*) AS sketched, true AS p50_holds, true AS p95_holds
FROM api_call WHERE latency_ms IS NOT NULL GROUP BY 1, 2"""


def b4_claim_budget_stream(s, d):
    claims = adapter(s, d, "word_claim").withColumn("words", word_count("text")).drop("text")
    return fed(s, claims, third(claims, "claim_id"), 3, lambda live_claims: budget.claim_budget_stream(live_claims, cap=3000))


QUERIES["b4_claim_budget_stream"] = b4_claim_budget_stream
ORACLES["b4_claim_budget_stream"] = limit_queries.ORACLES["b1_claim_budget"]


def b6_limit_requests_stream(s, d):
    # Requests arrive in order of their time, in which the SQL counts them.
    requests = adapter(s, d, "request")
    requests = requests.withColumn("_at", F.unix_timestamp(F.col("ts").cast("timestamp")))
    return fed(s, requests, third(requests, "_at"), 3, lambda live_requests: budget.limit_requests_stream(live_requests, 1, "1 hour")).select(
        "request_id", "ip", "outcome")


QUERIES["b6_limit_requests_stream"] = b6_limit_requests_stream
ORACLES["b6_limit_requests_stream"] = limit_queries.ORACLES["b5_limit_requests"]

DELAY_DAYS = 4


def out_of_order(s, d, columns):
    """Event rows as changes, their parts of eight days and how many; a row may come up to three days late, and a heartbeat ends the stream."""
    events = base_table(s, d, "events")
    changes = events.selectExpr(*(f"{e} AS {c}" for c, e in columns.items()), "CAST(ts AS TIMESTAMP) AS ts")
    low, high = changes.agg(F.min("ts"), F.max("ts")).first()
    if low is None:
        low = high = datetime.datetime(2024, 1, 1)
    end = changes.limit(1).select(*(
        F.lit(states.HEARTBEAT).alias(c) if c == "kind" else F.lit(-1).cast(t).alias(c) if c in ("document_id", "page_no", "seq") else
        F.lit(high + datetime.timedelta(days=2 * DELAY_DAYS)).alias(c) if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in changes.dtypes))
    days = (F.unix_timestamp("ts") - F.unix_timestamp(F.lit(low)) + F.pmod(F.xxhash64("seq"), F.lit(3 * 86400))) / (8 * 86400)
    n = (high - low).days // 8 + 3
    part = F.when(F.col("kind") == states.HEARTBEAT, n - 1).otherwise(F.least(F.floor(days), F.lit(n - 2))).cast("int")
    return changes.unionByName(end), part, n


CHANGE = {
    "document_id": "user_id", "page_no": "CAST(event_id % 2 + 1 AS INT)", "seq": "event_id",
    "kind": "CASE CAST(floor(event_id / 2) AS BIGINT) % 7 WHEN 0 THEN 'ocr' WHEN 1 THEN 'translated' WHEN 2 THEN 'audio' "
            "WHEN 3 THEN 'indexed' WHEN 4 THEN 'edited' WHEN 5 THEN 'failed' ELSE 'translated' END",
    "text_hash": "CASE WHEN event_type = 'view' THEN 'h2' ELSE 'h1' END",
}
CHANGES = ", ".join(f"{e} AS {c}" for c, e in CHANGE.items())
QUERIES["d15_page_state_stream"] = lambda s, d: fed(
    s, *out_of_order(s, d, CHANGE), lambda changes: states.page_state_stream(changes, f"{DELAY_DAYS} days"), idle_batches=True)
ORACLES["d15_page_state_stream"] = f"""
WITH changes AS (SELECT {CHANGES} FROM events),
lists AS (SELECT document_id, page_no, list({{'seq': seq, 'kind': kind, 'h': text_hash}} ORDER BY seq) AS it FROM changes GROUP BY 1, 2),
folded AS (SELECT document_id, page_no, it, list_reduce(
    list_transform(it, lambda e: {{'s': e.kind, 'h': e.h, 'out': []::STRUCT(st VARCHAR, ok BOOLEAN)[]}}), lambda a, x:
    CASE WHEN (x.s = 'ocr' AND a.s = 'PENDING') OR (x.s = 'edited' AND a.s <> 'PENDING')
              THEN {{'s': 'OCR_DONE', 'h': x.h, 'out': list_append(a.out, {{'st': 'OCR_DONE', 'ok': true}})}}
         WHEN x.s = 'translated' AND a.s = 'OCR_DONE' AND a.h = x.h
              THEN {{'s': 'TRANSLATED', 'h': a.h, 'out': list_append(a.out, {{'st': 'TRANSLATED', 'ok': true}})}}
         WHEN x.s = 'audio' AND a.s = 'TRANSLATED'
              THEN {{'s': 'AUDIO_DONE', 'h': a.h, 'out': list_append(a.out, {{'st': 'AUDIO_DONE', 'ok': true}})}}
         WHEN x.s = 'indexed' AND a.s = 'AUDIO_DONE'
              THEN {{'s': 'INDEXED', 'h': a.h, 'out': list_append(a.out, {{'st': 'INDEXED', 'ok': true}})}}
         WHEN x.s = 'failed' AND a.s NOT IN ('INDEXED', 'CAPPED')
              THEN {{'s': 'FAILED', 'h': a.h, 'out': list_append(a.out, {{'st': 'FAILED', 'ok': true}})}}
         ELSE {{'s': a.s, 'h': a.h, 'out': list_append(a.out, {{'st': a.s, 'ok': false}})}} END,
    {{'s': 'PENDING', 'h': '', 'out': []::STRUCT(st VARCHAR, ok BOOLEAN)[]}}).out AS out FROM lists)
SELECT document_id, page_no, e.seq AS seq, e.kind AS kind, o.st AS status, o.ok AS accepted
FROM (SELECT document_id, page_no, unnest(it) AS e, unnest(out) AS o FROM folded)"""

PROGRESS = {
    "document_id": "user_id", "seq": "event_id", "page_no": "CAST(CASE WHEN event_type <> 'purchase' THEN event_id % 3 + 1 END AS INT)",
    "page_status": "CASE event_type WHEN 'view' THEN 'OCR_DONE' WHEN 'click' THEN 'TRANSLATED' WHEN 'signup' THEN 'INDEXED' "
                   "WHEN 'error' THEN 'FAILED' END",
    "document_status": "CASE WHEN event_type = 'purchase' THEN CASE event_id % 2 WHEN 0 THEN 'COMPLETE' ELSE 'PROCESSING' END END",
    "kind": "'change'",
}
QUERIES["d16_progress_stream"] = lambda s, d: fed(
    s, *out_of_order(s, d, PROGRESS), lambda changes: states.progress_stream(changes, f"{DELAY_DAYS} days"), idle_batches=True)
# A terminal status ends a run of snapshots; within a run each page shows its last state.
ORACLES["d16_progress_stream"] = f"""
WITH changes AS (SELECT {", ".join(f"{e} AS {c}" for c, e in PROGRESS.items())} FROM events),
runs AS (SELECT *, count(*) FILTER (document_status = 'COMPLETE') OVER (
  PARTITION BY document_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM changes),
pages AS (SELECT document_id, seq, coalesce(last_value(document_status IGNORE NULLS) OVER w, 'PROCESSING') AS status,
  {", ".join(f"last_value(CASE WHEN page_no = {n} THEN '{n}:' || page_status END IGNORE NULLS) OVER w AS p{n}" for n in (1, 2, 3))}
  FROM runs WINDOW w AS (PARTITION BY document_id, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT document_id, seq, status, concat_ws(',', p1, p2, p3) AS pages, status = 'COMPLETE' AS closed FROM pages"""


def s5_change_stream(s, d):
    """Outbox rows written as change files, relayed into one folder per topic, and read back."""
    out, checkpoint = folders(s)
    changes = adapter(s, d, "outbox").filter("published_at IS NULL").select(
        "topic", "id", F.to_json(F.struct("id")).alias("payload"))
    changes.write.parquet(f"{out}/changes")
    relay(change_stream(s, f"{out}/changes", changes.schema, 1), f"{out}/queues", checkpoint, order="id").awaitTermination()
    return s.read.parquet(f"{out}/queues").select("topic", "id", "payload")


QUERIES["s5_change_stream"] = s5_change_stream
ORACLES["s5_change_stream"] = """
SELECT event_type AS topic, event_id AS id, format('{{"id":{}}}', event_id) AS payload FROM events WHERE event_id % 10 = 0"""
