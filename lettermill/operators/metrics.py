"""Operations metrics. The windowed ones take batch and streaming input alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions.calls import call_cost, classify_outcome
from lettermill.operators.ordering import nearest_rank, percentiles, ranked_percentiles, with_position

COST = "decimal(20,4)"
#: A sketch of this size is off by 0.7 % of all ranks in one of a hundred cases, and practically never by 2 %.
SKETCH_SIZE, RANK_ERROR = 400, 0.02


def _event_time(df: DataFrame, column: str, watermark: str | None) -> DataFrame:
    # A watermark needs an instant; parquet without a zone reads as timestamp_ntz.
    df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df.withWatermark(column, watermark) if watermark else df


def calls_per_minute(calls: DataFrame, watermark: str | None = None) -> DataFrame:
    """Calls per endpoint and outcome in one-minute windows."""
    calls = _event_time(calls, "created_at", watermark)
    grouped = calls.groupBy(
        F.window("created_at", "1 minute").alias("w"), "endpoint",
        classify_outcome("http_status").alias("outcome")).agg(F.count(F.lit(1)).alias("calls"))
    return grouped.select(F.col("w.start").alias("window_start"), "endpoint", "outcome", "calls")


def latency_quantiles(calls: DataFrame) -> DataFrame:
    """Exact p50 and p95 latency per endpoint."""
    out = percentiles(calls, ["endpoint"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    return out.select("endpoint", F.round("p50_ms", 4).alias("p50_ms"), F.round("p95_ms", 4).alias("p95_ms"))


def latency_quantiles_windowed(calls: DataFrame, width: str = "5 minutes", accuracy: int = 10000,
                               watermark: str | None = None) -> DataFrame:
    """Approximate p50 and p95 per endpoint and window, of bounded size for live use."""
    calls = _event_time(calls, "created_at", watermark)
    grouped = calls.groupBy(F.window("created_at", width).alias("w"), "endpoint").agg(
        F.percentile_approx("latency_ms", [0.5, 0.95], accuracy).alias("q"))
    return grouped.select(F.col("w.start").alias("window_start"), "endpoint",
                          F.col("q")[0].alias("p50_ms"), F.col("q")[1].alias("p95_ms"))


def latency_sketches(calls: DataFrame, width: str = "5 minutes", k: int = SKETCH_SIZE, watermark: str | None = None) -> DataFrame:
    """One mergeable quantile sketch of the latencies per endpoint and window, for batch and live input.

    A sketch keeps a few times ``k`` values however many calls there were; calls without a latency are left out.
    """
    timed = _event_time(calls, "created_at", watermark).filter(F.col("latency_ms").isNotNull())
    grouped = timed.groupBy(F.window("created_at", width).alias("w"), "endpoint").agg(
        F.kll_sketch_agg_bigint(F.col("latency_ms").cast("bigint"), k).alias("sketch"))
    return grouped.select(F.col("w.start").alias("window_start"), "endpoint", "sketch")


def quantiles_of_sketches(sketches: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """p50 and p95 per endpoint and wider window, from merged sketches of the windows inside.

    The rank of each differs from the wanted one by under :data:`RANK_ERROR`. Calls aren't read again,
    so any wider window, also one that slides, costs one row per narrow window.
    """
    wide = F.window("window_start", width, slide) if slide else F.window("window_start", width)
    merged = sketches.groupBy(wide.alias("w"), "endpoint").agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))
    at = lambda p: F.kll_sketch_get_quantile_bigint("sketch", F.lit(p))
    return merged.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "endpoint",
                         F.kll_sketch_get_n_bigint("sketch").alias("calls"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"))


def spend_cumulative(calls: DataFrame, step: str = "minute") -> DataFrame:
    """Running cost per endpoint at the end of each step that had calls.

    The ledger is summed per step first: the running total then walks one row per step and
    endpoint, however many calls there were.
    """
    spent = calls.groupBy("endpoint", F.date_trunc(step, "created_at").alias("step_start")).agg(
        F.sum(call_cost("endpoint", "units", "http_status")).cast(COST).alias("cost"))
    running = Window.partitionBy("endpoint").orderBy("step_start").rowsBetween(Window.unboundedPreceding, 0)
    return spent.withColumn("cumulative_cost", F.sum("cost").over(running).cast(COST))


def spend_per_hour(calls: DataFrame, watermark: str | None = None) -> DataFrame:
    """Cost per endpoint over the last hour, every five minutes.

    Five-minute sums first, then each counts into its twelve hours, so that the twelvefold
    expansion of a sliding window applies to sums and not to calls. A stream needs one
    aggregation per query, so it uses the sliding window as it is.
    """
    calls = _event_time(calls, "created_at", watermark)
    cost = call_cost("endpoint", "units", "http_status")
    if not calls.isStreaming:
        calls = calls.groupBy(F.window("created_at", "5 minutes").start.alias("created_at"), "endpoint").agg(
            F.sum(cost).alias("cost"))
        cost = F.col("cost")
    grouped = calls.groupBy(F.window("created_at", "1 hour", "5 minutes").alias("w"), "endpoint").agg(
        F.sum(cost).cast(COST).alias("cost"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "endpoint", "cost")


def units_per_minute(calls: DataFrame, watermark: str | None = None) -> DataFrame:
    """Units per minute by type, averaged over the last five minutes, every minute."""
    calls = _event_time(calls, "created_at", watermark)
    units = F.col("units").cast("bigint")
    if not calls.isStreaming:
        calls = calls.groupBy(F.window("created_at", "1 minute").start.alias("created_at"), "unit_type").agg(
            F.sum(units).alias("units"))
        units = F.col("units")
    grouped = calls.groupBy(F.window("created_at", "5 minutes", "1 minute").alias("w"), "unit_type").agg(
        (F.sum(units).cast("double") / 5).alias("units_per_minute"))
    return grouped.select(F.col("w.start").alias("window_start"), "unit_type", "units_per_minute")


def endpoint_latency_p95(calls: DataFrame, endpoint: str) -> DataFrame:
    """p95 latency of one endpoint."""
    one = percentiles(calls.filter(F.col("endpoint") == endpoint), ["endpoint"], "latency_ms", {"p95_ms": 0.95})
    return one.select("endpoint", F.round("p95_ms", 4).alias("p95_ms"))


def outbox_backlog(outbox: DataFrame) -> DataFrame:
    """Messages not yet published, per topic."""
    return outbox.groupBy("topic").agg(F.count_if(F.col("published_at").isNull()).alias("backlog"))


def outbox_backlog_as_of(outbox: DataFrame, at) -> DataFrame:
    """Messages created but not published at an instant."""
    waiting = (F.col("created_at") <= at) & (F.col("published_at").isNull() | (F.col("published_at") > at))
    return outbox.groupBy("topic").agg(F.count_if(waiting).alias("backlog"))


def outbox_backlog_over_time(outbox: DataFrame, step: str = "minute") -> DataFrame:
    """Backlog per topic at the end of each step in which it changed."""
    moves = F.array(
        F.struct(F.date_trunc(step, "created_at").alias("step_start"), F.lit(1).alias("move")),
        F.struct(F.date_trunc(step, "published_at").alias("step_start"), F.lit(-1).alias("move")))
    steps = outbox.select("topic", F.inline(moves)).filter(F.col("step_start").isNotNull()).groupBy(
        "topic", "step_start").agg(F.sum("move").alias("move"))
    running = Window.partitionBy("topic").orderBy("step_start").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("topic", "step_start", F.sum("move").over(running).cast("bigint").alias("backlog"))


def next_to_publish(outbox: DataFrame, limit: int = 50) -> DataFrame:
    """The oldest messages that wait; a top-n, not a full sort."""
    return outbox.filter(F.col("published_at").isNull()).orderBy("created_at", "id").limit(limit)


def purge_published(outbox: DataFrame, now, days: int = 7) -> DataFrame:
    """What remains after dropping messages published more than ``days`` ago."""
    cutoff = now - F.make_dt_interval(F.lit(days))
    return outbox.filter(F.col("published_at").isNull() | (F.col("published_at") >= cutoff))


def limited_requests_per_minute(decided: DataFrame) -> DataFrame:
    """Requests allowed and rejected per minute; input from ``limit_requests``."""
    grouped = decided.groupBy(F.window(F.col("ts").cast("timestamp"), "1 minute").alias("w"), "outcome").agg(
        F.count(F.lit(1)).alias("requests"))
    return grouped.select(F.col("w.start").alias("window_start"), "outcome", "requests")


def document_durations(docs: DataFrame) -> DataFrame:
    """p50, p95 and longest time from creation to completion, in seconds, per final status."""
    timed = durations(docs)
    out = ranked_percentiles(timed, ["status"], "duration_ms", {"p50": 0.5, "p95": 0.95, "longest": 1.0}, "documents")
    return out.select("status", "documents", *(F.round(F.col(c) / 1000, 4).alias(f"{c}_s")
                                               for c in ("p50", "p95", "longest")))


def durations(docs: DataFrame) -> DataFrame:
    done = docs.filter(F.col("completed_at").isNotNull())
    return done.withColumn("duration_ms", F.expr("timestampdiff(MILLISECOND, created_at, completed_at)"))


def duration_nearest_rank(docs: DataFrame, probabilities: dict[str, float] | None = None,
                          keys: tuple[str, ...] = ("status",)) -> DataFrame:
    """Nearest-rank percentiles of completion time in milliseconds."""
    return nearest_rank(durations(docs), list(keys), "duration_ms", probabilities or {"p50": 0.5, "p95": 0.95})


def fifo_inversions(docs: DataFrame) -> DataFrame:
    """Arrival and completion order of completed documents, and how far each moved."""
    done = docs.filter(F.col("completed_at").isNotNull()).select("document_id", "created_at", "completed_at")
    arrived = with_position(done, [], ["created_at", "document_id"], "arrival")
    finished = with_position(arrived, [], ["completed_at", "document_id"], "completion")
    return finished.select("document_id", F.col("arrival").cast("bigint"), F.col("completion").cast("bigint"),
                           (F.col("completion") - F.col("arrival")).cast("bigint").alias("moved"))


def cap_words(claims: DataFrame) -> DataFrame:
    """Words allowed and rejected; input from ``claim_budget``."""
    outcome = F.when(F.col("granted"), "allowed").otherwise("rejected")
    return claims.groupBy(outcome.alias("outcome")).agg(
        F.sum(F.greatest("words", F.lit(0))).cast("bigint").alias("words"), F.count(F.lit(1)).alias("claims"))
