"""Word budgets, request limits, retry routing and endpoint health."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions.calls import BUDGET_ZONE, budget_reset_at
from lettermill.operators.ordering import flag_first, with_position

# Words per owner and day, requests per address and minute, retry delays.
DAILY_WORDS = 7000
REQUESTS_PER_PERIOD = 60
RETRY_DELAYS_S = (5, 30)

# Which paths are limited, and which of those are exempt.
LIMITED_PATHS = "^/(api|oauth2|login)(/.*)?$"
EXEMPT_PATHS = "^(/api/documents/[^/]+/events|/actuator(/.*)?)$"

# The health window.
HEALTH_WINDOW = 10
HEALTH_MIN_CALLS = 5
HEALTH_THRESHOLD = 0.5


def _grant_in_order(keys: Sequence[str]):
    def grant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, left = None, 0
        for batch in batches:
            granted = []
            columns = [batch.column(name).to_pylist() for name in (*keys, "words", "_available")]
            for *key, words, available in zip(*columns):
                if key != current:
                    current, left = key, available
                fits = words <= left
                left -= words if fits else 0
                granted.append(fits)
            yield batch.append_column("granted", pa.array(granted, pa.bool_()))

    return grant


def claim_budget(claims: DataFrame, used: DataFrame | None = None, cap: int = DAILY_WORDS,
                 keys: Sequence[str] = ("owner_id", "day"), order: Sequence[str] = ("claim_id",)) -> DataFrame:
    """Grant or refuse word claims in ``order`` (unique within a key) against a cap per key.

    A claim of no words is free. A refused claim takes nothing, so a smaller one after it may
    still pass; the outcome is a fold and not a running sum. ``used`` holds the words already
    taken per key. Returns keys, order, ``words`` and ``granted``.

    What is left only shrinks, so among claims of equal size the granted ones come first and
    number at most available / size. Ranking within (key, size) therefore refuses all later
    ones outright, and at most about cap * ln(cap) claims of a key reach its fold, whatever
    the size of the key. A key whose candidates all fit needs no fold either.
    """
    keys, order = list(keys), list(order)
    base = claims.select(*keys, *order, F.col("words").cast("int").alias("words"))
    if used is not None:
        base = base.join(used.select(*keys, "used"), keys, "left")
        left = F.greatest(F.lit(cap) - F.coalesce("used", F.lit(0)), F.lit(0))
    else:
        left = F.lit(cap)
    base = base.withColumn("_available", left.cast("bigint")).select(*keys, *order, "words", "_available")
    fitting = F.when(F.col("words") > 0, F.floor(F.col("_available") / F.col("words"))).otherwise(F.lit(0))
    ranked = flag_first(base, [*keys, "words"], order, fitting, "_candidate")

    settled = ranked.filter(~F.col("_candidate")).withColumn("granted", F.col("words") <= 0)
    open_claims = ranked.filter("_candidate")
    wanted = F.sum("words").over(Window.partitionBy(*keys))
    open_claims = open_claims.withColumn("_fits", wanted <= F.col("_available"))
    easy = open_claims.filter("_fits").withColumn("granted", F.lit(True))
    contested = open_claims.filter("not _fits").select(*keys, *order, "words", "_available")
    contested = contested.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = contested.withColumn("granted", F.lit(True)).schema
    folded = contested.mapInArrow(_grant_in_order(keys), schema)

    out = [*keys, *order, "words", "granted"]
    return settled.select(out).unionByName(easy.select(out)).unionByName(folded.select(out))


def budget_used(claims: DataFrame, keys: Sequence[str] = ("owner_id", "day")) -> DataFrame:
    """Words taken per key by decided claims."""
    taken = F.sum(F.when(F.col("granted"), F.greatest("words", F.lit(0))).otherwise(0))
    return claims.groupBy(*keys).agg(taken.cast("bigint").alias("used"))


def remaining_budget(owners: DataFrame, usage: DataFrame, cap: int = DAILY_WORDS,
                     keys: Sequence[str] = ("owner_id",)) -> DataFrame:
    """Words used and left for each owner, also for owners without usage."""
    used = F.coalesce(F.col("used"), F.lit(0)).cast("bigint")
    return owners.select(*keys).distinct().join(usage, list(keys), "left").select(
        *keys, used.alias("used"), F.greatest(F.lit(cap) - used, F.lit(0)).cast("bigint").alias("remaining"),
        F.lit(cap).cast("bigint").alias("daily_limit"))


def with_reset_at(df: DataFrame, ts: str, zone: str = BUDGET_ZONE) -> DataFrame:
    return df.withColumn("reset_at", budget_reset_at(ts, zone))


def limited_path(path: str = "path"):
    return F.col(path).rlike(LIMITED_PATHS) & ~F.col(path).rlike(EXEMPT_PATHS)


def limit_requests(requests: DataFrame, limit: int = REQUESTS_PER_PERIOD, per: str = "1 minute") -> DataFrame:
    """Decide each limited request: the first ``limit`` per address and period are allowed.

    Periods are aligned to the clock and not to an address's first request. A limit
    of 0 or less switches the limiter off.
    """
    timed = requests.filter(limited_path()).withColumn(
        "period_start", F.window(F.col("ts").cast("timestamp"), per).start)
    if limit <= 0:
        return timed.withColumn("outcome", F.lit("allowed"))
    flagged = flag_first(timed, ["ip", "period_start"], ["ts", "request_id"], limit, "_allowed")
    return flagged.withColumn("outcome", F.when(F.col("_allowed"), "allowed").otherwise("rejected")).drop("_allowed")


def route_failures(failures: DataFrame, delays: Sequence[int] = RETRY_DELAYS_S) -> DataFrame:
    """Retry tier, next attempt or dead letter for each failed message."""
    tiers = F.array(*(F.lit(d) for d in delays))
    retry = F.col("attempt") < len(delays)
    delay = F.when(F.col("is_pause"), F.lit(delays[0])).when(retry, F.try_element_at(tiers, F.col("attempt") + 1))
    route = F.when(F.col("is_pause"), "pause").when(retry, "retry").otherwise("dead_letter")
    following = F.when(F.col("is_pause"), F.col("attempt")).when(retry, F.col("attempt") + 1)
    return failures.withColumns({
        "route": route,
        "delay_s": delay,
        "next_attempt": following,
        "target_queue": F.when(delay.isNotNull(), F.format_string("%s.retry.%ds", "queue", delay))
        .otherwise(F.concat("queue", F.lit(".dlq"))),
    })


def endpoint_health(calls: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Failure rate over each endpoint's last ten calls, known from the fifth call on.

    5xx and no response are failures; 429 and other 4xx count as answers; attempts that were
    stopped before the provider must not be in the input.

    There are only a few endpoints, so their calls are numbered in balanced blocks and cut
    into chunks. The last nine calls of a chunk are repeated at the head of the next one,
    which makes every window local to its chunk.
    """
    status = F.col("http_status")
    failed = ((status == 0) | (status >= 500)).cast("double")
    narrow = calls.select("endpoint", "created_at", "call_id", failed.alias("failed"))
    placed = with_position(narrow, ["endpoint"], ["created_at", "call_id"], "position")
    place = F.col("position") - 1
    own = F.floor(place / chunk)
    tail = (place % chunk) >= chunk - (HEALTH_WINDOW - 1)
    copies = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("_own", own).withColumn("_chunk", F.explode(copies))
    last = Window.partitionBy("endpoint", "_chunk").orderBy("position").rowsBetween(-(HEALTH_WINDOW - 1), 0)
    rated = spread.withColumns({"_rate": F.avg("failed").over(last), "_seen": F.count(F.lit(1)).over(last)})
    known = F.col("_seen") >= HEALTH_MIN_CALLS
    return rated.filter(F.col("_own") == F.col("_chunk")).select(
        "call_id", "endpoint", F.when(known, F.round("_rate", 4)).alias("failure_rate"),
        (known & (F.col("_rate") >= HEALTH_THRESHOLD)).alias("unhealthy"))
