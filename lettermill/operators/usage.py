"""The ledger of paid calls: prices, outcomes and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.functions.calls import (
    RATES, USAGE_ZONE, call_cost, call_price, classify_outcome, local_day,
)
from lettermill.operators.ordering import percentiles

COST = "decimal(20,4)"

# Reasons why an attempt never reached the provider.
UNBILLED = ("limiter", "breaker", "busy")


def price_calls(calls: DataFrame, rates=RATES) -> DataFrame:
    """Add ``est_cost``."""
    return calls.withColumn("est_cost", call_cost("endpoint", "units", "http_status", rates))


def classify_calls(calls: DataFrame) -> DataFrame:
    return calls.withColumn("outcome", classify_outcome("http_status"))


def billable_attempts(attempts: DataFrame, rejected_by: str = "rejected_by") -> DataFrame:
    """Attempts that reached the provider become ledger rows; no response counts as status 0."""
    kept = attempts.filter(F.col(rejected_by).isNull() | ~F.col(rejected_by).isin(*UNBILLED))
    return kept.withColumn("http_status", F.coalesce("http_status", F.lit(0))).drop(rejected_by)


def usage_by_endpoint(calls: DataFrame, document_id=None) -> DataFrame:
    """Calls, units, cost and exact p50 / p95 latency per document and endpoint."""
    if document_id is not None:
        calls = calls.filter(F.col("document_id") == document_id)
    summary = percentiles(
        price_calls(calls), ["document_id", "endpoint"], "latency_ms",
        {"p50_ms": 0.5, "p95_ms": 0.95},
        {"units": F.col("units"), "cost": F.col("est_cost")}, count="calls")
    return summary.withColumns({
        "units": F.col("units").cast("bigint"), "cost": F.col("cost").cast(COST),
        "p50_ms": F.round("p50_ms", 4), "p95_ms": F.round("p95_ms", 4)})


def document_cost(docs: DataFrame, calls: DataFrame) -> DataFrame:
    """Total per document over all endpoints, zero without calls."""
    spent = price_calls(calls).groupBy("document_id").agg(F.sum("est_cost").alias("total_cost"))
    zero = F.lit(0).cast(COST)
    return docs.select("document_id").join(spent, "document_id", "left").select(
        "document_id", F.coalesce(F.col("total_cost").cast(COST), zero).alias("total_cost"))


def usage_by_owner_day(calls: DataFrame, docs: DataFrame, start, end, owner: str | None = None,
                       zone: str = USAGE_ZONE, ordered: bool = True) -> DataFrame:
    """Calls, cost and p95 per owner, day and document within ``[start, end)``.

    The ledger is summarised before it meets the documents, so a busy document is a few
    rows by then. For one owner the ledger is cut to that owner's documents first.
    """
    calls = calls.filter((F.col("created_at") >= start) & (F.col("created_at") < end))
    docs = docs.select("document_id", "owner_id", "title")
    if owner is not None:
        docs = docs.filter(F.col("owner_id") == owner)
        calls = calls.join(docs.select("document_id"), "document_id", "left_semi")
    priced = price_calls(calls).withColumn("day", local_day("created_at", zone))
    summary = percentiles(priced, ["document_id", "day"], "latency_ms", {"p95_ms": 0.95},
                          {"cost": F.col("est_cost")}, count="calls")
    rows = summary.join(docs, "document_id").select(
        "owner_id", "day", "document_id", "title", "calls", F.col("cost").cast(COST).alias("cost"),
        F.round("p95_ms", 4).alias("p95_ms"))
    return rows.orderBy(F.desc("day"), F.desc("cost"), "document_id") if ordered else rows


def estimate_cost(planned: DataFrame, by: list[str], rates=RATES) -> DataFrame:
    """Cost of planned work (``endpoint``, ``units``) if every call succeeds."""
    return planned.groupBy(*by, "endpoint").agg(
        F.sum("units").cast("bigint").alias("units"),
        F.sum(call_price("endpoint", "units", rates)).cast(COST).alias("cost"))


def units_by_type(calls: DataFrame) -> DataFrame:
    return calls.groupBy("unit_type").agg(F.sum("units").cast("bigint").alias("units"))


def calls_priced(calls: DataFrame) -> DataFrame:
    """Ledger rows as recorded: outcome and cost beside the call."""
    return classify_calls(price_calls(calls))
