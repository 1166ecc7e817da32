"""Outcome, price, backoff and clock rules of paid calls."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill.functions.text import as_column

# Estimated unit prices in INR per page or per character.
RATES: Mapping[str, Decimal] = {
    "vision-submit": Decimal("0.50"),
    "translate": Decimal("0.002"),
    "tts": Decimal("0.003"),
}

# Polling backoff in milliseconds.
POLL_FIRST_MS = 5000
POLL_MULTIPLIER = 1.5
POLL_LONGEST_MS = 60000
POLL_JITTER = 0.2
POLL_LIMIT = 30

BUDGET_ZONE = "Asia/Kolkata"
USAGE_ZONE = "UTC"


def is_success(status: Column | str) -> Column:
    return as_column(status).between(200, 299)


def classify_outcome(status: Column | str) -> Column:
    s = as_column(status)
    return (
        F.when(s == 0, "io_error").when(s == 429, "rate_limited").when(is_success(s), "success")
        .when(s.between(400, 499), "client_error").otherwise("server_error")
    )


def call_price(endpoint, units, rates: Mapping[str, Decimal] = RATES, kind: str = "decimal(10,4)") -> Column:
    """Unit price times units. An endpoint without a price fails the job."""
    name = as_column(endpoint)
    rate = F.raise_error(F.concat(F.lit("no price for endpoint "), name)).cast("decimal(10,4)")
    for endpoint_name, price in rates.items():
        rate = F.when(name == endpoint_name, F.lit(price).cast("decimal(10,4)")).otherwise(rate)
    return (rate * as_column(units).cast("decimal(18,0)")).cast(kind)


def call_cost(endpoint, units, status, rates: Mapping[str, Decimal] = RATES) -> Column:
    """Only a successful call costs anything."""
    free = F.lit(Decimal("0")).cast("decimal(10,4)")
    return F.when(is_success(status), call_price(endpoint, units, rates)).otherwise(free)


def backoff_delay_ms(polls, key=None) -> Column:
    """Delay after the n-th poll. With ``key`` it is jittered, the same way on every replay."""
    n = as_column(polls)
    delay = F.least(F.lit(float(POLL_FIRST_MS)) * F.pow(F.lit(POLL_MULTIPLIER), n - 1), F.lit(float(POLL_LONGEST_MS)))
    if key is not None:
        unit = F.pmod(F.xxhash64(as_column(key), n), F.lit(1_000_001)) / F.lit(1_000_000.0)
        delay = delay * (F.lit(1.0) + F.lit(POLL_JITTER) * (F.lit(2.0) * unit - F.lit(1.0)))
    return F.round(delay).cast("bigint")


def local_day(ts, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(as_column(ts), zone))


def budget_reset_at(ts, zone: str = BUDGET_ZONE) -> Column:
    """The next local midnight, as an instant in a UTC session."""
    return F.to_utc_timestamp(F.date_add(local_day(ts, zone), 1).cast("timestamp"), zone)
