"""Word budgets and request limits on live input: one small value of keyed state per owner and day, or bucket of addresses and period.

A micro-batch's rows of a key come in pieces. Of what a piece adds, only rows that can still
be granted are held, so a busy key needs no more memory than its cap allows.
State goes once nothing has arrived for a key for so long that none can any more.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lettermill.operators.limits import DAILY_WORDS, REQUESTS_PER_PERIOD, limited_path
from lettermill.streaming.sinks import use_keyed_state

#: States that the addresses of a period are dealt out to; the number can't change within a checkpoint.
ADDRESS_BUCKETS = 16
#: A day's claims end with the day; two days cover every zone. A period's requests end with it.
BUDGET_KEPT, REQUESTS_KEPT = datetime.timedelta(days=2), datetime.timedelta(hours=2)


class Counted(StatefulProcessor):
    """Keeps one number per key, with a time to live."""

    def __init__(self, keys: Sequence[str], kept: datetime.timedelta) -> None:
        self.keys, self.kept_ms = list(keys), int(kept.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n bigint", self.kept_ms)

    def so_far(self) -> int:
        return int(self.count.get()[0]) if self.count.exists() else 0

    def keyed(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        for name, value in zip(self.keys, key, strict=True):
            rows[name] = value
        return rows

    def close(self) -> None:
        pass


class Budget(Counted):
    """Grants claims in order of ``order`` within a micro-batch, as long as they fit."""

    def __init__(self, keys: Sequence[str], order: str, cap: int, kept: datetime.timedelta) -> None:
        super().__init__(keys, kept)
        self.order, self.cap = order, cap

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used = self.so_far()
        left, held = max(self.cap - used, 0), None
        for frame in rows:
            piece = frame[[self.order, "words"]]
            free = piece["words"] <= 0
            piece = pd.concat([held, piece[~free]] if held is not None else [piece[~free]]).sort_values(["words", self.order], kind="stable")
            # Of claims of one size the granted ones come first and are at most left / size.
            rank = piece.groupby("words").cumcount().to_numpy()
            can = rank < left // np.maximum(piece["words"].to_numpy(), 1)
            held = piece[can]
            settled = pd.concat([frame.loc[free, [self.order, "words"]].assign(granted=True), piece[~can].assign(granted=False)])
            if len(settled):
                yield self.keyed(key, settled)
        held = held.sort_values(self.order)
        granted = []
        for words in held["words"].tolist():
            fits = words <= left
            left -= words if fits else 0
            granted.append(fits)
        taken = int(held["words"][np.array(granted, bool)].sum())
        if taken:
            self.count.update((used + taken,))
        if granted:
            yield self.keyed(key, held.assign(granted=granted))


class Permits(StatefulProcessor):
    """Allows the first requests of each address of a period, in order of time and id within a micro-batch.

    A group is a bucket of addresses in one period; its state counts what each was allowed.
    """

    def __init__(self, limit: int, kept: datetime.timedelta) -> None:
        self.limit, self.kept_ms = limit, int(kept.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.allowed = handle.getValueState("allowed", "ip array<string>, n array<int>", self.kept_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = dict(zip(*self.allowed.get(), strict=True)) if self.allowed.exists() else {}
        held = None
        for frame in rows:
            piece = frame[["ip", "request_id", "ts"]]
            piece = (piece if held is None else pd.concat([held, piece])).sort_values(["ts", "request_id"])
            codes, ips = pd.factorize(piece["ip"], use_na_sentinel=False)
            left = self.limit - np.array([seen.get(None if pd.isna(ip) else ip, 0) for ip in ips])
            fits = piece.groupby(codes).cumcount().to_numpy() < left[codes]
            held = piece[fits]
            if not fits.all():
                yield piece[~fits].assign(period_start=key[0], outcome="rejected")
        if len(held):
            for ip, n in held["ip"].value_counts(dropna=False).items():
                ip = None if pd.isna(ip) else ip
                seen[ip] = seen.get(ip, 0) + int(n)
            self.allowed.update((list(seen), list(seen.values())))
            yield held.assign(period_start=key[0], outcome="allowed")

    def close(self) -> None:
        pass


def claim_budget_stream(claims: DataFrame, cap: int = DAILY_WORDS, keys: Sequence[str] = ("owner_id", "day"), order: str = "claim_id",
                        kept: datetime.timedelta = BUDGET_KEPT) -> DataFrame:
    """Grant claims as they arrive; what was granted before is never granted again."""
    use_keyed_state(claims.sparkSession)
    rows = claims.select(*keys, order, F.col("words").cast("int").alias("words"))
    schema = rows.withColumn("granted", F.lit(True)).schema
    return rows.groupBy(*keys).transformWithStateInPandas(Budget(keys, order, cap, kept), schema, "Append", "ProcessingTime")


def limit_requests_stream(requests: DataFrame, limit: int = REQUESTS_PER_PERIOD, per: str = "1 minute",
                          kept: datetime.timedelta = REQUESTS_KEPT, buckets: int = ADDRESS_BUCKETS) -> DataFrame:
    """Allow the first ``limit`` requests per address and period over all micro-batches; 0 or less allows all.

    ``kept`` must be longer than a period and the delay of its requests. The addresses of a period share
    ``buckets`` states, so Python is entered once per bucket and not once per address.
    """
    timed = requests.filter(limited_path()).withColumn(
        "period_start", F.window(F.col("ts").cast("timestamp"), per).start).select("ip", "period_start", "request_id", F.col("ts").cast("timestamp").alias("ts"))
    if limit <= 0:
        return timed.withColumn("outcome", F.lit("allowed"))
    use_keyed_state(requests.sparkSession)
    schema = timed.withColumn("outcome", F.lit("")).schema
    bucketed = timed.withColumn("_bucket", F.pmod(F.xxhash64("ip"), F.lit(buckets)).cast("int"))
    return bucketed.groupBy("period_start", "_bucket").transformWithStateInPandas(Permits(limit, kept), schema, "Append", "ProcessingTime")
