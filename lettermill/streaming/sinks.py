"""Where streams put their results, so that a replayed micro-batch changes nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lettermill.session import SETTINGS

STATE_STORE = SETTINGS["spark.sql.streaming.stateStore.providerClass"]
BATCH = "_batch"


def start_upserts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the rows that each micro-batch changed into the folder of that batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return (stream.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def start_appends(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", idle_batches: bool = True) -> StreamingQuery:
    """``idle_batches=False`` runs no micro-batch without rows: state with a time to live would ask for them without end."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    conf, setting = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(setting)
    # A query keeps the settings it is started with.
    conf.set(setting, str(idle_batches).lower())
    try:
        return (stream.writeStream.outputMode(mode).foreachBatch(write)
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        conf.set(setting, before)


def read_latest(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row per key of :func:`start_upserts`."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, BATCH)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("_row"))
    return newest.select(*keys, "_row.*")


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BATCH)


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state with timers needs this store; it spills to disk and writes changes to the query's checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark so far."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0))
               for progress in query.recentProgress for op in progress.get("stateOperators", []))
