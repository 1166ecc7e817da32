"""Change rows: written beside the state they follow from, read back as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def enqueue(df: DataFrame, topic: str, *pointer: str) -> DataFrame:
    """One message per row: topic and a JSON object of the pointer columns."""
    payload = F.to_json(F.struct(*(F.col(c) for c in pointer)))
    return df.select(F.lit(topic).alias("topic"), payload.alias("payload"))


def change_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Change rows appended as parquet files under ``path``."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def relay(stream: DataFrame, path: str, checkpoint: str, by: str = "topic", order: str | None = None):
    """Append the stream to one folder per topic, in ``order`` within the files of a micro-batch.

    A replayed micro-batch overwrites the folder of its own id, so each change arrives once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if order:
            # A busy topic is split into ranges, each of which makes one file.
            batch = batch.repartitionByRange(by, order).sortWithinPartitions(by, order)
        batch.write.mode("overwrite").partitionBy(by).parquet(f"{path}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
