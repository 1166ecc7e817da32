"""The archive's seven tables: read with fixed schemas, write partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "document": "document_id string, owner_id string, title string, language string, status string, "
                "tags array<string>, year int, created_at timestamp, completed_at timestamp",
    "page": "document_id string, page_no int, image_key string, status string, original_text string, "
            "translated_text string, text_hash string, edited boolean",
    "ocr_batch": "batch_id string, document_id string, page_range string, job_id string, status string, poll_count int, "
                 "next_poll_at timestamp, attempts int, last_error string, created_at timestamp, updated_at timestamp",
    "stage_task": "idempotency_key string, page_id string, stage string, attempts int, last_error string, status string, "
                  "result string, lease_until timestamp, created_at timestamp, updated_at timestamp",
    "api_call": "call_id string, document_id string, endpoint string, units int, unit_type string, latency_ms int, "
                "http_status int, est_cost decimal(10,4), created_at timestamp",
    "outbox": "id string, topic string, payload string, published_at timestamp, created_at timestamp, attempts int, "
              "last_error string",
    "user_daily_usage": "owner_id string, day date, used bigint, created_at timestamp",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table as parquet under ``folder/name``; columns a file lacks read as null."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, names: Sequence[str] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """Tables by name, each read lazily."""
    return {name: read_table(spark, folder, name) for name in names}


def read_table_jdbc(spark: SparkSession, url: str, name: str, column: str, lower, upper, partitions: int,
                    **options: str) -> DataFrame:
    """A table of a live database, in parallel ranges of a numeric or time column."""
    return (spark.read.format("jdbc").options(
        url=url, dbtable=name, partitionColumn=column, lowerBound=lower, upperBound=upper,
        numPartitions=partitions, **options).load())


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    """Write one folder per key. Adaptive rebalancing merges small keys' files and splits large keys over several."""
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)
