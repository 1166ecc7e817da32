"""Stored postings that are kept current: versions of changed pages, merged bucket by bucket.

A store is a folder of Parquet tables. ``postings`` is partitioned by version and by a hash bucket of the key;
``deleted`` names the pages that a version replaced, so their older postings no longer count; ``written`` gets
its row last, and versions without one are ignored, so a write that failed leaves nothing to be read and is
overwritten by the next. One writer at a time; readers see the versions written before they started.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.operators.joins import broadcast_if_small

PAGE = ["document_id", "page_no"]
BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def create(postings: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Store ``postings``, which carry the page they come from, as version 0 of a new store."""
    postings.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    spark = postings.sparkSession
    every = spark.range(buckets).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("bucket"))
    _write(postings, postings.select(*PAGE).limit(0), every, path, 0, key, buckets, "overwrite")


def apply_changes(postings: DataFrame, changed: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> int:
    """Add a version: ``changed`` pages lose what they had and get ``postings``, which may be none.

    Only buckets of new postings are written. Returns the version.
    """
    spark = changed.sparkSession
    version = next_version(spark, path)
    row = spark.range(1).select(F.lit(version).alias("version"), F.lit(None).cast("int").alias("bucket"))
    _write(postings, changed.select(*PAGE).distinct(), row, path, version, key, buckets, "append")
    return version


def next_version(spark: SparkSession, path: str) -> int:
    return _last(spark, path) + 1


def read(spark: SparkSession, path: str, keys: DataFrame | None = None, key: str = "token", buckets: int = BUCKETS) -> DataFrame:
    """Postings that count now, of the buckets that ``keys`` fall into or of all.

    At most ``buckets`` numbers reach the driver; as a partition filter they prune the scan.
    """
    wanted = None if keys is None else {row[0] for row in keys.select(bucket_of(key, buckets)).distinct().collect()}
    return _live(spark, path, _bases(spark, path), wanted).drop("bucket")


def merge(spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> list[int]:
    """Rewrite each bucket that holds several versions as one; other buckets aren't touched. Returns the buckets."""
    bases, version = _bases(spark, path), next_version(spark, path)
    stored = _stored(spark, path).filter(_current(bases, None)).groupBy("bucket").agg(F.count_distinct("version").alias("n"))
    several = sorted(row["bucket"] for row in stored.filter("n > 1").collect())
    if several:
        rows = spark.createDataFrame([(version, b) for b in several], "version int, bucket int")
        live = _live(spark, path, bases, set(several)).drop("bucket")
        _write(live, live.select(*PAGE).limit(0), rows, path, version, key, buckets, "append")
    return several


def _write(postings: DataFrame, deleted: DataFrame, rows: DataFrame, path: str, version: int, key: str, buckets: int, mode: str) -> None:
    # Rebalancing splits the bucket of a common key over several files.
    placed = postings.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket")
    placed.sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/version={version}")
    deleted.write.mode("overwrite").parquet(f"{path}/deleted/version={version}")
    rows.coalesce(1).write.mode(mode).parquet(f"{path}/written")


def _last(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/written").agg(F.max("version")).first()[0]


def _bases(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Buckets by the version that last wrote them whole; one number per bucket."""
    found = spark.read.parquet(f"{path}/written").filter("bucket is not null").groupBy("bucket").agg(F.max("version").alias("base"))
    bases: dict[int, list[int]] = {}
    for row in found.collect():
        bases.setdefault(row["base"], []).append(row["bucket"])
    return bases


def _current(bases: dict[int, list[int]], wanted: set[int] | None) -> Column:
    kept = {base: [b for b in found if wanted is None or b in wanted] for base, found in bases.items()}
    each = [(F.col("version") >= base) & F.col("bucket").isin(found) for base, found in kept.items() if found]
    return reduce(lambda a, b: a | b, each, F.lit(False))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema.add("version", "integer").add("bucket", "integer")
    return spark.read.schema(schema).parquet(f"{path}/postings").filter(F.col("version") <= _last(spark, path))


def _live(spark: SparkSession, path: str, bases: dict[int, list[int]], wanted: set[int] | None) -> DataFrame:
    postings = _stored(spark, path).filter(_current(bases, wanted))
    # What a base already left out isn't looked at again.
    deleted = spark.read.parquet(f"{path}/deleted").filter(F.col("version").between(min(bases) + 1, _last(spark, path)))
    gone = deleted.groupBy(*PAGE).agg(F.max("version").alias("_gone"))
    left = postings.join(broadcast_if_small(gone), PAGE, "left").filter(F.col("_gone").isNull() | (F.col("version") >= F.col("_gone")))
    return left.select(*(c for c in postings.columns if c != "version"))
