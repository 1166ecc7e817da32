"""Ranks and first-n selections that hold up when one group holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.session import pin

SALTS = 32


def flag_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: Column | int,
               flag: str = "within", salts: int = SALTS) -> DataFrame:
    """Mark, in every group, the first ``limit`` rows in ``order`` (a unique order).

    The group is first split by a hash of the order key. A row that is past the limit within
    its split is past it in the group, so the second ranking only gathers ``salts * limit``
    rows of a group; the others stay spread over the splits.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")).withColumn("_limit", limit)
    first = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
    split = salted.withColumn("_open", first <= F.col("_limit"))
    split = split.withColumn("_salt", F.when(F.col("_open"), F.lit(-1)).otherwise(F.col("_salt")))
    second = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
    ranked = split.withColumn(flag, F.col("_open") & (second <= F.col("_limit")))
    return ranked.drop("_salt", "_limit", "_open")


def with_running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: Column, name: str,
                       blocks: int | None = None) -> DataFrame:
    """Add the sum of ``amount`` over the rows of ``keys`` up to each row in ``order`` (a unique order).

    Rows are range partitioned into balanced blocks, pinned, summed up inside their block and
    shifted by the sums of the earlier blocks. No group, however large, is sorted in one task.
    """
    spark = df.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_amount", amount).repartitionByRange(blocks, *keys, *order)
    ranged = pin(ranged.withColumn("_block", F.spark_partition_id()))
    so_far = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # At most one row per key and block.
    sizes = ranged.groupBy(*keys, "_block").agg(F.sum("_amount").alias("_size"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_block", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    summed = ranged.withColumn("_sum", F.sum("_amount").over(so_far)).join(offsets, [*keys, "_block"])
    return summed.withColumn(name, F.col("_sum") + F.col("_offset")).drop("_block", "_sum", "_offset", "_amount")


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position",
                  blocks: int | None = None) -> DataFrame:
    """Add the dense 1-based position of each row within ``keys`` in ``order`` (a unique order)."""
    return with_running_total(df, keys, order, F.lit(1).cast("bigint"), name, blocks)


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float],
                totals: dict[str, Column] | None = None, count: str | None = None) -> DataFrame:
    """Exact percentiles per group, with optional sums and a row count.

    Equal values are counted first, so what reaches a group's final task is one row per
    distinct value and not one per input row: a bounded number for whole milliseconds.
    """
    totals = totals or {}
    counted = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(name) for name, c in totals.items()))
    ps = F.percentile(value, F.array(*(F.lit(p) for p in probabilities.values())), F.col("_n"))
    rolled = counted.groupBy(*keys).agg(
        F.sum("_n").alias("_count"), ps.alias("_ps"), *(F.sum(name).alias(name) for name in totals))
    out = [F.col("_count").cast("bigint").alias(count)] if count else []
    out += [F.col(name) for name in totals]
    out += [F.col("_ps")[i].alias(name) for i, name in enumerate(probabilities)]
    return rolled.select(*keys, *out)


def _ranked_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with ``_before`` and ``_upto``, the rows below and up to each, and the group's ``_total``."""
    if not keys:
        raise ValueError("give at least one key; a constant column ranks all rows together")
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = with_running_total(counted, keys, [value], F.col("_n"), "_upto")
    totals = placed.groupBy(*keys).agg(F.max("_upto").alias("_total"))
    return placed.join(totals, list(keys)).withColumn("_before", F.col("_upto") - F.col("_n"))


def _value_at(value: str, place: Column) -> Column:
    """The value at a 0-based place of its group."""
    return F.max(F.when((F.col("_before") <= place) & (place < F.col("_upto")), F.col(value)))


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """The value at sorted position ceil(n * p) per group; any number of distinct values."""
    return _ranked_values(df, keys, value).groupBy(*keys).agg(*(
        _value_at(value, F.ceil(F.col("_total") * F.lit(p)) - 1).alias(name) for name, p in probabilities.items()))


def ranked_percentiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float],
                       count: str = "count") -> DataFrame:
    """Exact interpolated percentiles for values with many distinct settings; see :func:`percentiles` for few."""
    ends = []
    for name, p in probabilities.items():
        place = (F.col("_total") - 1) * F.lit(p)
        ends += [_value_at(value, F.floor(place)).alias(f"_{name}_low"), _value_at(value, F.ceil(place)).alias(f"_{name}_high")]
    found = _ranked_values(df, keys, value).groupBy(*keys).agg(F.max("_total").alias(count), *ends)

    def between(name: str, p: float) -> Column:
        place = (F.col(count) - 1) * F.lit(p)
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        return (low + (high - low) * (place - F.floor(place))).alias(name)

    return found.select(*keys, count, *(between(name, p) for name, p in probabilities.items()))
