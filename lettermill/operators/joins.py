"""Broadcast behind a size check."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def _bytes(name: str, kind: DataType) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(kind, (ArrayType, MapType, StructType)):
        column = F.to_json(F.struct(column))
    elif not isinstance(kind, (StringType, BinaryType)):
        return F.lit(8)
    return F.coalesce(F.octet_length(column), F.lit(0))


def _size(fields: list) -> Column:
    each = F.lit(0).cast("bigint")
    for field in fields:
        each = each + _bytes(field.name, field.dataType)
    return each


def broadcasts(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> int:
    """In how many parts of at most about ``rows`` rows and ``size`` bytes ``df`` can be broadcast, one after the other."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(_size(df.schema.fields)), F.lit(0)).alias("bytes")).first()
    return max(1, math.ceil(found["n"] / rows), math.ceil(found["bytes"] / size))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and ``size`` bytes; reads no more than one row beyond."""
    found = df.select(_size(df.schema.fields).alias("bytes")).limit(rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    return found["n"] <= rows and found["bytes"] <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if is_small(df, rows) else df
