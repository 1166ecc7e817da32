"""Sharding by a permutation-filled lookup table, with DataFrame and SQL functions only.

Every shard has a preference order over the slots of a table of prime size, a walk from its own
offset by its own step. Shards take turns; each claims its first preferred slot that is still
free, until the table is full, so shares differ by one slot at most, and when a shard leaves,
nearly all other slots keep their owner. A row goes to the shard that owns the slot of its key's
hash: one look-up in a broadcast table of ``slots`` rows, whatever the number of rows.

Defined results: a null key is placed as the empty text; repeated keys go to one shard; rows of
an empty table give none; a column that already has the name of the result is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SLOTS = 65_537


def hash60(text: Column) -> Column:
    """60 bits of md5 as a number, so that any engine with md5 can find a row's shard."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _check(shards: Sequence[str], slots: int) -> None:
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must have different names, one at least")
    if not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be from the number of shards to {MAX_SLOTS}")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("slots must be a prime number")


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int = 4099) -> DataFrame:
    """(slot, shard), one row per slot: at most ``MAX_SLOTS`` rows whatever the data.

    The claims are one fold over ``slots`` turns in which each turn scans one preference order,
    ``slots`` squared cheap steps in all.
    """
    _check(shards, slots)
    names = F.array(*(F.lit(s) for s in shards))

    def preferences(name: Column) -> Column:
        offset = F.pmod(hash60(F.concat(F.lit("offset "), name)), F.lit(slots))
        step = F.pmod(hash60(F.concat(F.lit("step "), name)), F.lit(slots - 1)) + 1
        return F.transform(F.sequence(F.lit(0), F.lit(slots - 1)),
                           lambda j: F.pmod(offset + j * step, F.lit(slots)).cast("int"))

    def turn(owners: Column, t: Column) -> Column:
        shard = F.pmod(t, F.lit(len(shards)))
        free = F.filter(F.get(F.col("prefs"), shard), lambda slot: F.get(owners, slot) == -1)
        # One-element arrays bind the claimed slot, so that it is found once a turn.
        claimed = F.transform(F.array(F.get(free, F.lit(0))), lambda slot: F.concat(
            F.slice(owners, F.lit(1), slot), F.array(shard),
            F.slice(owners, slot + 2, F.lit(slots) - slot - 1)))
        return F.get(claimed, F.lit(0))

    # Preferences are made by an own step, which the fold then reads.
    walks = spark.range(1).select(F.explode(F.array(F.transform(names, preferences))).alias("prefs"))
    owners = F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)),
                         F.array_repeat(F.lit(-1), slots), turn).alias("owners")
    return walks.select(owners).select(F.posexplode("owners").alias("slot", "owner")).select(
        "slot", F.get(names, F.col("owner")).alias("shard"))


def place(df: DataFrame, key: str, table: DataFrame, slots: int = 4099) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; no row is shuffled."""
    slot = F.pmod(hash60(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(slots)).cast("int")
    return df.drop("shard").withColumn("slot", slot).join(F.broadcast(table), "slot")
