"""URL filters by a cascade of Bloom filters.

Rules are (host, path, verdict). The keys of a url are its host's endings of as many labels as
rules have, each joined with its path's beginnings of as many characters as rules have; a rule
fits if it is one of them. The first filter holds the listed keys, the second the corpus's keys
that the first takes in wrongly, the third the listed keys that the second takes in, and so on
until a level takes in nothing wrongly. Over the key universe it was built for, the level at
which a key first fails tells exactly whether it is listed; no url meets a list by a join.

One cascade tells listed keys from others, a second one block rules from allow rules.
A filter's size is bounded by ``MAX_BITS``; a list too long for it is refused.

Defined results: a null url or one without ``://`` has an empty host and path and fits no rule;
no rule: the verdict is ``allow``, as the cascade finds no listed key; of rules of equal length
the one with the longer host wins; repeated rows stay; a rule given twice must agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.tables import written

BITS_PER_KEY, HASHES, MAX_BITS = 10, 5, 1 << 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty for null and where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def candidate_keys(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """All keys by which a rule could fit, the longest first; few, as rules have few shapes."""
    ends = F.array(*(F.when((host != "") & (F.size(F.split(host, r"\.")) >= n), F.substring_index(host, ".", -n))
                     for n in labels))
    starts = F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths))
    joined = F.transform(F.filter(ends, lambda e: e.isNotNull()), lambda e: F.transform(
        F.filter(starts, lambda s: s.isNotNull()),
        lambda s: F.struct(-F.length(e) - F.length(s), -F.length(e), F.concat(e, s).alias("key"))))
    return F.array_sort(F.flatten(joined))["key"]


def _places(first: np.ndarray, second: np.ndarray, bits: int, level: int) -> np.ndarray:
    """One row of bit positions per hash pair; each level has its own."""
    steps = np.arange(HASHES, dtype=np.uint64) + np.uint64(level * HASHES)
    return ((first[:, None].view(np.uint64) + steps * (second[:, None].view(np.uint64) | np.uint64(1)))
            >> np.uint64(17)) % np.uint64(bits)


class Cascade:
    """The levels, as packed bits; ``contains`` is exact for the keys of the universe."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def passes(self, level: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        filled = self.levels[level]
        at = _places(first, second, len(filled) * 8, level)
        return ((filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def contains(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        found, open_ = np.zeros(len(first), bool), np.arange(len(first))
        for level in range(len(self.levels)):
            # Those that pass an even level are listed unless a later level says otherwise.
            open_ = open_[self.passes(level, first[open_], second[open_])]
            found[open_] = level % 2 == 0
        return found


def key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(1))


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade for ``listed.key`` within ``universe.key`` and the listed keys themselves.

    One shuffle finds which distinct keys are listed. Each level then is one pass over the keys
    of the other kind: bits are set per task, and tasks' words of 64 bits are merged by ``bit_or``
    before the filter, whose size is bounded, comes to the driver.
    """
    both = universe.select("key", F.lit(0).alias("listed")).unionByName(listed.select("key", F.lit(1).alias("listed")))
    first, second = key_hashes(F.col("key"))
    keys = written(both.filter(F.col("key").isNotNull()).groupBy("key").agg(F.max("listed").alias("listed")).select(
        first.alias("a"), second.alias("b"), "listed"))
    cascade = Cascade()
    while True:
        level = len(cascade.levels)
        kind = keys.filter(F.col("listed") == (1 if level % 2 == 0 else 0)).select("a", "b")
        if level:
            kind = kind.filter(_still_open(cascade, kind.sparkSession)("a", "b"))
        count = kind.count()
        if not count:
            return cascade
        bits = max(64, -(-count * BITS_PER_KEY // 64) * 64)
        if bits > MAX_BITS:
            raise ValueError(f"{count} keys at level {level} need a filter of over {MAX_BITS} bits")
        words = _set_bits(kind, bits, level).groupBy("word").agg(F.bit_or("value").alias("value"))
        filled = np.zeros(bits // 64, np.int64)
        for row in words.toLocalIterator():
            filled[row["word"]] = row["value"]
        cascade.levels.append(filled.view(np.uint8))


def _still_open(cascade: Cascade, spark):
    shared = spark.sparkContext.broadcast(cascade)

    @F.pandas_udf("boolean")
    def still_open(a, b):
        import pandas as pd
        first, second = a.to_numpy(), b.to_numpy()
        kept = np.ones(len(first), bool)
        for level in range(len(shared.value.levels)):
            kept &= shared.value.passes(level, first, second)
        return pd.Series(kept)

    return still_open


def _set_bits(keys: DataFrame, bits: int, level: int) -> DataFrame:
    """(word, value) of the filter's words with any bit set, once per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = _places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits, level).ravel()
            np.bitwise_or.at(filled, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
        words = filled.view(np.int64)
        set_ = np.flatnonzero(words)
        for i in range(0, len(set_), 1 << 16):
            part = set_[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(words[part])], names=["word", "value"])

    return keys.mapInArrow(run, "word bigint, value bigint")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """``key``, ``host``, ``path``, ``rule`` (the longest that fits, else null) and ``verdict`` per row."""
    known = {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block") or known.setdefault(host + path, verdict) != verdict:
            raise ValueError(f"rule {host}{path} must have one verdict, allow or block")
    labels = sorted({host.count(".") + 1 for host, _, _ in rules})
    lengths = sorted({len(path) for _, path, _ in rules})
    spark = pages.sparkSession
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths) if rules
                             else F.array().cast("array<string>"))
    universe = parts.select(F.explode("keys").alias("key"))
    listed = _key_table(spark, list(known))
    blocked = _key_table(spark, [k for k, v in known.items() if v == "block"])
    is_listed = spark.sparkContext.broadcast(build_cascade(listed, universe))
    # The second universe is the listed keys: only they are asked about.
    is_blocked = spark.sparkContext.broadcast(build_cascade(blocked, listed))
    found = parts.withColumn("_hit", _longest_hit(is_listed, is_blocked)(
        F.transform("keys", lambda k: key_hashes(k)[0]), F.transform("keys", lambda k: key_hashes(k)[1])))
    return found.select(
        key, "host", "path", F.get("keys", F.col("_hit.place")).alias("rule"),
        F.when(F.col("_hit.blocked"), "block").otherwise("allow").alias("verdict"))


def _key_table(spark, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")


def _longest_hit(is_listed: Broadcast, is_blocked: Broadcast):
    """The place of the first listed key of each row, and whether it is a block rule."""

    @F.pandas_udf("place int, blocked boolean")
    def hit(a, b):
        import pandas as pd
        sizes = a.map(len).to_numpy()
        first = np.concatenate([np.zeros(0, np.int64), *a.tolist()]).astype(np.int64)
        second = np.concatenate([np.zeros(0, np.int64), *b.tolist()]).astype(np.int64)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(is_listed.value.contains(first, second))
        owners, earliest = np.unique(rows[at], return_index=True)
        at = at[earliest]
        starts = np.cumsum(sizes) - sizes
        place = pd.Series(pd.NA, index=range(len(sizes)), dtype="Int32")
        place.iloc[owners] = (at - starts[owners]).astype(np.int32)
        blocked = np.zeros(len(sizes), bool)
        blocked[owners] = is_blocked.value.contains(first[at], second[at])
        return pd.DataFrame({"place": place, "blocked": blocked})

    return hit
