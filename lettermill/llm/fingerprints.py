"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the ``k`` smallest distinct 64-bit hashes of a text's five-word
shingles. Sketches of parts merge into the sketch of the whole, and two of them estimate
resemblance, containment and the number of distinct shingles; sketches with fewer than ``k``
hashes are complete and give exact values.

Defined results: a null text is empty; a text of one to four words has one shingle; a text
without words has an empty sketch, which resembles another empty one fully and others not at
all; rows with equal ids are ordered by text; a null id comes first; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.words import in_chunks, shingle_hashes

K = 128


# --- sketches in numpy, inside tasks ------------------------------------------------------

def sketches(texts: list[str], k: int = K) -> list[np.ndarray]:
    hashes, edges = shingle_hashes(texts)
    hashes = hashes.view(np.int64)
    return [np.unique(hashes[a:b])[:k] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated resemblance: the share of the ``k`` smallest hashes of both that are in each."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    again = both[1:] == both[:-1]
    distinct = both[np.concatenate(([True], ~again))][:k]
    return float(np.count_nonzero(both[1:][again] <= distinct[-1]) / len(distinct))


def distinct_shingles(sketch: np.ndarray, k: int = K) -> float:
    if len(sketch) < k:
        return float(len(sketch))
    return (k - 1) / ((float(sketch[k - 1]) + 2.0 ** 63) / 2.0 ** 64)


def as_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<i8").tobytes()).decode()


# --- sketches as columns --------------------------------------------------------------------

def fingerprints(df: DataFrame, key: str, text: str, k: int = K) -> DataFrame:
    """(key, sketch) per row of ``df``; rows of one key are parts, to be merged by :func:`merge`."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0), batch.column(1).to_pylist(), strict=True)
            for chunk in in_chunks(pairs, lambda pair: len(pair[1])):
                found = sketches([t for _, t in chunk], k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.as_py() for i, _ in chunk], batch.column(0).type), pa.array(found, pa.list_(pa.int64()))],
                    names=["key", "sketch"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, sketch array<bigint>").withColumnRenamed("key", key)


def merge(df: DataFrame, key: str, k: int = K, salts: int = 32) -> DataFrame:
    """One sketch per key from those of its parts, first within ``salts`` splits of a key."""
    def smallest(sketch: Column) -> Column:
        return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(sketch)))), 1, k)

    salted = df.withColumn("_salt", F.pmod(F.xxhash64("sketch"), F.lit(salts)))
    part = salted.groupBy(key, "_salt").agg(smallest(F.col("sketch")).alias("sketch"))
    return part.groupBy(key).agg(smallest(F.col("sketch")).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(
        shared / F.size(union))


def distinct_count(sketch: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles."""
    kth = (F.element_at(sketch, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of the first text's shingles that the second has too."""
    r = resemblance(a, b, k)
    shared = r / (1 + r) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


# --- each document against its edited text and its successor -----------------------------------

def _successor_buckets(df: DataFrame, blocks: int) -> tuple[np.ndarray, dict[int, int]]:
    """Bounds of ``blocks`` ranges of ids, and for the first id of each the range before it (around the end).

    Reads ids only; what comes to the driver has one row per range.
    """
    shares = [i / blocks for i in range(1, blocks)]
    bounds = np.unique(df.approxQuantile("id", shares, 0.2 / blocks) if shares else []).astype(np.float64)

    @F.pandas_udf("int")
    def bucket(ids):
        import pandas as pd
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.float64), "right"))

    first = sorted(df.groupBy(bucket("id").alias("b")).agg(F.min("id").alias("id")).collect())
    return bounds, {row["id"]: first[i - 1]["b"] for i, row in enumerate(first)}


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K,
                        blocks: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is the next text's start.

    Texts move once: into ranges of ids, sorted. The first row of each range also goes to the
    range before it, so that every row meets its successor in its own task.
    """
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A null id stands before all others.
    rows = df.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(key).cast("long"), F.lit(-(2 ** 63))).alias("id"),
                     F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds, before = _successor_buckets(rows.select("id"), blocks)

    @F.pandas_udf("array<int>")
    def targets(ids):
        import pandas as pd
        own = np.searchsorted(bounds, ids.to_numpy(np.float64), "right").tolist()
        return pd.Series([[b, before[i]] if i in before else [b] for i, b in zip(ids.tolist(), own, strict=True)])

    dealt = rows.select("doc", "id", "text", F.posexplode(targets("id")).alias("ahead", "bucket"))
    ranged = dealt.repartition(blocks, "bucket").sortWithinPartitions("bucket", "ahead", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flat() -> Iterator[tuple]:
            for batch in batches:
                for doc, ahead, body in zip(batch.column("doc").to_pylist(), batch.column("ahead").to_pylist(),
                                            batch.column("text"), strict=True):
                    yield doc, ahead, body.as_py()

        held: list[tuple] = []
        for chunk in in_chunks(flat(), lambda row: len(row[2])):
            chunk = held + chunk
            held = chunk[-1:]
            pairs = [(a, b) for a, b in zip(chunk[:-1], chunk[1:], strict=True) if not a[1]]
            if pairs:
                yield _compare(pairs, k)

    return ranged.select("doc", "ahead", "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double, distinct_shingles double")


def _compare(pairs: list[tuple], k: int) -> pa.RecordBatch:
    """Rows of the result for (row, next row) pairs."""
    texts = [a[2] for a, _ in pairs]
    nexts = [b[2] for _, b in pairs]
    edited = [t[:len(t) - len(t) // 4] + n[:len(t) // 4] for t, n in zip(texts, nexts, strict=True)]
    own, new, after = sketches(texts, k), sketches(edited, k), None
    after = own[1:] + sketches(nexts[-1:], k)
    # Where rows of two ranges meet, the next row of a pair isn't the first of the following pair.
    for i, n in enumerate(nexts[:-1]):
        if n is not texts[i + 1]:
            after[i] = sketches([n], k)[0]
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([a[0] for a, _ in pairs], pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
        "fingerprint": [as_text(s) for s in own],
        "edited_fingerprint": [as_text(s) for s in new],
        "near_edited": [likeness(s, t, k) for s, t in zip(own, new, strict=True)],
        "near_next": [likeness(s, t, k) for s, t in zip(own, after, strict=True)],
        "distinct_shingles": [distinct_shingles(s, k) for s in own],
    })
