"""Best-fit packing of token sequences, bulk-synchronous.

Documents are cut into full sequences and a rest. Rests and gaps are packed in rounds. A round
range-sorts rests and gaps together by size, largest first, gaps before rests of equal size; a
rest takes the smallest larger gap that no earlier rest has taken (as brackets match). Ranges
are swept side by side, then what is open at a range's start is matched with what earlier
ranges left over, by rank: only the two counts of each range come to the driver. Gaps shrink,
and the next round sorts again. So that many short rests don't need as many rounds, each task
first bundles rests that are short against the mean gap; bundles that find no gap fall apart.

Defined results: a null text is empty; every text ends with the end id, so an empty one has one
token; repeated rows are packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.tables import arrow_batches, written
from lettermill.llm.tokens import encode_words
from lettermill.llm.words import in_chunks

FINE_ROUNDS, SHARE, ROWS_PER_TASK, CHARS, TEXT_ROWS = 7, 3, 50_000, 1 << 22, 1000
PARTS = "array<struct<uid:bigint,at:int>>"


def token_pieces(docs: DataFrame, key: str, text: str, tokenizer: str, window: int = 4096, end_id: int = 1,
                 keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` tokens: doc, piece, start, length, ids_crc32 and, if asked for, ids."""
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker may come from another stage; what that one has freed goes back.
        pa.default_memory_pool().release_unused()
        for batch in batches:
            kind_of_key = batch.column(0).type
            pairs = zip(batch.column(0), batch.column(1), strict=True)
            for chunk in in_chunks(((k.as_py(), t.as_py()) for k, t in pairs), lambda pair: len(pair[1]), CHARS):
                found = encode_words([t for _, t in chunk], tokenizer)
                out = [(k, i, at // 4, len(piece) // 4, zlib.crc32(piece), piece)
                       for (k, _), ids in zip(chunk, found, strict=True)
                       for i, at in enumerate(range(0, len(ids) + 4, 4 * window))
                       for piece in ((ids + end)[at:at + 4 * window],)]
                columns = list(zip(*out, strict=True))
                arrays = [pa.array(columns[0], kind_of_key), pa.array(columns[1], pa.int32()), *(
                    pa.array(c, pa.int64()) for c in columns[2:5])]
                names = ["doc", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    edges = np.concatenate(([0], np.cumsum(columns[3]))).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(edges, np.frombuffer(b"".join(columns[5]), "<i4")))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    ids = ", ids array<int>" if keep_ids else ""
    return rows.mapInArrow(run, f"doc {kind}, piece int, start long, length long, ids_crc32 long{ids}")


def pack(pieces: DataFrame, window: int = 4096) -> DataFrame:
    """``pieces`` with sequence_id and offset. Each full piece is a sequence of its own."""
    with arrow_batches(pieces.sparkSession, TEXT_ROWS):
        pieces = written(pieces.withColumn("uid", F.monotonically_increasing_id()))
    full = pieces.filter(F.col("length") == window).select(
        *pieces.columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = pieces.filter(F.col("length") < window)
    placed = _place(rests.select("uid", F.col("length").cast("int").alias("size")), window)
    packed = rests.join(placed, "uid").select(*pieces.columns, "sequence_id", "offset")
    return full.unionByName(packed).drop("uid")


def _place(rests: DataFrame, window: int) -> DataFrame:
    """(uid, sequence_id, offset) of all rests."""
    spark = rests.sparkSession
    total = rests.agg(F.sum("size")).first()[0] or 0
    sequences = -(-total // window)
    gaps = spark.range(sequences).select(F.col("id").alias("seq"), F.lit(window).alias("size"))
    mean = top = float(window)
    rows, rounds, placements = rests.count() + sequences, 0, []
    while total:
        rounds += 1
        bundle = max(1, int(mean / SHARE if rounds <= FINE_ROUNDS else top * 2 / 3))
        after = written(_round(_bundled(rests, bundle), gaps, _tasks(rows)))
        placements.append(after.filter("kind = 2").select("seq", (F.lit(window) - F.col("size")).cast("long").alias("offset"), "parts"))
        # At most two counts per size within the window come to the driver.
        sizes = after.filter("kind < 2").select("kind", F.explode(
            F.when(F.col("kind") == 0, F.array("size")).otherwise(F.transform("lengths", lambda n: n))).alias("n"))
        counts = [(r["kind"], r["n"], r["count"]) for r in sizes.groupBy("kind", "n").count().collect()]
        open_ = {n: c for kind, n, c in counts if kind == 0}
        left = {n: c for kind, n, c in counts if kind == 1}
        total = sum(n * c for n, c in left.items())
        top = max(open_, default=0)
        more = -(-sum(n * c for n, c in left.items() if n > top) // window)
        rests = after.filter("kind = 1").select(F.explode(F.arrays_zip("parts.uid", "lengths")).alias("p")).select("p.*").toDF("uid", "size")
        gaps = after.filter("kind = 0").select("seq", "size")
        if more:
            gaps = gaps.unionByName(spark.range(sequences, sequences + more).select(F.col("id").alias("seq"), F.lit(window).alias("size")))
            sequences, top = sequences + more, window
        n_gaps = sum(open_.values()) + more
        mean = (sum(n * c for n, c in open_.items()) + more * window) / max(1, n_gaps)
        rows = sum(left.values()) + n_gaps
    if not placements:
        return spark.createDataFrame([], "uid long, sequence_id long, offset long")
    found = placements[0]
    for more_placed in placements[1:]:
        found = found.unionByName(more_placed)
    return found.select(F.col("seq").alias("sequence_id"), "offset", F.explode("parts").alias("p")).select(
        F.col("p.uid").alias("uid"), "sequence_id", (F.col("offset") + F.col("p.at")).alias("offset"))


def _tasks(rows: int) -> int:
    """Tasks of a round: they follow its rows, as there are many rounds, the last ones are small, and a task holds its range."""
    return 2 + rows // ROWS_PER_TASK


def _bundled(rests: DataFrame, bundle: int) -> DataFrame:
    """Rests as objects: those up to half of ``bundle`` together, per task, until they come to ``bundle``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            done = []
            for uid, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if size > bundle // 2:
                    done.append([(uid, size)])
                    continue
                held.append((uid, size))
                total += size
                if total >= bundle:
                    done.append(held)
                    held, total = [], 0
            if done:
                yield objects(done)
        if held:
            yield objects([held])

    def objects(groups: list[list[tuple]]) -> pa.RecordBatch:
        lengths = [[n for _, n in g] for g in groups]
        parts = [[{"uid": uid, "at": int(at)} for (uid, _), at in zip(g, np.cumsum([0, *n]), strict=False)]
                 for g, n in zip(groups, lengths, strict=True)]
        return pa.RecordBatch.from_arrays([
            pa.array([sum(n) for n in lengths], pa.int32()),
            pa.array(parts, pa.list_(pa.struct([("uid", pa.int64()), ("at", pa.int32())]))),
            pa.array(lengths, pa.list_(pa.int32()))], names=["size", "parts", "lengths"])

    return rests.select("uid", "size").mapInArrow(run, f"size int, parts {PARTS}, lengths array<int>")


def _round(objects: DataFrame, gaps: DataFrame, blocks: int) -> DataFrame:
    """One round: rows of kind 0 (gap left), 1 (object left) and 2 (object placed into ``seq`` where ``size`` was open)."""
    spark = objects.sparkSession
    both = gaps.select("size", F.lit(0).alias("kind"), "seq", F.lit(None).cast(PARTS).alias("parts"),
                       F.lit(None).cast("array<int>").alias("lengths")).unionByName(
        objects.select("size", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), "parts", "lengths"))
    # Equal sizes may make up most rows, so that ranges also go by a hash.
    both = both.withColumn("tie", F.xxhash64("seq", F.col("parts")[0]["uid"]))
    order = [F.col("size").desc(), F.col("kind"), F.col("tie")]
    swept = written(both.repartitionByRange(blocks, *order).sortWithinPartitions(*order).withColumn(
        "block", F.spark_partition_id()).select("block", "size", "kind", "seq", "parts", "lengths").mapInArrow(
        _sweep, f"block int, kind int, rank long, seq long, size int, parts {PARTS}, lengths array<int>"))
    open_ = swept.filter("rank is not null")
    # Two counts per range.
    counts: dict[int, list[int]] = {}
    for row in open_.groupBy("block", "kind").count().collect():
        counts.setdefault(row["block"], [0, 0])[row["kind"]] = row["count"]
    segments = carried(counts)
    carry = spark.createDataFrame(segments or [(-1, 0, 0, 0, 0)], "block int, low long, high long, gap_block int, gap_rank long")
    items = open_.filter("kind = 1").alias("o").join(
        F.broadcast(carry).alias("c"),
        (F.col("o.block") == F.col("c.block")) & (F.col("o.rank") >= F.col("low")) & (F.col("o.rank") < F.col("high")), "left").select(
        F.col("gap_block").alias("block"), (F.col("gap_rank") - (F.col("rank") - F.col("low"))).alias("rank"),
        "size", "parts", "lengths")
    met = open_.filter("kind = 0").select("block", "rank", "seq", F.col("size").alias("gap")).join(
        items.filter("block is not null"), ["block", "rank"], "left")
    nothing = [F.lit(None).cast(PARTS).alias("parts"), F.lit(None).cast("array<int>").alias("lengths")]
    columns = ["kind", "seq", "size", "parts", "lengths"]
    matched = F.col("parts").isNotNull()
    row = F.struct
    of_met = F.when(matched, F.array(
        row(F.lit(2).alias("kind"), F.col("seq"), F.col("gap").alias("size"), F.col("parts"), F.col("lengths")),
        row(F.lit(0).alias("kind"), F.col("seq"), (F.col("gap") - F.col("size")).alias("size"), *nothing))).otherwise(F.array(
        row(F.lit(0).alias("kind"), F.col("seq"), F.col("gap").alias("size"), *nothing)))
    left = items.filter("block is null").select(
        F.lit(1).alias("kind"), F.lit(None).cast("long").alias("seq"), "size", "parts", "lengths")
    after = met.select(F.inline(of_met)).coalesce(blocks).unionByName(left).unionByName(swept.filter("rank is null").select(*columns))
    return after.filter("kind > 0 or size > 0").coalesce(blocks)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match brackets within a range: gaps open, objects close.

    Gives kind 2 and a smaller gap for a match; what stays open has a rank in its order.
    """
    found = [batch for batch in batches if batch.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    kinds, sizes = table["kind"].to_numpy().tolist(), table["size"].to_numpy().copy()
    rank, mate = np.full(len(kinds), -1, np.int64), np.full(len(kinds), -1, np.int64)
    stack, unmatched = [], 0
    for i, kind in enumerate(kinds):
        if kind == 0:
            stack.append(i)
        elif stack:
            mate[i] = stack.pop()
        else:
            rank[i] = unmatched
            unmatched += 1
    rank[stack] = np.arange(len(stack))
    kinds = np.array(kinds)
    taken = np.flatnonzero(mate >= 0)
    seq = table["seq"].combine_chunks().to_numpy(zero_copy_only=False).copy()
    sizes_out = sizes.copy()
    seq[taken], sizes_out[taken], kinds[taken] = seq[mate[taken]], sizes[mate[taken]], 2
    sizes_out[mate[taken]] = sizes[mate[taken]] - sizes[taken]
    none = np.isnan(seq) if seq.dtype.kind == "f" else np.zeros(len(seq), bool)
    out = pa.table({
        "block": table["block"], "kind": pa.array(kinds, pa.int32()), "rank": pa.array(rank, mask=rank < 0),
        "seq": pa.array(np.where(none, 0, seq).astype(np.int64), mask=none), "size": pa.array(sizes_out, pa.int32()),
        "parts": table["parts"], "lengths": table["lengths"]})
    yield from out.to_batches(10_000)


def carried(counts: dict[int, list[int]]) -> list[tuple[int, int, int, int, int]]:
    """Which open objects of a range take which gaps left by earlier ranges, the latest left first.

    ``counts`` has (gaps, objects) left open per range. Returns (block, low, high, gap_block, gap_rank):
    object ``low + t`` of ``block``, below ``high``, takes gap ``gap_rank - t`` of ``gap_block``.
    """
    stack, found = [], []
    for block in sorted(counts):
        gaps, objects = counts[block]
        low = 0
        while low < objects and stack:
            gap_block, n = stack.pop()
            take = min(n, objects - low)
            found.append((block, low, low + take, gap_block, n - 1))
            if take < n:
                stack.append((gap_block, n - take))
            low += take
        if gaps:
            stack.append((block, gaps))
    return found
