"""Mixing sources to target weights by the cube method.

A source's target is its weight's share of the words wanted, at most ``cap`` times its size; what
is cut off goes to the others by weight until none is above. Every document of a source is then
taken ``target / size`` times: the whole part for certain, and one more time with the
fraction as its probability. Which ones is drawn by the cube method. In its flight, a window of documents
moves along the null space of the two balancing constraints, their number and their words,
until one of them is in or out, and the next takes its place. So both totals of a source stay what
they were expected to be, and every document keeps its probability. The direction is the one
nearest to moving the largest document alone, so that large ones are decided first.

A source is dealt into blocks by a hash, so that no task has to take a source whole. A block leaves two documents undecided
at most; these are dealt into blocks again until a source has one block. Documents come in order
of size, the largest first, so the two that are left at the end are as a rule among the smallest: the
landing lets go of the number of documents, then of the words.

Equal rows are counted first. All but one of them are decided at once (they are as many as their
probabilities come to), so a row that a third of all repeat costs no more than another.

Defined results: a word is a run without ASCII white space; a null text has none; a null source is a source of its own,
the last; a null id is an id as any other; equal rows are drawn each and equal among themselves; documents without words take part in the
number of documents; a source without words has target 0 and isn't taken; an empty table gives an empty result; other columns are ignored. Draws hang on
``seed``, id, source, size and the number of equal rows alone, so reruns agree, however the table is split.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.tables import written
from lettermill.operators.ordering import with_position

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
WINDOW, PER_BLOCK, CHUNK, SALTS, FEW_BYTES = 40, 2_000, 10_000, 32, 8 << 20
_MASK = (1 << 64) - 1


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sources`` (source, source_size) with ``place``, from 0 in order of code points, null last, and ``target``.

    Each round cuts off what is above the caps and shares the rest anew; two sums a round come to the driver.
    """
    placed = with_position(sources.withColumn("last", F.col("source").isNull()), [], ["last", "source"], "place").drop("last")
    size = F.col("source_size").cast("double")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    table = written(placed.select("source", "source_size", (F.col("place") - 1).alias("place"), weight.alias("weight")))
    wanted = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    rate, capped = None, -1
    while True:
        above = F.lit(False) if rate is None else cap * size < F.lit(rate) * F.col("weight")
        full, rest, n = table.agg(F.sum(F.when(above, size).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))),
                                  F.count_if(above)).first()
        if n == capped or not rest:
            break
        rate, capped = max(wanted - cap * full, 0.0) / rest, n
    target = cap * size if not rest else F.least(cap * size, F.lit(rate) * F.col("weight"))
    return table.withColumn("target", target)


def _mixed(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


class Flight:
    """Undecided units of one block, the largest first: [probability, size, row]."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.held: list[list] = []

    def _direction(self) -> list[float] | None:
        """In the null space of the constraints, as near as can be to moving the first unit alone; none if there is no way."""
        sizes = [unit[1] for unit in self.held]
        n, total, square = len(sizes), sum(sizes), sum(x * x for x in sizes)
        spread = n * square - total * total
        if not spread:
            # Of one size all: one up, one down.
            return [1.0, -1.0, *[0.0] * (n - 2)] if n > 1 else None
        if n < 3:
            return None
        for i, x in enumerate(sizes):
            # The unit vector without its part along the two constraints.
            flat, slope = (square - total * x) / spread, (n * x - total) / spread
            found = [-(flat + slope * y) for y in sizes]
            found[i] += 1
            if found[i] > 1e-7:
                return found
        return None

    def _move(self, direction: Sequence[float], draw: float) -> list[list]:
        """Along ``direction`` or against it, as far as probabilities allow; what is decided leaves."""
        ahead = back = float("inf")
        for (p, *_), u in zip(self.held, direction, strict=True):
            if abs(u) > 1e-12:
                up, down = (1 - p) / abs(u), p / abs(u)
                ahead, back = min(ahead, up if u > 0 else down), min(back, down if u > 0 else up)
        # Each side with a probability that keeps every unit's expectation.
        step = ahead if draw * (ahead + back) < back else -back
        done, left = [], []
        for unit, u in zip(self.held, direction, strict=True):
            p = unit[0] + step * u
            unit[0] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
            (left if 0 < unit[0] < 1 else done).append(unit)
        self.held = left
        return done

    def add(self, unit: list, draws: Iterator[float]) -> list[list]:
        """Units that are decided now. Keeps the number of units and their sizes in sum."""
        self.held.append(unit)
        return self.settle(draws, self.window)

    def settle(self, draws: Iterator[float], most: int = 1) -> list[list]:
        """Moves until fewer than ``most`` units are undecided or the constraints leave no way; then two are left at most."""
        done: list[list] = []
        while len(self.held) >= most and (direction := self._direction()):
            done += self._move(direction, next(draws))
        return done

    def land(self, draws: Iterator[float]) -> list[list]:
        """Decides what is left: sizes stay in sum while two are undecided, the last is drawn."""
        done = self.settle(draws)
        while self.held:
            sizes = [unit[1] for unit in self.held]
            done += self._move((float(sizes[1]), -float(sizes[0])) if len(sizes) == 2 else (1.0,), next(draws))
        return done


def _draws(seed: int) -> Iterator[float]:
    while True:
        seed = (seed + 0x9E3779B97F4A7C15) & _MASK
        yield (_mixed(seed) >> 11) / float(1 << 53)


def _flown(final: bool):
    """Sorted rows (place, block, size, tie, p) with ``p`` replaced by 0 or 1, but for up to two a block that stay between."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flight, group, draws = Flight(), None, iter(())

        def end() -> list[list]:
            return flight.land(draws) if final else flight.settle(draws) + flight.held

        for batch in batches:
            names, done = batch.schema.names, []
            columns = [batch.column(names.index(c)).to_pylist() for c in ("place", "block", "size", "tie", "p")]
            for i, (place, block, size, tie, p) in enumerate(zip(*columns, strict=True)):
                if (place, block) != group:
                    done += end()
                    flight, group = Flight(), (place, block)
                draws = _draws(tie & _MASK)
                done += flight.add([p, size, batch.slice(i, 1)], draws)
            yield from _rows(done)
        yield from _rows(end())

    return run


def _rows(done: list[list]) -> Iterator[pa.RecordBatch]:
    if done:
        table = pa.Table.from_batches([row for *_, row in done]).combine_chunks()
        at = table.schema.names.index("p")
        yield from table.set_column(at, "p", pa.array([p for p, *_ in done], pa.float64())).to_batches()


def balanced(units: DataFrame, seed: int = 0, per_block: int = PER_BLOCK) -> DataFrame:
    """``units`` (place, size, tie, p, ...) with ``p`` drawn to 0 or 1, balanced within every ``place`` in number and size."""
    largest = units.groupBy("place").count().agg(F.max("count")).first()[0] or 0
    counts = units.groupBy("place").agg(F.count(F.lit(1)).alias("units"))
    left = units.join(counts, "place").withColumn("units", F.ceil(F.col("units") / per_block))
    decided, level, kind = [], 0, units.columns
    while True:
        final = largest <= per_block
        dealt = left.withColumn("block", F.pmod(F.xxhash64("tie", F.lit(level)), "units"))
        # A key for the shuffle that deals blocks of one source out.
        flown = dealt.repartition("place", "block").sortWithinPartitions("place", "block", F.desc("size"), "tie").mapInArrow(
            _flown(final), dealt.schema)
        flown = written(flown.drop("block"))
        decided.append(flown.filter(F.col("p").isin(0.0, 1.0)).select(*kind))
        if final:
            break
        # Two a block at most are left.
        largest = -(-largest // per_block) * 2
        left = flown.filter((F.col("p") > 0) & (F.col("p") < 1)).withColumn("units", F.ceil(F.col("units") * 2 / per_block))
        level += 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS,
        share: float = SHARE, cap: float = CAP, seed: int = 0) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken) of every row: how many times the mix takes it."""
    sized = docs.select(F.col(key).alias("doc"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"))
    # Texts are read once; equal rows become one, in chunks, so that they can be dealt out again.
    equal = written(sized.groupBy("doc", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    totals = equal.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = written(source_targets(totals, weights, share, cap))
    named = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("s"), "source"))
    chunks = equal.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK)))).withColumn(
        "rows", F.least(F.col("rows") - F.col("chunk") * CHUNK, F.lit(CHUNK).cast("long"))).withColumn(
        "tie", F.xxhash64("doc", "source", "size", "chunk", F.lit(seed))).withColumn("name", named)
    sources = targets.withColumn("name", named).drop("source")
    bytes_ = sources.agg(F.sum(F.octet_length("name") + 48)).first()[0] or 0
    if bytes_ <= FEW_BYTES:
        joined = chunks.join(F.broadcast(sources), "name")
    else:
        # Many sources: a source's rows are spread over salts.
        salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = chunks.withColumn("salt", F.pmod("tie", F.lit(SALTS)).cast("int")).join(salted, ["name", "salt"]).drop("salt")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(F.col("times") + 1e-12)
    more = F.greatest(F.col("times") - F.col("base"), F.lit(0.0)) * F.col("rows")
    units = joined.withColumn("times", times).withColumn("base", base).withColumn("full", F.floor(more + 1e-9)).withColumn(
        "p", F.greatest(more - F.col("full"), F.lit(0.0))).withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p"))).select(
        "doc", "source", "size", "source_size", "target", "place", "tie", "rows", "base", "full", "p")
    units = written(units)
    drawn = balanced(units.filter("p > 0"), seed).unionByName(units.filter("p = 0"))
    every = drawn.withColumn("more", F.col("full") + F.col("p").cast("long")).withColumn(
        "row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.col("base") + (F.col("row") <= F.col("more")).cast("long")
    return every.select(F.col("doc").alias(key), "source", "size", "source_size", "target", copies.alias("copies"),
                        (copies * F.col("size")).alias("taken"))
