"""Near-duplicate classes by ProbMinHash.

A text is its distinct five-word shingles, weighted by how often it has them; the similarity of
two texts is their probability Jaccard, which is the common Jaccard where no shingle repeats.
Every shingle is a Poisson process whose rate is its weight: its arrivals each hit one of ``M``
registers, a register keeps its earliest arrival, and a shingle stops once it arrives later than
all registers of its text. Registers of two texts agree with the probability of their similarity.

Registers are banded, and texts that share a band are candidates. Every band has two leaders; of a
text's candidates the leaders it meets in most bands are verified on whole shingle sets, and verified
links are joined to components. Bands that then still hold several components
are searched in full, block against block: every text outside a band's largest component meets
every text of the band that isn't in its component. So each link that shares a band is found or
its ends are already joined, and no band has a cap. What is missed are links that share no band:
a pair at similarity s with a chance of about (1 - s ** 5) ** 30, 6.7e-6 at 0.8 and less above, unless
other links join its texts. Equal texts are one node throughout.

Defined results: a null text is empty; texts that differ in case or white space only are equal,
so all texts without words are one class; a text of one to four words has one shingle; the class
id is the smallest document id of its class, null if none has an id; repeated rows get a row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.components import components
from lettermill.llm.tables import written
from lettermill.llm.words import WORDS, in_chunks, mix, shingle_hashes, word_hashes

BANDS, ROWS = 30, 5
M = BANDS * ROWS
SIMILARITY = 0.8
BLOCK_TEXTS, LEADERS = 512, 4
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# --- in tasks ---------------------------------------------------------------------------------

def weighted_sets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    hashes, edges = shingle_hashes(texts, WORDS)
    return [np.unique(hashes[a:b], return_counts=True) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def prob_minhash(sets: list[tuple[np.ndarray, np.ndarray]], m: int = M) -> np.ndarray:
    """The shingles that ``m`` registers of each set keep; zeros for an empty set."""
    docs = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    items = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in sets)])
    rates = np.concatenate([np.zeros(0), *(w for _, w in sets)]).astype(np.float64)
    first, kept = np.full(len(sets) * m, np.inf), np.zeros(len(sets) * m, np.uint64)
    times, arrivals, batch = np.zeros(len(items)), 0, 1
    while len(items):
        numbers = np.arange(arrivals + 1, arrivals + batch + 1, dtype=np.uint64)
        drawn = mix(items[:, None] + numbers * _GOLDEN)
        gaps = -np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / rates[:, None]
        at = times[:, None] + np.cumsum(gaps, axis=1)
        register = ((mix(drawn ^ _GOLDEN) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        place = (docs[:, None] * m + register.astype(np.int64)).ravel()
        flat = at.ravel()
        better = np.flatnonzero(flat < first[place])
        np.minimum.at(first, place[better], flat[better])
        winners = better[first[place[better]] == flat[better]]
        kept[place[winners]] = np.repeat(items, batch)[winners]
        times, arrivals = at[:, -1], arrivals + batch
        held, of_doc = np.unique(docs, return_inverse=True)
        latest = first.reshape(-1, m)[held].max(axis=1)
        on = np.flatnonzero(times < latest[of_doc])
        docs, items, rates, times = docs[on], items[on], rates[on], times[on]
        batch = min(64, batch * 2) if arrivals > 1 else 1
    return kept.reshape(-1, m)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact similarity of two weighted sets with sorted hashes."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if a[1].max() == b[1].max() == 1:
        place = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
        both = np.count_nonzero(a[0][place] == b[0])
        return both / (len(a[0]) + len(b[0]) - both)
    union = np.union1d(a[0], b[0])
    x, y = np.zeros(len(union)), np.zeros(len(union))
    x[np.searchsorted(union, a[0])], y[np.searchsorted(union, b[0])] = a[1], b[1]
    x, y = x / x.sum(), y / y.sum()
    shared = np.flatnonzero((x > 0) & (y > 0))
    # For each shared shingle: sum of max(x / x_i, y / y_i), by the order of the ratios x / y.
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    above_x = np.concatenate((np.cumsum(x[order][::-1])[::-1], [0.0]))
    below_y = np.concatenate(([0.0], np.cumsum(y[order])))
    cut = np.searchsorted(ratio[order], ratio[shared], "right")
    return float(np.sum(1.0 / (above_x[cut] / x[shared] + below_y[cut] / y[shared])))


def _key(words: np.ndarray) -> bytes:
    return hashlib.md5(words.tobytes()).digest()


def _keys(texts: list[str]) -> list[bytes]:
    words, edges = word_hashes(texts)
    return [_key(words[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, stamp, key, sig): ids of documents, digests of their texts, keys of their words, 16 bits of each register."""
    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)
        for chunk in in_chunks(((d, s, t.as_py()) for d, s, t in rows), lambda row: len(row[2])):
            texts = [t for *_, t in chunk]
            sets = weighted_sets(texts)
            registers = mix(prob_minhash(sets)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([
                pa.array([d for d, *_ in chunk], pa.int64()), pa.array([s for _, s, _ in chunk], pa.binary()),
                pa.array(_keys(texts), pa.binary()),
                pa.array([r.tobytes() if len(s[0]) else None for r, s in zip(registers, sets, strict=True)], pa.binary())],
                names=["doc", "stamp", "key", "sig"])


def _as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, sig, hashes, counts) of texts that have the key they are wanted for."""
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True)
        for chunk in in_chunks(((n, k, s, t.as_py()) for n, k, s, t in rows), lambda row: len(row[3])):
            texts = [t for *_, t in chunk]
            found = [(node, sig, *s) for (node, key, sig, _), own, s in zip(chunk, _keys(texts), weighted_sets(texts), strict=True)
                     if key == own]
            yield pa.RecordBatch.from_arrays([
                pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary()),
                pa.array([f[2].tobytes() for f in found], pa.binary()),
                pa.array([f[3].astype(np.uint32).tobytes() for f in found], pa.binary())],
                names=["node", "sig", "hashes", "counts"])


def _set(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.uint32)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (a, b) of candidate rows whose sets are similar enough."""
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        sets = zip(*(batch.column(i) for i in range(2, 6)), strict=True)
        good = [probability_jaccard(_set(s[0].as_py(), s[1].as_py()), _set(s[2].as_py(), s[3].as_py())) >= SIMILARITY for s in sets]
        yield pa.RecordBatch.from_arrays([
            pa.array([x for x, g in zip(a, good, strict=True) if g], pa.int64()),
            pa.array([x for x, g in zip(b, good, strict=True) if g], pa.int64())], names=["a", "b"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components within tasks, which come sorted; a task's texts are one block against another.

    Rows are (task, band, role, node, root, sig, hashes, counts); the role is 0 for residents of a band's largest
    component, 1 for other residents, 2 for probes. A pair is checked in the first band that its
    texts share only, and two texts outside the largest component once; however few registers agree,
    whole sets decide, and the registers only give the order.
    """
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

    def search(group: list[tuple]) -> list[tuple[int, int]]:
        residents, probes = [r for r in group if r[2] < 2], [r for r in group if r[2] == 2]
        if not residents or not probes:
            return []
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        signatures = np.frombuffer(b"".join(r[5] for r in residents), np.uint16).reshape(len(residents), -1)
        sets = [_set(*r[6:]) for r in residents]
        nodes, other = np.array([r[3] for r in residents]), np.array([r[2] == 1 for r in residents])
        links = []
        for probe in probes:
            same = signatures == np.frombuffer(probe[5], np.uint16)
            near = same.mean(axis=1)
            first = same.reshape(len(residents), BANDS, ROWS).all(axis=2).argmax(axis=1)
            due = np.flatnonzero((first == probe[1]) & ~(other & (nodes <= probe[3])))
            own = _set(*probe[6:])
            for i in due[np.argsort(-near[due], kind="stable")].tolist():
                x, y = root(probe[4]), root(residents[i][4])
                if x != y and probability_jaccard(own, sets[i]) >= SIMILARITY:
                    links.append((probe[3], residents[i][3]))
                    parent[x] = y
        return links

    def flush(links: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    group, found = [], []
    for row in rows():
        if group and row[0] != group[0][0]:
            found += search(group)
            group = []
            if len(found) > 10_000:
                yield flush(found)
                found = []
        group.append(row)
    yield flush(found + (search(group) if group else []))


# --- the plan ------------------------------------------------------------------------------------

LINKS = "a long, b long"
NO_ID = -(2 ** 63)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, class_size) per row of ``docs``."""
    classed = written(_classed(docs, key, text))
    sizes = classed.groupBy("root").agg(F.min("doc").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return classed.join(sizes, "root").select(F.col("doc").alias(key), "class_id", "class_size")


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` per class, columns as they are: the smallest id, then the text with the smallest md5."""
    classed = written(_classed(docs, key, text))
    first = classed.groupBy("root").agg(F.min(F.struct(_id("doc").alias("doc"), "stamp")).alias("kept"))
    equal = classed.groupBy(_id("doc").alias("doc"), "stamp").agg(F.count(F.lit(1)).alias("rows"))
    kept = first.select("kept.*").join(equal, ["doc", "stamp"])
    rows = docs.select(F.struct(*docs.columns).alias("row"), _id(key).alias("doc"), _stamp(text).alias("stamp"))
    joined = rows.join(kept.hint("shuffle_hash"), ["doc", "stamp"])
    # Of equal rows one is taken; there are few.
    nth = F.row_number().over(Window.partitionBy("doc", "stamp").orderBy(F.xxhash64("row")))
    again = joined.filter("rows > 1").withColumn("nth", nth).filter("nth = 1").select("row")
    return joined.filter("rows = 1").select("row").unionByName(again).select("row.*")


def _id(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))


def _stamp(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _classed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, stamp, root) per row of ``docs``; rows of one class have one root."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), _stamp(text).alias("stamp"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = written(rows.mapInArrow(_signed, "doc long, stamp binary, key binary, sig binary"))
    texts = signed.groupBy("key").agg(F.min(_id("doc")).alias("rep"), F.min("sig").alias("sig"))
    # The written table gives each different text a number.
    texts = written(texts.withColumn("node", F.monotonically_increasing_id()))
    buckets = _buckets(texts.filter("sig is not null"))
    wanted = texts.join(buckets.select("node").distinct(), "node", "left_semi").select("rep", "node", F.col("key").alias("wanted"), "sig")
    # Texts move once, and only the wanted ones go on; their numbers, the smaller side, are hashed.
    found = rows.withColumn("rep", _id("doc")).join(wanted.hint("shuffle_hash"), "rep")
    sets = written(found.select("node", "wanted", "sig", "text").mapInArrow(
        _as_sets, "node long, sig binary, hashes binary, counts binary"))
    links = written(_checked(_with_leaders(buckets), sets))
    roots = written(components(links))
    links = links.unionByName(written(_rest(buckets, roots, sets)))
    rooted = texts.select("key", "node").join(components(links), "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    return signed.select("doc", "stamp", "key").join(rooted, "key").select("doc", "stamp", "root")


def _buckets(texts: DataFrame) -> DataFrame:
    """(bucket, band, node) of all bands that more than one text is in."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(
        i, F.substring("sig", (i * 2 * ROWS + 1).cast("int"), F.lit(2 * ROWS))))
    dealt = texts.select("node", F.posexplode(bands).alias("band", "bucket"))
    n = F.count(F.lit(1)).over(Window.partitionBy("bucket"))
    return written(dealt.withColumn("n", n).filter("n > 1").drop("n"))


def _with_leaders(buckets: DataFrame) -> DataFrame:
    """Each text with the leaders it meets in most bands; a band has one leader in each of two orders."""
    def least(seed: int) -> Column:
        return F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node"))["node"]

    leaders = buckets.groupBy("bucket").agg(F.array_distinct(F.array(least(0), least(1))).alias("leaders"))
    met = buckets.join(leaders, "bucket").select("node", F.explode("leaders").alias("leader")).filter("node <> leader").groupBy(
        "node", "leader").count()
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.col("count").desc(), "leader"))
    return met.withColumn("at", best).filter(F.col("at") <= LEADERS).select(F.col("node").alias("a"), F.col("leader").alias("b"))


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "ca", "hb", "cb").mapInArrow(_verified, LINKS)


def _numbers(below: str) -> Column:
    return F.sequence(F.lit(0), F.col(below) - 1).cast("array<bigint>")


def _rest(buckets: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within bands that still hold several components, all others of a band against its texts."""
    rooted = buckets.join(roots, "node", "left").select("bucket", "band", "node", F.coalesce("root", "node").alias("root"))
    shares = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = shares.groupBy("bucket").agg(
        F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    mixed = written(rooted.join(largest.filter("parts > 1"), "bucket").select(
        "bucket", "band", "node", "root", F.col("top.root").alias("top"), F.ceil(F.col("n") / BLOCK_TEXTS).cast("int").alias("blocks"),
        F.ceil((F.col("n") - F.col("top.n")) / BLOCK_TEXTS).cast("int").alias("probe_blocks")))
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node"), F.col("probe_blocks"))
    residents = mixed.select("bucket", "band", "node", "root", (F.col("root") != F.col("top")).cast("int").alias("role"), own.alias("x"),
                             F.explode(_numbers("probe_blocks")).alias("y"))
    probes = mixed.filter("root <> top").select("bucket", "band", "node", "root", F.lit(2).alias("role"),
                                                F.explode(_numbers("blocks")).alias("x"), other.alias("y"))
    both = residents.unionByName(probes).select(F.concat_ws(" ", "bucket", "x", "y").alias("task"), "band", "role", "node", "root")
    blocks = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = both.join(sets, "node").repartition(blocks, "task").sortWithinPartitions("task")
    return ready.select("task", "band", "role", "node", "root", "sig", "hashes", "counts").mapInArrow(_searched, LINKS)
