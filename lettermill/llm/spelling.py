"""Spelling variants: words within one edit, by dynamic programming along the sorted vocabulary.

Words that share a prefix stand together in a sorted list, so a row of the edit matrix that was
worked out for a prefix holds for the whole range of words under it. A scan goes down the list prefix by
prefix: ranges split where adjacent words' longest common prefix ends, each range's row follows from
its parent's, only the three cells about the diagonal are kept, and a range whose row exceeds one
edit is skipped whole. All words of a block are looked up in the block's list at once.

An edit leaves the letters before it and behind it alone. So of two words within one edit, with ``c`` letters
the shorter, either the first ``c // 2`` are equal, or the last ``c - c // 2`` are: the scan
runs over words that share such a prefix, and over reversed words that share such a suffix and
no such prefix, so no pair is found twice. These blocks are the shuffle's keys. Where many words share one,
its list and its look-ups are each cut into parts, and every part of the look-ups scans every
part of the list; work follows the ranges that are entered, not the number of pairs.

Tasks count what they find per word before it is shuffled. Roots follow forms by pointer doubling.

Defined results: words are compared by code points; a null word and words of under two letters have no row; a word
that is given twice counts as the sum of both; an empty vocabulary gives an empty result. Of texts: a null
text has no words, a null id counts as the empty text, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.tables import written

LETTERS, UPPER, LOWER = r"[A-Za-zÀ-ÿ]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_TIMES, EVERY = 5, 3, 97
LIST_WORDS, BATCH_WORDS, QUERIES, LONG = 100_000, 40_000, 4_000, 64


# --- the scan of one list -----------------------------------------------------------------

def one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two arrays of code points, the first at most one longer or shorter, differ by exactly one edit."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    if not len(differ):
        return len(a) != len(b)
    i = int(differ[0])
    return np.array_equal(a[i + (len(a) >= len(b)):], b[i + (len(b) >= len(a)):])


def scan(letters: np.ndarray, starts_anew: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray,
         queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of all words one edit away from a query.

    ``letters`` has the sorted list's words of ``c`` and ``c + 1`` letters as rows of ``c + 1`` code points, 0 behind the
    shorter; ``starts_anew`` marks words that begin another list. ``queries`` has words of ``c`` letters, each with the range
    ``low`` to ``high`` of its list, whose first ``depth`` letters are its own. ``places`` numbers the queries.
    """
    size, width = letters.shape
    c = width - 1
    # Where adjacent words' common prefix ends; -1 at a list's beginning.
    differ = letters[1:] != letters[:-1]
    common = np.concatenate(([-1], np.where(differ.any(axis=1), differ.argmax(axis=1), width)))
    common[starts_anew] = -1
    found_q, found_w = [], []
    q, lo, hi = np.arange(len(queries)), low, high
    # Cells for the query's first depth - 1, depth and depth + 1 letters.
    row = np.ones((3, len(q)), np.int8)
    row[1] = 0
    padded = np.concatenate((queries, np.zeros((len(queries), 2), queries.dtype)), axis=1)

    def report(hits: np.ndarray) -> None:
        found_q.append(places[q[hits]])
        found_w.append(lo[hits])

    for d in range(depth, width):
        if not len(q):
            break
        if c > LONG and (hi - lo == 1).all():
            # Long words alone in their ranges are compared as they are.
            hits = np.array([one_edit(queries[a], letters[b][letters[b] != 0]) for a, b in zip(q.tolist(), lo.tolist(), strict=True)])
            report(np.flatnonzero(hits))
            q = q[:0]
            break
        if d == c:
            report(np.flatnonzero((letters[lo, c] == 0) & (row[1] == 1)))
        # Ranges fall apart where the next letter changes.
        opens = np.flatnonzero(common <= d)
        closes = np.concatenate((opens[1:], [size]))
        upto = np.cumsum(common <= d)
        first, last = upto[lo] - 1, upto[hi - 1]
        n = last - first
        parent = np.repeat(np.arange(len(q)), n)
        child = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(parent))
        lo, letter, old, q = opens[child], letters[opens[child], d], row[:, parent], q[parent]
        hi = np.minimum(closes[child], hi[parent])
        miss = padded[q[None, :], np.array([[d - 1], [d], [d + 1]])] != letter
        first_cell = np.minimum(old[1] + 1, old[0] + miss[0])
        second = np.minimum(np.minimum(old[2] + 1, old[1] + miss[1]), first_cell + 1) if d < c else np.full(len(q), 2)
        third = np.minimum(old[2] + miss[2], second + 1) if d + 1 < c else np.full(len(q), 2)
        row = np.stack((first_cell, second, third)).astype(np.int8)
        kept = np.flatnonzero((row.min(axis=0) <= 1) & (letter != 0))
        q, lo, hi, row = q[kept], lo[kept], hi[kept], row[:, kept]
    if len(q):
        report(np.flatnonzero(row[0] == 1))
    none = np.zeros(0, np.int64)
    return np.concatenate((none, *found_q)), np.concatenate((none, *found_w))


# --- blocks -------------------------------------------------------------------------------

BLOCK = ["backward", "c", "shared", "list_part", "query_part"]


def _blocks(words: DataFrame) -> DataFrame:
    """Words (word, n) under the keys of all blocks they belong to: in the list, among the look-ups or both."""
    size = F.length("word")
    classes = F.explode(F.array(*(F.struct(F.lit(way).alias("backward"), (size - less).alias("c")) for way in (False, True) for less in (0, 1))))
    keyed = words.select("word", "n", classes.alias("k")).select("word", "n", "k.*").filter("c > 1")
    half = F.expr("c div 2")
    keyed = keyed.withColumn("shared", F.when(F.col("backward"), F.right("word", F.col("c") - half)).otherwise(F.left("word", half)))
    key = BLOCK[:3]
    # Blocks of more words than a part: at most one for so many rows.
    crowded = keyed.groupBy(*key).count().filter(F.col("count") > LIST_WORDS).select(
        *key, F.ceil(F.col("count") / LIST_WORDS).cast("int").alias("parts"))
    parted = keyed.join(F.broadcast(crowded), key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn(
        "part", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    # A part of the list meets all parts of the look-ups; with one part a word has both roles in one row.
    roles = F.concat(
        F.transform(every, lambda i: F.struct(F.col("part").alias("list_part"), i.alias("query_part"), F.lit(True).alias("listed"),
                                              (i == F.col("part")).alias("asks"))),
        F.transform(F.filter(every, lambda i: i != F.col("part")), lambda i: F.struct(
            i.alias("list_part"), F.col("part").alias("query_part"), F.lit(False).alias("listed"), F.lit(True).alias("asks"))))
    return parted.select("word", "n", *key, F.inline(roles))


def _letters(words: pa.Array, width: int) -> np.ndarray:
    """Code points of words in rows of ``width``, 0 behind the shorter."""
    sizes = pc.utf8_length(words).to_numpy()
    flat = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros((len(sizes), width), np.uint32)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _near(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """(word, n_near, form_n, form) of what the blocks of one direction and length have found; rows are sorted."""
    if not rows.num_rows:
        return
    backward, c = rows["backward"][0].as_py(), rows["c"][0].as_py()
    scanned = rows["scanned"].combine_chunks()
    plain = pc.utf8_reverse(scanned) if backward else scanned
    n = rows["n"].to_numpy()
    listed, asks = rows["listed"].to_numpy(), rows["asks"].to_numpy() & (pc.utf8_length(scanned).to_numpy() == c)
    block = rows["number"].to_numpy()
    in_list, asked = np.flatnonzero(listed), np.flatnonzero(asks)
    if not len(in_list) or not len(asked):
        return
    letters = _letters(scanned, c + 1)
    listed_block = block[in_list]
    anew = np.flatnonzero(np.concatenate(([True], listed_block[1:] != listed_block[:-1])))
    own, half, sizes = letters[in_list], c // 2, pc.utf8_length(scanned).to_numpy()
    rank = np.empty(len(plain), np.int64)
    rank[pc.sort_indices(plain).to_numpy()] = np.arange(len(plain))
    for start in range(0, len(asked), QUERIES):
        part = asked[start:start + QUERIES]
        low, high = np.searchsorted(listed_block, block[part]), np.searchsorted(listed_block, block[part], "right")
        part, low, high = (x[high > low] for x in (part, low, high))
        q, w = scan(own, anew, part, low, high, letters[part][:, :c], c - half if backward else half)
        w = in_list[w]
        if backward:
            # Pairs of one prefix were found by the other direction.
            ends = sizes[w][:, None] - 1 - np.arange(half)
            new = (letters[w[:, None], ends] != letters[q][:, c - 1 - np.arange(half)]).any(axis=1)
            q, w = q[new], w[new]
        # Words of the same length find each other; a longer one is told.
        longer = letters[w, c] != 0
        a, b = np.concatenate((q, w[longer])), np.concatenate((w, q[longer]))
        if not len(a):
            continue
        order = np.lexsort((rank[b], -n[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        counts = np.diff(np.concatenate((first, [len(a)])))
        yield pa.RecordBatch.from_arrays([
            plain.take(pa.array(a[first])), pa.array(counts), pa.array(n[b[first]]), plain.take(pa.array(b[first]))],
            names=["word", "n_near", "form_n", "form"])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collects whole blocks of one direction and length, about ``BATCH_WORDS`` words at a time, and scans them."""
    held: list[pa.Table] = []
    size, number, last = 0, 0, None
    for batch in batches:
        keys = list(zip(*(batch.column(batch.schema.names.index(k)).to_pylist() for k in BLOCK), strict=True))
        before = [last, *keys[:-1]]
        opens = [i for i, key in enumerate(keys) if key != before[i]]
        numbers = np.zeros(len(keys), np.int64)
        numbers[opens] = 1
        numbers = number + np.cumsum(numbers)
        table, begin = pa.Table.from_batches([batch]).append_column("number", pa.array(numbers)), 0
        for i in opens:
            if before[i] and (keys[i][:2] != before[i][:2] or size + i - begin >= BATCH_WORDS):
                yield from _near(pa.concat_tables([*held, table.slice(begin, i - begin)]))
                held, size, begin = [], 0, i
        held.append(table.slice(begin))
        if keys:
            size, number, last = size + len(keys) - begin, int(numbers[-1]), keys[-1]
    if held:
        yield from _near(pa.concat_tables(held))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, n_near, form_n, form) of a written vocabulary (word, n): how many words are one edit away, and the most frequent of them."""
    blocks = _blocks(vocabulary).withColumn("scanned", F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word")))
    order = [*BLOCK, "scanned"]
    found = blocks.select(*order, "n", "listed", "asks").repartition(*BLOCK).sortWithinPartitions(*order).mapInArrow(
        _scanned, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words of a written table (word, form) that have a form: the last one, followed from word to form.

    Each round doubles the way every word has come, so rounds are few.
    """
    ways = written(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(ways.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ways = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return ways


def group_spellings(vocabulary: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n).

    ``form`` is the most frequent near word, of equally frequent ones the first by code points, if it is ``times`` as frequent.
    """
    words = written(vocabulary.filter(F.length("word") > 1).groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    near = near_words(words)
    takes = F.col("form_n") >= times * F.col("n")
    table = written(near.select("word", "n", "n_near", F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n")))
    return table.join(roots(table.select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# --- words of texts ------------------------------------------------------------------------

def _misspelt(key: Column, run: Column, every: int) -> Column:
    """``run`` without one letter where ``every`` divides the checksum of key and run."""
    code = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    at = F.pmod(code, F.length(run)).cast("int")
    return F.when(code % every == 0, F.concat(F.left(run, at), F.substr(run, at + 2))).otherwise(run)


def text_vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = EVERY, letters: int = LEAST_LETTERS,
                    times: int = LEAST_TIMES) -> DataFrame:
    """(word, n): words of at least ``letters`` letters in whole texts that occur ``times`` or more."""
    runs = docs.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(
        F.col(text), F.lit(LETTERS + "{%d,}" % letters), F.lit(0))).alias("run"))
    lower = runs.select("key", F.translate("run", UPPER, LOWER).alias("run"))
    words = lower.select(_misspelt(F.col("key"), F.col("run"), every).alias("word")).filter(F.length("word") >= letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)
