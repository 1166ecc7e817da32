"""Repeated passages by hashes of sparse suffixes and of windows.

This stands in for a sorted sparse suffix array: nothing is sorted and no neighbours are compared, but
equal hashes are grouped. A group is then an aggregation, counted map-side, while a sort by words would
move the words of all suffixes and, unless salted, put a passage that very many texts share into one
range. Runs of words count as equal if two hashes of 64 bits are, one of the first ``K`` words and one of all.

Of all suffixes only those at minimisers are kept: of the ``WORDS - K + 1`` runs of ``K`` words in
every window of ``WORDS`` words, the first of the least hash. Equal windows choose the same place,
so every window has one suffix that stands for it, and a suffix stands for a stretch of windows.

Suffixes are grouped by the hash of their first ``K`` words. Where suffixes also agree in all words of
their windows, to the left and to the right, they match as a whole, and one row stands for them, the
first by document and place. Where a group holds suffixes that disagree somewhere, each of their kinds
is expanded into the hashes of all its windows, and these are grouped again. So a word is reported
exactly if it lies in a run of ``WORDS`` words that occurs again anywhere.

Groups are counted map-side before they are shuffled, nothing is listed per group, and a suffix
moves as a few numbers; texts move once, to those suffixes that have to be extended.

Defined results: a null text is empty; texts of under ``WORDS`` words have no rows; words are
compared as they are, case included, white space not; occurrences within one text count; the
first occurrence in order of document id, text and place isn't removed; rows with equal ids and texts are one
text, which repeats; a null id comes first; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.tables import written
from lettermill.llm.words import in_chunks, mix, placed_words, run_hashes

WORDS, K = 50, 8
_PLACE = np.uint64((1 << 26) - 1)
NO_ID = -(2 ** 63)


def minimisers(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place, first, last): minimiser places and the first and last starts of the windows they stand for."""
    width = WORDS - K + 1
    n = len(words) - WORDS + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    runs = np.arange(len(words) - K + 1)
    least = (mix(run_hashes(words, runs, runs + K)) & ~_PLACE) | runs.astype(np.uint64)
    size = 1
    while size * 2 <= width:
        least = np.minimum(least[:len(least) - size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[width - size:width - size + n])
    starts = np.arange(n)
    text = np.searchsorted(offsets, starts, "right") - 1
    within = np.flatnonzero(starts + WORDS <= offsets[text + 1])
    place, text, starts = (least[within] & _PLACE).astype(np.int64), text[within], starts[within]
    opens = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])))) if len(place) else within
    closes = np.concatenate((opens[1:], [len(place)]))[:len(opens)] - 1
    return text[opens], place[opens], starts[opens], starts[closes]


def _text_keys(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return run_hashes(words, offsets[:-1], offsets[1:]).view(np.int64)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text_key, k_words, around, first, start, end): the suffixes of all texts, their places in words and code points."""
    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
        for chunk in in_chunks(((d, t.as_py()) for d, t in pairs), lambda pair: len(pair[1])):
            words, offsets, (starts, ends) = placed_words([t for _, t in chunk])
            text, place, first, last = minimisers(words, offsets)
            around = mix(run_hashes(words, first, last + WORDS) + (place - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            docs, keys = np.array([d for d, _ in chunk], np.int64), _text_keys(words, offsets)
            yield pa.RecordBatch.from_arrays([
                pa.array(docs[text]), pa.array(keys[text]), pa.array(run_hashes(words, place, place + K).view(np.int64)),
                pa.array(around.view(np.int64)), pa.array((first - offsets[text]).astype(np.int32)),
                pa.array(starts[first].astype(np.int32)), pa.array(ends[last + WORDS - 1].astype(np.int32))],
                names=["doc", "text_key", "k_words", "around", "first", "start", "end"])


SUFFIX = "doc long, text_key long, k_words long, around long, first int, start int, end int"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text_key, k_words, window, start, end) of all windows of the suffixes asked for, given per text by ``first``."""
    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True)
        for chunk in in_chunks(((d, k, f, t.as_py()) for d, k, f, t in rows), lambda row: len(row[3])):
            words, offsets, (starts, ends) = placed_words([t for *_, t in chunk])
            right = _text_keys(words, offsets) == np.array([k for _, k, _, _ in chunk], np.int64)
            text, place, first, last = minimisers(words, offsets)
            counts = np.array([len(f) if ok else 0 for (_, _, f, _), ok in zip(chunk, right, strict=True)])
            wanted = np.concatenate([np.zeros(0, np.int64), *(f for (_, _, f, _), ok in zip(chunk, right, strict=True) if ok)]).astype(np.int64)
            kept = np.flatnonzero(np.isin(first, wanted + np.repeat(offsets[:-1], counts)))
            text, place, first, last = text[kept], place[kept], first[kept], last[kept]
            sizes = last - first + 1
            window = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            docs, keys = np.array([d for d, *_ in chunk], np.int64), np.array([k for _, k, _, _ in chunk], np.int64)
            owner = np.repeat(text, sizes)
            yield pa.RecordBatch.from_arrays([
                pa.array(docs[owner]), pa.array(keys[owner]),
                pa.array(np.repeat(run_hashes(words, place, place + K).view(np.int64), sizes)),
                pa.array(run_hashes(words, window, window + WORDS).view(np.int64)),
                pa.array(starts[window].astype(np.int32)), pa.array(ends[window + WORDS - 1].astype(np.int32))],
                names=["doc", "text_key", "k_words", "window", "start", "end"])


WINDOW = "doc long, text_key long, k_words long, window long, start int, end int"
SPANS = "array<struct<start:int,end:int>>"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each text joined where they overlap, once all and once those to remove."""
    def join(spans: list[dict]) -> list[dict]:
        out: list[dict] = []
        for s in sorted(spans, key=lambda s: s["start"]):
            if out and s["start"] <= out[-1]["end"]:
                out[-1]["end"] = max(out[-1]["end"], s["end"])
            else:
                out.append({"start": s["start"], "end": s["end"]})
        return out

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        lists = batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([join(spans) for spans in lists], kind),
            pa.array([join([s for s in spans if s["again"]]) for spans in lists], kind)],
            names=["doc", "text_key", "repeated", "removed"])


def _ordered(place: str) -> Column:
    return F.struct("doc", "text_key", place)


def _is_first(least: str, place: str) -> Column:
    return (F.col(f"{least}.doc") == F.col("doc")) & (F.col(f"{least}.text_key") == F.col("text_key")) & (
        F.col(f"{least}.{place}") == F.col(place))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_key, repeated, removed) of all texts with passages that occur again: spans of code points.

    ``removed`` leaves out what occurs for the first time. ``text_key`` tells texts of equal ids apart.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    suffixes = written(rows.mapInArrow(_suffixes, SUFFIX))
    group = ["k_words", "around"]
    alike = suffixes.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min(_ordered("first")).alias("least"))
    disagree = alike.groupBy("k_words").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).filter("all > 1")
    # What is left is a small part: suffixes whose first words occur again.
    alike = written(alike.join(disagree.select("k_words", "kinds"), "k_words"))
    whole = suffixes.join(alike.filter("n > 1").select(*group, "least"), group).select(
        "doc", "text_key", "start", "end", (~_is_first("least", "first")).alias("again"))
    # Each kind of a group that holds several is extended from its first suffix.
    asked = alike.filter("kinds > 1").groupBy(F.col("least.doc").alias("doc"), F.col("least.text_key").alias("text_key")).agg(
        F.collect_set("least.first").alias("firsts"))
    windows = written(rows.join(asked.hint("shuffle_hash"), "doc").select("doc", "text_key", "firsts", "text").mapInArrow(_windows, WINDOW))
    pair = ["k_words", "window"]
    twice = windows.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"), F.min(_ordered("start")).alias("least")).filter("n > 1")
    parts = windows.join(twice.drop("n"), pair).select("doc", "text_key", "start", "end", (~_is_first("least", "start")).alias("again"))
    # One text's spans meet in one row, as its words do.
    spans = whole.unionByName(parts).groupBy("doc", "text_key").agg(F.collect_set(F.struct("start", "end", "again")).alias("spans"))
    merged = spans.mapInArrow(_merged, f"doc long, text_key long, repeated {SPANS}, removed {SPANS}")
    return merged.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias(key), "text_key", "repeated", "removed")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text): spans are taken out of the texts they belong to, rows pass through."""
    for batch in batches:
        names = batch.schema.names
        texts, keys, spans = (batch.column(names.index(n)) for n in ("text", "keys", "spans"))
        done = []
        for chunk in in_chunks(range(batch.num_rows), lambda i: len(texts[i].as_py())):
            bodies = [texts[i].as_py() for i in chunk]
            words, offsets, _ = placed_words(bodies)
            for i, text, own in zip(chunk, bodies, _text_keys(words, offsets).tolist(), strict=True):
                at, left = 0, []
                for span in (s for k, of_text in zip(keys[i].as_py() or [], spans[i].as_py() or [], strict=True) if k == own for s in of_text):
                    left.append(text[at:span["start"]])
                    at = span["end"]
                done.append("".join(left) + text[at:])
        yield pa.RecordBatch.from_arrays([batch.column(names.index("row")), pa.array(done, pa.string())], names=["row", "text"])


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with all but the first occurrence of each passage cut out of ``text``; other columns stay."""
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"), F.struct(*others).alias("row"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = repeated_passages(docs, key, text).select(F.coalesce(key, F.lit(NO_ID)).alias("doc"), "text_key", "removed").filter(
        F.size("removed") > 0)
    spans = found.groupBy("doc").agg(F.collect_list(F.struct("text_key", "removed")).alias("s"))
    joined = rows.join(spans.hint("shuffle_hash"), "doc", "left").select(
        "row", "text", F.col("s.text_key").alias("keys"), F.col("s.removed").alias("spans"))
    # Only texts that lose something go through Python.
    cut = joined.filter("keys is not null").mapInArrow(_cut, f"row {joined.schema['row'].dataType.simpleString()}, text string")
    both = cut.unionByName(joined.filter("keys is null").select("row", "text"))
    return both.select(*(F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))
