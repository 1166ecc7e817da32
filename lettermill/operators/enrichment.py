"""Paid calls made once per content key: plan, call, keep, reassemble."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions.calls import RATES, call_price
from lettermill.functions.keys import document_track_key, speech_key, translate_key
from lettermill.functions.language import is_english, normalize_language, supports_speech
from lettermill.functions.text import ERROR_LIMIT, SPEECH_LIMIT, TRANSLATE_LIMIT
from lettermill.operators.chunks import explode_chunks
from lettermill.session import pin

KEY = "idempotency_key"
LEDGER_SCHEMA = f"{KEY} string, attempts int, status string, result string, lease_until timestamp, last_error string"
ENGLISH_CODE = "en-IN"


def plan_calls(work: DataFrame, ledger: DataFrame, now: Column) -> DataFrame:
    """What to do for each unit of work, given the ledger.

    REUSE a stored result, TAKEOVER a call that never finished, leave a running one (BUSY),
    or make a NEW call. ``next_attempt`` is set where a call is due.
    """
    known = ledger.select(KEY, F.col("attempts").alias("_attempts"), F.col("status").alias("_status"),
                          F.col("result").alias("_result"), F.col("lease_until").alias("_lease"))
    joined = work.join(known, KEY, "left")
    status = F.col("_status")
    action = (
        F.when(status.isNull(), "NEW").when(status == "DONE", "REUSE")
        .when((status == "PENDING") | (F.col("_lease") < now), "TAKEOVER").otherwise("BUSY")
    )
    planned = joined.withColumn("action", action)
    due = F.when(F.col("action") == "NEW", 1).when(F.col("action") == "TAKEOVER", F.col("_attempts") + 1)
    stored = F.when(F.col("action") == "REUSE", F.col("_result"))
    return planned.withColumn("next_attempt", due.cast("int")).withColumn("stored_result", stored).drop(
        "_attempts", "_status", "_result", "_lease")


def distinct_calls(work: DataFrame, order: list[str]) -> DataFrame:
    """One row per key: the first requester in ``order`` pays. Copies are dropped before the shuffle."""
    first = F.row_number().over(Window.partitionBy(KEY).orderBy(*order))
    return work.withColumn("_rn", first).filter(F.col("_rn") == 1).drop("_rn")


def enrich(calls: DataFrame, fn: Callable[[str], str], payload: str = "chunk", concurrency: int = 8) -> DataFrame:
    """Make each due call and return its ledger row: DONE with a result, or PENDING with the error.

    ``concurrency`` bounds the calls in flight. Spark may repeat a task, so switch
    speculation off and write or pin the outcome before using it twice.
    """
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results, errors = [], []
            for text in batch[payload]:
                try:
                    found = fn(text)
                    results.append(found)
                    errors.append("the call returned nothing" if found is None else None)
                except Exception as error:  # a failed call is an outcome
                    results.append(None)
                    errors.append(f"{type(error).__name__}: {error}"[:ERROR_LIMIT])
            yield pd.DataFrame({
                KEY: batch[KEY].to_numpy(), "attempts": batch["next_attempt"].to_numpy(),
                "status": ["DONE" if e is None else "PENDING" for e in errors],
                "result": pd.Series(results, dtype="object"), "lease_until": pd.Series([pd.NaT] * len(batch)),
                "last_error": pd.Series(errors, dtype="object")})

    due = calls.filter(F.col("next_attempt").isNotNull()).select(KEY, "next_attempt", payload)
    return due.repartition(concurrency, KEY).mapInPandas(call, LEDGER_SCHEMA)


def merge_ledger(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The next ledger snapshot: one row per key, and DONE is never taken back."""
    columns = [c for c in outcomes.columns if c != KEY]
    old = ledger.select(KEY, F.struct(*(
        F.col(c) if c in ledger.columns else F.lit(None).cast(dict(outcomes.dtypes)[c]).alias(c)
        for c in columns)).alias("_old"))
    new = outcomes.select(KEY, F.struct(*columns).alias("_new"))
    keep = (F.col("_old.status") == "DONE") | F.col("_new").isNull()
    merged = old.join(new, KEY, "full").withColumn(
        "_row", F.when(F.coalesce(keep, F.lit(False)), F.col("_old")).otherwise(F.col("_new")))
    return merged.select(KEY, "_row.*")


def reassemble(chunks: DataFrame, by: list[str], text: str = "result", index: str = "chunk_index",
               out: str = "text") -> DataFrame:
    """Join the chunks of each page by one space in index order; null while one is missing."""
    parts = F.array_sort(F.collect_list(F.struct(index, text)))
    whole = F.array_join(F.transform(parts, lambda p: p[text]), " ")
    missing = F.bool_or(F.col(text).isNull())
    return chunks.groupBy(*by).agg(F.when(~missing, whole).alias(out))


class Enriched(NamedTuple):
    results: DataFrame
    outcomes: DataFrame
    ledger: DataFrame


def _run_calls(work: DataFrame, ledger: DataFrame, fn, now, order, concurrency) -> tuple[DataFrame, DataFrame]:
    """Outcomes of the calls that are due, pinned so that no call is paid twice, and work with results."""
    planned = plan_calls(distinct_calls(work, order), ledger, now)
    outcomes = pin(enrich(planned, fn, "chunk", concurrency))
    done = outcomes.filter(F.col("status") == "DONE").select(KEY, "result")
    stored = ledger.filter(F.col("status") == "DONE").select(KEY, "result")
    return outcomes, work.join(stored.unionByName(done), KEY, "left")


def translate_work(pages: DataFrame, docs: DataFrame, limit: int = TRANSLATE_LIMIT) -> DataFrame:
    """Chunks with keys of the pages that need translating."""
    ready = pages.filter(F.col("status") == "OCR_DONE").select("document_id", "page_no", "original_text")
    foreign = docs.filter(~is_english("language")).select(
        "document_id", normalize_language("language").alias("source_language"))
    chunks = explode_chunks(ready.join(foreign, "document_id"), "original_text", limit)
    page_id = F.concat_ws("/", F.col("document_id").cast("string"), F.col("page_no").cast("string"))
    return chunks.withColumn(KEY, translate_key(page_id, "chunk_index", "chunk"))


def translate_pages(pages: DataFrame, docs: DataFrame, ledger: DataFrame, fn: Callable[[str], str], now: Column,
                    limit: int = TRANSLATE_LIMIT, concurrency: int = 8) -> Enriched:
    """Translate every OCR_DONE page; English pages pass through without a call.

    ``results`` has one row per page with ``translated_text`` (null while a chunk is
    missing) and the ``text_hash`` it was made from, ready for ``apply_translations``.
    """
    work = translate_work(pages, docs, limit)
    outcomes, answered = _run_calls(work, ledger, fn, now, ["document_id", "page_no", "chunk_index"], concurrency)
    translated = reassemble(answered, ["document_id", "page_no"], out="_translated")
    ready = pages.filter(F.col("status") == "OCR_DONE").join(docs.select("document_id", "language"), "document_id")
    text = F.when(is_english("language"), F.col("original_text")).otherwise(F.col("_translated"))
    results = ready.join(translated, ["document_id", "page_no"], "left").select(
        "document_id", "page_no", "text_hash", text.alias("translated_text"))
    return Enriched(results, outcomes, merge_ledger(ledger, outcomes))


def speech_requests(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Tracks to speak: always the English translation, the original where its language allows."""
    ready = pages.filter(F.col("status") == "TRANSLATED").join(
        docs.select("document_id", "owner_id", "language"), "document_id")
    fields = lambda track, text, language: F.struct(
        F.lit(track).alias("track"), F.col(text).alias("text"), language.alias("speech_language"))
    english = fields("en", "translated_text", F.lit(ENGLISH_CODE))
    original = fields("orig", "original_text", normalize_language("language"))
    both = ~is_english("language") & supports_speech("language")
    tracks = F.when(both, F.array(english, original)).otherwise(F.array(english))
    return ready.select("document_id", "page_no", "owner_id", F.inline(tracks))


def speech_work(pages: DataFrame, docs: DataFrame, limit: int = SPEECH_LIMIT) -> DataFrame:
    """Chunks with keys of the tracks to speak; equal chunks of one owner share a key."""
    chunks = explode_chunks(speech_requests(pages, docs), "text", limit)
    return chunks.withColumn(KEY, speech_key("owner_id", "speech_language", "chunk"))


def speak_pages(pages: DataFrame, docs: DataFrame, ledger: DataFrame, fn: Callable[[str], str], now: Column,
                limit: int = SPEECH_LIMIT, concurrency: int = 8) -> Enriched:
    """Speak every TRANSLATED page; ``results`` has per track the stored segment keys in order."""
    work = speech_work(pages, docs, limit)
    outcomes, answered = _run_calls(work, ledger, fn, now,
                                    ["document_id", "page_no", "track", "chunk_index"], concurrency)
    results = reassemble(answered, ["document_id", "page_no", "track"], out="segment_keys")
    return Enriched(results, outcomes, merge_ledger(ledger, outcomes))


def cache_savings(work: DataFrame, ledger: DataFrame, now: Column, rates=RATES) -> DataFrame:
    """Calls, units and cost per endpoint that the ledger and in-batch copies make unnecessary.

    ``work`` has ``endpoint`` and ``units`` per unit of work.
    """
    per_key = work.groupBy(KEY, "endpoint").agg(
        F.count(F.lit(1)).alias("asked"), F.sum("units").alias("asked_units"), F.min("units").alias("units"))
    planned = plan_calls(per_key, ledger, now)
    calls = F.when(F.col("action") == "REUSE", F.col("asked")).otherwise(F.col("asked") - 1)
    units = F.when(F.col("action") == "REUSE", F.col("asked_units")).otherwise(F.col("asked_units") - F.col("units"))
    saved = planned.groupBy("endpoint").agg(
        F.sum(calls).cast("bigint").alias("calls_avoided"), F.sum(units).cast("bigint").alias("units_avoided"))
    return saved.withColumn("cost_avoided", call_price("endpoint", "units_avoided", rates, "decimal(20,4)"))


def track_manifest(pages: DataFrame, segments: DataFrame) -> DataFrame:
    """Per document and track: page segments in page order, without failed or capped pages."""
    usable = pages.filter(~F.col("status").isin("FAILED", "CAPPED")).select("document_id", "page_no")
    joined = segments.join(usable, ["document_id", "page_no"])
    # A document has at most 30 pages.
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "key", "frames")))
    grouped = joined.groupBy("document_id", "track").agg(
        ordered.alias("segments"), F.sum("frames").cast("bigint").alias("total_frames"))
    return grouped.withColumn("track_key", document_track_key("document_id", "track"))


def format_conflicts(segments: DataFrame) -> DataFrame:
    """Tracks whose segments differ in format, which cannot be joined."""
    grouped = segments.groupBy("document_id", "track").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("frames").cast("bigint").alias("total_frames"),
        F.min("format").alias("_low"), F.max("format").alias("_high"))
    return grouped.withColumn("conflict", F.col("_low") != F.col("_high")).drop("_low", "_high")


def resolve_track(requests: DataFrame, docs: DataFrame, tracks: DataFrame) -> DataFrame:
    """The track served for each request (``request_id, owner_id, document_id, lang``).

    ``orig`` falls back to ``en``; a document of another owner does not exist.
    """
    owned = docs.select("document_id", "owner_id", F.lit(True).alias("_owned"))
    present = tracks.groupBy("document_id").agg(
        F.bool_or(F.col("track") == "orig").alias("_orig"), F.bool_or(F.col("track") == "en").alias("_en"))
    joined = requests.join(owned, ["document_id", "owner_id"], "left").join(present, "document_id", "left")
    orig, en = F.coalesce("_orig", F.lit(False)), F.coalesce("_en", F.lit(False))
    wants_orig = F.col("lang") == "orig"
    status = (
        F.when(~F.col("lang").isin("orig", "en"), "INVALID").when(F.col("_owned").isNull(), "NOT_FOUND")
        .when(wants_orig & orig, "FOUND").when(wants_orig & en, "FALLBACK").when(~wants_orig & en, "FOUND")
        .otherwise("NOT_FOUND")
    )
    served = joined.withColumn("outcome", status)
    track = F.when(F.col("outcome") == "FOUND", F.col("lang")).when(F.col("outcome") == "FALLBACK", "en")
    return served.select("request_id", "document_id", "lang", "outcome",
                         F.when(track.isNotNull(), document_track_key("document_id", track)).alias("track_key"))
