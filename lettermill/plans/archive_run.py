"""A whole run over an archive: recovered text to settled documents, in batch."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.text import SPEECH_LIMIT, TRANSLATE_LIMIT
from lettermill.operators.enrichment import speak_pages, translate_pages
from lettermill.operators.limits import DAILY_WORDS
from lettermill.operators.ocr_results import apply_ocr
from lettermill.operators.state import apply_audio, apply_translations, index_settled_pages, settle_documents
from lettermill.session import pin


class ArchiveRun(NamedTuple):
    pages: DataFrame
    documents: DataFrame
    translation_ledger: DataFrame
    speech_ledger: DataFrame


def run_archive(docs: DataFrame, pages: DataFrame, batches: DataFrame, parsed: DataFrame,
                translation_ledger: DataFrame, speech_ledger: DataFrame,
                translate: Callable[[str], str], speak: Callable[[str], str], now: Column, day: Column,
                used: DataFrame | None = None, cap: int = DAILY_WORDS,
                translate_limit: int = TRANSLATE_LIMIT, speech_limit: int = SPEECH_LIMIT,
                concurrency: int = 8) -> ArchiveRun:
    """OCR text onto pages, then translation, speech and settlement, over the whole page table.

    Documents with pages that no finished batch covers yet are DEFERRED.

    Pages are pinned where a stage has been paid for, so that no later step repeats it. With
    the returned ledgers a second run makes no call.
    """
    read = apply_ocr(batches, pages, parsed, docs, used, cap, day).pages.drop("batch_no")
    if "translated_text" not in read.columns:
        read = read.withColumn("translated_text", F.lit(None).cast("string"))
    read = pin(read)

    translated = translate_pages(read, docs, translation_ledger, translate, now, translate_limit, concurrency)
    results = translated.results.filter(F.col("translated_text").isNotNull()).withColumn(
        "result_id", F.concat_ws("/", "document_id", "page_no"))
    read = pin(apply_translations(read, results).pages.drop("applied"))

    spoken = speak_pages(read, docs, speech_ledger, speak, now, speech_limit, concurrency)
    tracks = spoken.results.groupBy("document_id", "page_no").agg(
        F.bool_and(F.col("segment_keys").isNotNull()).alias("whole"))
    audio = tracks.filter("whole").select("document_id", "page_no", F.concat_ws("/", "document_id", "page_no").alias("result_id"))
    read = apply_audio(read, audio).pages.drop("applied")

    settled = settle_documents(read)
    return ArchiveRun(index_settled_pages(read, settled), settled, translated.ledger, spoken.ledger)
