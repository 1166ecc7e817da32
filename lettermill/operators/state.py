"""Page and document state: guarded updates, roll-ups, edits and retries."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.functions.calls import BUDGET_ZONE, local_day
from lettermill.functions.text import content_hash, is_blank, word_count
from lettermill.operators.enrichment import KEY
from lettermill.operators.limits import DAILY_WORDS, claim_budget
from lettermill.session import pin
from lettermill.sources.changes import enqueue

# States in order, and the longest text an edit may carry.
STAGES = ("PENDING", "OCR_DONE", "TRANSLATED", "AUDIO_DONE", "INDEXED")
STOPPED = ("FAILED", "CAPPED")
IN_FLIGHT = ("PENDING", "OCR_DONE", "TRANSLATED")
TERMINAL = ("PARTIAL", "COMPLETE")
MAX_EDIT_CHARS = 20_000
PAGE = ["document_id", "page_no"]


class Applied(NamedTuple):
    pages: DataFrame
    discarded: DataFrame
    work: DataFrame


def apply_translations(pages: DataFrame, results: DataFrame) -> Applied:
    """Set translations whose page is still OCR_DONE with the text they were made from.

    Later copies of a result (by ``result_id``) and results for a text that changed since
    are discarded, as are those whose page moved on.
    """
    hashed = [*PAGE, "text_hash"]
    first = results.groupBy(*hashed).agg(
        F.min("result_id").alias("result_id"), F.min_by("translated_text", "result_id").alias("_translation"))
    joined = pages.join(first, hashed, "left")
    applied = (F.col("status") == "OCR_DONE") & F.col("_translation").isNotNull()
    flagged = joined.withColumn("applied", F.coalesce(applied, F.lit(False)))
    updated = flagged.withColumns({
        "status": F.when(F.col("applied"), "TRANSLATED").otherwise(F.col("status")),
        "translated_text": F.when(F.col("applied"), F.col("_translation")).otherwise(F.col("translated_text"))})
    taken = updated.filter("applied")
    discarded = results.join(taken.select("result_id"), "result_id", "left_anti")
    return Applied(updated.drop("_translation", "result_id"), discarded, enqueue(taken, "tts", *PAGE))


def apply_audio(pages: DataFrame, results: DataFrame) -> Applied:
    """Mark pages whose audio is ready, if they are still TRANSLATED."""
    ready = results.groupBy(*PAGE).agg(F.min("result_id").alias("result_id"))
    joined = pages.join(ready, PAGE, "left")
    applied = (F.col("status") == "TRANSLATED") & F.col("result_id").isNotNull()
    updated = joined.withColumn("applied", applied).withColumn(
        "status", F.when(F.col("applied"), "AUDIO_DONE").otherwise(F.col("status")))
    taken = updated.filter("applied")
    discarded = results.join(taken.select("result_id"), "result_id", "left_anti")
    work = enqueue(taken.select("document_id").distinct(), "assemble", "document_id")
    return Applied(updated.drop("result_id"), discarded, work)


def settle_documents(pages: DataFrame) -> DataFrame:
    """COMPLETE, PARTIAL, or DEFERRED while a page is in flight, per document that has pages."""
    flags = pages.groupBy("document_id").agg(
        F.bool_or(F.col("status").isin(*IN_FLIGHT)).alias("moving"),
        F.bool_or(F.col("status").isin(*STOPPED)).alias("stopped"))
    outcome = F.when(F.col("moving"), "DEFERRED").when(F.col("stopped"), "PARTIAL").otherwise("COMPLETE")
    return flags.select("document_id", outcome.alias("outcome"))


def index_settled_pages(pages: DataFrame, settled: DataFrame) -> DataFrame:
    """AUDIO_DONE pages of settled documents become INDEXED."""
    done = settled.filter(F.col("outcome") != "DEFERRED").select("document_id", F.lit(True).alias("_done"))
    indexed = (F.col("status") == "AUDIO_DONE") & F.col("_done")
    return pages.join(done, "document_id", "left").withColumn(
        "status", F.when(F.coalesce(indexed, F.lit(False)), "INDEXED").otherwise(F.col("status"))).drop("_done")


def early_partial(batches: DataFrame) -> DataFrame:
    """Documents that become PARTIAL because all their OCR batches ended and one went wrong."""
    flags = batches.groupBy("document_id").agg(
        F.bool_or(F.col("status").isin("PENDING", "RUNNING")).alias("moving"),
        F.bool_or(F.col("status").isin("FAILED", "PARTIALLY_COMPLETED")).alias("wrong"))
    return flags.filter(~F.col("moving") & F.col("wrong")).select("document_id", F.lit("PARTIAL").alias("status"))


def stamp_completion(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply new states (``status, changed_at``): terminal ones stamp completion, others clear it."""
    new = changes.select("document_id", F.col("status").alias("_status"), F.col("changed_at").alias("_at"))
    joined = docs.join(new, "document_id", "left")
    changed = F.col("_status").isNotNull()
    stamp = F.when(F.col("_status").isin(*TERMINAL), F.col("_at"))
    return joined.withColumns({
        "status": F.coalesce("_status", "status"),
        "completed_at": F.when(changed, stamp).otherwise(F.col("completed_at")),
    }).drop("_status", "_at")


def fail_exhausted(pages: DataFrame, failures: DataFrame) -> Applied:
    """Fail pages whose retries are used up, unless they are INDEXED or CAPPED."""
    exhausted = failures.select(*PAGE).distinct().withColumn("_exhausted", F.lit(True))
    hit = F.col("_exhausted") & ~F.col("status").isin("INDEXED", "CAPPED")
    flagged = pages.join(exhausted, PAGE, "left").withColumn("applied", F.coalesce(hit, F.lit(False)))
    updated = flagged.withColumn("status", F.when(F.col("applied"), "FAILED").otherwise(F.col("status")))
    updated = updated.drop("_exhausted")
    taken = updated.filter("applied")
    discarded = failures.join(taken.select(*PAGE), PAGE, "left_anti")
    work = enqueue(taken.select("document_id").distinct(), "assemble", "document_id")
    return Applied(updated, discarded, work)


class Edited(NamedTuple):
    outcomes: DataFrame
    pages: DataFrame
    documents: DataFrame
    work: DataFrame


def decide_edits(docs: DataFrame, pages: DataFrame, edits: DataFrame, used: DataFrame | None = None,
                 cap: int = DAILY_WORDS) -> DataFrame:
    """Outcome of each edit (``edit_id, document_id, page_no, owner_id, day, text``), in order of ``edit_id``.

    An edit meets its page as the last applied edit before it left it, so whether it changes
    anything depends on earlier grants, and a grant on which earlier edits claimed words. Both are
    worked out over all edits at once, and again while an outcome changes: each pass settles at
    least the first edit that was wrong, in practice nearly all. Texts join last.
    """
    owned = docs.select("document_id", "owner_id", F.lit(True).alias("_doc"))
    current = pages.select(*PAGE, F.col("status").alias("_status"), F.col("text_hash").alias("_hash"))
    narrow = edits.select(
        "edit_id", *PAGE, "owner_id", "day", content_hash("text").alias("text_hash"), word_count("text").alias("words"),
        is_blank("text").alias("_blank"), (F.length("text") > MAX_EDIT_CHARS).alias("_long"))
    early = (
        F.when(F.col("_doc").isNull(), "NOT_FOUND").when(F.col("_status").isNull(), "PAGE_NOT_FOUND")
        .when(F.col("_status") == "PENDING", "NOT_READY")
        .when(F.col("_blank"), "INVALID_BLANK").when(F.col("_long"), "INVALID_TOO_LONG")
    )
    joined = narrow.join(owned, ["document_id", "owner_id"], "left").join(current, PAGE, "left").withColumn("_early", early)
    decided = pin(joined.select("edit_id", *PAGE, "owner_id", "day", "text_hash", "words", "_status", "_hash", "_early"))
    live = decided.filter(F.col("_early").isNull()).drop("_early")
    before = Window.partitionBy(*PAGE).orderBy("edit_id").rowsBetween(Window.unboundedPreceding, -1)
    # The first pass takes it that no earlier edit was applied.
    guess = live.withColumn("_applied", F.lit(False))
    while True:
        last = F.last(F.when(F.col("_applied"), F.col("text_hash")), ignorenulls=True).over(before)
        seen = guess.withColumn("_last", last)
        stands = F.when(F.col("_last").isNotNull(), F.col("_last") == F.col("text_hash")).otherwise(
            ~F.col("_status").isin(*STOPPED) & F.col("text_hash").eqNullSafe(F.col("_hash")))
        seen = seen.withColumn("_same", F.coalesce(stands, F.lit(False)))
        claims = claim_budget(seen.filter(~F.col("_same")), used, cap, order=("edit_id",)).select("edit_id", "granted")
        after = pin(seen.join(claims, "edit_id", "left").withColumn("_now", F.coalesce("granted", F.lit(False))))
        wrong = after.filter(F.col("_now") != F.col("_applied")).limit(1).count()
        if not wrong:
            break
        guess = after.withColumn("_applied", F.col("_now")).select(*live.columns, "_applied")
    outcome = F.when(F.col("_same"), "NO_OP").when(F.col("_now"), "APPLIED").otherwise("OVER_BUDGET")
    late = after.select("edit_id", outcome.alias("_late"))
    outcomes = decided.join(late, "edit_id", "left").select(
        "edit_id", *PAGE, "owner_id", "text_hash", "words", F.coalesce("_early", "_late").alias("outcome"))
    return outcomes.join(edits.select("edit_id", "text"), "edit_id")


def apply_edits(docs: DataFrame, pages: DataFrame, edits: DataFrame, used: DataFrame | None = None,
                cap: int = DAILY_WORDS) -> Edited:
    """Decide edits and put the applied ones onto their pages, to be translated again."""
    outcomes = decide_edits(docs, pages, edits, used, cap)
    applied = outcomes.filter(F.col("outcome") == "APPLIED")
    # Of several applied edits of a page the last one stands.
    newest = applied.groupBy(*PAGE).agg(F.max("edit_id").alias("edit_id"))
    taken = applied.join(newest.select("edit_id"), "edit_id", "left_semi")
    new = taken.select(*PAGE, F.col("text").alias("_text"), F.col("text_hash").alias("_new_hash"))
    joined = pages.join(new, PAGE, "left")
    edited = F.col("_new_hash").isNotNull()
    before = F.col("edited") if "edited" in pages.columns else F.lit(False)
    updated = joined.withColumns({
        "status": F.when(edited, "OCR_DONE").otherwise(F.col("status")),
        "original_text": F.when(edited, F.col("_text")).otherwise(F.col("original_text")),
        "text_hash": F.when(edited, F.col("_new_hash")).otherwise(F.col("text_hash")),
        "translated_text": F.when(~edited, F.col("translated_text")),
        "edited": edited | before,
    }).drop("_text", "_new_hash")
    documents = taken.select("document_id").distinct().withColumn("status", F.lit("PROCESSING"))
    return Edited(outcomes, updated, documents, enqueue(taken, "translate", *PAGE))


def plan_retries(docs: DataFrame, pages: DataFrame, used: DataFrame | None = None, cap: int = DAILY_WORDS,
                 day: Column | None = None) -> DataFrame:
    """New state and queue of each failed or capped page; skipped pages keep their state.

    A capped page claims its words again. A failed page resumes where its text allows.
    """
    stopped = pages.filter(F.col("status").isin(*STOPPED)).join(
        docs.select("document_id", "owner_id"), "document_id")
    capped = F.col("status") == "CAPPED"
    sized = stopped.withColumn("words", word_count("original_text")).withColumn(
        "day", day if day is not None else local_day(F.current_timestamp(), BUDGET_ZONE))
    claims = claim_budget(sized.filter(capped), used, cap, order=tuple(PAGE)).select(*PAGE, "granted")
    decided = sized.join(claims, PAGE, "left")
    target = (
        F.when(capped & F.col("granted"), "OCR_DONE").when(capped, None)
        .when(F.col("original_text").isNull(), None)
        .when(F.col("translated_text").isNull(), "OCR_DONE").otherwise("TRANSLATED")
    )
    planned = decided.withColumn("new_status", target)
    queue = F.when(F.col("new_status") == "OCR_DONE", "translate").when(F.col("new_status") == "TRANSLATED", "tts")
    return planned.select(*PAGE, "status", "new_status", queue.alias("queue"))


def retry_counts(planned: DataFrame) -> DataFrame:
    """Pages requeued and skipped per document; it is PROCESSING again if any was requeued."""
    counts = planned.groupBy("document_id").agg(
        F.count_if(F.col("new_status").isNotNull()).alias("requeued"),
        F.count_if(F.col("new_status").isNull()).alias("skipped"))
    return counts.withColumn("document_status", F.when(F.col("requeued") > 0, "PROCESSING"))


def recompute_set(work: DataFrame, ledger: DataFrame) -> DataFrame:
    """Chunks after an edit that no finished call covers. A reverted edit leaves none."""
    return work.join(ledger.filter(F.col("status") == "DONE").select(KEY), KEY, "left_anti")


def document_view(docs: DataFrame, pages: DataFrame, fields: tuple[str, ...] = ("page_no", "status")) -> DataFrame:
    """Documents with their pages in order. A document has at most 30 pages."""
    listed = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pages"))
    empty = F.array().cast(dict(listed.dtypes)["pages"])
    return docs.join(listed, "document_id", "left").withColumn("pages", F.coalesce("pages", empty))


def progress_snapshot(docs: DataFrame, pages: DataFrame) -> DataFrame:
    return document_view(docs.select("document_id", "status"), pages)


def page_progress(status: str = "status") -> Column:
    """Stage reached, 0 to 4. A stopped page counts as full, an unknown state as none."""
    s = F.col(status)
    reached = F.when(s.isin(*STOPPED), len(STAGES) - 1)
    for index, stage in enumerate(STAGES):
        reached = reached.when(s == stage, index)
    return reached.otherwise(0)


def percent_complete(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Rounded share of all stages reached per document; 0 without pages."""
    done = pages.groupBy("document_id").agg(
        (F.sum(page_progress()) / (F.count(F.lit(1)) * (len(STAGES) - 1))).alias("_share"))
    percent = F.floor(F.coalesce("_share", F.lit(0.0)) * 100 + 0.5)
    return docs.select("document_id").join(done, "document_id", "left").select(
        "document_id", percent.cast("bigint").alias("percent"))


def editable_pages(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages past PENDING of settled documents."""
    settled = docs.filter(F.col("status").isin(*TERMINAL)).select("document_id")
    return pages.filter(F.col("status") != "PENDING").join(settled, "document_id", "left_semi")


def owner_scope(df: DataFrame, owner: str) -> DataFrame:
    """Another owner's rows do not exist. Filters before any join, so it reaches the scan."""
    return df.filter(F.col("owner_id") == owner)
