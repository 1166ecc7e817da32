"""Upload checks, OCR batches, submission, polling and redispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.calls import POLL_LIMIT, backoff_delay_ms
from lettermill.functions.language import is_known_language
from lettermill.functions.ranges import format_page_range, range_size
from lettermill.functions.text import truncate_error
from lettermill.operators.limits import DAILY_WORDS

# Upload and submission limits.
MAX_FILE_BYTES = 20 * 1024 * 1024
MAX_PAGES = 30
MAX_PAYLOAD_BYTES = 33_554_432
PAGES_PER_BATCH = 10
BATCH_LEASE_S = 60
MAX_SUBMITS = 3
IMAGE_TYPES = ("image/jpeg", "image/png")
PDF_TYPE = "application/pdf"


def validate_uploads(uploads: DataFrame, used: DataFrame | None = None, cap: int = DAILY_WORDS) -> DataFrame:
    """Add ``page_count`` and the first ``reject_reason`` that applies, null when accepted.

    ``files`` is an array of struct ``content_type, bytes, pages``; ``used`` holds the words
    already taken today per owner.
    """
    if used is not None:
        uploads = uploads.join(used.select("owner_id", F.col("used").alias("_used")), "owner_id", "left")
        spent = F.coalesce("_used", F.lit(0)) >= cap
    else:
        spent = F.lit(cap <= 0)
    files = F.col("files")
    empty = F.coalesce(F.size(files) < 1, F.lit(True))
    one_pdf = (F.size(files) == 1) & F.coalesce(files[0]["content_type"] == PDF_TYPE, F.lit(False))
    not_image = F.exists(files, lambda f: ~F.coalesce(f["content_type"].isin(*IMAGE_TYPES), F.lit(False)))
    pages = F.aggregate(files, F.lit(0), lambda n, f: n + F.coalesce(f["pages"], F.lit(1)).cast("int"))
    reason = (
        F.when(~is_known_language("language"), "unknown_language")
        .when(empty, "no_files")
        .when(F.exists(files, lambda f: f["bytes"] > MAX_FILE_BYTES), "file_too_large")
        .when(spent, "budget_spent")
        .when(~one_pdf & not_image, "bad_type")
        .when(F.col("page_count") > MAX_PAGES, "too_many_pages")
    )
    checked = uploads.withColumn("page_count", F.coalesce(pages, F.lit(0))).withColumn("reject_reason", reason)
    return checked.drop("_used")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNull())


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull())


def plan_batches(docs: DataFrame, size: int = PAGES_PER_BATCH, now: Column | None = None,
                 lease_s: int = BATCH_LEASE_S) -> DataFrame:
    """Consecutive page ranges of at most ``size``; documents without pages plan nothing."""
    total = F.col("total_pages")
    starts = F.when(total >= 1, F.sequence(F.lit(1), total, F.lit(size)))
    rows = docs.filter(total >= 1).select("document_id", total.alias("_total"),
                                          F.posexplode(starts).alias("batch_no", "first_page"))
    last = F.least(F.col("first_page") + size - 1, F.col("_total"))
    due = (now if now is not None else F.current_timestamp()) + F.make_dt_interval(secs=F.lit(lease_s))
    return rows.select("document_id", "batch_no", "first_page", last.alias("last_page"),
                       format_page_range(F.col("first_page"), last).alias("page_range"),
                       F.lit("PENDING").alias("status"), due.alias("next_poll_at"))


def unplannable(docs: DataFrame) -> DataFrame:
    """Documents that :func:`plan_batches` refuses."""
    return docs.filter(F.coalesce(F.col("total_pages") < 1, F.lit(True)))


def pages_in_batch(pages: DataFrame, batches: DataFrame) -> DataFrame:
    """Pages with their batch and their 1-based index in it."""
    joined = pages.join(batches.select("document_id", "batch_no", "first_page", "last_page"), "document_id")
    inside = joined.filter(F.col("page_no").between(F.col("first_page"), F.col("last_page")))
    return inside.withColumn("batch_index", F.col("page_no") - F.col("first_page") + 1)


def batch_payload_check(pages: DataFrame, batches: DataFrame, max_bytes: int = MAX_PAYLOAD_BYTES) -> DataFrame:
    """Whether each batch can be submitted: all its pages exist and the payload is small enough."""
    keys = ["document_id", "batch_no", "first_page", "last_page"]
    found = pages_in_batch(pages, batches).groupBy("document_id", "batch_no").agg(
        F.count(F.lit(1)).alias("found"), F.sum("bytes").cast("bigint").alias("payload_bytes"))
    expected = range_size("first_page", "last_page")
    rows = batches.select(*keys).join(found, ["document_id", "batch_no"], "left")
    reason = F.when(F.coalesce("found", F.lit(0)) != expected, "page_count").when(
        F.col("payload_bytes") > max_bytes, "too_large")
    return rows.select("document_id", "batch_no", expected.alias("expected"),
                       F.coalesce("found", F.lit(0)).cast("bigint").alias("found"),
                       F.coalesce("payload_bytes", F.lit(0)).cast("bigint").alias("payload_bytes"),
                       reason.alias("problem"))


def payload_entry_name(batch_index: str = "batch_index", extension: str = "extension") -> Column:
    return F.format_string("page_%03d.%s", F.col(batch_index), F.col(extension))


def poll_outcomes(polled: DataFrame, give_up_after: int = POLL_LIMIT) -> DataFrame:
    """What each provider status means for its batch.

    ``parsed_pages`` counts the pages recovered from a finished job's result.
    """
    job = F.col("job_status")
    done, bad = job.isin("COMPLETED", "PARTIALLY_COMPLETED"), job.isin("FAILED", "REJECTED")
    empty = F.coalesce(F.col("parsed_pages"), F.lit(0)) < 1
    tired = F.col("poll_count") >= give_up_after
    action = F.when(done & ~empty, "apply").when(done | bad | tired, "fail").otherwise("wait")
    reason = (
        F.when(done & empty, "no text could be recovered from the result")
        .when(bad, F.concat(F.lit("job ended as "), job))
        .when(~done & tired, F.concat(F.lit("gave up after "), F.col("poll_count").cast("string"), F.lit(" polls")))
    )
    return polled.withColumn("action", action).withColumn("reason", reason)


def _oldest(batches: DataFrame, limit: int | None) -> DataFrame:
    return batches if limit is None else batches.orderBy("next_poll_at", "batch_id").limit(limit)


def due_for_poll(batches: DataFrame, now: Column, limit: int | None = None, jitter: bool = True) -> DataFrame:
    """Claim the batches whose poll is due and schedule their next poll; with ``limit`` the oldest so many."""
    due = batches.filter((F.col("status") == "RUNNING") & F.col("job_id").isNotNull() & (F.col("next_poll_at") <= now))
    picked = _oldest(due, limit)
    count = F.col("poll_count") + 1
    delay = backoff_delay_ms(count, F.col("batch_id") if jitter else None)
    return picked.withColumns({
        "next_poll_at": now + F.make_dt_interval(secs=(delay / 1000).cast("decimal(18,6)")), "poll_count": count})


def stalled_batches(batches: DataFrame, docs: DataFrame, now: Column, limit: int | None = None,
                    max_submits: int = MAX_SUBMITS, lease_s: int = BATCH_LEASE_S) -> DataFrame:
    """Batches never submitted in time: back to PENDING with a new lease; with ``limit`` the oldest leases."""
    stuck = batches.filter(
        F.col("status").isin("PENDING", "RUNNING") & F.col("job_id").isNull()
        & (F.col("next_poll_at") <= now) & (F.col("attempts") < max_submits))
    picked = _oldest(stuck, limit)
    renewed = picked.withColumns({
        "status": F.lit("PENDING"), "next_poll_at": now + F.make_dt_interval(secs=F.lit(lease_s))})
    return renewed.join(docs.select("document_id", "language"), "document_id", "left")


def claim_submissions(batches: DataFrame, outcomes: DataFrame, now: Column, max_submits: int = MAX_SUBMITS) -> DataFrame:
    """Batches after one submission round.

    ``outcomes`` holds per ``batch_id`` an ``outcome`` (``submitted``, ``paused``, ``failed``)
    with ``new_job_id`` or ``error``. Only PENDING batches with attempts left are claimed.
    A pause gives the attempt back.
    """
    joined = batches.join(outcomes.select("batch_id", "outcome", "new_job_id", "error"), "batch_id", "left")
    claimed = F.col("outcome").isNotNull() & (F.col("status") == "PENDING") & (F.col("attempts") < max_submits)
    claimed = F.coalesce(claimed, F.lit(False))
    paused, submitted = F.col("outcome") == "paused", F.col("outcome") == "submitted"
    first_poll = now + F.make_dt_interval(secs=(backoff_delay_ms(F.lit(1)) / 1000).cast("decimal(18,6)"))
    return joined.withColumns({
        "status": F.when(claimed & ~paused, "RUNNING").otherwise(F.col("status")),
        "attempts": F.when(claimed & ~paused, F.col("attempts") + 1).otherwise(F.col("attempts")),
        "job_id": F.when(claimed & submitted, F.col("new_job_id")).otherwise(F.col("job_id")),
        "next_poll_at": F.when(claimed & submitted, first_poll).otherwise(F.col("next_poll_at")),
        "last_error": F.when(claimed & (F.col("outcome") == "failed"), truncate_error("error"))
        .otherwise(F.col("last_error")),
    }).drop("outcome", "new_job_id", "error")
