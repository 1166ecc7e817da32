"""Registered queries of state changes and roll-ups."""

from pyspark.sql import functions as F

from lettermill.functions.text import content_hash as hash_of
from lettermill.operators import enrichment as en
from lettermill.operators import state
from lettermill.plans.common import (
    BATCH_SQL, NOW, batches, blank, budget_ctes, chunk_ctes, content_hash, now, view, views, word_count,
)
from lettermill.plans.enrichment import all_ready, empty_ledger, mark
from lettermill.plans.metrics import SETTLED
from lettermill.sources.changes import enqueue

QUERIES, ORACLES = {}, {}

DAY = "2024-01-02"


def pages(s, d):
    return view(s, d, "page").withColumn("text_hash", hash_of("original_text"))


PAGES = f"hashed AS (SELECT *, {content_hash('original_text')} AS text_hash FROM page)"

# Two results per page with text, and one that was made from a text since edited.
COPIES = "(VALUES (0), (1)) v(copy)"


def translation_results(s, d):
    copies = pages(s, d).filter("original_text IS NOT NULL").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return copies.select(
        "document_id", "page_no", F.expr("(document_id * 100 + page_no) * 10 + copy").alias("result_id"),
        F.expr("concat('t', copy, ':', original_text)").alias("translated_text"),
        F.expr("CASE WHEN page_no % 4 = 1 THEN 'stale' ELSE text_hash END").alias("text_hash"))


def ready_pages(s, d):
    """Every other document waits for its translation."""
    return pages(s, d).withColumn("status", F.expr("CASE WHEN document_id % 2 = 0 THEN 'OCR_DONE' ELSE status END"))


READY = """ready AS (SELECT * REPLACE (CASE WHEN document_id % 2 = 0 THEN 'OCR_DONE' ELSE status END AS status) FROM hashed)"""
TRANSLATED = f"""{views('page')}, {PAGES}, {READY},
moved AS (SELECT *, status = 'OCR_DONE' AND original_text IS NOT NULL AND page_no % 4 <> 1 AS applied FROM ready)"""
QUERIES["d1_apply_translations"] = lambda s, d: state.apply_translations(
    ready_pages(s, d), translation_results(s, d)).pages.select("document_id", "page_no", "status", "translated_text", "applied")
ORACLES["d1_apply_translations"] = f"""{TRANSLATED}
SELECT document_id, page_no, CASE WHEN applied THEN 'TRANSLATED' ELSE status END AS status,
       CASE WHEN applied THEN concat('t0:', original_text) ELSE translated_text END AS translated_text, applied FROM moved"""
QUERIES["d1_discarded_translations"] = lambda s, d: state.apply_translations(
    ready_pages(s, d), translation_results(s, d)).discarded.select("result_id", "document_id", "page_no")
ORACLES["d1_discarded_translations"] = f"""{TRANSLATED}
SELECT (document_id * 100 + page_no) * 10 + copy AS result_id, document_id, page_no
FROM moved, {COPIES} WHERE original_text IS NOT NULL AND NOT (applied AND copy = 0)"""


def audio_results(s, d):
    return view(s, d, "page").filter("page_no % 2 = 1").selectExpr("document_id", "page_no", "document_id * 100 + page_no AS result_id")


QUERIES["d2_apply_audio"] = lambda s, d: state.apply_audio(view(s, d, "page"), audio_results(s, d)).pages.select(
    "document_id", "page_no", "status", "applied")
ORACLES["d2_apply_audio"] = f"""{views('page')}
SELECT document_id, page_no, CASE WHEN status = 'TRANSLATED' AND page_no % 2 = 1 THEN 'AUDIO_DONE' ELSE status END AS status,
       status = 'TRANSLATED' AND page_no % 2 = 1 AS applied FROM page"""

QUERIES["d3_settle_documents"] = lambda s, d: state.settle_documents(view(s, d, "page"))
ORACLES["d3_settle_documents"] = f"{SETTLED} SELECT * FROM settled"
QUERIES["d3_index_settled_pages"] = lambda s, d: state.index_settled_pages(
    view(s, d, "page"), state.settle_documents(view(s, d, "page"))).select("document_id", "page_no", "status")
ORACLES["d3_index_settled_pages"] = f"""{SETTLED}
SELECT document_id, page_no, CASE WHEN status = 'AUDIO_DONE' AND outcome <> 'DEFERRED' THEN 'INDEXED' ELSE status END AS status
FROM page JOIN settled USING (document_id)"""

QUERIES["d4_early_partial"] = lambda s, d: state.early_partial(batches(s, d))
ORACLES["d4_early_partial"] = f"""{views('upload')}, {BATCH_SQL}
SELECT document_id, 'PARTIAL' AS status FROM batch GROUP BY document_id
HAVING NOT bool_or(status IN ('PENDING', 'RUNNING')) AND bool_or(status IN ('FAILED', 'PARTIALLY_COMPLETED'))"""


def d5_stamp_completion(s, d):
    changes = state.settle_documents(view(s, d, "page")).filter("document_id % 2 = 0").select(
        "document_id", F.expr("CASE WHEN outcome = 'DEFERRED' THEN 'PROCESSING' ELSE outcome END").alias("status"),
        now().alias("changed_at"))
    docs = view(s, d, "document").withColumn("status", F.lit("PENDING"))
    return state.stamp_completion(docs, changes).select("document_id", "status", "completed_at")


QUERIES["d5_stamp_completion"] = d5_stamp_completion
ORACLES["d5_stamp_completion"] = f"""{SETTLED}
SELECT document_id, CASE WHEN document_id % 2 = 1 THEN 'PENDING' WHEN outcome = 'DEFERRED' THEN 'PROCESSING' ELSE outcome END AS status,
       CASE WHEN document_id % 2 = 1 THEN completed_at WHEN outcome <> 'DEFERRED' THEN {NOW} END AS completed_at
FROM document JOIN settled USING (document_id)"""


def exhausted(s, d):
    failed = view(s, d, "failure").filter("attempt >= 2 AND NOT is_pause")
    return failed.select((F.col("failure_id") % 100).alias("document_id"),
                         (F.col("failure_id") % 7 + 1).cast("int").alias("page_no"))


QUERIES["d6_fail_exhausted"] = lambda s, d: state.fail_exhausted(view(s, d, "page"), exhausted(s, d)).pages.select(
    "document_id", "page_no", "status", "applied")
ORACLES["d6_fail_exhausted"] = f"""{views('page', 'failure')},
gone AS (SELECT DISTINCT failure_id % 100 AS document_id, failure_id % 7 + 1 AS page_no FROM failure WHERE attempt >= 2 AND NOT is_pause),
flagged AS (SELECT p.*, g.page_no IS NOT NULL AND status NOT IN ('INDEXED', 'CAPPED') AS applied
            FROM page p LEFT JOIN gone g USING (document_id, page_no))
SELECT document_id, page_no, CASE WHEN applied THEN 'FAILED' ELSE status END AS status, applied FROM flagged"""

EDIT_CAP = 900
EDIT_TEXT = """CASE page_no % 5 WHEN 0 THEN '  ' WHEN 1 THEN original_text
  WHEN 2 THEN repeat('ab ', 7000) ELSE concat(coalesce(original_text, 'new text'), ' edited') END"""
EDITOR = """concat('owner', CAST((document_id + CASE WHEN document_id % 13 = 0 THEN 1 ELSE 0 END) % 7 AS STRING))"""
EDITED_PAGE = "CAST(page_no + CASE WHEN document_id % 17 = 0 THEN 50 ELSE 0 END AS INT)"


def edits(s, d):
    return view(s, d, "page").select(
        F.expr("document_id * 100 + page_no").alias("edit_id"), "document_id", F.expr(EDITED_PAGE).alias("page_no"),
        F.expr(EDITOR).alias("owner_id"), F.lit(DAY).cast("date").alias("day"), F.expr(EDIT_TEXT).alias("text"))


EDITS = f"""{views('document', 'page')}, {PAGES},
edits AS (SELECT document_id * 100 + page_no AS edit_id, document_id, {EDITED_PAGE} AS page_no, {EDITOR} AS owner_id, {EDIT_TEXT} AS text FROM page),
early AS (SELECT e.*, h.status, {content_hash('e.text')} AS new_hash, {word_count('e.text')} AS words,
  CASE WHEN o.document_id IS NULL THEN 'NOT_FOUND' WHEN h.status IS NULL THEN 'PAGE_NOT_FOUND' WHEN h.status = 'PENDING' THEN 'NOT_READY'
       WHEN {blank('e.text')} THEN 'INVALID_BLANK' WHEN length(e.text) > 20000 THEN 'INVALID_TOO_LONG'
       WHEN h.status NOT IN ('FAILED', 'CAPPED') AND {content_hash('e.text')} = h.text_hash THEN 'NO_OP' END AS early
  FROM edits e LEFT JOIN document o ON o.document_id = e.document_id AND o.owner_id = e.owner_id
               LEFT JOIN hashed h ON h.document_id = e.document_id AND h.page_no = e.page_no),
claims AS (SELECT owner_id, edit_id, words FROM early WHERE early IS NULL),
{budget_ctes('claims', 'owner_id', 'edit_id', EDIT_CAP)},
outcomes AS (SELECT e.*, coalesce(early, CASE WHEN granted THEN 'APPLIED' ELSE 'OVER_BUDGET' END) AS outcome
             FROM early e LEFT JOIN granted g USING (edit_id))"""


def edited(s, d):
    return state.apply_edits(view(s, d, "document"), pages(s, d), edits(s, d), cap=EDIT_CAP)


QUERIES["d7_edit_outcomes"] = lambda s, d: edited(s, d).outcomes.select("edit_id", "outcome")
ORACLES["d7_edit_outcomes"] = f"{EDITS} SELECT edit_id, outcome FROM outcomes"
QUERIES["d7_edited_pages"] = lambda s, d: edited(s, d).pages.select(
    "document_id", "page_no", "status", "text_hash", "translated_text", "edited")
ORACLES["d7_edited_pages"] = f"""{EDITS}
SELECT h.document_id, h.page_no, CASE WHEN o.edit_id IS NOT NULL THEN 'OCR_DONE' ELSE h.status END AS status,
       CASE WHEN o.edit_id IS NOT NULL THEN new_hash ELSE h.text_hash END AS text_hash,
       CASE WHEN o.edit_id IS NULL THEN translated_text END AS translated_text, o.edit_id IS NOT NULL AS edited
FROM hashed h LEFT JOIN outcomes o ON o.document_id = h.document_id AND o.page_no = h.page_no AND outcome = 'APPLIED'"""

RETRY_CAP = 60


def retries(s, d):
    return state.plan_retries(view(s, d, "document"), view(s, d, "page"), cap=RETRY_CAP, day=F.lit(DAY).cast("date"))


RETRIES = f"""{views('document', 'page')},
claims AS (SELECT document_id, page_no, owner_id, {word_count('original_text')} AS words
           FROM page JOIN document USING (document_id) WHERE status = 'CAPPED'),
{budget_ctes('claims', 'owner_id', 'document_id, page_no', RETRY_CAP)},
planned AS (SELECT document_id, page_no, status,
   CASE WHEN status = 'CAPPED' THEN CASE WHEN granted THEN 'OCR_DONE' END WHEN original_text IS NULL THEN NULL
        WHEN translated_text IS NULL THEN 'OCR_DONE' ELSE 'TRANSLATED' END AS new_status
   FROM page LEFT JOIN granted USING (document_id, page_no) WHERE status IN ('FAILED', 'CAPPED'))"""
QUERIES["d8_plan_retries"] = retries
ORACLES["d8_plan_retries"] = f"""{RETRIES}
SELECT *, CASE new_status WHEN 'OCR_DONE' THEN 'translate' WHEN 'TRANSLATED' THEN 'tts' END AS queue FROM planned"""
QUERIES["d8_retry_counts"] = lambda s, d: state.retry_counts(retries(s, d))
ORACLES["d8_retry_counts"] = f"""{RETRIES}
SELECT document_id, count(new_status) AS requeued, count(*) - count(new_status) AS skipped,
       CASE WHEN count(new_status) > 0 THEN 'PROCESSING' END AS document_status FROM planned GROUP BY document_id"""


def d9_recompute_set(s, d):
    """After one run over all pages, page 3 of each document is edited: which chunks must be called again."""
    docs, before = view(s, d, "document"), all_ready(s, d)
    ledger = en.translate_pages(before, docs, empty_ledger(s), mark, now(), limit=120).ledger
    after = before.withColumn("original_text", F.expr(
        "CASE WHEN page_no = 3 THEN concat(original_text, ' Added.') ELSE original_text END"))
    return state.recompute_set(en.translate_work(after, docs, 120), ledger).select("document_id", "page_no", "chunk_index", "chunk")


QUERIES["d9_recompute_set"] = d9_recompute_set
FOREIGN = "SELECT p.* FROM page p JOIN document USING (document_id) WHERE original_text IS NOT NULL AND language <> 'en' AND page_no = 3"
ORACLES["d9_recompute_set"] = f"""{views('document', 'page', recursive=True)},
versions AS (SELECT document_id, page_no, 0 AS v, original_text FROM ({FOREIGN})
             UNION ALL SELECT document_id, page_no, 1, concat(original_text, ' Added.') FROM ({FOREIGN})),
{chunk_ctes('versions', 'document_id, page_no, v', 'original_text', 120)}
SELECT document_id, page_no, chunk_index, chunk FROM chunks a WHERE v = 1 AND NOT exists(
  SELECT 1 FROM chunks b WHERE b.v = 0 AND b.document_id = a.document_id AND b.page_no = a.page_no
                           AND b.chunk_index = a.chunk_index AND b.chunk = a.chunk)"""

listed = lambda c="pages": F.array_join(
    F.transform(c, lambda p: F.concat_ws(":", p["page_no"].cast("string"), p["status"])), ",")
LISTED = "string_agg(concat(page_no, ':', p.status), ',' ORDER BY page_no)"
QUERIES["d10_document_view"] = lambda s, d: state.document_view(view(s, d, "document"), view(s, d, "page")).select(
    "document_id", "owner_id", "title", listed().alias("pages"))
ORACLES["d10_document_view"] = f"""{views('document', 'page')}
SELECT document_id, owner_id, title, {LISTED} AS pages FROM document JOIN page p USING (document_id) GROUP BY 1, 2, 3"""


def with_status(s, d):
    settled = state.settle_documents(view(s, d, "page"))
    return view(s, d, "document").join(settled, "document_id").withColumn(
        "status", F.expr("CASE WHEN outcome = 'DEFERRED' THEN 'PROCESSING' ELSE outcome END"))


STATUS = "CASE WHEN outcome = 'DEFERRED' THEN 'PROCESSING' ELSE outcome END"
QUERIES["d11_progress_snapshot"] = lambda s, d: state.progress_snapshot(with_status(s, d), view(s, d, "page")).select(
    "document_id", "status", listed().alias("pages"))
ORACLES["d11_progress_snapshot"] = f"""{SETTLED}
SELECT document_id, {STATUS} AS status, {LISTED} AS pages FROM settled JOIN page p USING (document_id) GROUP BY 1, 2"""

QUERIES["d12_percent_complete"] = lambda s, d: state.percent_complete(view(s, d, "document"), view(s, d, "page"))
ORACLES["d12_percent_complete"] = f"""{views('page')}
SELECT document_id, CAST(floor(sum(CASE status WHEN 'PENDING' THEN 0 WHEN 'OCR_DONE' THEN 1 WHEN 'TRANSLATED' THEN 2
         WHEN 'AUDIO_DONE' THEN 3 ELSE 4 END) / (count(*) * 4) * 100 + 0.5) AS BIGINT) AS percent FROM page GROUP BY document_id"""

QUERIES["d13_editable_pages"] = lambda s, d: state.editable_pages(with_status(s, d), view(s, d, "page")).select(
    "document_id", "page_no", "status")
ORACLES["d13_editable_pages"] = f"""{SETTLED}
SELECT document_id, page_no, p.status FROM page p JOIN settled USING (document_id)
WHERE outcome <> 'DEFERRED' AND p.status <> 'PENDING'"""

QUERIES["d14_owner_scope"] = lambda s, d: state.owner_scope(view(s, d, "document"), "owner2").join(
    view(s, d, "page"), "document_id").select("document_id", "page_no", "owner_id")
ORACLES["d14_owner_scope"] = f"""{views('document', 'page')}
SELECT document_id, page_no, owner_id FROM document JOIN page USING (document_id) WHERE owner_id = 'owner2'"""

QUERIES["s6_enqueue"] = lambda s, d: enqueue(view(s, d, "page").filter("status = 'OCR_DONE'"), "translate", "document_id", "page_no")
ORACLES["s6_enqueue"] = f"""{views('page')}
SELECT 'translate' AS topic, format('{{{{"document_id":{{}},"page_no":{{}}}}}}', document_id, page_no) AS payload
FROM page WHERE status = 'OCR_DONE'"""

