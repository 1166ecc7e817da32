"""Registered queries of OCR planning and result ingestion."""

from pyspark.sql import functions as F

from lettermill.functions.text import word_count as words
from lettermill.operators import ocr_planning as planning
from lettermill.operators import ocr_results as results
from lettermill.plans.common import (
    BATCH_SQL, NOW, batches, blank, budget_ctes, content_hash, now, page_sizes, strip, table, view, views, word_count,
)
from lettermill.functions.calls import backoff_delay_ms

QUERIES, ORACLES = {}, {}

UPLOAD_CAP = 18_000


def p1_validate_uploads(s, d):
    used = view(s, d, "word_claim").groupBy("owner_id").agg(F.sum(words("text")).alias("used"))
    uploads = view(s, d, "upload").select(
        "document_id", "owner_id", F.expr("CASE WHEN document_id % 2 = 0 THEN 'ta' ELSE language END").alias("language"),
        F.expr("CASE WHEN document_id % 17 <> 3 THEN array(named_struct('content_type', content_type, "
               "'bytes', file_bytes * 2, 'pages', total_pages)) END").alias("files"))
    return planning.validate_uploads(uploads, used, UPLOAD_CAP).select(
        "document_id", "owner_id", "page_count", "reject_reason")


QUERIES["p1_validate_uploads"] = p1_validate_uploads
ORACLES["p1_validate_uploads"] = f"""{views('upload', 'word_claim')},
used AS (SELECT owner_id, sum({word_count('text')}) AS used FROM word_claim GROUP BY owner_id)
SELECT document_id, owner_id, CASE WHEN document_id % 17 = 3 THEN 0 ELSE total_pages END AS page_count,
  CASE WHEN document_id % 2 = 1 AND language NOT IN ('en') THEN 'unknown_language'
       WHEN document_id % 17 = 3 THEN 'no_files'
       WHEN file_bytes * 2 > 20971520 THEN 'file_too_large'
       WHEN coalesce(used, 0) >= {UPLOAD_CAP} THEN 'budget_spent'
       WHEN content_type = 'text/plain' THEN 'bad_type'
       WHEN total_pages > 30 THEN 'too_many_pages' END AS reject_reason
FROM upload LEFT JOIN used USING (owner_id)"""

QUERIES["p2_plan_batches"] = lambda s, d: planning.plan_batches(view(s, d, "upload"), now=now())
ORACLES["p2_plan_batches"] = f"""{views('upload')}, {BATCH_SQL}
SELECT document_id, batch_no, first_page, last_page, concat(first_page, '-', last_page) AS page_range,
       'PENDING' AS status, {NOW} + INTERVAL 60 SECOND AS next_poll_at FROM batch"""


def small_batches(s, d):
    return planning.plan_batches(page_sizes(s, d), size=3, now=now())


SMALL = """small AS (SELECT document_id, b AS batch_no, b * 3 + 1 AS first_page, CAST(least(b * 3 + 3, n) AS INT) AS last_page
  FROM (SELECT document_id, n, CAST(unnest(range((n + 2) // 3)) AS INT) AS b
        FROM (SELECT document_id, count(*) AS n FROM page GROUP BY document_id)))"""
QUERIES["p3_pages_in_batch"] = lambda s, d: planning.pages_in_batch(
    view(s, d, "page"), small_batches(s, d)).select("document_id", "page_no", "batch_no", "batch_index", "status")
ORACLES["p3_pages_in_batch"] = f"""{views('page')}, {SMALL}
SELECT document_id, page_no, batch_no, page_no - first_page + 1 AS batch_index, status
FROM page JOIN small USING (document_id) WHERE page_no BETWEEN first_page AND last_page"""


def p4_batch_payload_check(s, d):
    pages = view(s, d, "page").filter("status <> 'CAPPED'").withColumn(
        "bytes", F.coalesce(F.octet_length("original_text"), F.lit(1)) * 1000)
    return planning.batch_payload_check(pages, small_batches(s, d), 800_000)


QUERIES["p4_batch_payload_check"] = p4_batch_payload_check
ORACLES["p4_batch_payload_check"] = f"""{views('page')}, {SMALL},
found AS (SELECT document_id, batch_no, count(*) AS found,
                 sum(coalesce(octet_length(encode(original_text)), 1) * 1000) AS payload_bytes
          FROM page JOIN small USING (document_id)
          WHERE page_no BETWEEN first_page AND last_page AND status <> 'CAPPED' GROUP BY 1, 2)
SELECT document_id, batch_no, last_page - first_page + 1 AS expected, CAST(coalesce(found, 0) AS BIGINT) AS found,
       CAST(coalesce(payload_bytes, 0) AS BIGINT) AS payload_bytes,
       CASE WHEN coalesce(found, 0) <> last_page - first_page + 1 THEN 'page_count'
            WHEN payload_bytes > 800000 THEN 'too_large' END AS problem
FROM small LEFT JOIN found USING (document_id, batch_no)"""

QUERIES["p4_payload_entry_names"] = lambda s, d: planning.pages_in_batch(
    view(s, d, "page"), small_batches(s, d)).withColumn("extension", F.lit("png")).select(
    "document_id", "page_no", planning.payload_entry_name().alias("entry_name"))
ORACLES["p4_payload_entry_names"] = f"""{views('page')}, {SMALL}
SELECT document_id, page_no, format('page_{{:03d}}.png', page_no - first_page + 1) AS entry_name
FROM page JOIN small USING (document_id) WHERE page_no BETWEEN first_page AND last_page"""

NAMED = """CASE WHEN json_type(json, '$.markdown') = 'VARCHAR' AND trim(json->>'$.markdown') <> '' THEN json->>'$.markdown'
  WHEN json_type(json, '$.text') = 'VARCHAR' AND trim(json->>'$.text') <> '' THEN json->>'$.text'
  WHEN json_type(json, '$.result.text') = 'VARCHAR' AND trim(json->>'$.result.text') <> '' THEN json->>'$.result.text'
  WHEN length(json->>'$.body') > 1 AND trim(json->>'$.body') <> '' THEN json->>'$.body' ELSE json->>'$.id' END"""
QUERIES["p5_extract_page_text"] = lambda s, d: results.extract_page_text(view(s, d, "ocr_entry")).select(
    "archive_id", "ordinal", "text")
ORACLES["p5_extract_page_text"] = f"{views('ocr_entry')} SELECT archive_id, ordinal, {NAMED} AS text FROM ocr_entry"


def json_entries(s, d):
    return view(s, d, "ocr_entry").select(
        "archive_id", F.format_string("metadata/page_%03d.json", F.expr("CAST(floor(ordinal / 2) AS INT)")).alias("entry_name"),
        F.col("ordinal").alias("entry_pos"), F.col("json").alias("content"))


JSON_PAGES = f"""json_pages AS (
  SELECT archive_id, CAST(ordinal // 2 AS INT) AS ordinal, arg_max(text, ordinal) AS text
  FROM (SELECT archive_id, ordinal, {NAMED} AS text FROM ocr_entry) WHERE text IS NOT NULL GROUP BY 1, 2)"""
QUERIES["p6_pages_from_json"] = lambda s, d: results.pages_from_json(json_entries(s, d))
ORACLES["p6_pages_from_json"] = f"{views('ocr_entry')}, {JSON_PAGES} SELECT * FROM json_pages"


def text_entries(s, d):
    return table(s, d, "documents").selectExpr(
        "CAST(floor(doc_id / 10.0) AS BIGINT) AS archive_id",
        "format_string('pages/page_%03d.md', CAST(doc_id % 10 + doc_id % 30 / 10 AS INT)) AS entry_name",
        "CAST(doc_id % 10 AS INT) AS entry_pos", "CASE WHEN doc_id % 4 = 1 THEN ' \\n ' ELSE text END AS content")


TEXT_PAGES = f"""text_pages AS (
  SELECT CAST(floor(doc_id / 10.0) AS BIGINT) AS archive_id, CAST(floor(doc_id % 10 + (doc_id % 30) / 10.0) AS INT) AS ordinal,
         arg_max(text, doc_id) AS text
  FROM documents WHERE doc_id % 4 <> 1 AND NOT {blank('text')} GROUP BY 1, 2)"""
QUERIES["p7_pages_from_text"] = lambda s, d: results.pages_from_text(text_entries(s, d))
ORACLES["p7_pages_from_text"] = f"WITH {TEXT_PAGES} SELECT * FROM text_pages"


def main_entries(s, d):
    """One long markdown file per conversation, with a page break that differs, beside a short one."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "#|#")
    files = table(s, d, "conversations").groupBy("conv_id").agg(joined.alias("joined"), F.count(F.lit(1)).alias("n"))
    mark = F.expr("CASE conv_id % 3 WHEN 0 THEN '\\n---\\n' WHEN 1 THEN chr(12) ELSE '<!-- page -->' END")
    content = F.concat(F.replace("joined", F.lit("#|#"), mark), F.when(F.col("conv_id") % 2 == 0, mark).otherwise(""))
    long = files.select(F.col("conv_id").alias("archive_id"), F.lit("out/output.md").alias("entry_name"),
                        F.lit(1).alias("entry_pos"), content.alias("content"))
    short = files.select(F.col("conv_id").alias("archive_id"), F.lit("README.md").alias("entry_name"),
                         F.lit(0).alias("entry_pos"), F.lit("x").alias("content"))
    expected = files.select(F.col("conv_id").alias("archive_id"),
                            F.expr("CAST(n + CASE WHEN conv_id % 5 = 4 THEN 1 ELSE 0 END AS INT)").alias("expected_pages"))
    return long.unionByName(short), expected


MAIN_PAGES = f"""main_pages AS (
  SELECT conv_id AS archive_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS ordinal, {strip('text')} AS text
  FROM conversations WHERE conv_id % 5 <> 4)"""
QUERIES["p8_split_main_document"] = lambda s, d: results.split_main_document(*main_entries(s, d))
ORACLES["p8_split_main_document"] = f"WITH {MAIN_PAGES} SELECT * FROM main_pages"

QUERIES["p9_normalise_ordinals"] = lambda s, d: results.normalise_ordinals(results.pages_from_text(text_entries(s, d)))
ORACLES["p9_normalise_ordinals"] = f"""WITH {TEXT_PAGES}
SELECT archive_id, ordinal - min(ordinal) OVER (PARTITION BY archive_id) + 1 AS ordinal, text FROM text_pages"""


def archive_entries(s, d):
    """JSON entries in every third archive, text files in two of three, one main file in all."""
    long, expected = main_entries(s, d)
    entries = json_entries(s, d).filter("archive_id % 3 = 0").unionByName(
        text_entries(s, d).filter("archive_id % 3 <> 2")).unionByName(long)
    return entries, expected


def p10_parse_archives(s, d):
    return results.parse_archives(*archive_entries(s, d))


ARCHIVES = f"""{views('ocr_entry')}, {JSON_PAGES}, {TEXT_PAGES}, {MAIN_PAGES},
candidates AS (SELECT *, 0 AS r, 'page_json' AS strategy FROM json_pages WHERE archive_id % 3 = 0
               UNION ALL SELECT *, 1, 'page_text' FROM text_pages WHERE archive_id % 3 <> 2
               UNION ALL SELECT *, 2, 'main_document' FROM main_pages),
parsed AS (SELECT archive_id, CASE WHEN r = 2 THEN ordinal ELSE ordinal - min(ordinal) OVER (PARTITION BY archive_id, r) + 1 END AS ordinal,
                  text, strategy
           FROM candidates QUALIFY r = min(r) OVER (PARTITION BY archive_id))"""
QUERIES["p10_parse_archives"] = p10_parse_archives
ORACLES["p10_parse_archives"] = f"{ARCHIVES} SELECT * FROM parsed"


def p11_manifest_mismatches(s, d):
    parsed = p10_parse_archives(s, d)
    manifest = table(s, d, "documents").filter("doc_id % 10 = 0").selectExpr(
        "CAST(doc_id / 10 AS BIGINT) AS archive_id", "'manifest.json' AS entry_name", "99 AS entry_pos",
        "CASE WHEN doc_id % 20 = 0 THEN '{\"page_count\": 5}' ELSE '{\"page_count\": \"x\", \"pages\": [1, 2, 3, 4]}' END AS content")
    return results.manifest_mismatches(manifest, parsed)


QUERIES["p11_manifest_mismatches"] = p11_manifest_mismatches
ORACLES["p11_manifest_mismatches"] = f"""{ARCHIVES},
stated AS (SELECT doc_id // 10 AS archive_id, CASE WHEN doc_id % 20 = 0 THEN 5 ELSE 4 END AS manifest_pages
           FROM documents WHERE doc_id % 10 = 0)
SELECT archive_id, manifest_pages, CAST(coalesce(n, 0) AS BIGINT) AS parsed_pages
FROM stated LEFT JOIN (SELECT archive_id, count(*) AS n FROM parsed GROUP BY 1) USING (archive_id)
WHERE manifest_pages <> coalesce(n, 0)"""

OCR_CAP = 1500


def ocr_run(s, d):
    pages = view(s, d, "page")
    recovered = planning.pages_in_batch(pages, small_batches(s, d)).select(
        "document_id", "batch_no", F.col("batch_index").alias("ordinal"), F.col("original_text").alias("text"))
    return results.apply_ocr(small_batches(s, d), pages, recovered, view(s, d, "document"), cap=OCR_CAP,
                             day=F.lit("2024-01-02").cast("date"))


OCR_PAGE = ["document_id", "page_no", "batch_no", "status", "original_text", "text_hash"]


def applied_sql(finished: str = "true") -> str:
    return f"""{views('document', 'page')}, {SMALL},
texts AS (SELECT document_id, page_no, batch_no, owner_id, original_text AS text, {word_count('original_text')} AS words
          FROM page JOIN small USING (document_id) JOIN document USING (document_id)
          WHERE page_no BETWEEN first_page AND last_page AND {finished}),
claims AS (SELECT * FROM texts WHERE NOT {blank('text')}),
{budget_ctes('claims', 'owner_id', 'document_id, page_no', OCR_CAP)},
applied AS (SELECT document_id, page_no, batch_no, CASE WHEN {blank('text')} THEN NULL ELSE text END AS original_text,
                   CASE WHEN granted IS NULL THEN 'FAILED' WHEN granted THEN 'OCR_DONE' ELSE 'CAPPED' END AS status
            FROM texts LEFT JOIN granted USING (document_id, page_no))"""


APPLIED = applied_sql()
QUERIES["p12_apply_ocr_pages"] = lambda s, d: ocr_run(s, d).pages.select(*OCR_PAGE)
ORACLES["p12_apply_ocr_pages"] = f"""{APPLIED}
SELECT document_id, page_no, batch_no, status, original_text, {content_hash('original_text')} AS text_hash FROM applied"""
QUERIES["p12_apply_ocr_batches"] = lambda s, d: ocr_run(s, d).batches
ORACLES["p12_apply_ocr_batches"] = f"""{APPLIED}
SELECT document_id, batch_no, CASE WHEN bool_and(status <> 'FAILED') THEN 'COMPLETED' ELSE 'PARTIALLY_COMPLETED' END AS status
FROM applied GROUP BY 1, 2"""
QUERIES["p12_apply_ocr_work"] = lambda s, d: ocr_run(s, d).work
ORACLES["p12_apply_ocr_work"] = f"""{APPLIED}
SELECT 'translate' AS topic, format('{{{{"document_id":{{}},"page_no":{{}}}}}}', document_id, page_no) AS payload
FROM applied WHERE status = 'OCR_DONE'
UNION ALL SELECT DISTINCT 'assemble', format('{{{{"document_id":{{}}}}}}', document_id) FROM applied WHERE status = 'CAPPED'"""


def failed_run(s, d):
    failed = small_batches(s, d).filter("document_id % 3 = 0").withColumn("reason", F.lit("job ended as FAILED"))
    return results.fail_batches(failed, view(s, d, "page").select("document_id", "page_no", "status"))


QUERIES["p13_fail_batches_pages"] = lambda s, d: failed_run(s, d).pages
ORACLES["p13_fail_batches_pages"] = f"""{views('page')}, {SMALL}
SELECT document_id, page_no, CASE WHEN status = 'PENDING' THEN 'FAILED' ELSE status END AS status, batch_no
FROM page JOIN small USING (document_id) WHERE page_no BETWEEN first_page AND last_page AND document_id % 3 = 0
UNION ALL SELECT document_id, page_no, status, NULL FROM page
WHERE document_id % 3 <> 0 OR NOT EXISTS (FROM small s WHERE s.document_id = page.document_id AND page_no BETWEEN first_page AND last_page)"""
QUERIES["p13_fail_batches"] = lambda s, d: failed_run(s, d).batches
ORACLES["p13_fail_batches"] = f"""{views('page')}, {SMALL}
SELECT document_id, batch_no, 'FAILED' AS status, 'job ended as FAILED' AS last_error FROM small WHERE document_id % 3 = 0"""

JOB_STATUS = """CASE batch_id % 6 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'PARTIALLY_COMPLETED' WHEN 2 THEN 'FAILED'
  WHEN 3 THEN 'REJECTED' WHEN 4 THEN 'RUNNING' ELSE 'PENDING' END"""
PARSED = "CAST(document_id % 3 AS INT)"
QUERIES["p14_poll_outcomes"] = lambda s, d: planning.poll_outcomes(batches(s, d).withColumns({
    "job_status": F.expr(JOB_STATUS), "parsed_pages": F.expr(PARSED)})).select(
    "batch_id", "job_status", "poll_count", "action", "reason")
ORACLES["p14_poll_outcomes"] = f"""{views('upload')}, {BATCH_SQL}
SELECT batch_id, job_status, poll_count,
  CASE WHEN job_status LIKE '%COMPLETED' THEN CASE WHEN parsed_pages > 0 THEN 'apply' ELSE 'fail' END
       WHEN job_status IN ('FAILED', 'REJECTED') OR poll_count >= 30 THEN 'fail' ELSE 'wait' END AS action,
  CASE WHEN job_status LIKE '%COMPLETED' THEN CASE WHEN parsed_pages = 0 THEN 'no text could be recovered from the result' END
       WHEN job_status IN ('FAILED', 'REJECTED') THEN concat('job ended as ', job_status)
       WHEN poll_count >= 30 THEN concat('gave up after ', poll_count, ' polls') END AS reason
FROM (SELECT *, {JOB_STATUS} AS job_status, {PARSED} AS parsed_pages FROM batch)"""

QUERIES["p15_backoff_delay"] = lambda s, d: batches(s, d).filter("poll_count > 0").select(
    "batch_id", "poll_count", backoff_delay_ms("poll_count").alias("delay_ms"))
DELAY = "CAST(round(least(5000 * pow(1.5, {n} - 1), 60000)) AS BIGINT)"
ORACLES["p15_backoff_delay"] = f"""{views('upload')}, {BATCH_SQL}
SELECT batch_id, poll_count, {DELAY.format(n='poll_count')} AS delay_ms FROM batch WHERE poll_count > 0"""

QUERIES["p16_due_for_poll"] = lambda s, d: planning.due_for_poll(batches(s, d), now(), jitter=False).select(
    "batch_id", "document_id", "job_id", "poll_count", "next_poll_at")
ORACLES["p16_due_for_poll"] = f"""{views('upload')}, {BATCH_SQL}
SELECT batch_id, document_id, job_id, poll_count + 1 AS poll_count,
       {NOW} + {DELAY.format(n='(poll_count + 1)')} * INTERVAL 1 MILLISECOND AS next_poll_at
FROM batch WHERE status = 'RUNNING' AND job_id IS NOT NULL AND next_poll_at <= {NOW}"""

QUERIES["p17_stalled_batches"] = lambda s, d: planning.stalled_batches(
    batches(s, d), view(s, d, "upload"), now()).select("batch_id", "document_id", "language", "status", "next_poll_at")
ORACLES["p17_stalled_batches"] = f"""{views('upload')}, {BATCH_SQL}
SELECT batch_id, document_id, language, 'PENDING' AS status, {NOW} + INTERVAL 60 SECOND AS next_poll_at
FROM (SELECT * FROM batch WHERE status IN ('PENDING', 'RUNNING') AND job_id IS NULL AND next_poll_at <= {NOW} AND attempts < 3)
LEFT JOIN upload USING (document_id)"""

SUBMITTED = "CASE batch_id % 4 WHEN 0 THEN 'submitted' WHEN 1 THEN 'paused' WHEN 2 THEN 'failed' END"


def p18_claim_submissions(s, d):
    outcomes = batches(s, d).select(
        "batch_id", F.expr(SUBMITTED).alias("outcome"), F.concat(F.lit("new-"), F.col("batch_id").cast("string")).alias("new_job_id"),
        F.lit("timeout").alias("error")).filter("outcome IS NOT NULL")
    return planning.claim_submissions(batches(s, d), outcomes, now()).select(
        "batch_id", "status", "attempts", "job_id", "next_poll_at", "last_error")


QUERIES["p18_claim_submissions"] = p18_claim_submissions
ORACLES["p18_claim_submissions"] = f"""{views('upload')}, {BATCH_SQL},
asked AS (SELECT *, CASE WHEN status = 'PENDING' AND attempts < 3 THEN {SUBMITTED} END AS o FROM batch)
SELECT batch_id, CASE WHEN o IN ('submitted', 'failed') THEN 'RUNNING' ELSE status END AS status,
       CASE WHEN o IN ('submitted', 'failed') THEN attempts + 1 ELSE attempts END AS attempts,
       CASE WHEN o = 'submitted' THEN concat('new-', batch_id) ELSE job_id END AS job_id,
       CASE WHEN o = 'submitted' THEN {NOW} + INTERVAL 5 SECOND ELSE next_poll_at END AS next_poll_at,
       CASE WHEN o = 'failed' THEN 'timeout' ELSE last_error END AS last_error FROM asked"""
