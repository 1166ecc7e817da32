"""Registered queries of the sources and of a whole run."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from lettermill.plans.archive_run import run_archive
from lettermill.plans.common import now, view, views
from lettermill.plans.enrichment import empty_ledger, mark
from lettermill.plans.ocr import applied_sql, OCR_CAP, small_batches
from lettermill.operators import ocr_planning as planning
from lettermill.session import scratch_dir
from lettermill.sources import archives, tables

QUERIES, ORACLES = {}, {}


def folder(spark):
    return f"{scratch_dir(spark)}/tables-{uuid.uuid4().hex}"


def s1_read_tables(s, d):
    """Ledger rows stored as an archive table and read back with its schema: calls per document and status."""
    root = folder(s)
    calls = view(s, d, "api_call").selectExpr(
        "CAST(call_id AS STRING) AS call_id", "CAST(document_id AS STRING) AS document_id", "endpoint", "units", "unit_type",
        "latency_ms", "http_status", "CAST(created_at AS TIMESTAMP) AS created_at")
    calls.write.parquet(f"{root}/api_call")
    return tables.read_tables(s, root, ["api_call"])["api_call"].groupBy("document_id", "http_status").agg(
        F.count(F.lit(1)).alias("calls"), F.max("created_at").alias("last_call"))


QUERIES["s1_read_tables"] = s1_read_tables
ORACLES["s1_read_tables"] = f"""{views('api_call')}
SELECT CAST(document_id AS VARCHAR) AS document_id, http_status, count(*) AS calls, max(created_at) AS last_call
FROM api_call GROUP BY 1, 2"""


#: Per archive table: the test view it is stored from, its columns, and what is counted of it: a group, an optional column, an amount.
STORED = {
    "document": ("document", ["CAST(document_id AS STRING) AS document_id", "owner_id", "title", "language", "array(tag) AS tags", "year",
                              "CAST(created_at AS TIMESTAMP) AS created_at", "CAST(completed_at AS TIMESTAMP) AS completed_at"],
                 ("concat(language, ' ', tags[0])", "completed_at", "year")),
    "page": ("page", ["CAST(document_id AS STRING) AS document_id", "page_no", "status", "original_text", "translated_text"],
             ("status", "translated_text", "page_no")),
    "ocr_batch": ("page", ["CAST(document_id AS STRING) AS document_id", "concat('1-', CAST(page_no AS STRING)) AS page_range",
                           "CASE status WHEN 'FAILED' THEN 'FAILED' ELSE 'COMPLETED' END AS status", "page_no AS attempts"],
                  ("status", "page_range", "attempts")),
    "stage_task": ("stage_task", ["idempotency_key", "attempts", "status", "result", "CAST(lease_until AS TIMESTAMP) AS lease_until"],
                   ("status", "result", "attempts")),
    "api_call": ("api_call", ["CAST(call_id AS STRING) AS call_id", "endpoint", "units", "unit_type", "latency_ms", "http_status",
                              "CAST(created_at AS TIMESTAMP) AS created_at"], ("endpoint", "created_at", "units")),
    "outbox": ("outbox", ["CAST(id AS STRING) AS id", "topic", "CAST(published_at AS TIMESTAMP) AS published_at", "CAST(id % 3 AS INT) AS attempts"],
               ("topic", "published_at", "attempts")),
    "user_daily_usage": ("word_claim", ["owner_id", "date_add(DATE '2024-01-01', day) AS day", "CAST(length(text) AS BIGINT) AS used"],
                         ("CAST(day AS STRING)", "owner_id", "used")),
}


def s1_read_all_tables(s, d):
    """All seven archive tables stored, read back with their schemas and counted; a column that wasn't stored reads as null."""
    root, found = folder(s), None
    for name, (source, columns, _) in STORED.items():
        view(s, d, source).selectExpr(*columns).write.parquet(f"{root}/{name}")
    for name, table in tables.read_tables(s, root).items():
        group, optional, amount = STORED[name][2]
        missing = [c for c in table.columns if not any(e == c or e.endswith(f" AS {c}") for e in STORED[name][1])]
        unstored = F.lit(0).cast("bigint")
        for c in missing:
            unstored = unstored + F.count(c)
        counted = table.groupBy(F.lit(name).alias("table_name"), F.expr(group).alias("kind")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count(optional).alias("filled"), F.sum(amount).cast("bigint").alias("amount"),
            unstored.alias("unstored"))
        found = counted if found is None else found.unionByName(counted)
    return found


QUERIES["s1_read_all_tables"] = s1_read_all_tables
ORACLES["s1_read_all_tables"] = f"""{views('document', 'page', 'stage_task', 'api_call', 'outbox', 'word_claim')},
counted AS (
SELECT 'document' AS table_name, concat(language, ' ', tag) AS kind, completed_at IS NOT NULL AS has, year AS amount FROM document
UNION ALL SELECT 'page', status, translated_text IS NOT NULL, page_no FROM page
UNION ALL SELECT 'ocr_batch', CASE status WHEN 'FAILED' THEN 'FAILED' ELSE 'COMPLETED' END, true, page_no FROM page
UNION ALL SELECT 'stage_task', status, result IS NOT NULL, attempts FROM stage_task
UNION ALL SELECT 'api_call', endpoint, true, units FROM api_call
UNION ALL SELECT 'outbox', topic, published_at IS NOT NULL, id % 3 FROM outbox
UNION ALL SELECT 'user_daily_usage', strftime(DATE '2024-01-01' + day, '%Y-%m-%d'), owner_id IS NOT NULL, length(text) FROM word_claim)
SELECT table_name, kind, count(*) AS n_rows, count(*) FILTER (has) AS filled, CAST(sum(amount) AS BIGINT) AS amount, 0::BIGINT AS unstored
FROM counted GROUP BY 1, 2"""


def zipped(s, d):
    """One ZIP per OCR archive; every seventh is cut short."""
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as out:
            out.writestr("metadata/", "")
            for ordinal, text in sorted(zip(rows["ordinal"], rows["json"])):
                out.writestr(f"metadata/page_{ordinal:03d}.json", text)
        archive_id, data = int(rows["archive_id"].iloc[0]), buffer.getvalue()
        return pd.DataFrame({"archive_id": [archive_id], "content": [data[: len(data) // 2] if archive_id % 7 == 0 else data]})

    return view(s, d, "ocr_entry").groupBy("archive_id").applyInPandas(pack, "archive_id bigint, content binary")


QUERIES["s2_read_ocr_archives"] = lambda s, d: archives.unzip(zipped(s, d)).select(
    "archive_id", "entry_name", F.decode("content", "UTF-8").alias("json"), "reject_reason")
ORACLES["s2_read_ocr_archives"] = f"""{views('ocr_entry')}
SELECT archive_id, format('metadata/page_{{:03d}}.json', ordinal) AS entry_name, json, NULL AS reject_reason
FROM ocr_entry WHERE archive_id % 7 <> 0
UNION ALL SELECT DISTINCT archive_id, NULL, NULL, 'unreadable' FROM ocr_entry WHERE archive_id % 7 = 0"""


def s4_write_partitioned(s, d):
    root = folder(s)
    tables.write_partitioned(view(s, d, "api_call"), f"{root}/api_call", ["endpoint"])
    stored = s.read.parquet(f"{root}/api_call")
    return stored.select("call_id", "endpoint", "units")


QUERIES["s4_write_partitioned"] = s4_write_partitioned
ORACLES["s4_write_partitioned"] = f"{views('api_call')} SELECT call_id, endpoint, units FROM api_call"


#: Some documents have batches that aren't finished yet.
FINISHED = "(document_id + batch_no) % 9 <> 0"


def whole_run(s, d):
    docs, pages, batches = view(s, d, "document"), view(s, d, "page"), small_batches(s, d).filter(FINISHED)
    parsed = planning.pages_in_batch(pages, batches).select(
        "document_id", "batch_no", F.col("batch_index").alias("ordinal"), F.col("original_text").alias("text"))
    pages = pages.select("document_id", "page_no", F.lit("PENDING").alias("status"))
    return run_archive(docs, pages, batches, parsed, empty_ledger(s), empty_ledger(s), mark, mark, now(),
                       F.lit("2024-01-02").cast("date"), cap=OCR_CAP, translate_limit=120, speech_limit=150)


QUERIES["run_archive_documents"] = lambda s, d: whole_run(s, d).documents
RUN = f"""{applied_sql(FINISHED)},
state AS (SELECT page.document_id, page.page_no, coalesce(a.status, 'PENDING') AS status
          FROM page LEFT JOIN applied a ON a.document_id = page.document_id AND a.page_no = page.page_no),
outcome AS (SELECT document_id, CASE WHEN bool_or(status = 'PENDING') THEN 'DEFERRED'
  WHEN bool_or(status IN ('FAILED', 'CAPPED')) THEN 'PARTIAL' ELSE 'COMPLETE' END AS outcome FROM state GROUP BY document_id)"""
ORACLES["run_archive_documents"] = f"{RUN} SELECT * FROM outcome"
QUERIES["run_archive_pages"] = lambda s, d: whole_run(s, d).pages.select("document_id", "page_no", "status")
ORACLES["run_archive_pages"] = f"""{RUN}
SELECT document_id, page_no, CASE WHEN status <> 'OCR_DONE' THEN status WHEN outcome = 'DEFERRED' THEN 'AUDIO_DONE' ELSE 'INDEXED' END AS status
FROM state JOIN outcome USING (document_id)"""
