import pytest
from pyspark.sql import functions as F

from lettermill.functions.text import content_hash
from lettermill.operators import enrichment as en
from lettermill.operators import state



def now():
    return F.expr("TIMESTAMP '2024-01-02 00:00:00'")


def ledger(spark, rows):
    return spark.createDataFrame(rows, "idempotency_key string, attempts int, status string, result string, lease string").withColumn(
        "lease_until", F.col("lease").cast("timestamp")).drop("lease")


def test_plan_calls(spark):
    known = ledger(spark, [("done", 1, "DONE", "r", None), ("live", 1, "RUNNING", None, "2024-01-03"),
                           ("late", 2, "RUNNING", None, "2024-01-01"), ("open", 1, "PENDING", None, None)])
    work = spark.createDataFrame([(k,) for k in ("done", "live", "late", "open", "absent")], "idempotency_key string")
    got = {r[0]: (r["action"], r["next_attempt"], r["stored_result"]) for r in en.plan_calls(work, known, now()).collect()}
    assert got == {"done": ("REUSE", None, "r"), "live": ("BUSY", None, None), "late": ("TAKEOVER", 3, None),
                   "open": ("TAKEOVER", 2, None), "absent": ("NEW", 1, None)}


def test_done_is_never_taken_back(spark):
    old = ledger(spark, [("a", 1, "DONE", "first", None), ("b", 1, "PENDING", None, None)])
    new = ledger(spark, [("a", 2, "PENDING", None, None), ("b", 2, "DONE", "second", None), ("c", 1, "DONE", "third", None)])
    got = {r[0]: (r["status"], r["result"]) for r in en.merge_ledger(old, new).collect()}
    assert got == {"a": ("DONE", "first"), "b": ("DONE", "second"), "c": ("DONE", "third")}


@pytest.fixture()
def letters(spark):
    docs = spark.createDataFrame([("d1", "o1", "hi"), ("d2", "o1", "en"), ("d3", "o2", "as")],
                                 "document_id string, owner_id string, language string")
    pages = spark.createDataFrame(
        [("d1", 1, "OCR_DONE", "एक वाक्य। दूसरा वाक्य।"), ("d1", 2, "OCR_DONE", "एक वाक्य। दूसरा वाक्य।"), ("d2", 1, "OCR_DONE", "English."),
         ("d3", 1, "FAILED", "no"), ("d3", 2, "OCR_DONE", "তৃতীয়")], "document_id string, page_no int, status string, original_text string")
    return docs, pages.withColumn("text_hash", content_hash("original_text")).withColumn(
        "translated_text", F.lit(None).cast("string"))


def counting(path):
    def call(text):
        with open(path, "a", encoding="utf-8") as log:
            log.write("x\n")
        if "তৃ" in text:
            raise RuntimeError("down")
        return f"<{text}>"

    return call


def calls_made(path):
    return sum(1 for _ in open(path, encoding="utf-8")) if path.exists() else 0


def test_translate_once_and_rerun_free(spark, letters, tmp_path):
    docs, pages = letters
    log = tmp_path / "calls"
    empty = spark.createDataFrame([], en.LEDGER_SCHEMA)
    first = en.translate_pages(pages, docs, empty, counting(log), now(), limit=12)
    got = {(r["document_id"], r["page_no"]): r["translated_text"] for r in first.results.collect()}
    assert got == {("d1", 1): "<एक वाक्य।> <दूसरा वाक्य।>", ("d1", 2): "<एक वाक्य।> <दूसरा वाक्य।>", ("d2", 1): "English.", ("d3", 2): None}
    # Translation keys name the page: equal pages are paid for separately; English is free.
    assert calls_made(log) == 5
    failed = first.outcomes.filter("status = 'PENDING'").collect()
    assert [r["last_error"] for r in failed] == ["RuntimeError: down"]

    second = en.translate_pages(pages, docs, first.ledger, counting(log), now(), limit=12)
    assert {r["translated_text"] for r in second.results.collect()} >= {"<एक वाक्य।> <दूसरा वाक्य।>"}
    # Only the failed call is taken over.
    assert calls_made(log) == 6


def test_speech_is_shared_within_an_owner_only(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "o1", "hi"), ("d2", "o1", "as"), ("d3", "o2", "as")],
                                 "document_id string, owner_id string, language string")
    pages = spark.createDataFrame([(d, 1, "TRANSLATED", "मूल", "Same words.") for d in ("d1", "d2", "d3")],
                                  "document_id string, page_no int, status string, original_text string, translated_text string")
    log = tmp_path / "calls"
    run = en.speak_pages(pages, docs, spark.createDataFrame([], en.LEDGER_SCHEMA), counting(log), now())
    tracks = {(r["document_id"], r["track"]) for r in run.results.collect()}
    assert tracks == {("d1", "en"), ("d1", "orig"), ("d2", "en"), ("d3", "en")}
    assert calls_made(log) == 3


def test_edit_recomputes_its_page_and_revert_nothing(spark, letters):
    docs, pages = letters
    base = en.translate_pages(pages.filter("document_id = 'd1'"), docs, spark.createDataFrame([], en.LEDGER_SCHEMA),
                              lambda t: t, now(), limit=12)
    edited = pages.filter("document_id = 'd1'").withColumn(
        "original_text", F.expr("CASE WHEN page_no = 2 THEN 'नया।' ELSE original_text END"))
    again = state.recompute_set(en.translate_work(edited, docs, 12), base.ledger).collect()
    assert [(r["page_no"], r["chunk"]) for r in again] == [(2, "नया।")]
    assert state.recompute_set(en.translate_work(pages.filter("document_id = 'd1'"), docs, 12), base.ledger).count() == 0


def test_results_apply_only_to_the_text_they_were_made_from(spark, letters):
    _, pages = letters
    hashed = {(r["document_id"], r["page_no"]): r["text_hash"] for r in pages.collect()}
    results = spark.createDataFrame(
        [(1, "d1", 1, "late copy", hashed["d1", 1]), (0, "d1", 1, "good", hashed["d1", 1]), (2, "d1", 2, "stale", "other"),
         (3, "d3", 1, "not waiting", hashed["d3", 1])],
        "result_id int, document_id string, page_no int, translated_text string, text_hash string")
    run = state.apply_translations(pages, results)
    assert [(r["document_id"], r["page_no"], r["translated_text"]) for r in run.pages.filter("applied").collect()] == [("d1", 1, "good")]
    assert sorted(r["result_id"] for r in run.discarded.collect()) == [1, 2, 3]
    assert run.work.count() == 1


@pytest.mark.parametrize("statuses,percent", [
    ([], 0), (["PENDING"], 0), (["INDEXED", "INDEXED"], 100), (["FAILED", "CAPPED"], 100), (["PENDING", "INDEXED"], 50),
    (["OCR_DONE", "ODD", "TRANSLATED"], 25)])
def test_percent_complete(spark, statuses, percent):
    docs = spark.createDataFrame([("d",)], "document_id string")
    pages = spark.createDataFrame([("d", i, s) for i, s in enumerate(statuses)], "document_id string, page_no int, status string")
    assert state.percent_complete(docs, pages).first()["percent"] == percent


def test_edit_outcomes(spark):
    docs = spark.createDataFrame([("d", "o")], "document_id string, owner_id string")
    pages = spark.createDataFrame(
        [("d", 1, "PENDING", None), ("d", 2, "INDEXED", "same"), ("d", 3, "FAILED", "same"), ("d", 4, "CAPPED", "x"), ("d", 5, "INDEXED", "y"),
         ("d", 6, "INDEXED", "z")], "document_id string, page_no int, status string, original_text string")
    pages = pages.withColumn("text_hash", content_hash("original_text")).withColumn("translated_text", F.lit("t"))
    edits = spark.createDataFrame(
        [(1, "d", 1, "o", "a"), (2, "d", 2, "o", " same "), (3, "d", 3, "o", "same"), (4, "d", 4, "o", "one two three four"),
         (5, "d", 5, "o", " "), (6, "d", 6, "o", "b" * 20001), (7, "d", 9, "o", "a"), (8, "d", 2, "other", "a"), (9, "gone", 1, "o", "a"),
         (10, "d", 5, "o", "later"), (11, "d", 6, "o", "later")],
        "edit_id int, document_id string, page_no int, owner_id string, text string").withColumn("day", F.lit("2024-01-01").cast("date"))
    run = state.apply_edits(docs, pages, edits, cap=3)
    assert {r["edit_id"]: r["outcome"] for r in run.outcomes.collect()} == {
        1: "NOT_READY", 2: "NO_OP", 3: "APPLIED", 4: "OVER_BUDGET", 5: "INVALID_BLANK", 6: "INVALID_TOO_LONG",
        7: "PAGE_NOT_FOUND", 8: "NOT_FOUND", 9: "NOT_FOUND", 10: "APPLIED", 11: "APPLIED"}
    page = {r["page_no"]: r for r in run.pages.collect()}
    assert page[3]["status"] == "OCR_DONE" and page[3]["translated_text"] is None and page[3]["edited"]
    assert page[2]["translated_text"] == "t" and not page[2]["edited"]


def test_track_resolution(spark):
    docs = spark.createDataFrame([("both", "o"), ("en", "o"), ("none", "o")], "document_id string, owner_id string")
    tracks = spark.createDataFrame([("both", "en"), ("both", "orig"), ("en", "en")], "document_id string, track string")
    asked = [("both", "orig"), ("en", "orig"), ("none", "orig"), ("en", "en"), ("none", "en"), ("both", "fr")]
    requests = spark.createDataFrame([(i, "o", d, t) for i, (d, t) in enumerate(asked)] + [(9, "x", "both", "en")],
                                     "request_id int, owner_id string, document_id string, lang string")
    got = {r["request_id"]: r["outcome"] for r in en.resolve_track(requests, docs, tracks).collect()}
    assert got == {0: "FOUND", 1: "FALLBACK", 2: "NOT_FOUND", 3: "FOUND", 4: "NOT_FOUND", 5: "INVALID", 9: "NOT_FOUND"}
