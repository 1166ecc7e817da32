import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lettermill.operators import ocr_planning as planning
from lettermill.operators import ocr_results as results
from lettermill.sources import archives


def test_plan_batches(spark):
    docs = spark.createDataFrame([("a", 12), ("b", 10), ("c", 1), ("d", 0), ("e", 30)], "document_id string, total_pages int")
    plan = planning.plan_batches(docs).groupBy("document_id").agg(F.sort_array(F.collect_list("page_range")).alias("r"))
    assert {r["document_id"]: r["r"] for r in plan.collect()} == {
        "a": ["1-10", "11-12"], "b": ["1-10"], "c": ["1-1"], "e": ["1-10", "11-20", "21-30"]}
    assert [r[0] for r in planning.unplannable(docs).select("document_id").collect()] == ["d"]


@pytest.mark.parametrize("language,files,used,reason", [
    ("fr", [("image/png", 1, 1)], 0, "unknown_language"), ("hi", [], 0, "no_files"), ("hi", None, 0, "no_files"),
    ("hi", [("text/plain", 21 * 1024 * 1024, 1)], 9000, "file_too_large"), ("hi", [("text/plain", 1, 1)], 7000, "budget_spent"),
    ("hi", [("text/plain", 1, 40)], 0, "bad_type"), ("hi", [("application/pdf", 1, 31)], 0, "too_many_pages"),
    ("hi", [("application/pdf", 1, 3), ("image/png", 1, 1)], 0, "bad_type"), ("hi-IN", [("application/pdf", 1, 30)], 6999, None),
    ("ta", [("image/png", 1, 1)] * 31, 0, "too_many_pages"), ("ta", [("image/jpeg", 1, 1)] * 30, 0, None)])
def test_validate_uploads(spark, language, files, used, reason):
    uploads = spark.createDataFrame([("o", language, files)],
                                    "owner_id string, language string, files array<struct<content_type:string,bytes:bigint,pages:int>>")
    taken = spark.createDataFrame([("o", used)], "owner_id string, used int")
    assert planning.validate_uploads(uploads, taken).first()["reject_reason"] == reason


@pytest.mark.parametrize("node,text", [
    ({"text": "b", "markdown": "a"}, "a"), ({"markdown": "  ", "output": "o"}, "o"), ({"data": {"content": "c"}, "x": "longer text"}, "c"),
    ({"markdown": 5, "page": {"md": "m"}}, "m"), ({"a": "xx", "b": {"c": "yyyy"}}, "yyyy"), ({"a": "same", "b": "four"}, "same"),
    ({"a": "     ", "b": "x"}, None), ({"n": 1, "list": ["zz"]}, None), ({"o": {"deep": {"er": "found"}}}, "found")])
def test_extract_page_text(spark, node, text):
    df = spark.createDataFrame([(json.dumps(node),)], "json string")
    assert results.extract_page_text(df).first()["text"] == text


def test_extract_page_text_passes_over_bad_json(spark):
    df = spark.createDataFrame([("{oops",), ('"str"',), ("[1]",), (None,)], "json string")
    assert [r["text"] for r in results.extract_page_text(df).collect()] == [None] * 4


def zip_of(entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as out:
        for name, content in entries:
            out.writestr(name, content)
    return buffer.getvalue()


def test_archives_from_files_to_pages(spark, tmp_path):
    page = lambda text: json.dumps({"markdown": text})
    files = {
        "json": [("metadata/", ""), ("metadata/page_000.json", page("zero")), ("metadata/page_001.json", page("one")),
                 ("pages/page_001.md", "ignored"), ("manifest.json", json.dumps({"page_count": 3}))],
        "text": [("pages/page_002.md", "two"), ("pages/page_003.txt", "three"), ("pages/page_004.txt", " ")],
        "main": [("output.md", "first\n---\nsecond\n---\n"), ("small.md", "x")],
        "none": [("output.md", "only one part")],
        "many": [(f"f{i}", "x") for i in range(1001)],
        "huge": [("a", b"0" * (archives.MAX_UNZIPPED_BYTES + 1))],
    }
    for name, entries in files.items():
        (tmp_path / f"{name}.zip").write_bytes(zip_of(entries))
    (tmp_path / "broken.zip").write_bytes(b"PK not a zip")
    read = archives.read_ocr_archives(spark, str(tmp_path)).withColumn(
        "archive_id", F.regexp_extract("archive_id", "([a-z]+)\\.zip$", 1))
    assert {r["archive_id"]: r["reject_reason"] for r in archives.refused(read).collect()} == {
        "many": "too_many_entries", "huge": "too_large", "broken": "unreadable"}
    entries = archives.readable(read)
    expected = spark.createDataFrame([(n, 2) for n in files], "archive_id string, expected_pages int")
    parsed = results.parse_archives(entries, expected)
    got = sorted((r["archive_id"], r["ordinal"], r["text"], r["strategy"]) for r in parsed.collect())
    assert got == [("json", 1, "zero", "page_json"), ("json", 2, "one", "page_json"), ("main", 1, "first", "main_document"),
                   ("main", 2, "second", "main_document"), ("text", 1, "two", "page_text"), ("text", 2, "three", "page_text")]
    mismatch = results.manifest_mismatches(entries, parsed).collect()
    assert [(r["archive_id"], r["manifest_pages"], r["parsed_pages"]) for r in mismatch] == [("json", 3, 2)]
    texts = spark.createDataFrame([("json", "one"), ("text", "two")], "archive_id string, text string")
    sources = {r["archive_id"]: r["text_source"] for r in results.text_provenance(entries, texts).collect()}
    assert sources == {"json": "metadata/page_001.json -> markdown", "text": None}


def test_labelled_samples(spark, tmp_path):
    (tmp_path / "hi").mkdir()
    (tmp_path / "ta").mkdir()
    for name in ("hi/a.jpg", "hi/b.PNG", "ta/c.jpeg", "ta/notes.pdf"):
        (tmp_path / name).write_bytes(b"image")
    (tmp_path / "hi/a.txt").write_text("नमस्ते", encoding="utf-8")
    (tmp_path / "ta/c.txt").write_text("text")
    got = {(r["language"], r["name"]): r["reference"] for r in archives.read_labelled_samples(spark, str(tmp_path)).collect()}
    assert got == {("hi", "a"): "नमस्ते", ("ta", "c"): "text"}
    assert [r["name"] for r in archives.unlabelled_samples(spark, str(tmp_path)).collect()] == ["b"]


def test_second_batch_lands_on_absolute_pages(spark):
    docs = spark.createDataFrame([("d", "o", 12)], "document_id string, owner_id string, total_pages int")
    pages = spark.range(1, 13).selectExpr("'d' AS document_id", "CAST(id AS INT) AS page_no", "'PENDING' AS status")
    batches = planning.plan_batches(docs)
    parsed = spark.createDataFrame([("d", 1, 1, "eleven"), ("d", 1, 2, " "), *(("d", 0, i, f"p{i}") for i in range(1, 11))],
                                   "document_id string, batch_no int, ordinal int, text string")
    run = results.apply_ocr(batches, pages, parsed, docs, cap=10)
    got = {r["page_no"]: (r["status"], r["original_text"]) for r in run.pages.collect()}
    assert got[11] == ("CAPPED", "eleven") and got[12] == ("FAILED", None) and got[10] == ("OCR_DONE", "p10")
    assert {r["batch_no"]: r["status"] for r in run.batches.collect()} == {0: "COMPLETED", 1: "PARTIALLY_COMPLETED"}
    topics = [r["topic"] for r in run.work.collect()]
    assert topics.count("translate") == 10 and topics.count("assemble") == 1


def test_pages_outside_finished_batches_stay(spark):
    docs = spark.createDataFrame([("d", "o", 12)], "document_id string, owner_id string, total_pages int")
    pages = spark.range(1, 13).selectExpr(
        "'d' AS document_id", "CAST(id AS INT) AS page_no", "IF(id = 11, 'TRANSLATED', 'PENDING') AS status",
        "IF(id = 11, 'old', NULL) AS original_text", "IF(id = 11, 'alt', NULL) AS translated_text")
    first = planning.plan_batches(docs).filter("batch_no = 0")
    parsed = spark.createDataFrame([("d", 0, i, f"p{i}") for i in range(1, 11)], "document_id string, batch_no int, ordinal int, text string")
    got = {r["page_no"]: r for r in results.apply_ocr(first, pages, parsed, docs).pages.collect()}
    assert len(got) == 12 and got[12]["status"] == "PENDING" and got[12]["batch_no"] is None
    assert (got[11]["status"], got[11]["original_text"], got[11]["translated_text"]) == ("TRANSLATED", "old", "alt")
    assert got[1]["status"] == "OCR_DONE"
    failed = results.fail_batches(first.withColumn("reason", F.lit("x")), pages).pages.collect()
    assert sorted(r["status"] for r in failed) == ["FAILED"] * 10 + ["PENDING", "TRANSLATED"]


def test_longest_string_folds_inner_objects():
    find = results._longest
    assert find({"a": "xx", "b": {"c": "yyy", "d": "zzz"}}) == "yyy"
    assert find({"a": "x", "b": {"c": "     ", "d": "zz"}}) == "x"
    # A blank one may be the longest; it is refused then.
    assert find({"a": " ", "b": {"c": {"d": "q"}}}) is None and find({"a": "", "b": {"c": {"d": "q"}}}) == "q"
    assert find({"a": [{"b": "listed"}], "n": 5}) is None and find({}) is None
