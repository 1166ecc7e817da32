"""Several edits of a page in one run, against deciding them one after the other."""

import random

from pyspark.sql import functions as F

from lettermill.functions.text import content_hash
from lettermill.functions.similarity import grams
from lettermill.operators import state


def one_by_one(pages, edits, cap):
    """(edit_id, outcome) in order of edit_id."""
    now, used, out = {p[:2]: list(p[2:]) for p in pages}, {}, []
    for edit_id, doc, page, owner, text in sorted(edits):
        if doc % 5 != int(owner):
            outcome = "NOT_FOUND"
        elif (doc, page) not in now:
            outcome = "PAGE_NOT_FOUND"
        elif now[doc, page][0] == "PENDING":
            outcome = "NOT_READY"
        elif not text.strip():
            outcome = "INVALID_BLANK"
        elif now[doc, page][0] not in ("FAILED", "CAPPED") and now[doc, page][1] == text:
            outcome = "NO_OP"
        elif used.get(owner, 0) + len(text.split()) <= cap:
            outcome = "APPLIED"
            used[owner] = used.get(owner, 0) + len(text.split())
            now[doc, page] = ["OCR_DONE", text]
        else:
            outcome = "OVER_BUDGET"
        out.append((edit_id, outcome))
    return out, {k: v[1] for k, v in now.items()}


def test_every_edit_is_decided_in_order(spark):
    rng = random.Random(4)
    words = ["one", "one two", "one two three", " ", "four five six seven"]
    pages = [(d, p, rng.choice(["OCR_DONE", "FAILED", "CAPPED", "PENDING", "INDEXED"]), rng.choice(words)) for d in range(6) for p in (1, 2)]
    edits = [(i, rng.randrange(6), rng.randrange(1, 4), str(rng.randrange(6) % 5 if rng.random() < 0.1 else 0), rng.choice(words)) for i in range(90)]
    edits = [(i, d, p, str(d % 5) if o == "0" else o, t) for i, d, p, o, t in edits]
    docs = spark.range(6).selectExpr("id AS document_id", "CAST(id % 5 AS STRING) AS owner_id")
    table = spark.createDataFrame(pages, "document_id long, page_no int, status string, original_text string").withColumns({
        "text_hash": content_hash("original_text"), "translated_text": F.lit("t")})
    asked = spark.createDataFrame(edits, "edit_id long, document_id long, page_no int, owner_id string, text string").withColumn(
        "day", F.lit("2024-01-02").cast("date"))
    run = state.apply_edits(docs, table, asked, cap=14)
    want, texts = one_by_one(pages, edits, 14)
    assert sorted((r["edit_id"], r["outcome"]) for r in run.outcomes.collect()) == want
    assert {"APPLIED", "OVER_BUDGET", "NO_OP", "INVALID_BLANK"} <= {o for _, o in want}
    assert {(r["document_id"], r["page_no"]): r["original_text"] for r in run.pages.collect()} == texts


def test_grams_beyond_the_basic_plane(one):
    text = "\U00011103\U00011104\U00011105ab"
    assert one(grams("t", 3), t=text) == [text[i:i + 3] for i in range(3)]
    assert one(grams("t", 2), t="a") == [] and one(grams("t", 2), t="a\nb") == ["a\n", "\nb"]
