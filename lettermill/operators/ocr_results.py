"""OCR result archives back onto numbered pages."""

from __future__ import annotations

import json
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lettermill.functions.calls import BUDGET_ZONE, local_day
from lettermill.functions.text import content_hash, is_blank, strip, word_count
from lettermill.functions.ranges import absolute_page_no, range_size
from lettermill.operators.limits import DAILY_WORDS, claim_budget
from lettermill.operators.ocr_planning import pages_in_batch
from lettermill.sources.changes import enqueue

# Where a page's text is looked for, and how archive entries are named.
TEXT_FIELDS = ("markdown", "md", "text", "content", "page_content", "extracted_text", "output")
ENVELOPES = ("data", "result", "page")
PAGE_JSON = "(?is)^.*page_([0-9]+)\\.json$"
PAGE_TEXT = "(?is)^.*page_([0-9]+)\\.(?:md|txt)$"
PAGE_BREAKS = ("\n---\n", "\f", "<!-- page -->")
STRATEGIES = ("page_json", "page_text", "main_document")


def _strings(node: dict) -> list[tuple[tuple[str, ...], str]]:
    """Strings of nested objects with the keys that lead to them, in document order; arrays are skipped."""
    found, pending = [], [((), node)]
    while pending:
        path, value = pending.pop()
        if isinstance(value, str):
            found.append((path, value))
        elif isinstance(value, dict):
            pending += [((*path, key), inner) for key, inner in reversed(value.items())]
    return found


def _longest(node: dict) -> str | None:
    """The longest string; an object whose own longest one is blank offers none to the object around it.

    Strings are folded level by level, the deepest first: those of one object leave one.
    """
    offers = [(path, -place, value) for place, (path, value) in enumerate(_strings(node))]
    for depth in range(max((len(path) for path, _, _ in offers), default=0), 0, -1):
        folded: dict[tuple, tuple] = {}
        kept = []
        for path, place, value in offers:
            if len(path) < depth:
                kept.append((path, place, value))
            else:
                rival = folded.get(path[:-1])
                folded[path[:-1]] = max(rival, (len(value), place, value)) if rival else (len(value), place, value)
        offers = kept + [(path, place, value) for path, (_, place, value) in folded.items() if value.strip()]
    return offers[0][2] if offers else None


def _parse(text: str | None):
    try:
        node = json.loads(text) if text is not None else None
    except ValueError:
        return None
    return node if isinstance(node, dict) else None


@F.pandas_udf(StringType())
def _longest_string(values: pd.Series) -> pd.Series:
    def find(text):
        node = _parse(text)
        return _longest(node) if node else None

    return values.map(find, na_action="ignore")


@F.pandas_udf(StringType())
def _path_of_text(values: pd.Series, wanted: pd.Series) -> pd.Series:
    def find(text, target):
        node = _parse(text) if target is not None else None
        return next((".".join(path) for path, value in _strings(node) if value == target), None) if node else None

    return pd.Series([find(t, w) for t, w in zip(values, wanted)], dtype="object")


def named_page_text(document: Column) -> Column:
    """Text under a configured field of a variant: top level first, then inside an envelope."""
    paths = [f"$.{f}" for f in TEXT_FIELDS] + [f"$.{e}.{f}" for e in ENVELOPES for f in TEXT_FIELDS]
    values = F.array(*(F.try_variant_get(document, p, "variant") for p in paths))
    strings = F.filter(values, lambda v: F.schema_of_variant(v) == "STRING")
    texts = F.filter(F.transform(strings, lambda v: v.cast("string")), lambda t: ~is_blank(t))
    return F.get(texts, 0)


def extract_page_text(df: DataFrame, json_column: str = "json", out: str = "text") -> DataFrame:
    """Add the text of one page's JSON: named fields, else the longest string inside, else null.

    The JSON is parsed once, and only rows without a named field reach the Python fallback.
    """
    parsed = df.withColumn("_document", F.try_parse_json(F.col(json_column)))
    named = parsed.withColumn("_named", named_page_text(F.col("_document")))
    rest = F.when(F.col("_named").isNull() & F.col("_document").isNotNull(), F.col(json_column))
    return named.withColumn(out, F.coalesce("_named", _longest_string(rest))).drop("_document", "_named")


def _last_per_ordinal(found: DataFrame) -> DataFrame:
    # Entries without text are passed over here: a filter in front would run the fallback twice.
    place = F.when(F.col("text").isNotNull(), F.col("entry_pos"))
    last = found.groupBy("archive_id", "ordinal").agg(F.max_by("text", place).alias("text"))
    return last.filter(F.col("text").isNotNull())


def _text_content(df: DataFrame) -> DataFrame:
    kind = dict(df.dtypes)["content"]
    return df if kind == "string" else df.withColumn("content", F.decode("content", "UTF-8"))


def _numbered(entries: DataFrame, pattern: str) -> DataFrame:
    named = entries.filter(F.col("entry_name").rlike(pattern))
    ordinal = F.regexp_extract("entry_name", pattern, 1).try_cast("int")
    return _text_content(named.withColumn("ordinal", ordinal))


def pages_from_json(entries: DataFrame) -> DataFrame:
    """(archive_id, ordinal, text) of ``page_NNN.json`` entries; the last duplicate wins."""
    return _last_per_ordinal(extract_page_text(_numbered(entries, PAGE_JSON), "content"))


def pages_from_text(entries: DataFrame) -> DataFrame:
    """(archive_id, ordinal, text) of non-blank ``page_NNN.md`` and ``.txt`` entries."""
    found = _numbered(entries, PAGE_TEXT).withColumn("text", F.col("content")).filter(~is_blank("text"))
    return _last_per_ordinal(found)


def _split_parts(content: Column, mark: str) -> Column:
    # Trailing empty parts do not count; quoting keeps the mark literal.
    quoted = f"\\Q{mark}\\E"
    body = F.regexp_replace(content, f"(?:{quoted})+\\z", "")
    return F.when((body == "") & (content != ""), F.array().cast("array<string>")).otherwise(F.split(body, quoted))


def _parts_as_expected(content: Column) -> Column:
    """Parts by the first page break that gives ``expected_pages`` of them, else null."""
    return F.coalesce(*(
        F.when(F.size(p) == F.col("expected_pages"), p)
        for p in (_split_parts(content, mark) for mark in PAGE_BREAKS)))


def split_main_document(entries: DataFrame, expected: DataFrame) -> DataFrame:
    """(archive_id, ordinal, text) from the largest other ``.md`` entry.

    Page breaks are tried in order; one is accepted only if it yields exactly
    ``expected_pages`` parts.
    """
    name = F.lower("entry_name")
    others = entries.filter(name.endswith(".md") & ~F.col("entry_name").rlike(PAGE_TEXT))
    size = F.octet_length("content")
    main = others.groupBy("archive_id").agg(
        F.max_by("content", F.struct(size, -F.col("entry_pos"))).alias("content"))
    sized = _text_content(main).join(expected.select("archive_id", "expected_pages"), "archive_id")
    parts = _parts_as_expected(F.col("content"))
    return sized.select("archive_id", F.posexplode(parts).alias("_i", "part")).select(
        "archive_id", (F.col("_i") + 1).alias("ordinal"), strip("part").alias("text"))


def normalise_ordinals(found: DataFrame) -> DataFrame:
    """Number pages from 1 per archive, whatever the first ordinal. Archives hold at most 1000 entries."""
    first = F.min("ordinal").over(Window.partitionBy("archive_id"))
    return found.withColumn("ordinal", F.col("ordinal") - first + 1)


def parse_archives(entries: DataFrame, expected: DataFrame) -> DataFrame:
    """(archive_id, ordinal, text, strategy): the first strategy that finds a page serves its archive.

    Entries are read once: each falls to one strategy by its name, one aggregation keeps the last
    of every page and the largest main document, and the strategies of an archive meet in a window
    of at most 1000 rows.
    """
    name = F.col("entry_name")
    strategy = (
        F.when(name.rlike(PAGE_JSON), 0).when(name.rlike(PAGE_TEXT), 1).when(F.lower(name).endswith(".md"), 2))
    kinds = entries.withColumn("_rank", strategy).filter(F.col("_rank").isNotNull())
    pattern = F.when(F.col("_rank") == 0, F.regexp_extract(name, PAGE_JSON, 1)).when(
        F.col("_rank") == 1, F.regexp_extract(name, PAGE_TEXT, 1))
    binary = dict(entries.dtypes)["content"] != "string"
    content = F.decode("content", "UTF-8") if binary else F.col("content")
    numbered = kinds.withColumns({
        "ordinal": pattern.try_cast("int"), "_json": F.when(F.col("_rank") == 0, content)})
    read = extract_page_text(numbered, "_json", "_found")
    plain = F.when(F.col("_rank") == 1, content)
    page = F.coalesce("_found", F.when(~is_blank(plain), plain))
    last = read.withColumn("_page", page).groupBy("archive_id", "_rank", "ordinal").agg(
        F.max_by("_page", F.when(F.col("_page").isNotNull(), F.col("entry_pos"))).alias("text"),
        F.max_by("content", F.when(F.col("_rank") == 2, F.struct(F.octet_length("content"), -F.col("entry_pos")))).alias("content"))
    sized = last.join(expected.select("archive_id", "expected_pages"), "archive_id", "left")
    parts = F.when(F.col("_rank") == 2, _parts_as_expected(content))
    served = sized.withColumn("_parts", parts).filter(F.col("text").isNotNull() | F.col("_parts").isNotNull())
    of_archive = Window.partitionBy("archive_id")
    chosen = served.withColumn("_best", F.min("_rank").over(of_archive)).filter(F.col("_rank") == F.col("_best"))
    placed = chosen.withColumn("ordinal", F.col("ordinal") - F.min("ordinal").over(of_archive) + 1)
    split = F.transform("_parts", lambda p, i: F.struct((i + 1).alias("ordinal"), strip(p).alias("text")))
    one = F.array(F.struct(F.col("ordinal"), F.col("text")))
    label = F.element_at(F.array(*map(F.lit, STRATEGIES)), F.col("_rank") + 1)
    return placed.select("archive_id", label.alias("strategy"), F.inline(F.when(F.col("_rank") == 2, split).otherwise(one))).select(
        "archive_id", "ordinal", "text", "strategy")


def manifest_mismatches(entries: DataFrame, parsed: DataFrame) -> DataFrame:
    """Archives whose manifest states another page count than was parsed. A diagnostic only."""
    named = entries.filter(F.lower("entry_name").endswith("manifest.json"))
    first = named.groupBy("archive_id").agg(F.min_by("content", "entry_pos").alias("content"))
    manifest = _text_content(first).withColumn("_m", F.try_parse_json("content"))
    count = F.try_variant_get("_m", "$.page_count", "variant")
    whole = F.when(F.schema_of_variant(count).isin("BIGINT", "INT"), F.try_variant_get("_m", "$.page_count", "int"))
    listed = F.json_array_length(F.get_json_object("content", "$.pages"))
    stated = manifest.select("archive_id", F.coalesce(whole, listed).alias("manifest_pages"))
    counted = parsed.groupBy("archive_id").agg(F.count(F.lit(1)).alias("parsed_pages"))
    joined = stated.join(counted, "archive_id", "left").withColumn(
        "parsed_pages", F.coalesce("parsed_pages", F.lit(0)))
    return joined.filter(F.col("manifest_pages") != F.col("parsed_pages"))


class OcrApplied(NamedTuple):
    pages: DataFrame
    batches: DataFrame
    work: DataFrame


def apply_ocr(batches: DataFrame, pages: DataFrame, parsed: DataFrame, docs: DataFrame,
              used: DataFrame | None = None, cap: int = DAILY_WORDS, day: Column | None = None) -> OcrApplied:
    """Put recovered text onto the pages of finished batches; all other pages stay as they are.

    ``parsed`` holds ``document_id, batch_no, ordinal, text``. A page with text becomes
    OCR_DONE, or CAPPED where its words no longer fit its owner's day; one without becomes
    FAILED. Batches are COMPLETED only when every page was recovered. ``batch_no`` is null for
    pages outside ``batches``. Claims are decided on word counts; texts join last.
    """
    day = day if day is not None else local_day(F.current_timestamp(), BUDGET_ZONE)
    texts = parsed.join(batches.select("document_id", "batch_no", "first_page"), ["document_id", "batch_no"]).select(
        "document_id", absolute_page_no("first_page", "ordinal").alias("page_no"), "text")
    texts = texts.filter(~is_blank("text"))
    sizes = texts.select("document_id", "page_no", word_count("text").alias("words"))
    placed = pages_in_batch(pages.select("document_id", "page_no"), batches)
    owned = placed.join(docs.select("document_id", "owner_id"), "document_id").withColumn("day", day)
    filled = owned.join(sizes, ["document_id", "page_no"], "left")
    claims = claim_budget(filled.filter(F.col("words").isNotNull()), used, cap,
                          order=("document_id", "page_no")).select("document_id", "page_no", "granted")
    decided = filled.join(claims, ["document_id", "page_no"], "left")
    status = F.when(F.col("words").isNull(), "FAILED").when(F.col("granted"), "OCR_DONE").otherwise("CAPPED")
    decided = decided.select("document_id", "page_no", "batch_no", status.alias("status"))
    read = decided.join(texts, ["document_id", "page_no"], "left").select(
        "document_id", "page_no", "batch_no", F.col("status").alias("_status"), F.col("text").alias("_text"),
        content_hash("text").alias("_hash"))
    # One join from the page table, on the key that the recovered texts are dealt by already.
    held = [c for c in ("document_id", "page_no", "status", "original_text", "text_hash", "translated_text") if c in pages.columns]
    placed_now = F.col("_status").isNotNull()
    old = lambda c: F.col(c) if c in held else F.lit(None).cast("string")
    translated = {"translated_text": F.when(~placed_now, F.col("translated_text"))} if "translated_text" in held else {}
    updated = pages.select(*held).join(read, ["document_id", "page_no"], "left").withColumns({
        "status": F.coalesce("_status", old("status")),
        "original_text": F.when(placed_now, F.col("_text")).otherwise(old("original_text")),
        "text_hash": F.when(placed_now, F.col("_hash")).otherwise(old("text_hash")), **translated,
    }).select("document_id", "page_no", "batch_no", "status", "original_text", "text_hash", *translated)
    complete = F.bool_and(F.col("status") != "FAILED")
    settled = decided.groupBy("document_id", "batch_no").agg(
        F.when(complete, "COMPLETED").otherwise("PARTIALLY_COMPLETED").alias("status"))
    translate = enqueue(decided.filter(F.col("status") == "OCR_DONE"), "translate", "document_id", "page_no")
    capped = decided.filter(F.col("status") == "CAPPED").select("document_id").distinct()
    return OcrApplied(updated, settled, translate.unionByName(enqueue(capped, "assemble", "document_id")))


def _with_others(updated: DataFrame, pages: DataFrame) -> DataFrame:
    """``updated`` and the pages that aren't in it; a translation of a page that was read again goes."""
    held = [c for c in dict.fromkeys((*updated.columns, "translated_text")) if c in pages.columns]
    others = pages.select(*held).join(updated.select("document_id", "page_no"), ["document_id", "page_no"], "left_anti")
    return updated.unionByName(others, allowMissingColumns=True)


class BatchesFailed(NamedTuple):
    pages: DataFrame
    batches: DataFrame


def fail_batches(failed: DataFrame, pages: DataFrame) -> BatchesFailed:
    """Fail batches (with ``reason``): their PENDING pages fail, all others keep their state.

    ``batch_no`` is null for pages outside the failed batches.
    """
    placed = pages_in_batch(pages, failed).drop("first_page", "last_page", "batch_index")
    status = F.when(F.col("status") == "PENDING", "FAILED").otherwise(F.col("status"))
    updated = placed.withColumn("status", status)
    settled = failed.select("document_id", "batch_no", F.lit("FAILED").alias("status"),
                            F.col("reason").alias("last_error"))
    return BatchesFailed(_with_others(updated, pages), settled)


def expected_pages(batches: DataFrame) -> DataFrame:
    return batches.select("archive_id", range_size("first_page", "last_page").alias("expected_pages"))


def text_provenance(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """The first JSON path of an archive whose string equals the text given for it."""
    held = _text_content(entries.filter(F.lower("entry_name").endswith(".json"))).join(texts, "archive_id")
    found = held.withColumn("path", _path_of_text("content", "text"))
    source = F.concat(F.col("entry_name"), F.lit(" -> "), F.col("path"))
    place = F.when(F.col("path").isNotNull(), F.col("entry_pos"))
    first = found.groupBy("archive_id").agg(F.min_by(source, place).alias("text_source"))
    return texts.join(first, "archive_id", "left")
