"""Inputs shared by the registered queries, and SQL pieces shared by their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions.text import STRIP_CHARS
from lettermill.operators.ocr_planning import plan_batches
from lettermill.sources.adapters import adapter, base_table, with_views

NOW = "TIMESTAMP '2024-01-02 00:00:00'"


def now():
    return F.expr(NOW)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return base_table(spark, sf_dir, name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return adapter(spark, sf_dir, name)


def views(*names: str, recursive: bool = False) -> str:
    text = with_views(*names) if names else "WITH"
    return text.replace("WITH", "WITH RECURSIVE", 1) if recursive else text


# --- SQL pieces -----------------------------------------------------------------------

def strip(x: str) -> str:
    return f"trim({x}, '{STRIP_CHARS}')"


def blank(x: str) -> str:
    return f"coalesce({strip(x)} = '', true)"


def content_hash(x: str) -> str:
    return f"sha256({strip(f'nfc_normalize({x})')})"


def word_count(x: str) -> str:
    plain = "".join(chr(i) for i in range(1, 33))
    return (f"CASE WHEN {blank(x)} THEN 0 ELSE greatest(1, "
            f"len(regexp_extract_all(trim({x}, '{plain}'), '[^\\t-\\r ]+'))) END")


def sentence_list(x: str) -> str:
    marked = f"regexp_replace({x}, '([।॥.?!])[\\t-\\r ]+', '\\1' || chr(1), 'g')"
    marked = f"string_split(regexp_replace({marked}, '\\n+', chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({marked}, lambda x: {strip('x')}), lambda x: x <> '')"


def hard_ctes(limit: int, ids: str, source: str = "sx") -> str:
    """``pieces(ids, si, ps)`` of the over-long rows of ``source(ids, si, sentence)``."""
    space = f"strpos(reverse(left(rest, {limit + 1})), ' ')"
    return f"""
hard AS (
  SELECT {ids}, si, 0 AS pi, '' AS piece, sentence AS rest FROM {source} WHERE length(sentence) > {limit}
  UNION ALL
  SELECT {ids}, si, pi + 1, CASE WHEN length(rest) <= {limit} THEN {strip('rest')} ELSE {strip('left(rest, brk)')} END,
         CASE WHEN length(rest) <= {limit} THEN '' ELSE ltrim(substr(rest, brk + 1), '{STRIP_CHARS}') END
  FROM (SELECT *, CAST(CASE WHEN {space} BETWEEN 1 AND {limit} THEN {limit + 1} - {space} ELSE {limit} END AS BIGINT) AS brk
        FROM hard WHERE rest <> '')),
pieces AS (SELECT {ids}, si, list(piece ORDER BY pi) AS ps FROM hard WHERE pi > 0 AND piece <> '' GROUP BY {ids}, si)"""


def chunk_ctes(source: str, ids: str, text: str, limit: int) -> str:
    """``chunks(ids, chunk_index, chunk)`` of ``source``; needs WITH RECURSIVE."""
    using = f"USING ({ids}, si)"
    return f"""
sx AS (SELECT {ids}, unnest(range(len(s))) AS si, unnest(s) AS sentence
       FROM (SELECT {ids}, {sentence_list(text)} AS s FROM {source})),
{hard_ctes(limit, ids)},
items AS (SELECT {ids}, list({{'cur': CASE WHEN ps IS NULL THEN sentence ELSE '' END, 'out': coalesce(ps, []::VARCHAR[])}} ORDER BY si) AS it
          FROM sx LEFT JOIN pieces {using} GROUP BY {ids}),
packed AS (SELECT {ids}, list_reduce(it, lambda a, x:
    CASE WHEN len(x.out) > 0 THEN {{'cur': '', 'out': list_concat(a.out, CASE WHEN a.cur <> '' THEN [a.cur] ELSE []::VARCHAR[] END, x.out)}}
         WHEN a.cur = '' THEN {{'cur': x.cur, 'out': a.out}}
         WHEN length(a.cur) + 1 + length(x.cur) > {limit} THEN {{'cur': x.cur, 'out': list_append(a.out, a.cur)}}
         ELSE {{'cur': a.cur || ' ' || x.cur, 'out': a.out}} END, {{'cur': '', 'out': []::VARCHAR[]}}) AS r FROM items),
chunks AS (SELECT {ids}, CAST(unnest(range(len(o))) AS INT) AS chunk_index, unnest(o) AS chunk
           FROM (SELECT {ids}, list_concat(r.out, CASE WHEN r.cur <> '' THEN [r.cur] ELSE []::VARCHAR[] END) AS o FROM packed))"""


def budget_ctes(source: str, keys: str, order: str, cap: int, used: str = "0", name: str = "granted") -> str:
    """``name(keys, order, words, granted)``: the ordered fold over ``source(keys, order, words)``."""
    item = ", ".join(f"'{c.strip()}': {c.strip()}" for c in order.split(","))
    back = ", ".join(f"e.{c.strip()} AS {c.strip()}" for c in order.split(","))
    return f"""
{name}_lists AS (SELECT {keys}, list({{{item}, 'words': words}} ORDER BY {order}) AS it, CAST(max({used}) AS BIGINT) AS used0
           FROM {source} GROUP BY {keys}),
{name}_folded AS (SELECT {keys}, it, list_reduce(list_transform(it, lambda e: {{'u': CAST(e.words AS BIGINT), 'g': []::BOOLEAN[]}}), lambda a, x:
    CASE WHEN x.u <= 0 THEN {{'u': a.u, 'g': list_append(a.g, true)}}
         WHEN a.u + x.u <= {cap} THEN {{'u': a.u + x.u, 'g': list_append(a.g, true)}}
         ELSE {{'u': a.u, 'g': list_append(a.g, false)}} END, {{'u': used0, 'g': []::BOOLEAN[]}}).g AS g FROM {name}_lists),
{name} AS (SELECT {keys}, {back}, e.words AS words, granted
            FROM (SELECT {keys}, unnest(it) AS e, unnest(g) AS granted FROM {name}_folded))"""


# --- OCR batches over the upload view ---------------------------------------------------

BATCH_COLUMNS = {
    "batch_id": "document_id * 100 + batch_no",
    "status": "CASE (document_id + batch_no) % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'RUNNING' "
              "WHEN 3 THEN 'COMPLETED' WHEN 4 THEN 'FAILED' ELSE 'PARTIALLY_COMPLETED' END",
    "job_id": "CASE WHEN (document_id + batch_no) % 6 IN (2, 3, 5) THEN concat('job-', CAST(document_id AS STRING)) END",
    "poll_count": "CAST(document_id % 35 AS INT)",
    "attempts": "CAST(document_id % 4 AS INT)",
    "next_poll_at": "TIMESTAMP '2024-01-01 00:00:00' + document_id * INTERVAL '3' MINUTE",
    "last_error": "CAST(NULL AS STRING)",
}
BATCH_SQL = (
    "batch AS (SELECT document_id, batch_no, first_page, last_page, "
    + ", ".join(f"{e} AS {c}" for c, e in BATCH_COLUMNS.items())
    + " FROM (SELECT document_id, b AS batch_no, b * 10 + 1 AS first_page, "
      "CAST(least(b * 10 + 10, total_pages) AS INT) AS last_page "
      "FROM (SELECT *, CAST(unnest(range((total_pages + 9) // 10)) AS INT) AS b FROM upload)))"
)


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_batches(view(spark, sf_dir, "upload"), now=now()).drop("status", "next_poll_at", "page_range")
    return planned.withColumns({c: F.expr(e) for c, e in BATCH_COLUMNS.items()})


def documents_with_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "document").withColumn("tags", F.array("tag"))


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the page view with their number of pages."""
    return view(spark, sf_dir, "page").groupBy("document_id").agg(
        F.count(F.lit(1)).cast("int").alias("total_pages"))
