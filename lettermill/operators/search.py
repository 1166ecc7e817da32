"""Full text search over translations and substring search over original script."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lettermill.functions.similarity import gram_similarity, grams, trigrams
from lettermill.functions.stemming import STOP_WORDS, stem
from lettermill.functions.text import as_column, escape_like
from lettermill.operators import index_store, joins
from lettermill.operators.joins import broadcast_if_small
from lettermill.session import pin

# Query limits and snippet sizes.
MIN_QUERY, MAX_QUERY = 2, 200
DEFAULT_LIMIT, MAX_LIMIT = 20, 50
SNIPPET_BEFORE, SNIPPET_CHARS = 60, 200
FRAGMENT_BEFORE, FRAGMENT_WORDS = 8, 25

WORD = "[\\p{L}\\p{M}\\p{N}]+"
WORD_WITH_REST = "[\\p{L}\\p{M}\\p{N}]+[^\\p{L}\\p{M}\\p{N}]*"
QUERY_PIECE = '-?"[^"]*"?|[^\\s"]+'
PAGE = ["document_id", "page_no"]

# Queries and their terms are a few dozen bytes each: more of them are broadcast than of other rows, but no more bytes.
NARROW_ROWS = 1_000_000
# A page's key and number of trigrams are three numbers.
SIZED_ROWS = 2_000_000
# Lengths of the n-grams by which queries find the pages that may contain them.
PROBES = (2, 3, 5, 8)


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit(WORD), 0)


def _index_terms(df: DataFrame, english: bool) -> DataFrame:
    """Drop stop words and stem ``token``."""
    if not english:
        return df
    return df.filter(~F.col("token").isin(*STOP_WORDS)).withColumn("token", stem("token"))


def build_index(pages: DataFrame, docs: DataFrame, english: bool = True) -> DataFrame:
    """Postings of the translations: one row per (owner, token, page, position).

    Positions count all words, so a dropped stop word leaves its gap. Built without a
    shuffle of text; see :func:`write_index` for the stored layout.
    """
    owned = pages.join(docs.select("document_id", "owner_id"), "document_id")
    tokens = owned.select("owner_id", *PAGE, F.posexplode(words("translated_text")).alias("position", "token"))
    return _index_terms(tokens, english)


def build_gram_index(pages: DataFrame, docs: DataFrame, sizes: Sequence[int] = (2, 3)) -> DataFrame:
    """Distinct lower-case n-grams of the original text of each page."""
    owned = pages.join(docs.select("document_id", "owner_id"), "document_id")
    lowered = F.lower("original_text")
    all_grams = F.flatten(F.array(*(F.array_distinct(grams(lowered, n)) for n in sizes)))
    return owned.select("owner_id", *PAGE, F.explode(all_grams).alias("gram"))


def write_index(postings: DataFrame, path: str, key: str = "token", buckets: int = 64) -> None:
    """Store postings by hash of their key, so that a search reads only its keys' buckets.

    Rebalancing splits the bucket of a common token over several files.
    """
    placed = postings.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket")
    placed.sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, keys: DataFrame, key: str = "token", buckets: int = 64,
               schema: StructType | None = None) -> DataFrame:
    """Stored postings of the buckets that ``keys`` (such as query terms) fall into.

    At most ``buckets`` numbers reach the driver; as a partition filter they prune the scan. Without
    ``schema`` something must have been stored.
    """
    wanted = [row[0] for row in keys.select(bucket_of(key, buckets)).distinct().collect()]
    stored = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return stored.filter(F.col("bucket").isin(wanted)).drop("bucket")


def bucket_of(key: str, buckets: int = 64) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _is_or(placed: Column, pieces: Column) -> Column:
    return (F.lower(placed["text"]) == "or") & placed["after"] & (placed["piece"] + 1 < F.size(pieces))


def _placed_pieces(pieces: Column) -> Column:
    """Pieces with their place and whether a word or phrase stands directly before them."""
    start = F.struct(F.lit(False).alias("operand"), F.array().cast("array<struct<piece:int,text:string,after:boolean>>").alias("out"))

    def step(state: Column, text: Column) -> Column:
        placed = F.struct(F.size(state["out"]).alias("piece"), text.alias("text"), state["operand"].alias("after"))
        return F.struct((~_is_or(placed, pieces)).alias("operand"), F.array_append(state["out"], placed).alias("out"))

    return F.aggregate(pieces, start, step, lambda state: state["out"])


def parse_queries(queries: DataFrame, english: bool = True) -> DataFrame:
    """Term rows of web-style queries: bare words all required, quotes for phrases, ``or``, ``-``.

    ``or`` separates alternatives only between two operands; as the first or last piece, or directly
    behind another ``or`` that does, it is a word.
    One row per term with its ``clause`` (alternatives), ``piece`` (a word or phrase), offset
    in the phrase and the sizes needed to tell when piece and clause are satisfied.
    """
    pieces = F.regexp_extract_all("q", F.lit(QUERY_PIECE), 0)
    is_or = lambda s: _is_or(s, F.col("_pieces"))
    placed = F.transform(F.filter("_placed", lambda s: ~is_or(s)), lambda s: F.struct(
        s["piece"].alias("piece"), s["text"].alias("text"),
        F.size(F.filter(F.slice("_placed", 1, s["piece"]), is_or)).alias("clause")))
    rows = queries.select("query_id", "owner_id", pieces.alias("_pieces")).withColumn("_placed", _placed_pieces(F.col("_pieces"))).select(
        "query_id", "owner_id", F.inline(placed))
    terms = rows.select(
        "query_id", "owner_id", "clause", "piece", F.col("text").startswith("-").alias("negated"),
        F.posexplode(words("text")).alias("offset", "token"))
    terms = _index_terms(terms, english)
    # A query has at most 200 characters, so these groups are small.
    by_piece = Window.partitionBy("query_id", "piece")
    by_clause = Window.partitionBy("query_id", "clause")
    needed = F.size(F.collect_set(F.when(~F.col("negated"), F.col("piece"))).over(by_clause))
    return terms.withColumn("piece_terms", F.count(F.lit(1)).over(by_piece)).withColumn("needed", needed)


def _page_words(terms: DataFrame, postings: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row per page with the places of each word on it that a query has; ``listed`` if it is one of ``pages``.

    Dealt out by page, into a fixed number of parts: what is found on a page is worked out where its row is, so
    only words move, and never matches.
    """
    words_of = terms.select("owner_id", "token").distinct()
    wanted = postings.join(broadcast_if_small(words_of, NARROW_ROWS), ["owner_id", "token"], "left_semi").select(
        "owner_id", *PAGE, "token", "position")
    if pages is not None:
        wanted = wanted.unionByName(pages.select("owner_id", *PAGE), allowMissingColumns=True)
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_word = wanted.repartition(parts, *PAGE).groupBy("owner_id", *PAGE, "token").agg(F.sort_array(F.collect_list("position")).alias("at"))
    word = F.when(F.col("token").isNotNull(), F.struct("token", "at"))
    return pin(by_word.groupBy("owner_id", *PAGE).agg(
        F.map_from_entries(F.collect_list(word)).alias("places"), F.bool_or(F.col("token").isNull()).alias("listed")))


def _forms(terms: DataFrame, words: DataFrame) -> DataFrame:
    """Queries of the same terms as one row, ``form``, with the clauses that can match and the ``asks`` that want it.

    A clause lists its pieces, a piece its words with the number of pages they are on. ``open`` forms have a clause
    of negations only. Clauses with a required word that no page of the owner has are left out.
    """
    on_pages = words.select("owner_id", F.explode(F.map_keys("places")).alias("token")).groupBy("owner_id", "token").agg(
        F.count(F.lit(1)).alias("pages"))
    # A query has at most 200 characters, so these groups are small.
    pieces = terms.join(broadcast_if_small(on_pages, NARROW_ROWS), ["owner_id", "token"], "left").groupBy(
        "query_id", "owner_id", "clause", "piece", "negated").agg(F.sort_array(F.collect_list(F.struct("offset", "token", "pages"))).alias("words"))
    clauses = pieces.groupBy("query_id", "owner_id", "clause").agg(F.sort_array(F.collect_list(F.struct("negated", "words"))).alias("pieces"))
    # Pieces with a word that is nowhere stand for nothing to find: required ones end their clause, negated ones hold.
    somewhere = lambda piece: F.forall(piece["words"], lambda w: w["pages"].isNotNull())
    clauses = clauses.filter(F.forall("pieces", lambda piece: piece["negated"] | somewhere(piece))).select(
        "query_id", "owner_id", F.filter("pieces", somewhere).alias("pieces"),
        F.forall("pieces", lambda piece: piece["negated"]).alias("open"))
    queries = clauses.groupBy("query_id", "owner_id").agg(F.sort_array(F.collect_set(F.struct("open", "pieces"))).alias("clauses"))
    forms = queries.groupBy("owner_id", "clauses").agg(F.min("query_id").alias("form"), F.collect_list("query_id").alias("asks"))
    return pin(forms.withColumn("open", F.exists("clauses", lambda clause: clause["open"])))


def _rarest(words: Column) -> Column:
    return F.array_min(F.transform(words, lambda w: F.struct(w["pages"], w["token"])))["token"]


def _led(words: DataFrame, forms: DataFrame) -> DataFrame:
    """Pages that may match a clause: those with the rarest of its required words. ``nth`` is the clause's place."""
    required = F.flatten(F.transform(F.filter(F.col("clause")["pieces"], lambda piece: ~piece["negated"]), lambda piece: piece["words"]))
    leads = forms.filter("NOT open").select("owner_id", "form", "clauses", "asks", F.posexplode("clauses").alias("nth", "clause")).withColumn(
        "token", _rarest(required)).drop("clause")
    return words.select("*", F.explode(F.map_keys("places")).alias("token")).join(F.broadcast(leads), ["owner_id", "token"])


def _banned(words: DataFrame, forms: DataFrame) -> DataFrame:
    """Pages that may have a negated piece of a form that is one clause of negations; ``piece`` are its words."""
    pieces = forms.filter("open AND size(clauses) = 1").select("owner_id", "form", F.explode(F.col("clauses")[0]["pieces"]["words"]).alias("piece"))
    return words.select("*", F.explode(F.map_keys("places")).alias("token")).join(
        F.broadcast(pieces.withColumn("token", _rarest(F.col("piece")))), ["owner_id", "token"])


def _hits(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """What matching looks at: each word of a clause on the pages that the rarest required one is on.

    Words of clauses made of negations only are looked up wherever the rarest of their piece is.
    """
    words = _page_words(terms, postings)
    forms = _forms(terms, words)
    of_clause = F.flatten(F.get("clauses", F.col("nth"))["pieces"]["words"])
    looked_up = _led(words, forms).select("form", *PAGE, "places", F.explode(of_clause).alias("word")).unionByName(
        _banned(words, forms).select("form", *PAGE, "places", F.explode("piece").alias("word")))
    return looked_up.select("form", *PAGE, F.col("word.token").alias("token"), F.explode(F.col("places")[F.col("word.token")]).alias("position"))


def _found(piece: Column) -> Column:
    """How often a word or phrase is on the page, counted in words, and where first."""
    at = lambda w: F.coalesce(F.col("places")[w["token"]], F.array().cast("array<int>"))
    # A phrase is satisfied where all its terms agree on where it starts.
    starts = lambda w: F.transform(at(w), lambda place: place - w["offset"])
    rest = F.slice(piece, 2, F.size(piece))
    agreed = F.aggregate(rest, starts(piece[0]), lambda both, w: F.array_intersect(both, starts(w)))
    alone = F.transform(F.array(at(piece[0])), lambda places: F.struct(F.size(places).alias("n"), F.get(places, 0).alias("first")))
    phrase = F.transform(F.array(agreed), lambda s: F.struct(
        (F.size(s) * F.size(piece)).alias("n"), (F.array_min(s) + piece[0]["offset"]).alias("first")))
    return F.get(F.when(F.size(piece) == 1, alone).otherwise(phrase), 0)


def _judged(clause: Column) -> Column:
    """Whether the page satisfies the clause, with its text rank and first hit."""
    found = F.transform(clause["pieces"], lambda piece: F.struct(piece["negated"].alias("negated"), _found(piece["words"]).alias("hit")))

    def judge(pieces: Column) -> Column:
        holds = F.forall(pieces, lambda p: (p["hit"]["n"] > 0) != p["negated"])
        wanted = F.filter(pieces, lambda p: ~p["negated"])
        return F.struct(
            (holds & (~clause["open"] | F.col("listed"))).alias("ok"),
            F.aggregate(wanted, F.lit(0.0), lambda total, p: total + text_rank(p["hit"]["n"])).alias("text_rank"),
            F.coalesce(F.array_min(F.transform(wanted, lambda p: p["hit"]["first"])), F.lit(0)).alias("first_hit"))

    return F.get(F.transform(F.array(found), judge), 0)


def _matches(pages: DataFrame, nth: Column | None = None) -> DataFrame:
    """Matching pages once per query: of all clauses the best text rank and the first hit.

    With ``nth`` a page that several clauses lead to counts where the first of them that is satisfied stands.
    """
    def best(judged: Column) -> Column:
        ok = F.filter(judged, lambda c: c["ok"])
        first = F.size(ok) > 0 if nth is None else F.array_position(judged["ok"], F.lit(True)) == nth + 1
        return F.when(first, F.struct(F.array_max(ok["text_rank"]).alias("text_rank"), F.array_min(ok["first_hit"]).alias("first_hit")))

    matched = F.filter(F.transform(F.array(F.transform("clauses", _judged)), best), lambda match: match.isNotNull())
    return pages.select(*PAGE, "asks", F.inline(matched)).select(F.explode("asks").alias("query_id"), *PAGE, "text_rank", "first_hit")


def match_translated(terms: DataFrame, postings: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that satisfy a clause of their query, with text rank and first hit.

    ``pages`` (``owner_id, document_id, page_no``) serves clauses made of negations only. Queries of the same terms
    are matched once, each on the rows of pages: matches, which grow with queries times pages, are neither
    shuffled nor stored. Queries that are too many for one broadcast are matched in several parts.
    """
    terms = pin(terms)
    words = _page_words(terms, postings, pages)
    forms = _forms(terms, words)
    return reduce(DataFrame.unionByName, (_match_forms(words, part) for part in _broadcast_parts(forms)))


def _broadcast_parts(forms: DataFrame) -> list[DataFrame]:
    """``forms`` in parts that are each small enough for a broadcast; mostly one."""
    n = joins.broadcasts(forms, NARROW_ROWS)
    return [forms.filter(F.pmod(F.xxhash64("form"), F.lit(n)) == part) for part in range(n)] if n > 1 else [forms]


def _match_forms(words: DataFrame, forms: DataFrame) -> DataFrame:
    columns = ["query_id", *PAGE, "text_rank", "first_hit"]
    # Forms of one word need no look at the other words of a page.
    single = F.expr("NOT open AND size(clauses) = 1 AND size(clauses[0].pieces) = 1 AND size(clauses[0].pieces[0].words) = 1")
    token = F.col("clauses")[0]["pieces"][0]["words"][0]["token"]
    alone = words.select("owner_id", *PAGE, F.explode("places").alias("token", "at")).join(
        F.broadcast(forms.filter(single).select("owner_id", token.alias("token"), "asks")), ["owner_id", "token"]).select(
        F.explode("asks").alias("query_id"), *PAGE, text_rank(F.size("at")).alias("text_rank"), F.get("at", F.lit(0)).alias("first_hit"))
    led = _matches(_led(words, forms.filter(~single)), F.col("nth"))
    # Clauses of negations only match nearly all pages: each page has a list of those that it breaks.
    kept = forms.filter("open AND size(clauses) = 1").select("owner_id", "form", "asks")
    broken = _banned(words, forms).filter(_found(F.col("piece"))["n"] > 0).groupBy(*PAGE).agg(F.collect_set("form").alias("broken"))
    # A fixed number of parts: far more rows come out of them than the few bytes that partitions are merged by tell.
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = words.filter("listed").select("owner_id", *PAGE).join(broken, PAGE, "left").repartition(parts, *PAGE)
    unbroken = lists.join(F.broadcast(kept), "owner_id").filter(
        F.col("broken").isNull() | ~F.array_contains("broken", F.col("form"))).select(
        F.explode("asks").alias("query_id"), *PAGE, F.lit(0.0).alias("text_rank"), F.lit(0).alias("first_hit"))
    mixed = _matches(words.join(F.broadcast(forms.filter("open AND size(clauses) > 1")), "owner_id"))
    return reduce(DataFrame.unionByName, (part.select(*columns) for part in (alone, led, unbroken, mixed)))


def text_rank(hits: Column | str) -> Column:
    """What one satisfied word or phrase adds: the log of its frequency."""
    return F.log1p(as_column(hits).cast("double"))


def is_small(forms: DataFrame) -> bool:
    return joins.is_small(forms, NARROW_ROWS)


def match_original(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages whose original text contains the query, case-insensitively and literally.

    A page can only contain the query if it contains the query's first characters, as many as the largest
    of ``PROBES`` that fits. That equi-join on (owner, n-gram) finds candidates; no query is compared with
    every page, and a query that is its own gram needs no further look. Queries of one text are matched once;
    only the rows of the result are as many as matches. Distinct queries of checked size are broadcast and the
    pages are scanned once; larger batches are joined on narrow rows before texts are fetched.
    """
    asked = queries.filter(F.length("q") >= MIN_QUERY).select("query_id", "owner_id", F.lower("q").alias("q"))
    gram = F.coalesce(*(F.when(F.length("q") >= n, F.substring("q", 1, n)) for n in reversed(PROBES)))
    forms = pin(asked.groupBy("owner_id", "q").agg(F.min("query_id").alias("form")).withColumn("gram", gram))
    # A fixed number of parts: making the grams takes long for the few bytes that partitions are merged by.
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = pages.select("owner_id", *PAGE, F.lower("original_text").alias("text")).repartition(parts, *PAGE)
    probe = F.explode(F.flatten(F.array(*(F.array_distinct(grams("text", n)) for n in PROBES)))).alias("gram")
    if is_small(forms):
        candidates = texts.select("owner_id", *PAGE, "text", probe).join(F.broadcast(forms), ["owner_id", "gram"])
    else:
        wanted = broadcast_if_small(forms.select("owner_id", "gram").distinct())
        narrow = texts.select("owner_id", *PAGE, probe).join(wanted, ["owner_id", "gram"], "left_semi").join(forms, ["owner_id", "gram"])
        candidates = narrow.join(texts.select(*PAGE, "text"), PAGE)
    matched = candidates.filter((F.col("gram") == F.col("q")) | F.contains("text", "q")).select("form", *PAGE)
    askers = asked.join(forms, ["owner_id", "q"]).select("form", "query_id")
    return matched.join(broadcast_if_small(askers, NARROW_ROWS), "form").select("query_id", *PAGE)


def gram_postings(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per (owner, page, gram) with its positions: the three characters at every place of the lower-case original text.

    The last place but one has two characters, so that ``head``, the first two of a gram, finds every pair.
    Texts are dealt out by page, so that places are gathered where they are made.
    """
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = pages.join(docs.select("document_id", "owner_id"), "document_id").select("owner_id", *PAGE, "original_text").repartition(parts, *PAGE)
    at = F.posexplode(F.regexp_extract_all(F.lower("original_text"), F.lit("(?s)(?=(.{2,3}))."), 1)).alias("position", "gram")
    return owned.select("owner_id", *PAGE, at).groupBy("owner_id", *PAGE, "gram").agg(
        F.sort_array(F.collect_list("position")).alias("positions")).withColumn("head", F.substring("gram", 1, 2))


def _count_grams(postings: DataFrame, path: str, version: int) -> None:
    counts = postings.groupBy("owner_id", "head", "gram").agg(F.sum(F.size("positions")).alias("postings"))
    write_index(counts, f"{path}/counts/version={version}", "head")


def create_gram_index(pages: DataFrame, docs: DataFrame, path: str) -> None:
    """Store the positions of all grams and how many postings each has, both by buckets of ``head``."""
    index_store.create(gram_postings(pages, docs), f"{path}/grams", "head")
    _count_grams(index_store.read(pages.sparkSession, f"{path}/grams", key="head"), path, 0)


def update_gram_index(changed: DataFrame, docs: DataFrame, path: str) -> None:
    """Give the ``changed`` pages their new text; only buckets of its grams are written.

    Counts are added up and never taken back. They only say which gram is looked up first, and
    that a gram without any count is nowhere.
    """
    postings = gram_postings(changed, docs)
    # Counts come first: without them the grams of a version would count as missing.
    version = index_store.next_version(changed.sparkSession, f"{path}/grams")
    _count_grams(postings, path, version)
    index_store.apply_changes(postings, changed, f"{path}/grams", "head")


def match_gram_index(queries: DataFrame, path: str) -> DataFrame:
    """:func:`match_original` from a stored gram index alone: no text is read.

    Of each query the rarest gram leads to the pages and places where it may start. The grams at every third
    character, and the last, cover the whole query; a page matches where all of them stand at their distance from
    one such place. Queries with a gram that their owner's pages lack end before any posting is read, and only
    buckets of wanted grams are read. These postings are dealt out by page once and each page is judged on its
    one row, so matches and places to try aren't shuffled.
    """
    spark = queries.sparkSession
    valid = queries.filter(F.length("q") >= MIN_QUERY).select("query_id", "owner_id", F.lower("q").alias("q"))
    # Queries of one text are matched once.
    asked = pin(valid.groupBy("owner_id", "q").agg(F.min("query_id").alias("form"), F.collect_list("query_id").alias("asks")).withColumn("size", F.length("q")))
    terms = asked.filter("size > 2").select("form", "owner_id", "size", F.posexplode(grams("q", 3)).alias("offset", "gram")).withColumn(
        "head", F.substring("gram", 1, 2))
    pairs = asked.filter("size = 2").select("owner_id", F.col("q").alias("head"), "asks")
    kept = spark.read.parquet(f"{path}/grams/schema").select("owner_id", "head", "gram").schema.add("postings", "long").add("bucket", "integer")
    counted = read_index(spark, f"{path}/counts", terms, "head", schema=kept).groupBy("owner_id", "head", "gram").agg(F.sum("postings").alias("postings"))
    found = counted.join(broadcast_if_small(terms), ["owner_id", "head", "gram"])
    # A query has at most 200 characters, so these groups are small.
    of_form = found.groupBy("form", "size").agg(F.sort_array(F.collect_list(F.struct("postings", "offset", "gram"))).alias("found"))
    covers = lambda g: (g["offset"] % 3 == 0) | (g["offset"] == F.col("size") - 3)
    complete = of_form.filter(F.size("found") == F.col("size") - 2).select(
        "form", F.get("found", F.lit(0)).alias("lead"), F.filter(F.slice("found", 2, F.size("found")), covers).alias("checks"))
    needed = pin(asked.join(complete, "form").select(
        "form", "owner_id", "asks", F.col("lead.gram").alias("gram"), F.col("lead.offset").alias("offset"), "checks"))
    wanted = needed.select("owner_id", F.explode(F.array_union(F.array("gram"), F.col("checks.gram"))).alias("gram")).distinct().select(
        "owner_id", F.substring("gram", 1, 2).alias("head"), "gram", F.lit(True).alias("placed"))
    heads = pairs.select("owner_id", "head", F.lit(True).alias("paired"))

    postings = index_store.read(spark, f"{path}/grams", wanted.select("head").union(heads.select("head")), "head")
    looked_up = postings.join(broadcast_if_small(wanted, NARROW_ROWS), ["owner_id", "head", "gram"], "left").join(
        broadcast_if_small(heads), ["owner_id", "head"], "left").filter("placed OR paired")
    # Places are only needed of grams that are aligned; a pair is found by any gram that starts with it.
    rows = looked_up.select("owner_id", *PAGE, "gram", F.when(F.col("placed"), F.col("positions")).alias("at"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    on_page = F.map_from_entries(F.collect_list(F.struct("gram", "at")))
    words = rows.repartition(parts, *PAGE).groupBy("owner_id", *PAGE).agg(on_page.alias("places"))
    # A key of a page is a gram or, of two characters, the head of one.
    keys = F.array_distinct(F.concat(F.map_keys("places"), F.transform(F.map_keys("places"), lambda gram: F.substring(gram, 1, 2))))
    tried = words.select("owner_id", *PAGE, "places", F.explode(keys).alias("key"))
    # Queries of two and three characters match wherever their only gram is.
    whole = needed.filter("size(checks) = 0").select("form", "owner_id", "asks", F.col("gram").alias("key")).unionByName(
        asked.filter("size = 2").select("form", "owner_id", "asks", F.col("q").alias("key")))
    stands = lambda start: F.forall("checks", lambda g: F.array_contains(F.col("places")[g["gram"]], start + g["offset"]))
    starts = F.filter(F.transform(F.col("places")[F.col("key")], lambda place: place - F.col("offset")), lambda start: start >= 0)
    aligned = needed.filter("size(checks) > 0").withColumnRenamed("gram", "key")
    matched = [found.select(F.explode("asks").alias("query_id"), *PAGE) for found in (
        *(tried.drop("places").join(F.broadcast(part), ["owner_id", "key"]) for part in _broadcast_parts(whole)),
        *(tried.join(F.broadcast(part), ["owner_id", "key"]).filter(F.exists(starts, stands)) for part in _broadcast_parts(aligned)))]
    return reduce(DataFrame.unionByName, matched)


def contains_text(text: Column | str, q: Column | str) -> Column:
    """``ILIKE %q%`` with the wildcards of ``q`` taken literally."""
    return F.lower(as_column(text)).contains(F.lower(as_column(q)))


def like_pattern(q: Column | str) -> Column:
    return F.concat(F.lit("%"), escape_like(q), F.lit("%"))


def snippet_original(text: Column | str, q: Column | str) -> Column:
    """200 characters from 60 before the first hit; from the start where case differs."""
    text = as_column(text)
    start = F.greatest(F.lit(1), F.instr(text, as_column(q)) - SNIPPET_BEFORE)
    return F.substring(F.coalesce(text, F.lit("")), F.coalesce(start, F.lit(1)), F.lit(SNIPPET_CHARS))


def snippet_translated(text: Column | str, first_hit: Column | str) -> Column:
    """Up to 25 words around the first hit, as plain text."""
    pieces = F.regexp_extract_all(as_column(text), F.lit(WORD_WITH_REST), 0)
    start = F.greatest(F.lit(1), as_column(first_hit).cast("int") + 1 - FRAGMENT_BEFORE)
    return F.coalesce(F.rtrim(F.array_join(F.slice(pieces, start, F.lit(FRAGMENT_WORDS)), "")), F.lit(""))


def filter_tag_year(docs: DataFrame, tag: str | None = None, year: int | None = None) -> DataFrame:
    """Apply only the filters that are given."""
    if tag is not None:
        docs = docs.filter(F.array_contains("tags", tag))
    if year is not None:
        docs = docs.filter(F.col("year") == year)
    return docs


def validate_queries(queries: DataFrame) -> DataFrame:
    """Add the effective limit and, where a query is refused, why."""
    limit = F.coalesce(F.col("limit"), F.lit(DEFAULT_LIMIT))
    size = F.coalesce(F.length("q"), F.lit(0))
    reason = F.when(~size.between(MIN_QUERY, MAX_QUERY), "bad_length").when(
        ~limit.between(1, MAX_LIMIT), "bad_limit")
    return queries.withColumn("limit", limit).withColumn("reject_reason", reason)


def search(queries: DataFrame, pages: DataFrame, docs: DataFrame, postings: DataFrame | None = None,
           english: bool = True, grams_path: str | None = None) -> DataFrame:
    """Ranked hits of every valid query within its owner's documents.

    ``queries``: ``query_id, owner_id, q, tag, year, limit`` (tag, year and limit may be null).
    A page found on both sides counts as TRANSLATED. Rank falls, then page number rises,
    then the document decides. With ``grams_path`` original texts are searched in that stored index.
    """
    valid = pin(validate_queries(queries).filter(F.col("reject_reason").isNull()).select(
        "query_id", "owner_id", "q", "tag", "year", "limit"))
    # Queries that differ in nothing but their limit are ranked once, and each text of an owner is matched once.
    asks = pin(valid.groupBy("owner_id", "q", "tag", "year").agg(F.min("query_id").alias("ask")))
    forms = asks.groupBy("owner_id", "q").agg(F.min("ask").alias("query_id"))
    owned = pages.join(docs.select("document_id", "owner_id"), "document_id")
    postings = postings if postings is not None else build_index(pages, docs, english)
    translated = match_translated(parse_queries(forms, english), postings, owned).withColumn(
        "in_translation", F.lit(True))
    in_original = match_gram_index(forms, grams_path) if grams_path else match_original(forms, owned)
    original = in_original.select(
        "query_id", *PAGE, F.lit(0.0).alias("text_rank"), F.lit(None).cast("int").alias("first_hit"),
        F.lit(False).alias("in_translation"))
    # What is found on both sides stands twice until few pages are left: all matches of a page are made from its
    # row, and in reach they are looked at twice rather than stored or shuffled.
    found = translated.unionByName(original)
    facts = docs.select("document_id", "title", F.col("year").alias("doc_year"), "tags")
    filters = pin(asks.join(forms, ["owner_id", "q"]).select("query_id", "ask", "tag", "year"))
    scoped = found.join(broadcast_if_small(filters, NARROW_ROWS), "query_id").join(
        broadcast_if_small(facts.select("document_id", "doc_year", "tags"), NARROW_ROWS), "document_id").filter(
        (F.col("tag").isNull() | F.array_contains("tags", F.col("tag")))
        & (F.col("year").isNull() | (F.col("doc_year") == F.col("year")))).select(
        "ask", *PAGE, "text_rank", "first_hit", "in_translation")
    near = pin(_within_reach(scoped, asks, pages))
    # Trigrams are made once per page that may be among the best and once per query, and no text takes part in ranking.
    similarity = gram_similarity("_page_grams", "_q_grams", short_right=True)
    ranked = near.join(_page_grams(pages, near), PAGE).join(broadcast_if_small(asks.select("ask", trigrams("q").alias("_q_grams")), NARROW_ROWS), "ask").withColumn(
        "rank", F.round(F.col("text_rank") + similarity, 6)).drop("_page_grams", "_q_grams")
    order = Window.partitionBy("ask").orderBy(F.desc("rank"), "page_no", "document_id")
    # The constant bound lets each task keep its own best before the shuffle.
    top = ranked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= MAX_LIMIT)
    texts = pages.select(*PAGE, "original_text", "translated_text")
    hits = top.join(asks.select("ask", "q"), "ask").join(texts, PAGE).join(facts, "document_id").select(
        "ask", "place", "document_id", "title", F.col("doc_year").alias("year"), "tags", "page_no",
        F.when(F.col("in_translation"), "TRANSLATED").otherwise("ORIGINAL").alias("matched_in"),
        F.when(F.col("in_translation"), snippet_translated("translated_text", "first_hit"))
        .otherwise(snippet_original("original_text", "q")).alias("snippet"),
        "rank")
    same = [valid[c].eqNullSafe(asks[c]) for c in ("owner_id", "q", "tag", "year")]
    askers = valid.join(asks, same).select("query_id", "ask", "limit")
    return hits.join(askers, "ask").filter(F.col("place") <= F.col("limit")).select("query_id", *hits.drop("ask").columns)


def _page_grams(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Trigrams of the original text of the found pages, made where a join by page meets them."""
    shown = pages.select(*PAGE, "original_text").join(broadcast_if_small(found.select(*PAGE).distinct()), PAGE, "left_semi")
    return shown.repartition(*PAGE).select(*PAGE, trigrams("original_text").alias("_page_grams"))


def _within_reach(scoped: DataFrame, asks: DataFrame, pages: DataFrame) -> DataFrame:
    """Leave out pages that can't be among the best of a query, whatever their similarity.

    Similarity adds at most the smaller over the larger number of trigrams. A page that doesn't get to the
    text rank of the query's 50th page with that is behind 50 others; the margin is for rounding to six digits.
    """
    # Text ranks take few values: counted, matches aren't sorted. A page found on both sides counts twice at rank 0 only, where every page is within reach.
    counts = scoped.groupBy("ask", "text_rank").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("ask").orderBy(F.desc("text_rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bars = counts.withColumn("so_far", so_far).groupBy("ask").agg(F.max(F.when(F.col("so_far") >= MAX_LIMIT, F.col("text_rank"))).alias("_bar"))
    of_ask = pin(asks.select("ask", F.size(trigrams("q")).alias("_q_size")).join(bars, "ask"))
    sizes = pin(pages.select(*PAGE, "original_text").repartition(*PAGE).select(
        *PAGE, F.size(F.coalesce(trigrams("original_text"), F.array())).alias("_page_size")))
    reach = F.col("text_rank") + F.least("_page_size", "_q_size") / F.greatest("_page_size", "_q_size", F.lit(1))
    kept = scoped.join(broadcast_if_small(of_ask, NARROW_ROWS), "ask").join(broadcast_if_small(sizes, SIZED_ROWS), PAGE).filter(
        F.col("_bar").isNull() | (reach >= F.col("_bar") - 2e-6))
    return kept.groupBy("ask", *PAGE).agg(
        F.max("text_rank").alias("text_rank"), F.min("first_hit").alias("first_hit"), F.bool_or("in_translation").alias("in_translation"))
