"""The corpus pipeline: documents through its stages, each written as Parquet and read again.

Every stage returns whole rows of documents (doc_id, text, lang, source, n_chars), the last the
pieces of the packed token sequences. A stage works on all that the one before it kept:

1. quality: documents that the rule ensemble predicts to be bad go; it learns from the documents and
   labels of ``sf_dir``, whichever rows it is handed. If no rule is learned, as without labels of both
   kinds, nothing tells documents apart and all are kept.
2. near-duplicates: of each class the document with the smallest id stays (of equal ids the one
   whose text sorts first by its digest; of equal rows one).
3. repeated passages: every passage of 50 words or more stays where it occurs first and is cut
   elsewhere; documents stay, ``n_chars`` is counted again.
4. packing: what is left becomes tokens, in sequences of at most 4096.

An empty table passes through all stages; a null text is empty; a document without an id is kept
and treated as any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm.near_dups import without_near_duplicates
from lettermill.llm.packing import pack, token_pieces
from lettermill.llm.quality import keep_good, train_quality
from lettermill.llm.queries import word_tokenizer
from lettermill.llm.suffix_dedup import without_repeats
from lettermill.llm.tables import read, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return keep_good(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = without_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = token_pieces(docs, "doc_id", "text", word_tokenizer(), keep_ids=True)
    return pack(pieces).withColumnRenamed("doc", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]
#: Learned rules, sketches and byte-pair merges aren't expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
