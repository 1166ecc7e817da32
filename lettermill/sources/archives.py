"""OCR result archives and labelled scan samples."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What an archive may hold.
MAX_ENTRIES = 1000
MAX_UNZIPPED_BYTES = 33_554_432

ENTRY_SCHEMA = "archive_id {id}, entry_name string, entry_pos int, content binary, reject_reason string"
IMAGES = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}"
SAMPLE_PATH = "([^/]+)/([^/]+)\\.[^./]+$"


def _entries(data: bytes) -> dict[str, bytes] | str:
    """Entries of one archive by name, or why it is refused. Stops reading at the size limit."""
    entries: dict[str, bytes] = {}
    left, count = MAX_UNZIPPED_BYTES, 0
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for info in archive.infolist():
                if info.is_dir():
                    continue
                count += 1
                if count > MAX_ENTRIES:
                    return "too_many_entries"
                with archive.open(info) as stream:
                    content = stream.read(left + 1)
                left -= len(content)
                if left < 0:
                    return "too_large"
                entries[info.filename] = content
    except (zipfile.BadZipFile, EOFError, NotImplementedError, RuntimeError, ValueError):
        return "unreadable"
    return entries


def unzip(archives: DataFrame) -> DataFrame:
    """(archive_id, entry_name, entry_pos, content, reject_reason) from ``archive_id, content``.

    A refused archive gives one row with its reason and no entry. One archive at a time is
    in memory, and its size is bounded.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive_id", "entry_name", "entry_pos", "content", "reject_reason"]
        for batch in batches:
            for archive_id, data in zip(batch["archive_id"], batch["content"]):
                found = _entries(data)
                if isinstance(found, str):
                    rows = [(archive_id, None, None, None, found)]
                else:
                    rows = [(archive_id, name, i, content, None) for i, (name, content) in enumerate(found.items())]
                yield pd.DataFrame(rows, columns=columns).astype({"entry_pos": "Int32"})

    kind = dict(archives.dtypes)["archive_id"]
    return archives.select("archive_id", "content").mapInPandas(read, ENTRY_SCHEMA.format(id=kind))


def read_ocr_archives(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all ZIP files under ``path``; the file path is the archive's id."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true")
    return unzip(files.load(path).select(F.col("path").alias("archive_id"), "content"))


def readable(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def refused(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("reject_reason").isNotNull()).select("archive_id", "reject_reason")


def _samples(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{root}/*")
    return files.withColumns({
        "language": F.regexp_extract("path", SAMPLE_PATH, 1), "name": F.regexp_extract("path", SAMPLE_PATH, 2)})


def read_labelled_samples(spark: SparkSession, root: str) -> DataFrame:
    """Images ``root/<language>/<name>.jpg|jpeg|png`` with the text of ``<name>.txt`` beside them."""
    images = _samples(spark, root, IMAGES).select("language", "name", F.col("path").alias("image_path"))
    texts = _samples(spark, root, "*.txt").select("language", "name", F.decode("content", "UTF-8").alias("reference"))
    return images.join(texts, ["language", "name"])


def unlabelled_samples(spark: SparkSession, root: str) -> DataFrame:
    """Images without a text."""
    images = _samples(spark, root, IMAGES).select("language", "name", F.col("path").alias("image_path"))
    return images.join(_samples(spark, root, "*.txt").select("language", "name"), ["language", "name"], "left_anti")
