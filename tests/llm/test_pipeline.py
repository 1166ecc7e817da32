"""The pipeline's stages, each against brute force on what the one before it kept."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_near_dups import classes
from test_suffix_dedup import brute_force
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from lettermill.llm.quality import fold, score_quality, train_quality
from lettermill.llm.tables import read, written

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """Rows after each stage, the input first."""
    docs = read(spark, FOLDER, "documents")
    out = [docs]
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, FOLDER))
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(kept):
    assert all(df.columns == kept[0].columns for df in kept[1:-1])


def test_quality(spark, kept):
    docs, labels = kept[0], read(spark, FOLDER, "labels")
    good = {r["doc_id"] for r in score_quality(docs, train_quality(docs, labels)).collect() if r["predicted"]}
    assert texts(kept[1]) == {d: t for d, t in texts(docs).items() if d in good} and len(good) < docs.count()


@pytest.mark.parametrize("usable", [
    lambda: F.lit(False), lambda: F.col("doc_id") < 0, lambda: fold(F.col("doc_id")) == 2, lambda: F.col("quality") == 0])
def test_quality_keeps_all_without_rules(spark, kept, tmp_path, usable):
    read(spark, FOLDER, "documents").write.parquet(f"{tmp_path}/documents.parquet")
    read(spark, FOLDER, "labels").filter(usable()).write.parquet(f"{tmp_path}/labels.parquet")
    assert texts(pipeline.quality(spark, kept[0], str(tmp_path))) == texts(kept[0])


def test_quality_learns_from_the_folder_whatever_it_is_handed(spark, kept):
    labels = read(spark, FOLDER, "labels")
    unlabelled = kept[0].join(labels, "doc_id", "left_anti")
    left = texts(unlabelled).keys()
    assert left and texts(pipeline.quality(spark, unlabelled, FOLDER)) == {d: t for d, t in texts(kept[1]).items() if d in left}


def test_near_duplicates(kept):
    first = {int(c) for _, c in classes(sorted(texts(kept[1]).items()))}
    assert texts(kept[2]) == {d: t for d, t in texts(kept[1]).items() if d in first}


def test_repeated_passages(kept):
    before = texts(kept[2])
    spans = brute_force(before.items())
    for doc, text in texts(kept[3]).items():
        left, at = "", 0
        for a, b in spans.get(doc, ([], []))[1]:
            left, at = left + before[doc][at:a], b
        assert text == left + before[doc][at:]
    assert all(r["n_chars"] == len(r["text"]) for r in kept[3].collect())


def test_packing(kept):
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for r in sorted(kept[4].collect(), key=lambda r: (r["doc_id"], r["piece"])):
        got.setdefault(r["doc_id"], []).extend(np.array(r["ids"], np.int64).tolist())
    assert got == {d: [*plain.encode(t, add_special_tokens=False).ids, 1] for d, t in texts(kept[3]).items()}
