import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lettermill.llm import packing
from lettermill.llm.tokens import encode_words

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n", "Hello, World!!", "it's don't 'quoted'", "ÀÉÎ ß İstanbul aβγ", "é é ́x", "<|endoftext|>x <|startoftext|>", "a\tb\x1cc\xa0d",
       "1234 5.6", "中文 \U0001F600", "x" * 3000, "end.) (a) b:c a?! thing, THING. Thing", "\r\nq", "ſ ª º µ ÷×"]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(plain, spark):
    texts = ODD + [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text, ids in zip(texts, encode_words(texts, PATH), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text[:80]


def check(rows, pieces, plain, window):
    """Every text's ids in pieces, and gapless sequences within the window."""
    want = []
    for doc, text in rows:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc, i, at, len(p), zlib.crc32(p.tobytes())) for i, at in enumerate(range(0, len(ids), window))
                 for p in (ids[at:at + window],)]
    got = [(r["doc"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces]
    assert sorted(map(str, got)) == sorted(map(str, want))
    sequences = {}
    for r in pieces:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(sequences)


@pytest.mark.parametrize("window", [4096, 50])
def test_documents_pack_well(spark, plain, window):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    pieces = packing.pack(packing.token_pieces(docs, "doc_id", "text", PATH, window), window).collect()
    n = check(rows, pieces, plain, window)
    total = sum(r["length"] for r in pieces)
    # Best fit by hand over the same pieces.
    gaps, fitted = [], 0
    for size in sorted((r["length"] for r in pieces), reverse=True):
        fit = min((g for g in gaps if g >= size), default=None)
        if fit is None:
            fitted += 1
            fit = window
        else:
            gaps.remove(fit)
        gaps.append(fit - size)
    assert -(-total // window) <= n <= fitted * 1.02 + 1


def test_one_length_and_tiny_texts(spark, plain):
    for texts in (["a b c d e f g h i"] * 500, ["a"] * 300 + [""] * 200, ["a b c d e f g h i j k l m n o p"] * 3 + ["q r"] * 20):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        n = check(list(enumerate(texts)), packing.pack(packing.token_pieces(df, "doc_id", "text", PATH, 20), 20).collect(), plain, 20)
        each = [len(plain.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
        assert n <= -(-sum(each) // 20) * 1.1 + 1


def test_odd_rows(spark, plain):
    rows = [(None, "a b"), (1, None), (1, None), (2, ODD[3]), (2, ODD[3]), *((10 + i, t) for i, t in enumerate(ODD))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, uid string")
    check(rows, packing.pack(packing.token_pieces(df, "doc_id", "text", PATH, 64), 64).collect(), plain, 64)
    with_ids = packing.token_pieces(df, "doc_id", "text", PATH, 64, keep_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in with_ids)
    assert packing.pack(packing.token_pieces(df.limit(0), "doc_id", "text", PATH)).collect() == []


def test_brackets_carry_over_ranges():
    # Gaps left by range 0 serve objects of ranges 1 and 2, the latest left first.
    assert packing.carried({0: [3, 1], 1: [2, 2], 2: [0, 4]}) == [(1, 0, 2, 0, 2), (2, 0, 2, 1, 1), (2, 2, 3, 0, 0)]
