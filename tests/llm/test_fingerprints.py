import hashlib

import numpy as np
from pyspark.sql import functions as F

from lettermill.llm import fingerprints as fp
from lettermill.llm.words import BLOCK, shingle_hashes, word_hashes

FOLDER = "/root/testdata/sf0.001"


def shingles(text, n=5):
    words = text.lower().encode().split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_equal_words_hash_alike():
    hashes, edges = word_hashes(["a bb  A\n", "", "", "bb é\tÉ", "a" * 70])
    assert edges.tolist() == [0, 3, 3, 3, 6, 7]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3] and hashes[4] == hashes[5]
    assert len(set(hashes.tolist())) == 4


def test_long_texts_hash_like_their_parts():
    words = [f"w{i}" for i in range(300_000)]
    assert sum(map(len, words)) > BLOCK
    whole, _ = word_hashes([" ".join(words)])
    parts, _ = word_hashes([" ".join(words[:1000]), " ".join(words[1000:])])
    assert (whole == parts).all() and len(set(whole.tolist())) == len(words)
    one, edges = word_hashes(["x" * (3 * BLOCK), "y"])
    assert edges.tolist() == [0, 1, 2]


def test_shingles():
    hashes, edges = shingle_hashes(["a b c d e f", "a b c d e", "a b", "", "b c d e f"])
    assert np.diff(edges).tolist() == [2, 1, 1, 0, 1]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[4] and hashes[3] not in hashes[:3]


def test_estimates_are_near():
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 2000), (500, 2500), (0, 50), (10, 50))]
    s = fp.sketches(texts)
    assert abs(fp.likeness(s[0], s[1]) - 1496 / 2496) < 0.15
    assert abs(fp.distinct_shingles(s[0]) / 1996 - 1) < 0.3
    assert fp.likeness(s[2], s[3]) == 36 / 46 and fp.distinct_shingles(s[2]) == 46
    empty = np.zeros(0, np.int64)
    assert fp.likeness(empty, empty) == 1 and fp.likeness(empty, s[0]) == 0


def test_parts_merge_and_columns_agree(spark):
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 900), (900, 1800), (300, 900), (0, 3))]
    parts = spark.createDataFrame([(1, texts[0], "x"), (1, texts[1], "y"), (2, texts[2], "z"), (3, texts[3], "z"), (4, None, None)],
                                  "id long, text string, sketch string")
    sketches = {r["id"]: r["sketch"] for r in fp.merge(fp.fingerprints(parts, "id", "text"), "id").collect()}
    own = fp.sketches([texts[0], texts[1], texts[2], texts[3]])
    assert sketches[1] == np.unique(np.concatenate(own[:2]))[:fp.K].tolist() and sketches[4] == []
    row = spark.createDataFrame([(sketches[1], sketches[2])], "a array<bigint>, b array<bigint>").select(
        fp.resemblance(F.col("a"), F.col("b")).alias("r"),
        fp.containment(F.col("b"), F.col("a")).alias("c"), fp.distinct_count(F.col("a")).alias("n")).first()
    assert row["r"] == fp.likeness(np.array(sketches[1]), np.array(sketches[2]))
    assert row["c"] > 0.7 and abs(row["n"] / 1792 - 1) < 0.3


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        m = len(text) // 4
        edited = text[:len(text) - m] + after[:m]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, after))
    return out


def check(df, rows, blocks):
    got = sorted(fp.edited_fingerprints(df, blocks=blocks).collect(),
                 key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["edited_sha256"]))
    want = sorted(expected(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got] == [w[:3] for w in want]
    for r, (_, _, _, text, edited, after) in zip(got, want, strict=True):
        a, b, c = fp.sketches([text, edited, after])
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fp.as_text(a), fp.as_text(b))
        assert (r["near_edited"], r["near_next"]) == (fp.likeness(a, b), fp.likeness(a, c))
        for other, near in ((edited, r["near_edited"]), (after, r["near_next"])):
            x, y = shingles(text), shingles(other)
            assert abs(near - (len(x & y) / len(x | y) if x | y else 1)) < 0.25


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for blocks in (1, 7):
        check(docs, rows, blocks)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f g h"), (3, None), (3, ""), (5, "x" * 50_000), (5, "x" * 50_000), (9, "é b c d e f " * 40), (2 ** 60, "z")]
    df = spark.createDataFrame([(*r, "bucket") for r in rows], "doc_id long, text string, bucket string")
    for blocks in (1, 3, 16):
        check(df, rows, blocks)
    check(df.limit(1), rows[:1], 4)
    assert fp.edited_fingerprints(df.limit(0), blocks=4).collect() == []
