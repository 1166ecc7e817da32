import collections
import random
from fractions import Fraction
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

from lettermill.llm import near_dups as nd
from lettermill.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def bag(text):
    words = (text or "").lower().split()
    return collections.Counter(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def similarity(a, b):
    """Probability Jaccard by its definition: for each shared i, one by the sum over j of max(x[j] / x[i], y[j] / y[i]).

    Where x[j] / y[j] is at least x[i] / y[i] the first is the larger, so sums along that order do.
    """
    if not a or not b:
        return float(not a and not b)
    total_a, total_b = sum(a.values()), sum(b.values())
    x, y = ({k: v / sum(c.values()) for k, v in c.items()} for c in (a, b))
    ratio = {j: Fraction(a.get(j, 0) * total_b, b[j] * total_a) if b.get(j) else float("inf") for j in x.keys() | y.keys()}
    above, below, at = {}, {}, 0.0
    for r, same in groupby(sorted(ratio, key=ratio.get, reverse=True), key=ratio.get):
        at += sum(x.get(j, 0) for j in same)
        above[r] = at
    at = 0.0
    for r, same in groupby(sorted(ratio, key=ratio.get), key=ratio.get):
        below[r] = at
        at += sum(y.get(j, 0) for j in same)
    return sum(1 / (above[ratio[i]] / x[i] + below[ratio[i]] / y[i]) for i in x.keys() & y.keys())


def classes(rows):
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if root(i) != root(j) and (bags[i] == bags[j] or (bags[i].keys() & bags[j].keys() and similarity(bags[i], bags[j]) >= 0.8)):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[root(i)] = min(doc, smallest.get(root(i), doc))
    return sorted((str(doc), str(smallest.get(root(i)))) for i, (doc, _) in enumerate(rows))


def found(df):
    return sorted((str(r["doc_id"]), str(r["class_id"])) for r in nd.near_duplicates(df).collect())


def hashed(text):
    return nd.weighted_sets([text])[0]


@pytest.mark.parametrize("a, b", [
    ("a b c d e f g h", "a b c d e f g x"), ("a a a a a a a a b", "a a a a a a b b"), ("", ""), ("", "a"), ("a b", "A B"), ("q w e", "q w")])
def test_exact_similarity(a, b):
    assert nd.probability_jaccard(hashed(a), hashed(b)) == pytest.approx(similarity(bag(a), bag(b)))


def test_registers_estimate_the_similarity():
    rng = random.Random(1)
    for share, size in ((0.5, 300), (0.8, 40), (0.9, 3)):
        keys = np.array(sorted(rng.sample(range(1, 1 << 60), size + 40)), np.uint64)
        a = (keys[:size], np.array([rng.randrange(1, 6) for _ in range(size)]))
        b = (keys[int(size * (1 - share)):size + 3], np.array([rng.randrange(1, 6) for _ in range(size + 3 - int(size * (1 - share)))]))
        m = 6000
        r = nd.prob_minhash([a, b, (np.zeros(0, np.uint64), np.zeros(0))], m)
        assert abs((r[0] == r[1]).mean() - nd.probability_jaccard(a, b)) < 0.03
        assert (r[2] == 0).all()
        # Neighbours in a batch don't matter.
        assert (nd.prob_minhash([b, a], m)[1] == r[0]).all()


def test_documents_against_brute_force(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    assert found(df) == classes([tuple(r) for r in df.collect()])


@pytest.fixture(scope="module")
def crowded():
    """A large group of edited copies, texts that share a long passage only, and repeated lines."""
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(passage + [word() for _ in range(30)])) for i in range(120)]
    rows += [(2000 + i, "one and the same line here\n" * (3 + i)) for i in range(6)]
    return rows


def test_crowded_bands_against_brute_force(spark, crowded, monkeypatch):
    df = spark.createDataFrame(crowded, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(nd, "BLOCK_TEXTS", 16)
    assert found(df) == classes(crowded)


def test_brute_force_follows_the_definition():
    rng = random.Random(1)
    for _ in range(50):
        a, b = (collections.Counter(rng.choices("abcdefg", k=rng.randint(1, 12))) for _ in "ab")
        x, y = ({k: v / sum(c.values()) for k, v in c.items()} for c in (a, b))
        want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
        assert similarity(a, b) == pytest.approx(want)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, "a b"), (None, "A  b"), (3, None), (4, ""), (5, " \n"), (6, long), (6, long), (7, long + " x"), (8, "one"), (8, "two"), (9, "ONE ")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    assert found(df) == classes(rows)
    kept = sorted((str(r["doc_id"]), (r["text"] or "")[:3]) for r in nd.without_near_duplicates(df).collect())
    assert [k for k, _ in kept] == ["3", "6", "8", "8", "None"]
    assert nd.without_near_duplicates(df.limit(0)).collect() == []


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 7)] + [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(9, 8), (8, 9)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, **{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 560)}}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("agreeing", [5, 97, 100, 150])
def test_pairs_of_a_band_are_verified_however_few_registers_agree(agreeing):
    a, b = (hashed(" ".join(f"w{i}" for i in range(start, start + 100))) for start in (0, 5))
    assert 0.8 <= nd.probability_jaccard(a, b) < 1
    sigs = [np.arange(nd.M, dtype=np.uint16), np.arange(nd.M, dtype=np.uint16)]
    sigs[1][agreeing:] += 1000
    rows = [("t", 0, role, node, node, sig.tobytes(), h.tobytes(), n.astype(np.uint32).tobytes())
            for role, node, sig, (h, n) in ((0, 1, sigs[0], a), (2, 2, sigs[1], b))]
    batch = pa.RecordBatch.from_pylist([dict(zip("abcdefgh", r, strict=True)) for r in rows])
    assert [tuple(r.values()) for out in nd._searched(iter([batch])) for r in out.to_pylist()] == [(2, 1)]
