import random
import re

import pytest

from lettermill.llm import suffix_dedup as sd

FOLDER = "/root/testdata/sf0.001"


def brute_force(rows, n=sd.WORDS):
    """Repeated and removed spans by listing all windows."""
    seen, placed = {}, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^ \t\n\v\f\r]+", text or "")]
        placed.append((doc, words))
        for i in range(len(words) - n + 1):
            seen.setdefault(tuple(w for _, _, w in words[i:i + n]), []).append((doc, i))
    out = {}
    for doc, words in placed:
        spans = [[], []]
        for i in range(len(words) - n + 1):
            where = seen[tuple(w for _, _, w in words[i:i + n])]
            for kind in range(2):
                if len(where) > 1 and (kind == 0 or where[0] != (doc, i)):
                    s = spans[kind]
                    if s and words[i][0] <= s[-1][1]:
                        s[-1][1] = words[i + n - 1][1]
                    else:
                        s.append([words[i][0], words[i + n - 1][1]])
        if spans[0]:
            out[doc] = tuple([tuple(x) for x in s] for s in spans)
    return out


def found(df):
    return {r["doc_id"]: ([tuple(s) for s in r["repeated"]], [tuple(s) for s in r["removed"]])
            for r in sd.repeated_passages(df).collect()}


@pytest.fixture(scope="module")
def mixed():
    """Texts that share passages, with edits close to each other, at places that shift."""
    rng = random.Random(3)
    word = lambda: rng.choice("é a bb ccc dd E f gg hh ii".split()) + str(rng.randrange(30))
    passages = [[word() for _ in range(rng.randrange(45, 160))] for _ in range(6)]
    rows = []
    for i in range(150):
        words = [word() for _ in range(rng.randrange(0, 70))]
        for _ in range(rng.randrange(0, 4)):
            p = list(rng.choice(passages))
            a = rng.randrange(0, 40)
            p = p[a:len(p) - rng.randrange(0, 40)] if rng.random() < 0.5 else p
            for _ in range(rng.randrange(0, 3)):
                if p:
                    p[rng.randrange(len(p))] = word()
            words += p + [word() for _ in range(rng.randrange(0, 30))]
        rows.append((i, "".join(w + rng.choice([" ", "\n", "  "]) for w in words)))
    rows += [(200, "Ha " * 400), (201, "ha " * 49), (202, "ho " * 50), (203, "ha ho " * 30), (204, ""), (205, rows[7][1])]
    return rows


def test_against_brute_force(spark, mixed):
    df = spark.createDataFrame(mixed, "doc_id long, text string").repartition(5)
    want = brute_force(mixed)
    assert len(want) > 50 and any(want[d][1] != want[d][0] for d in want)
    assert found(df) == want


def test_documents_against_brute_force(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    assert found(df) == brute_force([tuple(r) for r in df.collect()])


def test_cut_texts_keep_every_passage_once(spark, mixed):
    df = spark.createDataFrame(mixed, "doc_id long, text string")
    cut = dict(map(tuple, sd.without_repeats(df).collect()))
    assert len(cut) == len(mixed)
    want = brute_force(mixed)
    for doc, text in mixed:
        left, at = "", 0
        for a, b in want.get(doc, ([], []))[1]:
            left, at = left + text[at:a], b
        assert cut[doc] == left + text[at:]


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (None, None), (1, long + " x"), (1, "short"), (2, long), (2, long)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, start int")
    spans = {(r["doc_id"], r["text_key"]): (len(r["repeated"]), len(r["removed"])) for r in sd.repeated_passages(df).collect()}
    assert sorted((str(d), *n) for (d, _), n in spans.items()) == [("1", 1, 1), ("2", 1, 1), ("None", 1, 0)]
    cut = sorted(map(str, (tuple(r) for r in sd.without_repeats(df).collect())))
    assert cut == sorted(map(str, [(None, long, 5), (None, "", 5), (1, " x", 5), (1, "short", 5), (2, "", 5), (2, "", 5)]))
    assert sd.repeated_passages(df.limit(0)).collect() == []
