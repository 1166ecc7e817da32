import collections

import numpy as np
import public_tokenizers
import pytest

from lettermill.llm.piece_sampling import decode_pieces, lattices, sample_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", "a\n\n b", "x" * 5000, " lead", "trail  ", "a▁b ▁", "中文 \U0001F600é́\t\r\n",
       "<s> </s> <unk> <0x41>", "\x00\x1c", "word " * 300, "\U0010ffff"]


@pytest.fixture(scope="module")
def tables():
    return lattices(MODEL, 1.0)


def encode(tables, texts, seeds=None):
    ids, edges = tables.sample(texts, np.arange(len(texts), dtype=np.uint64) if seeds is None else seeds)
    return [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]


def test_every_text_decodes_to_itself(tables):
    for text, ids in zip(ODD, encode(tables, ODD), strict=True):
        assert tables.decode(ids) == text


def segmentations(tables, part):
    """All segmentations of a part and their weights, by the definition."""
    pieces = {tables.bytes_of[i].decode(): i for i in range(tables.size) if np.isfinite(tables.log_weight[i]) and i not in set(tables.byte_ids.tolist())}
    if not part:
        return [((), 0.0)]
    out = []
    for n in range(1, len(part) + 1):
        if part[:n] in pieces:
            i = pieces[part[:n]]
            out += [((i, *rest), w + tables.log_weight[i]) for rest, w in segmentations(tables, part[n:])]
    return out


def test_draws_follow_the_weights(tables):
    all_ = segmentations(tables, " they")
    weights = np.exp([w for _, w in all_])
    n = 40_000
    drawn = collections.Counter(map(tuple, encode(tables, ["they"] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919))))
    assert set(drawn) <= {s for s, _ in all_}
    for (ids, _), share in zip(all_, weights / weights.sum(), strict=True):
        assert abs(drawn[ids] / n - share) < 5 * (share * (1 - share) / n) ** 0.5 + 1e-3


def test_same_key_same_ids_whatever_the_batch(tables):
    texts = ["the letters of a mill", *ODD, "the letters of a mill"]
    seeds = np.array([5] + [9] * len(ODD) + [5], np.uint64)
    whole = encode(tables, texts, seeds)
    tables.forget()
    single = [encode(tables, [t], seeds[i:i + 1])[0] for i, t in enumerate(texts)]
    assert whole == single and whole[0] == whole[-1]


def test_tables(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null key", "x"), (3, None, "x"), (0, "a b", "x"), (0, "a b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = sample_pieces(df.repartition(3), "doc_id", "text", MODEL)
    assert all(r["lossless"] for r in found.collect())
    back = decode_pieces(found, "doc_id", "ids", MODEL)
    assert collections.Counter(map(tuple, back.collect())) == collections.Counter((k, t or "") for k, t, _ in rows)
    again = sample_pieces(df.repartition(7), "doc_id", "text", MODEL)
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))
    other = sample_pieces(df, "doc_id", "text", MODEL, seed=1)
    assert sorted(map(str, other.collect())) != sorted(map(str, found.collect()))
    assert sample_pieces(df.limit(0), "doc_id", "text", MODEL).collect() == []


def test_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = sample_pieces(docs, "doc_id", "text", MODEL)
    texts = dict(docs.select("doc_id", "text").collect())
    assert dict(map(tuple, decode_pieces(found, "doc_id", "ids", MODEL).collect())) == texts
