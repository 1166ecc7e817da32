"""Sampled segmentations into the pieces of a SentencePiece model, and lossless decoding.

A segmentation is drawn with a probability in proportion to the product of its pieces'
probabilities: sums over all segmentations run forward over the lattice of pieces, then a path is drawn
backward from the end, each step by the exact share of the paths through it. Draws depend on
the seed, the row's key, and the place in the row's text only, so any rerun, on any partitioning, gives the same ids.

No piece of the model spans the start of a run of blanks or a line end (checked when it is
loaded), so lattices are those of the parts in between; each distinct part's lattice is built
once per worker while a bounded cache lasts, all new parts of a batch at once.

The scores of a merge-based model are merge ranks; a piece's probability is taken to be in
proportion to 1 / (rank + 2) ** alpha. Characters without a piece become their UTF-8 byte pieces.
A blank is put before a text and taken off when decoding; a literal U+2581, which stands for
a blank in pieces, is written as bytes. So every text decodes to itself.

Defined results: a null text is empty and has no pieces; rows with equal keys and texts get equal
ids, null keys as the empty key; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.words import in_chunks, mix

BLANK, CHUNK, EDGES = "▁", 1 << 20, 6_000_000
_PARTS = re.compile(r" *[^ \n]+| +|\n+")
_GOLDEN, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_loaded: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, alpha: float) -> Lattices:
    if (path, alpha) not in _loaded:
        _loaded[path, alpha] = Lattices(path, alpha)
    return _loaded[path, alpha]


class Lattices:
    """The pieces of a model, and tables of the lattices of the parts seen so far."""

    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * self.size
        self.byte_ids = np.zeros(256, np.int32)
        ranks = np.full(self.size, -1.0)
        states: dict[tuple[int, int], int] = {}
        piece_at = [-1]
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes_of[i], ranks[i] = i, bytes([value]), self.size
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if "\n" in piece or " " in piece or BLANK in piece.lstrip(BLANK):
                    raise ValueError(f"piece {i} spans a boundary")
                score = model.get_score(i)
                ranks[i] = -score if score > -self.size else 0
                self.bytes_of[i] = piece.replace(BLANK, " ").encode()
                state = 0
                for c in piece:
                    state = states.setdefault((state, ord(c)), len(piece_at))
                    if state == len(piece_at):
                        piece_at.append(-1)
                piece_at[state] = i
        keys = np.array([(s << 21) | c for s, c in states], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(states.values()), np.int64)[order]
        self.piece_at = np.array(piece_at, np.int32)
        weights = np.where(ranks >= 0, 1.0 / (ranks + 2) ** alpha, 0.0)
        with np.errstate(divide="ignore"):
            self.log_weight = np.log(weights / weights.sum())
        self.byte_weight = float(self.log_weight[self.byte_ids[0]])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first_node, self.last_node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first_edge = np.zeros(0, np.int64)
        self.upto, self.code, self.start = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def learn(self, parts: list[str]) -> None:
        """Add the lattices of new parts: per node its incoming edges with summed-up shares."""
        sizes = np.array([len(p) for p in parts])
        text = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        of_part = np.repeat(np.arange(len(parts)), sizes)
        offsets = np.cumsum(sizes) - sizes
        ends = (offsets + sizes)[of_part]
        symbols = np.where(text == 0x20, 0x2581, np.where(text == 0x2581, 0x1FFFFF, text))
        at, state, length = np.arange(len(text)), np.zeros(len(text), np.int64), 0
        found = []
        single = np.zeros(len(text), bool)
        while len(at):
            wanted = (state << 21) | symbols[at + length]
            place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            ok = self.keys[place] == wanted
            at, state, length = at[ok], self.next[place[ok]], length + 1
            piece = self.piece_at[state]
            whole = piece >= 0
            found.append((at[whole], np.full(whole.sum(), length), piece[whole].astype(np.int64)))
            if length == 1:
                single[at[whole]] = True
            inside = at + length < ends[at]
            at, state = at[inside], state[inside]
        lone = np.flatnonzero(~single)
        found.append((lone, np.ones(len(lone), np.int64), self.size + text[lone]))
        begin, size, code = (np.concatenate(c) for c in zip(*found, strict=True))
        width = np.where(code >= self.size, _utf8_size(code - self.size), 0)
        weight = np.where(code >= self.size, width * self.byte_weight, self.log_weight[np.minimum(code, self.size - 1)])
        # Each part has a node before every character and one at its end.
        a, b = begin + of_part[begin], begin + size + of_part[begin]
        relative = begin - offsets[of_part[begin]]
        order = np.argsort(relative, kind="stable")
        log = np.full(len(text) + len(parts), -np.inf)
        log[offsets + np.arange(len(parts))] = 0.0
        from_, to, gain = a[order], b[order], weight[order]
        steps = np.concatenate(([0], np.cumsum(np.bincount(relative))))
        for low, high in zip(steps[:-1], steps[1:], strict=True):
            np.logaddexp.at(log, to[low:high], log[from_[low:high]] + gain[low:high])
        order = np.argsort(b, kind="stable")
        a, b, code, weight = a[order], b[order], code[order], weight[order]
        share = np.exp(log[a] + weight - log[b])
        first = np.searchsorted(b, np.arange(len(log) + 1))
        total = np.concatenate(([0.0], np.cumsum(share)))
        upto = total[1:] - total[first[b]]
        last = first[1:][np.diff(first) > 0] - 1
        upto[last] = 2.0
        nodes, edges = len(self.first_edge), len(self.code)
        for i, part in enumerate(parts):
            self.known[part] = len(self.first_node) + i
        self.first_node = np.concatenate((self.first_node, offsets + np.arange(len(parts)) + nodes))
        self.last_node = np.concatenate((self.last_node, offsets + sizes + np.arange(len(parts)) + nodes))
        self.first_edge = np.concatenate((self.first_edge, first[:-1] + edges))
        self.upto, self.code = np.concatenate((self.upto, upto)), np.concatenate((self.code, code.astype(np.int32)))
        self.start = np.concatenate((self.start, a + nodes))

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and where each text's begin."""
        parts = [_PARTS.findall(" " + t) if t else [] for t in texts]
        new = set().union(*parts).difference(self.known)
        if len(self.code) > EDGES:
            self.forget()
            new = set().union(*parts)
        if new:
            self.learn(sorted(new))
        sizes = np.array([len(p) for p in parts], np.int64)
        part = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, sizes.sum())
        of_text = np.repeat(np.arange(len(texts)), sizes)
        nth = np.arange(len(part)) - (np.cumsum(sizes) - sizes)[of_text]
        state = mix(seeds[of_text] + nth.astype(np.uint64) * _GOLDEN)
        on, node, goal, drawn = np.arange(len(part)), self.last_node[part], self.first_node[part], []
        while len(on):
            draw = (mix(state + np.uint64((len(drawn) + 1) * int(_OTHER) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            edge = self.first_edge[node]
            late = np.flatnonzero(draw >= self.upto[edge])
            while len(late):
                edge[late] += 1
                late = late[draw[late] >= self.upto[edge[late]]]
            drawn.append((on, self.code[edge]))
            node = self.start[edge]
            open_ = np.flatnonzero(node != goal)
            on, node, goal, state = on[open_], node[open_], goal[open_], state[open_]
        counts = np.zeros(len(part), np.int64)
        for step, (who, _) in enumerate(drawn):
            counts[who] = step + 1
        ends = np.cumsum(counts)
        codes = np.zeros(ends[-1] if len(ends) else 0, np.int64)
        for step, (who, code) in enumerate(drawn):
            codes[ends[who] - 1 - step] = code
        per_text = np.zeros(len(texts), np.int64)
        owner = np.repeat(of_text, counts)
        ids, width = self._with_bytes(codes)
        np.add.at(per_text, owner, width)
        return ids, np.concatenate(([0], np.cumsum(per_text)))

    def _with_bytes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as their bytes' ids; also the number of ids of each code."""
        point = codes - self.size
        width = np.where(point >= 0, _utf8_size(point), 1)
        if (width == 1).all() and (point < 0).all():
            return codes.astype(np.int32), width
        ends = np.cumsum(width)
        out = np.repeat(codes, width)
        for n in range(1, 5):
            who = np.flatnonzero((point >= 0) & (width == n))
            for i in range(n):
                bits = point[who] >> (6 * (n - 1 - i))
                value = bits if n == 1 else (bits & 0x3F) | 0x80 if i else bits | (0xF00 >> n) & 0xFF
                out[ends[who] - n + i] = self.byte_ids[value]
        return out.astype(np.int32), width

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:]


def _utf8_size(point: np.ndarray) -> np.ndarray:
    return 1 + (point >= 0x80).astype(np.int64) + (point >= 0x800) + (point >= 0x10000)


def sample_pieces(df: DataFrame, key: str, text: str, model: str, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """(key, ids, lossless) per row; ``lossless`` says whether the ids were decoded to the text again."""
    seeds = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed))
    rows = df.select(F.col(key).alias("key"), seeds.alias("seed"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = lattices(model, alpha)
        for batch in batches:
            cells = zip(*(batch.column(i) for i in range(3)), strict=True)
            for chunk in in_chunks(((k.as_py(), s.as_py(), t.as_py()) for k, s, t in cells), lambda row: len(row[2]), CHUNK):
                texts = [t for _, _, t in chunk]
                ids, edges = tables.sample(texts, np.array([s for _, s, _ in chunk], np.int64).view(np.uint64))
                flat = ids.tolist()
                same = [tables.decode(flat[a:b]) == t for a, b, t in zip(edges[:-1], edges[1:], texts, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([k for k, _, _ in chunk], batch.column(0).type),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids)), pa.array(same)],
                    names=["key", "ids", "lossless"])

    return rows.mapInArrow(run, f"key {kind}, ids array<int>, lossless boolean").withColumnRenamed("key", key)


def decode_pieces(df: DataFrame, key: str, ids: str, model: str) -> DataFrame:
    """(key, text) per row; null ids are an empty text."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = lattices(model, 1.0)
        for batch in batches:
            texts = pa.array([tables.decode(x.as_py()) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["key", "text"])

    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
