"""Token ids of whole texts inside tasks, by a public tokenizer file."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT_STEMS, KEPT_LENGTH, JOINED = 600_000, 48, 100
#: Letters that stay one pre-token, whatever their case, and marks that are a pre-token of their own behind them.
_PLAIN, _MARKS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", ".,;:!?)"
_known: dict[str, WordIds] = {}


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


class Recent:
    """A dictionary that forgets the older half of what it holds when it is full."""

    def __init__(self, kept: int) -> None:
        self.half, self.new, self.old = kept // 2, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= KEPT_LENGTH:
            if len(self.new) >= self.half:
                self.new, self.old = {}, self.new
            self.new[key] = value


class WordIds:
    """Ids of words as little-endian unsigned 32-bit values, remembered up to a bound.

    For vocabularies of lower-case words with a mark on every word's last token, whose tokens never
    span a blank or a line end.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Lower-case words of plain letters, and all else: other words, and marks behind words.
        self.stems, self.odd = Recent(KEPT_STEMS), Recent(KEPT_STEMS // 4)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _single(self, words: list[str]) -> list[bytes]:
        return [array("I", found.ids).tobytes() for start in range(0, len(words), 10_000)
                for found in self.tokenizer.encode_batch_fast(words[start:start + 10_000], add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Words of plain letters are encoded together and told apart by their last tokens."""
        out: list[bytes] = []
        groups = [words[start:start + JOINED] for start in range(0, len(words), JOINED)]
        for start in range(0, len(groups), 100):
            part = groups[start:start + 100]
            joined = self.tokenizer.encode_batch_fast([" ".join(g) for g in part], add_special_tokens=False)
            for group, found in zip(part, joined, strict=True):
                ids = np.array(found.ids, "<u4")
                ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip([0, *ends], ends, strict=False)] if len(ends) == len(group) else self._single(group)
        return out

    @staticmethod
    def _through(cache: Recent, words: list[str], encode) -> list[bytes]:
        found = list(map(cache.new.get, words))
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = cache.get(words[i])
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missing, encode([words[i] for i in missing]), strict=True):
            found[i] = ids
            cache.put(words[i], ids)
        return found

    def _words(self, words: pa.Array) -> list[bytes]:
        """The ids of distinct words: of their letters, each stem once, and of the marks behind them."""
        letters = pc.utf8_rtrim(words, characters=_MARKS)
        # Only plain letters are lowered here: some others have plain ones as their lower case, but not in the tokenizer.
        stems = pc.if_else(pc.match_substring_regex(letters, _PLAIN), pc.utf8_lower(letters), letters).dictionary_encode()
        plain = pc.match_substring_regex(stems.dictionary, _PLAIN).to_numpy(zero_copy_only=False)
        known = _strings(stems.dictionary.filter(pa.array(plain)))
        of_stem = np.full(len(plain), None, object)
        of_stem[np.flatnonzero(plain)] = self._through(self.stems, known, self._joined)
        heads = of_stem[stems.indices.to_numpy()].tolist()
        texts, sizes = _strings(words), pc.utf8_length(letters).to_numpy().tolist()
        tails = [text[size:] if head is not None else text for text, size, head in zip(texts, sizes, heads, strict=True)]
        others = list(set(tails))
        of_other = dict(zip(others, self._through(self.odd, others, self._single), strict=True))
        return [head + of_other[tail] if head else of_other[tail] for head, tail in zip(heads, tails, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each different word of ``texts`` is looked up once."""
        split = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = split.values.dictionary_encode()
        found, of_word = self._words(coded.dictionary), coded.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.concatenate(([0], np.cumsum(sizes[of_word])))
        edges = ends[split.offsets.to_numpy()].tolist()
        data = b"".join(map(found.__getitem__, of_word.tolist()))
        return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def encode_words(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit values."""
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path].encode(texts)
