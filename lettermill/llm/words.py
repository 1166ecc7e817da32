"""Hashes of words and word shingles of many texts at once, for use inside tasks.

A word is a run of bytes other than ASCII white space, in lower case unless asked for as it is. All words of a block are
hashed together: a polynomial over random byte values is summed up once along the block, and the
difference between a word's ends, shifted back to its start, is its hash. Blocks are cut at
white space and hold about ``BLOCK`` bytes, so memory stays bounded however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WORDS = 5
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\v\f\r")] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, BLOCK + 1024), base, np.uint64)
        known[0] = 1
        _powers[base] = known = np.multiply.accumulate(known)
    return known[:n]


def _parts(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of at most ``BLOCK`` bytes, cut at white space; only a longer word makes a longer part."""
    start = 0
    while len(text) - start > BLOCK:
        window = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, BLOCK, start)])
        if len(window):
            cut = start + int(window[-1]) + 1
        else:
            later = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, -1, start + BLOCK)])
            cut = start + BLOCK + int(later[0]) + 1 if len(later) else len(text)
        yield text[start:cut]
        start = cut
    yield text[start:]


def _block_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of ``parts``, the number of words of each part, and words' first and past-last code points."""
    buffer = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    space = _SPACE[buffer]
    before = np.concatenate(([True], space[:-1]))
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[buffer] * _power(_BASE, len(buffer)))))
    inverse = _power(pow(_BASE, -1, 1 << 64), len(buffer))
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    edges = np.cumsum([0] + [len(p) + 1 for p in parts])
    points = np.concatenate((np.zeros(1, np.int64), np.cumsum((buffer & 0xC0) != 0x80)))
    counts = np.diff(np.searchsorted(starts, edges))
    places = points[np.stack((starts, ends))] - np.repeat(points[edges[:-1]], counts)
    return hashes, counts, places


def word_hashes(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, in order, and where each text's words begin (and the last one's end)."""
    return placed_words([t.lower() for t in texts])[:2]


def placed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`word_hashes`, without changing case; also first and past-last code point of each word in its text."""
    found, counts, where, parts, owners, size = [], [], [], [], [], 0
    texts = [t.encode("utf-8", "surrogatepass") for t in texts]
    before, passed = [], 0

    def flush() -> None:
        if parts:
            hashes, n, places = _block_hashes(parts)
            found.append(hashes)
            counts.append(np.stack((np.array(owners), n)))
            where.append(places + np.repeat(np.array(before), n))
            parts.clear()
            owners.clear()
            before.clear()

    for i, text in enumerate(texts):
        passed = 0
        for part in _parts(text):
            if size + len(part) > BLOCK:
                flush()
                size = 0
            parts.append(part)
            owners.append(i)
            before.append(passed)
            size += len(part)
            if len(part) < len(text):
                passed += len(part.decode("utf-8", "surrogatepass"))
    flush()
    per_text = np.zeros(len(texts), np.int64)
    for pair in counts:
        np.add.at(per_text, pair[0], pair[1])
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(per_text)))
    if not found:
        return np.zeros(0, np.uint64), offsets, np.zeros((2, 0), np.int64)
    return np.concatenate(found), offsets, np.concatenate(where, axis=1)


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words from ``starts`` up to ``ends``, whatever stands around them."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * _power(_BASE, len(words)))))
    inverse = _power(pow(_BASE, -1, 1 << 64), len(words) + 1)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(texts: Iterable[str], n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words of each text, in order, and where each text's begin.

    A text of fewer words, but one at least, has one shingle of all its words; one without words has none.
    """
    words, offsets = word_hashes(texts)
    sizes = np.diff(offsets)
    counts = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)))
    places = np.repeat(offsets[:-1] - edges[:-1], counts) + np.arange(edges[-1])
    ends = np.repeat(offsets[1:], counts)
    padded = np.concatenate((words, np.zeros(n, np.uint64)))
    total = np.zeros(len(places), np.uint64)
    for j in range(n):
        total = np.where(places + j < ends, mix(total * np.uint64(_BASE) + padded[places + j]), total)
    return total, edges


def in_chunks(rows: Iterable, size, limit: int = BLOCK) -> Iterator[list]:
    """Lists of consecutive rows whose sizes come to about ``limit``."""
    chunk, total = [], 0
    for row in rows:
        chunk.append(row)
        total += size(row)
        if total >= limit or len(chunk) >= 4096:
            yield chunk
            chunk, total = [], 0
    if chunk:
        yield chunk
