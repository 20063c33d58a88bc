"""Hashed word and character n-gram features of whole texts, block by block.

A feature is an index below 2 ** BITS: of each word, of each pair of adjacent
words (all pairs of a word and itself share one), and of each run of three and of four
characters (code points, white space among them). Case is kept. Scoring needs only sums
of a table over a document's features, which are differences of running sums, so no
feature list of a document is ever built there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from sluice.llm.shared import Words, blocks, mix, span_hashes, split_words

BITS = 18
#: Lengths of the character n-grams.
GRAMS = (3, 4)
_U = np.uint64


def _kinds(data: np.ndarray, bounds: np.ndarray, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Feature indices of each kind, with the first and last + 1 of each document."""
    index = lambda h: (h >> _U(64 - BITS)).astype(np.int32)
    yield index(words.hashes), words.bounds[:-1], words.bounds[1:]
    again = words.hashes[:-1] == words.hashes[1:]
    pair = np.where(again, _U(0), mix(words.hashes[:-1] * _U(3) + words.hashes[1:]))
    yield index(pair), words.bounds[:-1], np.maximum(words.bounds[1:] - 1, words.bounds[:-1])
    letters = np.flatnonzero((data & 0xC0) != 0x80)  # bytes that begin a code point
    ends, at = np.append(letters, len(data)), np.searchsorted(letters, bounds)
    for n in GRAMS:
        grams = span_hashes(data, letters[: len(letters) - n + 1], ends[n:], salt=n) if len(letters) >= n else np.zeros(0, _U)
        yield index(grams), at[:-1], np.maximum(at[1:] - n + 1, at[:-1])


def table_means(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of each document the mean of ``table`` over its features; 0 without features."""
    out = []
    for _, _, part, at in blocks(data, bounds):
        total, count = np.zeros(len(at) - 1), np.zeros(len(at) - 1, np.int64)
        for index, first, last in _kinds(part, at, split_words(part, at)):
            run = np.zeros(len(index) + 1)
            np.cumsum(table[index], dtype=np.float64, out=run[1:])
            first, last = np.minimum(first, len(index)), np.minimum(last, len(index))
            total += run[last] - run[first]
            count += last - first
        out.append(total / np.maximum(count, 1))
    return np.concatenate(out) if out else np.zeros(0)


def feature_bags(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each document its distinct features and their shares (sum 1; empty without features)."""
    for _, _, part, at in blocks(data, bounds):
        kinds = list(_kinds(part, at, split_words(part, at)))
        for d in range(len(at) - 1):
            all_ = np.concatenate([index[first[d] : last[d]] for index, first, last in kinds])
            features, n = np.unique(all_, return_counts=True)
            yield features.astype(np.int32), (n / max(1, len(all_))).astype(np.float32)
