"""Distinct words of a batch of texts and their hashed byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dinerank.llm.common import list_offsets, mix64


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-cased words between white space: (offsets per text, code of each
    word, distinct words)."""
    parts = pc.split_pattern_regex(pc.utf8_lower(column), r"[\s\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}]+")
    flat, offsets = parts.flatten(), list_offsets(parts)
    kept = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
    coded = flat.filter(pa.array(kept)).dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


#: Distinct words whose n-grams are held at once.
WORDS = 1 << 14


def word_blocks(words: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    for lo in range(0, len(words), WORDS):
        yield lo, words.slice(lo, WORDS)


def ngrams_of(words: pa.Array, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of each word between boundary marks, and last the word
    itself: (bucket of each n-gram grouped by word, offsets per word)."""
    n = len(words)
    raw = words.cast(pa.large_binary())
    length = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8)
    marked = length + 2
    begin = np.cumsum(marked) - marked
    buf = np.full(int(marked.sum()), 1, dtype=np.uint64)  # 1 marks both ends
    inside = np.ones(len(buf), dtype=bool)
    inside[begin] = False
    inside[begin + marked - 1] = False
    buf[inside] = data
    word_of = np.repeat(np.arange(n), marked)
    place = np.arange(len(buf)) - begin[word_of]
    tail = marked[word_of] - place  # bytes from here to the word's end
    each = sum((np.maximum(marked - k + 1, 0) for k in sizes), np.ones(n, dtype=np.int64))
    offsets = np.concatenate([[0], np.cumsum(each)])
    out = np.empty(int(offsets[-1]), dtype=np.int32)
    free = offsets[:-1].copy()
    gram = np.zeros(len(buf), dtype=np.uint64)
    for k in range(1, max(sizes) + 1):
        gram *= np.uint64(0x100000001B3)
        gram[: len(buf) - k + 1] += buf[k - 1:] + np.uint64(1)
        if k in sizes:
            at = np.flatnonzero(tail >= k)
            out[free[word_of[at]] + place[at]] = mix64(gram[at] + np.uint64(k << 56)) % np.uint64(buckets)
            free += np.maximum(marked - k + 1, 0)
    if n:  # a polynomial over the whole word
        weight = np.cumprod(np.full(int(marked.max()), np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)
        out[free] = mix64(np.add.reduceat(buf * weight[place], begin)) % np.uint64(buckets)
    return out, offsets
