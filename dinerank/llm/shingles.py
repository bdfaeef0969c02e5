"""Word and shingle hashes of texts, vectorised over Arrow columns.

Words are maximal runs without the characters space and tab to carriage
return; only the letters A to Z are lower-cased.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dinerank.llm.common import list_offsets, mix64

_PLACE = np.random.default_rng(20240501).integers(1, 1 << 63, size=64, dtype=np.uint64) | np.uint64(1)
_BYTE = np.random.default_rng(20240502).integers(1, 1 << 63, size=256, dtype=np.uint64)


def string_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each string's bytes."""
    raw = words.cast(pa.large_binary())
    length = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    out = length.astype(np.uint64)
    full = length > 0
    if full.any():
        data = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8)
        begin = (np.cumsum(length) - length)[full]
        place = np.arange(len(data)) - np.repeat(begin, length[full])
        weight = np.cumprod(np.full(int(length.max()), np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)
        out[full] += np.add.reduceat(_BYTE[data] * weight[place], begin)
    return mix64(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, offsets per text) of a column without nulls."""
    return _hashes(pc.ascii_split_whitespace(pc.ascii_lower(column)))


def folded_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Like :func:`word_hashes`, of words that keep only letters, marks and digits,
    all in lower case; words without any are left out."""
    plain = pc.replace_substring_regex(pc.utf8_lower(column), r"[^\p{L}\p{M}\p{N}\p{Z}\s]+", "")
    return _hashes(pc.utf8_split_whitespace(plain))


def _hashes(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, offsets = parts.flatten(), list_offsets(parts)
    kept = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
    coded = flat.filter(pa.array(kept)).dictionary_encode()
    known = string_hashes(coded.dictionary)
    return known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64), offsets


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on; positions too close
    to the end of the array give the hash of what is there."""
    out = np.full(len(words), np.uint64(size))
    for i in range(min(size, len(words))):
        out[: len(words) - i] += mix64(words[i:] ^ _PLACE[i]) * _PLACE[i]
    return mix64(out)


def shingle_sets(column: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. A text of 1 to size - 1
    words has one shingle, its whole sequence; one without words has none."""
    words, offsets = word_hashes(column)
    every = sequence_hashes(words, size)
    out = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(every[lo:hi - size + 1]))
        elif hi > lo:
            out.append(sequence_hashes(words[lo:hi], hi - lo)[:1])
        else:
            out.append(every[:0])
    return out
