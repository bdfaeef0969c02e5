"""Token counts of whole texts without materialising token ids.

A text is cut at single spaces into segments (a byte-level BPE never merges
across the start of such a segment), segments are dictionary-encoded, each
distinct segment is split into its pre-tokens, and the tokenizer counts the
pieces of each distinct pre-token once. Counts are then joined to every
document's segment frequencies through the dictionary codes and summed.
Nothing is shuffled; a worker keeps its counts from batch to batch, so a
pre-token costs one encoding per worker and not one per occurrence.

Texts in which such segments could interact (runs of three or more white-space
characters, two or more at the end, or a special token's opening characters)
are cut where white space follows another character, so that a run stays with
what comes after it: no pre-token crosses such a place. Only a segment with a
special token's opening characters goes to the tokenizer as it is.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinerank.llm.common import list_offsets, map_arrow, segment_sums, slices, strings

#: The white space of the tokenizer's pattern language, as an RE2 class.
WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WHOLE = WHITE + r"{3,}|" + WHITE + r"{2,}\z|<\|"
#: Fixed value: the same class for the other engine, and a place where a text may be cut.
CUT = r"(?<=[^" + regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\u%04x" % int(m[1], 16), WHITE[1:-1]) + r"])(?=[ \t\n\r])"
#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens a worker remembers before it starts anew.
CACHE_ENTRIES = 1_000_000


class PieceCounter:
    """Numbers of tokens of strings, each distinct pre-token counted once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(PRE_TOKEN).findall
        self.cut = regex.compile(CUT, regex.V1).split
        self.known: dict[str, int] = {}

    def encode_counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def segments(self, segments: list[str]) -> np.ndarray:
        """Tokens per segment. A segment with a character beyond the Latin
        blocks is its own pre-token: character classes of the two pattern
        engines may differ there. So is one that may hold a special token."""
        parts = [self.split(s) if "<|" not in s and (s.isascii() or max(s) < "ɐ") else [s] for s in segments]
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        known = self.known
        new = list({p for part in parts for p in part if p not in known})
        known.update(zip(new, self.encode_counts(new), strict=True))
        return np.array([sum([known[p] for p in part]) for part in parts], dtype=np.int64)

    def texts(self, column: pa.Array) -> np.ndarray:
        """Tokens per text of a string column without nulls."""
        out = np.zeros(len(column), dtype=np.int64)
        whole = pc.match_substring_regex(column, WHOLE).to_numpy(zero_copy_only=False).astype(bool)
        if whole.any():
            cut = [self.cut(t) for t in column.filter(pa.array(whole)).to_pylist()]
            ends = np.cumsum([0, *map(len, cut)])
            coded = pa.array([s for segments in cut for s in segments], pa.large_string()).dictionary_encode()
            each = self.segments(coded.dictionary.to_pylist())
            out[whole] = segment_sums(each[coded.indices.to_numpy()], ends)
        plain = column.filter(pa.array(~whole))
        if not len(plain):
            return out
        parts = pc.split_pattern(plain, " ")
        offsets, flat = list_offsets(parts), parts.flatten()
        # A text's first segment has no space before it; the others have one.
        first = np.zeros(len(flat), dtype=bool)
        first[offsets[:-1]] = True
        counts = np.zeros(len(flat), dtype=np.int64)
        for mask, lead in ((first, ""), (~first, " ")):
            coded = flat.filter(pa.array(mask)).dictionary_encode()
            each = self.segments([lead + s for s in coded.dictionary.to_pylist()])
            if len(each):
                counts[mask] = each[coded.indices.to_numpy()]
        out[~whole] = segment_sums(counts, offsets)
        return out


_COUNTERS: dict[str, PieceCounter] = {}


def _counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` per row of ``docs``.

    ``tokenizer``: path of a byte-level BPE tokenizer file, readable on every
    executor. A null text counts as empty (0 tokens); repeated rows and null
    ids stay as they are; other columns are ignored; an empty table gives an
    empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for part in slices(batches, "_text"):
            text = strings(part.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), pc.binary_length(text).cast(pa.int64()), pa.array(counter.texts(text))],
                names=["_id", "n_bytes", "n_tokens"])

    src = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    counted = map_arrow(src, count, f"_id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
