"""Packing tokenised documents into sequences of a fixed length.

Exact-complement hashing, then best fit:

1. Each document's ids (plus an end id) are cut into pieces of at most
   ``capacity``; only longer documents are cut.
2. The counts of pieces per length, a table of at most ``capacity`` rows
   however large the corpus, are solved on the driver. From the longest
   length down, the rest of a sequence is looked up in hash indexes of single
   lengths, pair sums and triple sums; a combination that fills the gap exactly
   is used as often as the counts allow. Lengths that find no complement
   are placed best fit, largest first.
3. The solution is a list of layouts with multiplicities. Pieces of a
   length are numbered without gaps and each looks its number up in the layouts,
   so the corpus is joined to a table of bounded size and never sorted whole.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinerank.llm.common import gapless, list_offsets, map_arrow, scratch, segment_sums, slices, strings

#: Fixed value: the pre-token pattern of the word vocabulary.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of these characters are split by Arrow: there both pattern engines, and both
#: ways to lower-case, agree (no white space, no dotted capital I, nothing beyond Latin).
PLAIN = r"^[!-~\x{a1}-\x{12f}\x{131}-\x{24f}]+$"
#: Pre-tokens a worker remembers before it starts anew.
CACHE_ENTRIES = 400_000
#: Bytes of text worked on at once: a token takes some fifty bytes of arrays.
SLICE = 2 << 20


class WordIds:
    """Ids of texts under a tokenizer that drops white space: words between
    ASCII white space never interact, so each distinct pre-token is encoded
    once and a text's ids are gathered from a pool."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.ends = ends
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())  # an entry each, like the sizes
        self.pool, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _learn(self, plain: list[str], other: list[str]) -> None:
        """Add ids of plain pre-tokens, encoded as one text whose word ends part
        them, and of words that only the tokenizer can split."""
        keys, pools, sizes = [], [self.pool], [self.size]
        blocks = [plain[lo:lo + 50] for lo in range(0, len(plain), 50)]
        for block, e in self._encoded(blocks, [" ".join(b) for b in blocks], self.tokenizer.encode_batch_fast):
            ids = np.array(e.ids, dtype=np.uint32)
            size = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(size) != len(block):  # not one word each after all
                other = [*other, *block]
                continue
            keys += block
            pools.append(ids), sizes.append(size)
        for p, e in self._encoded(other, other, self.tokenizer.encode_batch):
            keys.append(p)
            pools.append(np.array(e.ids, dtype=np.uint32)), sizes.append(np.array([len(e.ids)]))
        self.pool, self.size = np.concatenate(pools), np.concatenate(sizes)
        self.known = pa.concat_arrays([self.known, pa.array(keys, pa.large_string())])

    @staticmethod
    def _encoded(names: list, texts: list[str], encode) -> Iterator[tuple]:
        """``names`` with the encodings of ``texts``, which are far larger than their
        ids: a few hundred are held at once."""
        for lo in range(0, len(texts), 256):
            yield from zip(names[lo:lo + 256], encode(texts[lo:lo + 256], add_special_tokens=False), strict=True)

    def _entries(self, plain: pa.Array, other: pa.Array) -> np.ndarray:
        """Entries of plain pre-tokens and of other words, learned where they are new."""
        keys = pa.concat_arrays([plain, other])
        at, first = pc.index_in(keys, value_set=self.known), len(self.known)
        if at.null_count:
            new = pc.is_null(at)
            fresh = plain.filter(new.slice(0, len(plain))).to_pylist()
            own = set(fresh)
            self._learn(fresh, [w for w in other.filter(new.slice(len(plain))).to_pylist() if w not in own])
            late = pc.index_in(keys.filter(new), value_set=self.known.slice(first))
            at = pc.replace_with_mask(at, new, pc.add(late, pa.scalar(first, pa.int32())))
        return at.to_numpy().astype(np.int64)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number per word)."""
        if len(self.known) > CACHE_ENTRIES:
            self._forget()
        # Plain words are lower-cased and split here; anything else, and what
        # may hold a special token, goes to the tokenizer as it is.
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|"))
        lower, other = pc.utf8_lower(words.filter(plain)), words.filter(pc.invert(plain))
        mixed = pc.invert(pc.match_substring_regex(lower, r"^\p{L}+$"))
        spaced = pc.replace_substring_regex(lower.filter(mixed), f"({PRE_TOKEN})", r"\1 ")
        parts = pc.split_pattern(pc.replace_with_mask(lower, mixed, pc.utf8_rtrim(spaced, " ")), " ")
        coded = parts.flatten().dictionary_encode()
        entries = self._entries(coded.dictionary, other)
        # Entries of all words in order: those of plain words' parts, one of any other word.
        plain = plain.to_numpy(zero_copy_only=False)
        each = np.ones(len(words), dtype=np.int64)
        each[plain] = np.diff(list_offsets(parts))
        ends = np.concatenate([[0], np.cumsum(each)])
        flat = np.empty(int(ends[-1]), dtype=np.int64)
        flat[np.repeat(plain, each)] = entries[coded.indices.to_numpy()]
        flat[np.repeat(~plain, each)] = entries[len(coded.dictionary):]
        return _gather(self.pool, self.size, flat), segment_sums(self.size[flat], ends)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, offsets per text) of a string column without nulls."""
        parts = pc.ascii_split_whitespace(column)
        offsets, coded = list_offsets(parts), parts.flatten().dictionary_encode()
        pool, size = self.words(coded.dictionary)
        codes = coded.indices.to_numpy().astype(np.int64)
        return _gather(pool, size, codes), np.concatenate([[0], np.cumsum(size[codes])]).astype(np.int64)[offsets]


def _gather(pool: np.ndarray, size: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Concatenation of the entries ``codes`` of a pool with entries of ``size``."""
    start = np.cumsum(size) - size
    each = size[codes]
    total = int(each.sum())
    return pool[np.arange(total) + np.repeat(start[codes] - (np.cumsum(each) - each), each)]


_WORDS: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` per piece of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _WORDS:
            _WORDS[tokenizer] = WordIds(tokenizer)
        for part in slices(batches, "_text", SLICE):
            ids, offsets = _WORDS[tokenizer].texts(strings(part.column("_text")))
            row, piece, start, length, crc = [], [], [], [], []
            for r in range(part.num_rows):
                own = np.append(ids[offsets[r]:offsets[r + 1]], np.uint32(end_id)).astype("<u4")
                for k, lo in enumerate(range(0, len(own), capacity)):
                    cell = own[lo:lo + capacity]
                    row.append(r)
                    piece.append(k)
                    start.append(lo)
                    length.append(len(cell))
                    crc.append(zlib.crc32(cell.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [part.column("_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return map_arrow(src, cut, f"_id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("_id", id_col)


class _Lengths:
    """Counts per length with indexes of the lengths that are left: bit sets,
    one by length and one by complement, so that all pairs of one sum are one
    shift and one intersection."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = Counter({n: c for n, c in counts.items() if c > 0})
        self.single = sum(1 << n for n in self.left)
        self.mirror = sum(1 << (capacity - n) for n in self.left)
        self.layouts: list[tuple[list[tuple[int, int]], int]] = []

    def pairs(self, total: int) -> int:
        """Bit a is set where lengths a and total - a are both left."""
        return self.single & (self.mirror >> (self.capacity - total)) & ((1 << max(total, 0)) - 1) if total > 1 else 0

    def use(self, combination: list[int]) -> bool:
        """Consume a combination as often as the counts allow."""
        need = Counter(combination)
        times = min(self.left[n] // k for n, k in need.items())
        if times <= 0:
            return False
        for n, k in need.items():
            self.left[n] -= k * times
            if not self.left[n]:
                self.single ^= 1 << n
                self.mirror ^= 1 << (self.capacity - n)
        self.layouts.append((sorted(need.items(), reverse=True), times))
        return True

    def use_pairs(self, head: list[int], total: int) -> None:
        """Consume head + pair for every pair of that sum, larger pairs first."""
        found = self.pairs(total)
        while found and all(self.left[n] for n in head):
            a = found.bit_length() - 1
            if 2 * a < total:
                return
            found ^= 1 << a
            while self.use([*head, a, total - a]):
                pass


def solve(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Layouts ``([(length, copies), ...], multiplicity)`` that place every
    piece: the sum of copies x multiplicity is the count of each length."""
    lengths = _Lengths(counts, capacity)
    left = lengths.left
    for n in sorted(left, reverse=True):
        gap = capacity - n
        if not gap:
            lengths.use([n])
            continue
        while left[n] and left[gap] and lengths.use([n, gap]):  # single
            pass
        if left[n]:
            lengths.use_pairs([n], gap)
        rest = lengths.single & ((1 << gap) - 1)
        while left[n] and rest:  # triple: a length and a pair
            a = rest.bit_length() - 1
            if 3 * a < gap:
                break
            rest ^= 1 << a
            while left[a] and left[n]:
                before = left[n]
                lengths.use_pairs([n, a], gap - a)
                if left[n] == before:
                    break
    return lengths.layouts + _best_fit({n: c for n, c in left.items() if c}, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first, over groups of equal open sequences: a step
    places one length into all open sequences of the tightest fitting rest,
    so the work follows distinct lengths and not pieces."""
    rests: list[int] = []  # open rests, ascending
    groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

    def put(rest: int, layout: tuple, times: int) -> None:
        if rest not in groups:
            insort(rests, rest)
            groups[rest] = []
        groups[rest].append((layout, times))

    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            at = bisect_left(rests, n)
            if at == len(rests):
                fit = capacity // n
                full, some = divmod(count, fit)
                if full:
                    put(capacity - fit * n, ((n, fit),), full)
                if some:
                    put(capacity - some * n, ((n, some),), 1)
                break
            rest = rests[at]
            layout, times = groups[rest].pop()
            if not groups[rest]:
                del groups[rest], rests[at]
            fit = min(rest // n, count)
            used = min(times, count // fit)
            put(rest - fit * n, (*layout, (n, fit)), used)
            if times > used:
                put(rest, layout, times - used)
            count -= used * fit
    return [(list(layout), times) for own in groups.values() for layout, times in own]


def _placement(layouts: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows ``(length, from, to, sequence, copies, offset)``: the piece of that
    length numbered j, from <= j < to, lies in sequence + (j - from) // copies
    at offset + (j - from) % copies * length."""
    seen: Counter[int] = Counter()
    rows, sequence = [], 0
    for layout, times in layouts:
        offset = 0
        for n, copies in layout:
            rows.append((n, seen[n], seen[n] + copies * times, sequence, copies, offset))
            seen[n] += copies * times
            offset += n * copies
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``id_col, piece, start, length, ids_crc32, sequence_id, offset`` per piece.

    A null text counts as empty (the end id alone). Repeated rows are packed
    each; null ids stay; other columns are ignored; an empty table gives an
    empty result. Equal lengths are interchangeable and numbered by piece
    fingerprint and id. The driver holds the counts per length (at most
    ``capacity`` rows) and the layouts (bounded by them), nothing per piece.
    """
    job = scratch(docs)
    cut = job.cut(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = _placement(solve(counts, capacity))
    spark = docs.sparkSession
    # One row per length: its places as arrays, sorted by "from".
    by: dict[int, list] = {}
    for n, *rest in rows:
        by.setdefault(n, []).append(rest)
    places = spark.createDataFrame([(n, sorted(v)) for n, v in by.items()],
                                   "length long, places array<array<long>>")
    places = places.select("length", F.posexplode(F.transform("places", lambda p: F.struct(
        p[0].alias("lo"), p[1].alias("hi"), p[2].alias("seq"), p[3].alias("copies"), p[4].alias("off")))).alias("_p", "_at"))
    places = places.select("length", "_at.*")
    numbered = gapless(cut, ["length"], [F.col(id_col), F.col("piece"), F.col("ids_crc32")],
                       F.xxhash64(F.col(id_col), "piece", "ids_crc32", "start"), "_j", sum(counts.values()))
    # Length classes with many places are looked up by the place's number block.
    joined = numbered.join(F.broadcast(places), (numbered["length"] == places["length"]) & (F.col("_j") >= F.col("lo"))
                           & (F.col("_j") < F.col("hi"))).drop(places["length"])
    step = F.col("_j") - F.col("lo")
    return joined.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("seq") + F.floor(step / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("off") + F.pmod(step, F.col("copies")) * F.col("length")).cast("long").alias("offset"))
