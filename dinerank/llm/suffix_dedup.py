"""Removal of byte strings that occur more than once, by anchors and fingerprints.

This takes the place of prefix doubling: no round sorts position-rank pairs,
no offset grows and nothing is ranked again. Names are 64-bit (and at last
96-bit) fingerprints, equal strings have equal names; Spark counts names, and
only positions with a repeated one go on.

1. Every window of ``length`` bytes has an anchor: of the ``BASE``-byte strings
   inside it, the one with the least name. Equal windows have the same anchor at the same
   offset, so only anchors (one position in seventy) are named and counted
   first. Anchors whose name is unique, and with them their windows, are done.
2. The name is extended to the anchor's context, the bytes of all its windows.
   A repeated context settles all its windows at once.
3. For contexts that occur once under a repeated anchor (the borders of
   repeated passages), each window start p is named once, by the pair of
   fingerprints of its two halves (at p and at p + length // 2), and counted. One
   occurrence stands for all those of a repeated context. Equal windows have
   the same anchor name, so contexts are dealt by it and windows are named
   and counted where they arrive; only an anchor with more than ``HOT``
   contexts has its windows dealt one by one, by their own names.

Counts are combined before they are shuffled and joined back, so a string
that a third of all documents hold is never gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinerank.llm.common import listed, map_arrow, mix64, slices
from dinerank.session import Scratch

#: Bytes of the names that anchors are chosen and first counted by.
BASE = 64
#: Window starts worked on at once in a task; a longer text is read in overlapping parts.
STEP = 1 << 20
#: Contexts of one anchor name up to which a task holds them together.
HOT = 1000
#: Bytes of contexts named at once in a task (whole anchors; at most HOT contexts more).
GROUPED = 1 << 20
_BYTE = np.random.default_rng(77001).integers(1, 1 << 63, size=256, dtype=np.uint64)
_FACTOR = 0x9E3779B97F4A7C15
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2**bits powers of the factor and of its inverse modulo 2**64."""

    def powers(factor: int) -> np.ndarray:
        out = np.full(1 << bits, factor, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return powers(_FACTOR), powers(pow(_FACTOR, -1, 1 << 64))


class Names:
    """Fingerprints of the substrings of a byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(max(21, int(len(data)).bit_length()))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of the texts concatenated in ``data`` (text i ends
    at ``ends[i]``): arrays ``text, anchor, low, high, name, context``; the
    windows of an anchor start at low..high."""
    n, width = len(data), length - BASE + 1
    names = Names(data)
    owner_end = np.repeat(ends, np.diff(ends, prepend=0))
    at = np.arange(n)
    key = np.full(n, _NONE)
    if n >= BASE:
        inner = n - BASE + 1
        key[:inner] = mix64((names.sums[BASE:] - names.sums[:inner]) * names.down[:inner])
    name = key.copy()
    # The low bits hold the position: the leftmost of equal names is least.
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (key >> bits << bits) | at.astype(np.uint64)
    key[at + BASE > owner_end] = _NONE
    blocks = -(-n // width)
    padded = np.full(blocks * width, _NONE)
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    start = np.flatnonzero(at + length <= owner_end)
    least = np.minimum(behind[start], ahead[start + width - 1]) & ((np.uint64(1) << bits) - np.uint64(1))
    least = least.astype(np.int64)
    new = np.flatnonzero((np.diff(least, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    low, anchor = start[new], least[new]
    high = start[np.append(new[1:], len(start)) - 1] if len(new) else low
    shape = ((anchor - low).astype(np.uint64) << np.uint64(32)) + (high - low).astype(np.uint64)
    context = mix64(names.of(low, high + length) + mix64(shape))
    return np.searchsorted(ends, anchor, side="right"), anchor, low, high, name[anchor], context


def _parts(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of ``(row, offset, bytes)`` of about STEP bytes: together they hold
    every window of every text exactly once."""
    out, size = [], 0
    for row, text in enumerate(texts):
        for lo in range(0, len(text) - length + 1, STEP):
            part = text[lo:lo + STEP + length - 1]
            if out and size + len(part) > STEP + length:
                yield out
                out, size = [], 0
            out.append((row, lo, part))
            size += len(part)
    if out:
        yield out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, v, text``: rows of one id with different texts differ in v."""
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("id"), (F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")) - F.lit(1 << 31)).cast("int").alias("v"),
                       text.alias("text"))


def _bytes(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()


def named_anchors(keyed: DataFrame, length: int) -> DataFrame:
    """``k, context, id, v, a, back, span``: anchor name, context name, position
    a, first window at a - back, last at a - back + span."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for group in _parts(_bytes(part.column("text")), length):
                data = np.frombuffer(b"".join(x for _, _, x in group), dtype=np.uint8)
                ends = np.cumsum([len(x) for _, _, x in group])
                i, a, low, high, name, context = anchors(data, ends, length)
                row = np.array([r for r, _, _ in group])[i]
                shift = (np.array([lo for _, lo, _ in group]) - np.concatenate([[0], ends[:-1]]))[i]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(context.view(np.int64)), part.column("id").take(take),
                     part.column("v").take(take), pa.array((a + shift).astype(np.int32)), pa.array((a - low).astype(np.int32)),
                     pa.array((high - low).astype(np.int32))],
                    names=["k", "context", "id", "v", "a", "back", "span"])

    return map_arrow(keyed, emit, "k long, context long, id long, v int, a int, back int, span int")


def context_bytes(both: DataFrame, length: int) -> DataFrame:
    """``k, id, v, lo, open, hot, data``: the bytes of each listed context."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            row, keep, data = [], [], []
            for r, (text, own) in enumerate(zip(_bytes(part.column("text")), part.column("ranges").to_pylist(), strict=True)):
                for x in own:
                    row.append(r), keep.append(x), data.append(text[x["lo"]:x["lo"] + x["span"] + length])
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([x["k"] for x in keep], pa.int64()), part.column("id").take(take), part.column("v").take(take),
                 pa.array([x["lo"] for x in keep], pa.int32()), pa.array([x["open"] for x in keep], pa.bool_()),
                 pa.array([x["hot"] for x in keep], pa.bool_()), pa.array(data, pa.binary())],
                names=["k", "id", "v", "lo", "open", "hot", "data"])

    return map_arrow(both, emit, "k long, id long, v int, lo int, open boolean, hot boolean, data binary")


def _named(contexts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of all windows of the contexts: context, start in it, and two names, each
    that of the pair of half names at the start and at half the length."""
    half = length // 2
    size = np.array([len(x) for x in contexts], dtype=np.int64)
    names = Names(np.frombuffer(b"".join(contexts), dtype=np.uint8))
    count = np.maximum(size - length + 1, 0)
    owner = np.repeat(np.arange(len(size)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    p = np.repeat(np.cumsum(size) - size, count) + start
    first, second = names.of(p, p + half), names.of(p + half, p + length)
    return owner, start, mix64(first ^ mix64(second)), mix64(second + mix64(first + np.uint64(9)))


def _repeated_runs(part: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Spans of the open contexts' windows that occur more than once in ``part``."""
    owner, start, w, x = _named(part.column("data").to_pylist(), length)
    order = np.lexsort((x, w))
    same = (np.diff(w[order]) == 0) & (np.diff(x[order]) == 0) if len(order) else np.zeros(0, bool)
    twice = np.zeros(len(order), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    twice &= part.column("open").to_numpy(zero_copy_only=False)[owner]
    owner, start = owner[twice], start[twice]
    new = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    last = np.append(new[1:], len(owner)) - 1 if len(new) else new
    take = pa.array(owner[new])
    lo = part.column("lo").to_numpy()[owner[new]]
    return pa.RecordBatch.from_arrays(
        [part.column("id").take(take), part.column("v").take(take), pa.array((lo + start[new]).astype(np.int32)),
         pa.array((lo + start[last] + length).astype(np.int32))], names=["id", "v", "lo", "hi"])


def grouped_windows(pieces: DataFrame, length: int) -> DataFrame:
    """``id, v, lo, hi``: repeated windows of contexts that arrive sorted by ``k``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in slices(iter([batch]), "data", GROUPED // 4):
                held.append(part)
                size += part.column("data").nbytes
                if size >= GROUPED:
                    table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    k = table.column("k").to_numpy()
                    cut = int(np.searchsorted(k, k[-1], side="left"))  # the last anchor may go on
                    if cut:
                        yield _repeated_runs(table.slice(0, cut), length)
                    held, size = [table.slice(cut)], table.slice(cut).column("data").nbytes
        if held:
            yield _repeated_runs(pa.Table.from_batches(held).combine_chunks().to_batches()[0], length)

    return map_arrow(pieces.select("k", "id", "v", "lo", "open", "data"), emit, "id long, v int, lo int, hi int")


def named_windows(pieces: DataFrame, length: int) -> DataFrame:
    """``w, x, id, v, p, open`` per window start of the contexts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "data", GROUPED // 8):
            owner, start, w, x = _named(part.column("data").to_pylist(), length)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.view(np.int64)), pa.array((x >> np.uint64(32)).astype(np.uint32).view(np.int32)), part.column("id").take(take),
                 part.column("v").take(take), pa.array((part.column("lo").to_numpy()[owner] + start).astype(np.int32)),
                 part.column("open").take(take)], names=["w", "x", "id", "v", "p", "open"])

    return map_arrow(pieces.select("id", "v", "lo", "open", "data"), emit, "w long, x int, id long, v int, p int, open boolean")


def _same(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["v"] == b["v"])


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, v, spans``: per text with repeated strings, unmerged byte spans."""
    if length <= BASE:
        raise ValueError(f"length must be above {BASE}")
    job = Scratch(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    # Round 1: names of BASE bytes at the anchors. The anchors are computed
    # twice, for the counts and for the join, instead of being kept on disk.
    found = named_anchors(keyed, length)
    often = found.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    kept = job.cut(found.join(often, "k"))
    # Round 2: contexts.
    contexts = job.cut(kept.groupBy("k", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "v", "a", "back", "span")).alias("one")))
    low = F.col("a") - F.col("back")
    settled = kept.join(contexts.where("n > 1").select("k", "context"), ["k", "context"]).select(
        "id", "v", low.alias("lo"), (low + F.col("span") + length).alias("hi"))
    # Round 3: windows, where an anchor has several contexts.
    several = contexts.groupBy("k").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    open_ = job.cut(contexts.join(several, "k").select(
        "k", "one.id", "one.v", (F.col("one.a") - F.col("one.back")).alias("lo"), F.col("one.span").alias("span"),
        (F.col("n") == 1).alias("open"), (F.col("c") > HOT).alias("hot")))
    ranges = open_.groupBy("id", "v").agg(F.collect_list(F.struct("k", "lo", "span", "open", "hot")).alias("ranges"))
    texts = listed(keyed, open_, ["id", "v"], "_listed").where("_listed").drop("_listed")
    both = texts.join(ranges, _same(texts, ranges)).select(texts["id"], texts["v"], "text", "ranges").dropDuplicates(["id", "v"])
    pieces = job.cut(context_bytes(both, length))
    near = grouped_windows(pieces.where("not hot").repartition("k").sortWithinPartitions("k"), length)
    windows = job.cut(named_windows(pieces.where("hot"), length))
    twice = windows.groupBy("w", "x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "x")
    again = windows.where("open").join(twice, ["w", "x"]).select("id", "v", F.col("p").alias("lo"), (F.col("p") + length).alias("hi"))
    # Starts within one block of BASE bytes overlap, so a block is one span.
    runs = again.groupBy("id", "v", F.floor(F.col("lo") / BASE).alias("b")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("id", "v", "lo", "hi").unionByName(near)
    return job.cut(settled.unionByName(runs).groupBy("id", "v").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal runs of the union of half-open spans (touching spans are one run)."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = False) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the
    remaining bytes, ``with_text``) per row of ``docs``.

    A text is its UTF-8 bytes, null as empty. A byte goes if some string of
    ``length`` bytes over it also starts elsewhere, in any text. Texts shorter
    than ``length`` keep all. Repeated rows count as occurrences of each other;
    null ids stay; other columns are ignored; an empty table gives an empty
    result.
    """
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_spans(docs, length, id_col, text_col)
    marked = listed(keyed, spans, ["id", "v"], "_listed")
    touched = marked.where("_listed").drop("_listed")
    shape = "array<struct<lo:int,hi:int>>"
    rows = touched.join(spans, _same(touched, spans), "left").select(touched["id"], "text", "spans").unionByName(
        marked.where(~F.col("_listed")).select("id", "text", F.lit(None).cast(shape).alias("spans")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, gone, runs, sha, kept = [], [], [], [], []
            for text, own in zip(_bytes(part.column("text")), part.column("spans").to_pylist(), strict=True):
                joined = merged([(s["lo"], s["hi"]) for s in own or []])
                edges = [0, *(e for s in joined for e in s), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                n.append(len(text)), gone.append(len(text) - len(rest)), runs.append(len(joined))
                sha.append(hashlib.sha256(rest).hexdigest()), kept.append(rest)
            arrays = [part.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.binary())] * with_text,
                                             names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    ddl = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return map_arrow(rows, cut, ddl).withColumnRenamed("id", id_col)
