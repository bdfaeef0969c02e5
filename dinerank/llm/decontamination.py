"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of folded words: all letters in lower
case, punctuation and symbols left out. Word shingles that a text shares with
an item are seeds. A text that leaks an item shares at least a known number of
its seeds, so each item is looked up by its rarest seeds only (all but one less
than that number), by an equi-join with the seeds of the texts. Each pair
found is compared with running Karp-Rabin greedy string tiling: the longest
common runs of unmarked words are found by their fingerprints and marked first,
then shorter ones, each word at most once. An item counts as leaked where the
tiles cover at least ``coverage`` of it, in whatever order they stand in the text.

Texts go by a 128-bit name of their content: copies are searched once, and only
texts that hold a seed of the benchmark, by a bit table of fixed size over all its
seeds, send anything to a shuffle. The benchmark never passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dinerank.llm.common import listed, map_arrow, mix64, slices, strings
from dinerank.llm.shingles import folded_hashes, sequence_hashes
from dinerank.session import Scratch

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class TilingParams:
    #: Least words of a tile, and of a seed.
    words: int = 5
    coverage: float = 0.8
    #: Length at which the search for long runs starts.
    first_length: int = 20


def _fingerprints(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin fingerprints of every run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _FACTOR + words[i:i + n]
    return mix64(out)


def _free_runs(marked: np.ndarray, size: int) -> np.ndarray:
    """Positions from which ``size`` words are unmarked."""
    before = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(before[size:] == before[:-size]) if len(marked) >= size else np.zeros(0, np.int64)


def tile(item: np.ndarray, text: np.ndarray, least: int, first: int = 20) -> list[tuple[int, int, int]]:
    """Tiles ``(item position, text position, length)`` of two sequences of word
    hashes: longest first, none shorter than ``least``, no word in two tiles."""
    done_i, done_t = np.zeros(len(item), bool), np.zeros(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(first, len(item)))
    while True:
        prints = _fingerprints(text, size)
        free = _free_runs(done_t, size)
        by: dict[int, list[int]] = {}
        own = _free_runs(done_i, size)
        item_prints = _fingerprints(item, size)
        wanted = item_prints[own]
        for t in free[np.isin(prints[free], wanted)].tolist():
            by.setdefault(int(prints[t]), []).append(t)
        found, longest = [], 0
        for i in own.tolist():
            for t in by.get(int(item_prints[i]), ()):
                top = min(len(item) - i, len(text) - t)
                stop = (item[i:i + top] != text[t:t + top]) | done_i[i:i + top] | done_t[t:t + top]
                k = int(stop.argmax()) if stop.any() else top
                longest = max(longest, k)
                if k >= size:
                    found.append((-k, i, t))
        if longest > 2 * size:
            size = longest
            continue
        again = False
        for k, i, t in sorted(found):
            if not done_i[i:i - k].any() and not done_t[t:t - k].any():
                done_i[i:i - k] = True
                done_t[t:t - k] = True
                tiles.append((i, t, -k))
            else:
                again = True  # partly taken: what is left of it may still be the longest run
                break
        if again:
            continue
        if size <= least:
            return tiles
        size = size // 2 if size > 2 * least else least


#: Bits of the table over all seeds of the benchmark. Where a benchmark is so large
#: that it fills up, more seeds of texts go to the join; none is lost.
SEED_BITS = 1 << 24

_NAME = "_k1 long, _k2 long"
#: Bytes of text worked on at once.
_SLICE = 2 << 20


def _name(text: Column) -> list[Column]:
    """A 128-bit name of a text's content."""
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(1), text).alias("_k2")]


def _seed_length(words: int, params: TilingParams) -> int:
    return min(params.words, words)


def _item_seeds(params: TilingParams):
    """``_i1, _i2, _seed, _size, _words`` of every place of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_t", _SLICE):
            words, at = folded_hashes(strings(part.column("_t")))
            seeds, row, size, count = [np.zeros(0, np.uint64)], [], [], []
            for r, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                if hi > lo:
                    k = _seed_length(hi - lo, params)
                    seeds.append(sequence_hashes(words[lo:hi], k)[: hi - lo - k + 1])
                    row += [r] * len(seeds[-1])
                    size += [k] * len(seeds[-1])
                    count += [hi - lo] * len(seeds[-1])
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("_k1").take(row), part.column("_k2").take(row), pa.array(np.concatenate(seeds).view(np.int64)),
                 pa.array(size, pa.int32()), pa.array(count, pa.int32())], names=["_i1", "_i2", "_seed", "_size", "_words"])

    return run


def _text_seeds(shared, sizes: list[int]):
    """``_k1, _k2, _seed`` of the distinct seeds of each text that the bit table has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for part in slices(batches, "_t", _SLICE):
            words, at = folded_hashes(strings(part.column("_t")))
            owner = np.repeat(np.arange(part.num_rows), np.diff(at))
            left = at[1:][owner] - np.arange(len(words))  # words from here to the text's end
            found, rows = [], []
            for size in sizes:
                every = sequence_hashes(words, size)
                bit = every & np.uint64(SEED_BITS - 1)
                hit = (left >= size) & ((table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
                pairs = np.unique(np.stack([owner[hit], every[hit].view(np.int64)]), axis=1) if hit.any() else np.zeros((2, 0), np.int64)
                rows.append(pairs[0])
                found.append(pairs[1])
            row = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [part.column("_k1").take(row), part.column("_k2").take(row), pa.array(np.concatenate(found))], names=["_k1", "_k2", "_seed"])

    return run


def _compare(params: TilingParams):
    """Pairs of which the item is leaked. Rows come sorted by text: the text itself
    (``_i1`` null), then its candidate items, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, seeds = np.zeros(0, np.uint64), {}
        for part in slices(batches, "_t", _SLICE):
            words, at = folded_hashes(strings(part.column("_t")))
            is_text = part.column("_i1").is_null().to_numpy(zero_copy_only=False)
            rows, coverage, count = [], [], []
            for r, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                if is_text[r]:
                    text, seeds = words[lo:hi].copy(), {}
                    continue
                item, n = words[lo:hi], hi - lo
                size = _seed_length(n, params)
                if size not in seeds:
                    seeds[size] = np.unique(sequence_hashes(text, size)[: max(0, len(text) - size + 1)])
                own = sequence_hashes(item, size)[: n - size + 1]
                shared = _among(own, seeds[size])
                reach = np.zeros(n + 1, np.int64)
                np.add.at(reach, np.flatnonzero(shared), 1)
                np.add.at(reach, np.flatnonzero(shared) + size, -1)
                if (np.cumsum(reach)[:n] > 0).sum() < params.coverage * n:
                    continue  # tiles lie within the seeds
                tiles = tile(item, text, size, params.first_length)
                covered = sum(k for _, _, k in tiles) / n
                if covered >= params.coverage:
                    rows.append(r), coverage.append(covered), count.append(len(tiles))
            row = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c).take(row) for c in ("_k1", "_k2", "_i1", "_i2")], pa.array(coverage, pa.float64()), pa.array(count, pa.int32())],
                names=["_k1", "_k2", "_i1", "_i2", "coverage", "tiles"])

    return run


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values the sorted array holds."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _rarest(seeds: DataFrame, hits: DataFrame, params: TilingParams) -> DataFrame:
    """``_i1, _i2, _seed`` by which items are looked up.

    A tile of L words holds L - size + 1 places of seeds, at least L / size, so a text
    that covers c words of an item shares c / size of its places or more. Leaving out
    fewer places than that loses no text; those with the commonest seeds are left out.
    """
    common = hits.groupBy("_seed").agg(F.count(F.lit(1)).alias("_f"))
    places = seeds.groupBy("_i1", "_i2", "_seed", "_size", "_words").agg(F.count(F.lit(1)).alias("_p")).join(common, "_seed")
    order = Window.partitionBy("_i1", "_i2").orderBy(F.desc("_f"), "_seed").rowsBetween(Window.unboundedPreceding, 0)
    need = F.ceil(F.lit(params.coverage) * F.col("_words") / F.col("_size") - 1e-9)
    return places.withColumn("_upto", F.sum("_p").over(order)).where(F.col("_upto") >= need).select("_i1", "_i2", "_seed")


def _bit_table(seeds: DataFrame) -> np.ndarray:
    """SEED_BITS bits, set for every seed: at most SEED_BITS / 64 rows reach the driver."""
    bit = F.col("_seed").bitwiseAND(F.lit(SEED_BITS - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
    rows = seeds.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    table = np.zeros(SEED_BITS >> 6, np.uint64)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def leaks(docs: DataFrame, benchmark: DataFrame, params: TilingParams = TilingParams(), text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text", out: str = "leaks") -> DataFrame:
    """``docs`` with the column ``out``: array of ``struct<item_id, coverage, tiles>``, one per leaked item, by item id.

    A null or empty text leaks nothing; an item that is null or without words
    (of letters or digits) is leaked nowhere; an item shorter than a seed must
    stand as a whole. Every row is judged by itself and kept; repeated items are
    listed each. All columns of ``docs`` come back as they are, whatever their
    names; if one is named ``out`` the new column takes its place. An empty
    benchmark gives empty arrays, an empty table stays empty. Long texts are
    searched as wholes.
    """
    spark = docs.sparkSession
    job = Scratch(spark)
    kind = benchmark.schema[item_col].dataType
    docs = docs.drop(out)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    text = F.col(f"c{docs.columns.index(text_col)}").cast("string")
    texts = plain.where(F.length(text) > 0).select(text.alias("_t"), *_name(text))
    items = job.cut(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("_t")).where("length(_t) > 0")
                    .select("*", *_name(F.col("_t"))))
    once = items.groupBy("_k1", "_k2").agg(F.first("_t").alias("_t"))
    seeds = job.cut(map_arrow(once, _item_seeds(params), "_i1 long, _i2 long, _seed long, _size int, _words int"))
    sizes = sorted(r["_size"] for r in seeds.select("_size").distinct().collect())  # at most params.words
    if not sizes:
        empty = F.array().cast(f"array<struct<item_id:{kind.simpleString()},coverage:double,tiles:int>>")
        return docs.withColumn(out, empty)

    shared = spark.sparkContext.broadcast(_bit_table(seeds))
    hits = job.cut(map_arrow(texts, _text_seeds(shared, sizes), f"{_NAME}, _seed long").join(
        seeds.select("_seed").distinct(), "_seed", "left_semi"))
    pairs = job.cut(hits.join(_rarest(seeds, hits, params), "_seed").select("_k1", "_k2", "_i1", "_i2").distinct())
    # Texts of the pairs, once each, and behind each text its items.
    own = listed(texts, pairs, ["_k1", "_k2"], "_listed").where("_listed").groupBy("_k1", "_k2").agg(F.first("_t").alias("_t"))
    own = own.join(pairs.select("_k1", "_k2").distinct(), ["_k1", "_k2"], "left_semi")
    none = F.lit(None).cast("long")
    both = own.select("_k1", "_k2", none.alias("_i1"), none.alias("_i2"), "_t").unionByName(
        pairs.join(once.toDF("_i1", "_i2", "_t"), ["_i1", "_i2"]).select("_k1", "_k2", "_i1", "_i2", "_t"))
    ordered = both.repartition("_k1", "_k2").sortWithinPartitions("_k1", "_k2", F.col("_i1").asc_nulls_first(), "_i2")
    leaked = map_arrow(ordered, _compare(params), f"{_NAME}, _i1 long, _i2 long, coverage double, tiles int")
    ids = items.select("item_id", F.col("_k1").alias("_i1"), F.col("_k2").alias("_i2"))
    found = job.cut(leaked.join(ids, ["_i1", "_i2"]).groupBy("_k1", "_k2").agg(
        F.sort_array(F.collect_list(F.struct("item_id", "coverage", "tiles"))).alias("_leaks")))
    # Only rows that may leak something meet the finds.
    marked = listed(plain.select("*", *_name(text)), found, ["_k1", "_k2"], "_listed")
    kept = [f"c{k}" for k in range(len(docs.columns))]
    nothing = F.array().cast(found.schema["_leaks"].dataType)
    clean = marked.where(~F.col("_listed")).select(*kept, nothing.alias("_leaks"))
    rest = marked.where("_listed").join(found, ["_k1", "_k2"], "left").select(*kept, F.coalesce("_leaks", nothing).alias("_leaks"))
    return clean.unionByName(rest).toDF(*docs.columns, out)
