"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

1. One permutation scatters a document's shingles over ``SPACE`` bins; a
   second permutation, circularly shifted by 0, 1, 2, ..., gives every signature
   coordinate (the minimum over the bins). The shifts of a bin are neighbours
   in the second table, so a task reads one row of it per shingle.
2. Documents with equal shingle sets form a class; only its least id goes on.
3. ``bands`` x ``rows`` coordinates are banded. With 40 x 6 a pair of
   similarity 0.85 shares no band with probability 6e-9.
4. Inside a bucket every class is compared with the bucket's least member (a
   star, not all pairs) on the full shingle sets. Buckets whose members are
   not yet connected get new stars among the rest, and what then remains
   unconnected in a bucket is compared across its components, so no link
   between different components is lost: pair by pair in small buckets; in
   large ones block against block, where a task holds two blocks of
   sets, intersects them as one matrix product and gives out links only.
5. Components come from alternating stars over the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinerank.llm.common import listed, map_arrow, mix64, slices, strings
from dinerank.llm.components import components
from dinerank.llm.shingles import shingle_sets
from dinerank.session import Scratch

SPACE = 1 << 20
#: Members up to which a bucket's open pairs are listed; and members per block beyond.
LISTED, BLOCK = 32, 256
#: Shingles per step of the signature minimum (times coordinates: memory).
STEP = 1 << 15
#: Bytes of text whose sets a task holds at once.
SLICE = 2 << 20

@dataclass(frozen=True)
class NearParams:
    words: int = 5
    #: Linked where percent * union <= 100 * intersection.
    percent: int = 85
    bands: int = 40
    rows: int = 6
    #: Rounds of stars before the remaining components are compared.
    star_rounds: int = 2
    seed: int = 11


@cache
def _tables(coordinates: int, seed: int) -> np.ndarray:
    """Row x: the second permutation at x, x + 1, ... (circular)."""
    values = np.random.default_rng(seed).permutation(SPACE).astype(np.uint32)
    ring = np.concatenate([values, values[:coordinates]])
    return np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def signatures(sets: list[np.ndarray], coordinates: int, seed: int) -> np.ndarray:
    """One row of ``coordinates`` minima per shingle set (all ones if empty)."""
    table = _tables(coordinates, seed)
    out = np.full((len(sets), coordinates), np.uint32(0xFFFFFFFF))
    size = np.array([len(s) for s in sets])
    if not size.sum():
        return out
    owner = np.repeat(np.arange(len(sets)), size)
    # The first permutation: a bijective mix of the hash, cut to the bins.
    bins = (mix64(np.concatenate(sets) + np.uint64(seed)) >> np.uint64(44)).astype(np.int64)
    for lo in range(0, len(bins), STEP):
        own = owner[lo:lo + STEP]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        least = np.minimum.reduceat(table[bins[lo:lo + STEP]], first, axis=0)
        out[own[first]] = np.minimum(out[own[first]], least)
    return out


def sketches(docs: DataFrame, params: NearParams, id_col: str, text_col: str) -> DataFrame:
    """``id, n, p1, p2, bands`` per row: set size, two set fingerprints, band keys."""
    rows, bands = params.rows, params.bands

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for part in slices(batches, "_text", SLICE):
            sets = shingle_sets(strings(part.column("_text")), params.words)
            sig = signatures(sets, rows * bands, params.seed).astype(np.uint64).reshape(len(sets), bands, rows)
            key = np.broadcast_to(salt, (len(sets), bands)).copy()
            for k in range(rows):
                key = mix64(key + sig[:, :, k])
            total = lambda c: np.array([mix64(s ^ np.uint64(c)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(total(3)), pa.array(total(5)),
                 pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands, key.reshape(-1).view(np.int64))],
                names=["id", "n", "p1", "p2", "bands"])

    src = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"))
    return map_arrow(src, sketch, "id long, n long, p1 long, p2 long, bands array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, params: NearParams) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose full shingle sets reach the similarity.

    ``b`` may be a hub of many pairs: its text is copied to as many salts as
    it has 64s of pairs, and each pair takes one. An id with several texts
    gives a row for each of them; any of them may reach the similarity.
    """
    per_hub = pairs.groupBy("b").agg((F.floor((F.count(F.lit(1)) - 1) / 64) + 1).cast("int").alias("salts"))
    wanted = pairs.select(F.col("a").alias("id")).unionByName(per_hub.select(F.col("b").alias("id")))
    own = listed(texts, wanted, ["id"], "_listed").where("_listed").drop("_listed")
    hubs = own.join(per_hub, own["id"] == per_hub["b"]).select(
        "b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("text").alias("b_text"))
    salted = pairs.join(per_hub, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    left = own.join(salted, own["id"] == salted["a"]).select("a", "b", "salt", F.col("text").alias("a_text"))
    both = left.join(hubs, ["b", "salt"]).select("a", "b", "a_text", "b_text")
    words, percent = params.words, params.percent

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "a_text", SLICE):
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            sets, keep = shingle_sets(strings(part.column("a_text")), words), []
            other = strings(part.column("b_text")).dictionary_encode()
            hub, hub_sets, text_of = None, {}, other.indices.to_pylist()
            for i, key in enumerate(b):
                if key != hub:
                    hub, hub_sets = key, {}
                if (code := text_of[i]) not in hub_sets:
                    hub_sets[code] = shingle_sets(other.dictionary.slice(code, 1), words)[0]
                hub_set = hub_sets[code]
                common = len(np.intersect1d(sets[i], hub_set, assume_unique=True))
                union = len(sets[i]) + len(hub_set) - common
                keep.append(bool(union) and 100 * common >= percent * union)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(pa.array(keep)), pa.array(b, pa.int64()).filter(pa.array(keep))],
                                             names=["a", "b"])

    return map_arrow(both, test, "a long, b long")


def _fits(x: str, y: str, percent: int):
    """Set sizes that allow the similarity."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def near_duplicates(docs: DataFrame, params: NearParams = NearParams(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` per row of ``docs``.

    ``component_id`` is the least id reachable over links, ``kept`` whether it
    is the row's own id. A null or empty text, or one without words, has an
    empty set and links with nothing. Rows with equal ids are one node: the
    links of any of them hold for all. A row with a null id links with nothing
    and is kept, its component is null. Other columns are ignored. An empty
    table gives an empty result.
    """
    job = Scratch(docs.sparkSession)
    rows = job.cut(sketches(docs, params, id_col, text_col))
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    real = rows.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = job.cut(real.groupBy("p1", "p2", "n").agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands")))
    banded = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("key")
    buckets = job.cut(banded.join(shared, "key"))
    # A class and its members' ids: same node where one id has several texts.
    links = job.cut(real.join(classes.select("p1", "p2", "n", "rep"), ["p1", "p2", "n"])
                    .where(F.col("id") != F.col("rep")).join(
                        real.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id"), "id")
                    .select(F.col("id").alias("a"), F.col("rep").alias("b")))
    seen = None
    found = components(links, job)
    for step in range(params.star_rounds + 1):
        placed = buckets.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
            "key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
        if step < params.star_rounds:
            pairs = _star_pairs(placed, step, params.percent)
        else:
            placed = job.cut(_open(placed))
            links = links.unionByName(job.cut(_block_links(placed.where(F.col("m") > LISTED), texts, params)))
            pairs = _cross_pairs(placed.where(F.col("m") <= LISTED), params.percent)
        pairs = pairs.distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = job.cut(pairs)
        if pairs.isEmpty() and step < params.star_rounds:
            continue
        new = job.cut(confirm(pairs, texts, params))
        seen = pairs if seen is None else seen.unionByName(pairs)
        links = links.unionByName(new)
        found = components(links, job)
    component = found.select(F.col("node").alias("rep"), "component")
    reps = classes.join(component, "rep", "left").select(
        "p1", "p2", F.col("n"), F.coalesce("component", "rep").alias("_component"))
    out = rows.join(reps, ["p1", "p2", "n"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("id"))).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _star_pairs(placed: DataFrame, step: int, percent: int) -> DataFrame:
    """Per bucket, every member outside the hub's component with the hub. The
    hub is the least member, in later rounds the least member (by a hash of
    the round) of another component than before."""
    order = F.col("rep") if step == 0 else F.xxhash64("rep", F.lit(step))
    hubs = placed.groupBy("key").agg(F.min(F.struct(order.alias("o"), "rep", "n", "comp")).alias("h"),
                                     F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    hubs = hubs.where(F.col("lo") != F.col("hi")).select(
        "key", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.comp").alias("hub_comp"))
    return placed.join(hubs, "key").where(
        (F.col("comp") != F.col("hub_comp")) & _fits("n", "hub_n", percent)).select(
        F.col("rep").alias("a"), F.col("hub").alias("b"))


def _open(placed: DataFrame) -> DataFrame:
    """The members of buckets that still have several components, and the size ``m``."""
    several = placed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(
        F.col("lo") != F.col("hi")).select("key", "m")
    return placed.join(several, "key")


def _cross_pairs(left: DataFrame, percent: int) -> DataFrame:
    """Members of different components in a bucket (of at most LISTED)."""
    right = left.select("key", F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("comp").alias("bc"))
    return left.join(right, "key").where(
        (F.col("rep") > F.col("b")) & (F.col("comp") != F.col("bc")) & _fits("n", "bn", percent)).select(
        F.col("rep").alias("a"), "b")


def _block_links(members: DataFrame, texts: DataFrame, params: NearParams) -> DataFrame:
    """``a, b``: links between different components of large buckets. Members are
    dealt into blocks; a group is two blocks of one bucket with their sets."""
    reps = members.select(F.col("rep").alias("id")).distinct()
    own = listed(texts, reps, ["id"], "_listed").where("_listed").drop("_listed")
    words, percent = params.words, params.percent

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            found = shingle_sets(strings(part.column("text")), words)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) for x in found], pa.int64()),
                                              pa.ListArray.from_arrays(offsets, flat)], names=["sid", "sn", "set"])

    full = map_arrow(own, sets, "sid long, sn long, set array<long>")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "key", "rep", "n", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    # Rows of one id with several texts: the set of the class's size.
    held = dealt.join(full, (F.col("rep") == F.col("sid")) & (F.col("n") == F.col("sn")))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        comp, rep = group.column("comp").to_numpy(), group.column("rep").to_numpy()
        side = group.column("block").to_numpy() == group.column("i").to_numpy()[:1]
        same = bool(side.all()) and group.column("i")[0] == group.column("j")[0]
        rows_a, rows_b = np.flatnonzero(side), (np.flatnonzero(side) if same else np.flatnonzero(~side))
        flat = group.column("set").combine_chunks()
        offsets = flat.offsets.to_numpy()
        size = np.diff(offsets)
        values, code = np.unique(flat.values.to_numpy()[offsets[0]:offsets[-1]], return_inverse=True)
        owner = np.repeat(np.arange(len(size)), size)
        common = np.zeros((len(rows_a), len(rows_b)))
        place = np.full((2, len(size)), -1)
        place[0, rows_a], place[1, rows_b] = np.arange(len(rows_a)), np.arange(len(rows_b))
        for lo in range(0, len(values), 4096):  # shingles of both blocks, some thousands at a time
            inside = (code >= lo) & (code < lo + 4096)
            hot = []
            for k, rows in enumerate((rows_a, rows_b)):
                m = np.zeros((len(rows), 4096), np.float32)
                at = place[k][owner[inside]]
                m[at[at >= 0], code[inside][at >= 0] - lo] = 1
                hot.append(m)
            common += hot[0] @ hot[1].T
        union = size[rows_a][:, None] + size[rows_b][None, :] - common
        link = (100 * common >= percent * union) & (comp[rows_a][:, None] != comp[rows_b][None, :])
        x, y = np.nonzero(link)
        a, b = rep[rows_a[x]], rep[rows_b[y]]
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return held.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()
