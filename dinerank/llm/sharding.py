"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts form a group that stays in one shard. Groups
sorted by size, largest first, enter the shard with the tightest remaining
capacity that takes them; the open shards hang in a balanced tree ordered by
remaining capacity. The capacity is the smallest (to within ``TOLERANCE``)
at which the groups fit into the asked number of shards, which makes the
shards' bytes near equal.

At scale the sequential part must not see every group. Groups above one
``BUNDLES``-th of all bytes (at most ``BUNDLES`` of them, whatever the
corpus) are packed one by one; all others are summed into ``BUNDLES``
bundles by a hash of the group, and a bundle is packed as one item of its
exact size. The driver so holds at most twice ``BUNDLES`` sizes. Only
DataFrame operations run on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinerank.llm.common import gapless, scratch

BUNDLES = 8192
#: Relative step at which the search for the smallest capacity ends.
TOLERANCE = 1e-4


class RestTree:
    """A height-balanced (AVL) tree of (remaining capacity, shard) pairs."""

    __slots__ = ("root",)

    def __init__(self):
        self.root = None

    @staticmethod
    def _height(node) -> int:
        return node[3] if node else 0

    def _node(self, key, low, high):
        return (key, low, high, 1 + max(self._height(low), self._height(high)))

    def _balanced(self, key, low, high):
        h = self._height
        if h(low) > h(high) + 1:
            if h(low[1]) < h(low[2]):
                mid = low[2]
                return self._node(mid[0], self._node(low[0], low[1], mid[1]), self._node(key, mid[2], high))
            return self._node(low[0], low[1], self._node(key, low[2], high))
        if h(high) > h(low) + 1:
            if h(high[2]) < h(high[1]):
                mid = high[1]
                return self._node(mid[0], self._node(key, low, mid[1]), self._node(high[0], mid[2], high[2]))
            return self._node(high[0], self._node(key, low, high[1]), high[2])
        return self._node(key, low, high)

    def add(self, key) -> None:
        def put(node):
            if node is None:
                return self._node(key, None, None)
            if key < node[0]:
                return self._balanced(node[0], put(node[1]), node[2])
            return self._balanced(node[0], node[1], put(node[2]))

        self.root = put(self.root)

    def remove(self, key) -> None:
        def least(node):
            while node[1]:
                node = node[1]
            return node[0]

        def cut(node, key):
            if key < node[0]:
                return self._balanced(node[0], cut(node[1], key), node[2])
            if key > node[0]:
                return self._balanced(node[0], node[1], cut(node[2], key))
            if node[1] is None:
                return node[2]
            if node[2] is None:
                return node[1]
            follows = least(node[2])
            return self._balanced(follows, node[1], cut(node[2], follows))

        self.root = cut(self.root, key)

    def tightest(self, size: int):
        """The least key whose remaining capacity is at least ``size``."""
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                node, best = node[1], node[0]
            else:
                node = node[2]
        return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size (0, 1, ...), opening a bin only where none fits."""
    tree, bins, out = RestTree(), 0, [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.tightest(sizes[i])
        if found is None:
            found = (capacity, bins)
            bins += 1
        else:
            tree.remove(found)
        out[i] = found[1]
        tree.add((found[0] - sizes[i], found[1]))
    return out


def fewest_bytes(sizes: list[int], shards: int) -> list[int]:
    """Best-fit-decreasing at the smallest capacity that needs at most ``shards`` bins."""
    total = sum(sizes)
    low = max([1, -(-total // shards), *sizes])
    high = low
    while max(found := best_fit_decreasing(sizes, high), default=0) >= shards:
        low, high = high, high + max(1, high // 64)
    while high - low > max(1, int(high * TOLERANCE)):
        mid = (low + high) // 2
        tried = best_fit_decreasing(sizes, mid)
        if max(tried, default=0) < shards:
            high, found = mid, tried
        else:
            low = mid
    return found


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard`` per row.

    ``size``: UTF-8 bytes of the text plus 1. Law ``bytes``: shard sizes are as
    equal as indivisible groups allow (one group of more than a shard's part
    makes the capacity). A null text is an empty text; all those are one group.
    Repeated rows are kept, each with its slot; null ids stay; other columns
    are ignored; an empty table gives an empty result. ``slot`` numbers a
    shard's rows from 0 by a hash of the id.
    """
    spark, job = docs.sparkSession, scratch(docs)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = job.cut(docs.select(
        docs[id_col].alias("_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_group")))
    # Copies are summed on the map side, so a hot group is a few rows here.
    groups = job.cut(rows.groupBy("_group").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    large = F.col("bytes") * BUNDLES > F.lit(int(total))
    bundle = F.pmod(F.xxhash64("_group"), F.lit(BUNDLES)).cast("int")
    single = groups.where(large).select("_group", "bytes").orderBy(F.col("bytes").desc(), "_group").collect()
    small = groups.where(~large).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes")).orderBy("bundle").collect()
    place = fewest_bytes([int(r["bytes"]) for r in (*single, *small)], shards)
    by_group = spark.createDataFrame([(r["_group"], s) for r, s in zip(single, place, strict=False)], "_group binary, _single int")
    by_bundle = spark.createDataFrame([(r["bundle"], s) for r, s in zip(small, place[len(single):], strict=True)],
                                      "_bundle int, _bundled int")
    # Both tables hold at most BUNDLES rows of a few bytes.
    placed = job.cut(rows.join(F.broadcast(by_group), "_group", "left")
                     .join(F.broadcast(by_bundle), bundle == F.col("_bundle"), "left")
                     .select("_id", "size", "text_crc32", F.coalesce("_single", "_bundled").alias("shard")))
    slotted = gapless(placed, ["shard"], [F.col("_id"), F.col("text_crc32")], F.xxhash64("_id", "text_crc32"), "slot",
                      int(n), rows_per_task=10_000)
    return slotted.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))
