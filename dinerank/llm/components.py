"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinerank.session import Scratch


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Point the neighbours of every node at the node's least neighbour:
    larger neighbours (``both``: edges are read in both directions) or, with
    the node itself, smaller ones. Minimum first and join back, so a hub's
    neighbours are never gathered."""
    e = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        e = e.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = e.join(least, "u")
    if both:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.where(F.col("u") != F.col("m")).select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, job: Scratch) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``; the component is its
    least node. Each round is written to the job's folder; ends when a round
    changes nothing."""
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = job.cut(edges.where(F.col("a") != F.col("b")).select(high.alias("a"), low.alias("b")).distinct())
    # On rows (high, low) a small star around high points it and its smaller
    # neighbours at the least of them.
    mark = _mark(now)
    while mark[0]:
        now = job.cut(_stars(_stars(now, both=True), both=False))
        after = _mark(now)
        if after == mark:
            break
        mark = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of an edge table."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")),
                           F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())
