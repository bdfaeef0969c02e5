"""Exact top-k inner products by ball trees with branch and bound.

Vectors are dealt into shards by a hash of their id. Each shard builds a ball
tree (split on the direction of its widest pair, every node with centre and radius).
For a query q no vector of a node can score above q.centre + |q| radius, so
nodes are visited in the order of that bound and left out once it cannot
reach the query's current k-th score. Shards share that score: in a first pass
every query searches one shard, and its k-th score there is the starting
threshold in all of them in the second pass.

Queries meet shards in blocks of bounded size, one block and one shard per
task; nothing grows with the data except the number of tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinerank.session import Scratch, ship_package


@dataclass(frozen=True)
class SearchParams:
    k: int = 20
    shard_rows: int = 20_000
    block_rows: int = 4_000
    leaf: int = 64
    #: Query-node pairs bounded at once.
    pairs: int = 1 << 17


class BallTree:
    """Ball tree over integer vectors, stored as arrays; children of node i
    are ``child[i]`` and ``child[i] + 1`` (0: a leaf over ``order[lo:hi]``)."""

    def __init__(self, vectors: np.ndarray, leaf: int):
        self.order = np.arange(len(vectors))
        centre, radius, child, lo_hi = [], [], [], []
        todo = [(0, len(vectors), 0)]
        centre.append(None), radius.append(0.0), child.append(0), lo_hi.append((0, len(vectors)))
        while todo:
            lo, hi, node = todo.pop()
            rows = self.order[lo:hi]
            own = vectors[rows].astype(np.float64)
            centre[node] = own.mean(axis=0) if hi > lo else np.zeros(vectors.shape[1])
            gap = np.sqrt(((own - centre[node]) ** 2).sum(axis=1))
            radius[node] = float(gap.max(initial=0.0))
            lo_hi[node] = (lo, hi)
            if hi - lo <= leaf or radius[node] == 0:
                continue
            far = own[gap.argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            half = (hi - lo) // 2
            side = np.argsort(own @ (other - far), kind="stable")
            self.order[lo:hi] = rows[side]
            child[node] = len(centre)
            for a, b in ((lo, lo + half), (lo + half, hi)):
                todo.append((a, b, len(centre)))
                centre.append(None), radius.append(0.0), child.append(0), lo_hi.append((a, b))
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.child, self.span = np.array(child), np.array(lo_hi)
        self.vectors = vectors[self.order]

    def bounds(self, queries: np.ndarray, norms: np.ndarray, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Upper bound of the score of query q[i] in node nodes[i]."""
        dot = np.einsum("ij,ij->i", queries[q], self.centre[nodes])
        bound = dot + norms[q] * self.radius[nodes]
        return np.floor(bound + 1e-9 * (np.abs(dot) + norms[q] * (self.radius[nodes] + 1)) + 1e-6)


def _dot(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating-point multiplication where no
    sum can leave the exactly represented integers, else in 64-bit integers."""
    top = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1])
    if top < 2 ** 53:
        return (vectors.astype(np.float64) @ queries.astype(np.float64).T).astype(np.int64)
    if top < 2 ** 63:
        return vectors @ queries.T
    raise ValueError("an inner product does not fit into 64 bits")


class Search:
    """Best ``k`` (score, id) of a block of queries over one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, params: SearchParams):
        self.params = params
        self.tree = BallTree(vectors, params.leaf)
        self.ids = ids[self.tree.order]

    def run(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query row, id, score)`` rows: all that can be among the k best with
        a score of at least ``floor`` of the query (ties to the smaller id)."""
        k, tree = self.params.k, self.tree
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        fl = queries.astype(np.float64)
        n = len(queries)
        best_s = np.full((n, k), np.iinfo(np.int64).min)
        best_i = np.full((n, k), np.iinfo(np.int64).max)
        kth = floor.astype(np.float64)
        # Branch: pairs (query, node) level by level while the bound reaches the threshold.
        leaves_q, leaves_n, leaves_b = [], [], []
        for lo in range(0, n, max(1, self.params.pairs // 64)):
            q = np.arange(lo, min(n, lo + max(1, self.params.pairs // 64)))
            nodes = np.zeros(len(q), dtype=np.int64)
            while len(q):
                b = np.concatenate([tree.bounds(fl, norms, q[i:i + self.params.pairs], nodes[i:i + self.params.pairs])
                                    for i in range(0, len(q), self.params.pairs)])
                ok = b >= kth[q]
                q, nodes, b = q[ok], nodes[ok], b[ok]
                at_leaf = tree.child[nodes] == 0
                leaves_q.append(q[at_leaf]), leaves_n.append(nodes[at_leaf]), leaves_b.append(b[at_leaf])
                q, nodes = q[~at_leaf], tree.child[nodes[~at_leaf]]
                q, nodes = np.concatenate([q, q]), np.concatenate([nodes, nodes + 1])
        q, nodes, b = np.concatenate(leaves_q), np.concatenate(leaves_n), np.concatenate(leaves_b)
        # Bound: every query's leaves from its highest bound down; ranks 0, 1, 2-3, 4-7, ... of all
        # queries at once, leaf by leaf.
        order = np.lexsort((-b, q))
        q, nodes, b = q[order], nodes[order], b[order]
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(n))[q]
        round_of = np.frexp(rank.astype(np.float64))[1]
        by_rank = np.argsort(round_of, kind="stable")
        ends = np.cumsum(np.bincount(round_of, minlength=1))
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            at = by_rank[lo:hi]
            at = at[b[at] >= kth[q[at]]]
            if not len(at):
                continue
            at = at[np.argsort(nodes[at], kind="stable")]
            for group in np.split(at, np.flatnonzero(np.diff(nodes[at])) + 1):
                s, e = tree.span[nodes[group[0]]]
                own = q[group]
                scores = _dot(tree.vectors[s:e], queries[own]).T
                hit = scores.max(axis=1) >= kth[own]
                if not hit.any():
                    continue
                own, scores = own[hit], scores[hit]
                ids = np.broadcast_to(self.ids[s:e], scores.shape)
                scores = np.where(ids == query_ids[own][:, None], np.iinfo(np.int64).min, scores)
                all_s = np.concatenate([best_s[own], scores], axis=1)
                all_i = np.concatenate([best_i[own], np.where(scores == np.iinfo(np.int64).min, np.iinfo(np.int64).max, ids)], axis=1)
                top = np.lexsort((all_i, ~all_s), axis=1)[:, :k]
                best_s[own] = np.take_along_axis(all_s, top, axis=1)
                best_i[own] = np.take_along_axis(all_i, top, axis=1)
                full = best_s[own, k - 1]
                kth[own] = np.maximum(kth[own], np.where(full == np.iinfo(np.int64).min, -np.inf, full.astype(np.float64)))
        row, col = np.nonzero((best_s != np.iinfo(np.int64).min) & (best_s >= np.where(np.isfinite(floor), floor, -np.inf)[:, None]))
        return row, best_i[row, col], best_s[row, col]


def _valid(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def top_k(vectors: DataFrame, is_query: Column, scale: float = 64.0, params: SearchParams = SearchParams(),
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, id_col, score``: for every row with ``is_query`` the k
    rows of other ids with the highest inner product of ``floor(scale * x)``
    components, ties to the smaller id; all of them where there are fewer.

    Rows with a null id, or a vector that is null or holds a null or non-finite
    component, take no part. Repeated ids count once per distinct row as
    candidates; a repeated query id is answered once, from its least vector. Vectors of
    another length than the query's take no part for it, empty ones none at all. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    job = Scratch(spark)
    v = F.col(vector_col).cast("array<double>")
    kept = job.cut(vectors.withColumn("_query", F.coalesce(is_query, F.lit(False))).withColumn("_v", v)
                   .where(F.col(id_col).isNotNull() & _valid(F.col("_v")))
                   .select(F.col(id_col).cast("long").alias("id"), "_query",
                           F.transform("_v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))
                   .withColumn("dim", F.size("v")))
    sizes = kept.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per vector length
    shards = max(1, -(-sum(r["n"] for r in sizes) // params.shard_rows))
    n_queries = kept.where("_query").count()
    blocks = max(1, -(-n_queries // params.block_rows))
    base = kept.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    queries = (kept.where("_query").groupBy("id", "dim").agg(F.min("v").alias("v"))
               .withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")))
    home = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(shards)).cast("int")
    # First pass: one shard per query gives the shared threshold.
    first = _search(queries.withColumn("shard", home).withColumn("floor", F.lit(None).cast("long")), base, params)
    kth = job.cut(first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
                  .select("query_id", F.when(F.col("n") >= params.k, F.col("s")).alias("floor")))
    # Second pass: every shard, from that threshold on.
    every = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(
        kth, queries["id"] == kth["query_id"], "left").drop("query_id")
    found = _search(every, base, params)
    # At most k rows per query and shard meet here, merged before they are ranked.
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(
        F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, params.k).alias("b"))
    return best.select("query_id", F.posexplode("b").alias("_r", "_b")).select(
        "query_id", (F.col("_r") + 1).cast("int").alias("rank"), F.col("_b.vec_id").alias(id_col), (-F.col("_b.s")).alias("score"))


def _search(queries: DataFrame, base: DataFrame, params: SearchParams) -> DataFrame:
    """``query_id, vec_id, score`` of the queries' shards: one task per (block, shard)."""
    columns = ("query_id", "vec_id", "score")

    def search(own: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: np.array([], np.int64) for c in columns})]
        for dim, q in own.groupby("dim"):
            cand = shard[shard["dim"] == dim]
            if not len(cand) or not dim:
                continue
            tool = Search(cand["id"].to_numpy(), np.stack(cand["v"].to_list()), params)
            floor = q["floor"].astype("float64").fillna(-np.inf).to_numpy()
            row, found, score = tool.run(q["id"].to_numpy(), np.stack(q["v"].to_list()), floor)
            out.append(pd.DataFrame(dict(zip(columns, (q["id"].to_numpy()[row], found, score), strict=True))))
        return pd.concat(out, ignore_index=True)

    # A shard's vectors go to each block of queries that asks for it.
    copies = base.join(queries.select("block", "shard").distinct(), "shard")
    copies = copies.select(*[F.col(c).alias(c) for c in ("block", "shard", "id", "v", "dim")])  # columns of their own
    return queries.groupBy("block", "shard").cogroup(copies.groupBy("block", "shard")).applyInPandas(
        search, "query_id long, vec_id long, score long")
