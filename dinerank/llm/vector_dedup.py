"""Near-duplicate embeddings by an inverted multi-index.

1. Equal vectors form a class; one row per class goes on, with its count.
2. Each half of the (unit) vectors has a codebook of ``K`` centroids, fitted on
   a bounded sample. The two nearest centroids name a vector's home cell on
   the ``K x K`` product grid, which holds every class.
3. A vector visits cells in multi-sequence order, the order of the summed
   squared distances of its halves to the cells' centroids, until that sum
   exceeds the least one by ``slack``. The slack is set once, from pairs made
   at exactly the threshold around the sample: the share ``recall`` of them must meet,
   from either side.
4. A pair met in a cell is verified in double precision. Tasks hold one
   block of a cell's residents and one block of its visitors, compare them as
   a matrix product and give out counts and one label per vector, never pairs.
5. Components come from alternating stars over those labels.

A pair is met if either vector visits the other's home. If both do, each
counts the other on its own visit, else the visit counts for both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinerank.llm.common import map_arrow
from dinerank.llm.components import components
from dinerank.session import Scratch


@dataclass(frozen=True)
class GridParams:
    cosine: float = 0.95
    #: Share of pairs at exactly ``cosine`` that the traversal must meet.
    recall: float = 0.998
    #: Rows a cell should hold on average; sets the size of the codebooks.
    cell_rows: int = 1024
    least_k: int = 4
    most_k: int = 512
    #: Rows the codebooks and the slack are fitted on (all, if fewer).
    sample: int = 20_000
    iterations: int = 8
    #: Residents, and visitors, that one task compares.
    block: int = 4096
    seed: int = 5


class Grid:
    """Codebooks of both halves, and the slack of the traversal."""

    def __init__(self, order: np.ndarray, books: list[np.ndarray], slack: float = 0.0):
        self.order, self.books, self.slack = order, books, slack

    def distances(self, unit: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each half to its centroids, less the half's own square."""
        mixed = unit[:, self.order]
        cut = self.books[0].shape[1]
        return [(b * b).sum(1)[None, :] - 2 * part @ b.T for part, b in zip((mixed[:, :cut], mixed[:, cut:]), self.books, strict=True)]

    def visits(self, unit: np.ndarray) -> list[np.ndarray]:
        """Cells of each row in multi-sequence order; the first is its home."""
        k, out = len(self.books[1]), []
        for lo in range(0, len(unit), 512):
            ranked, gaps = [], []
            for d in self.distances(unit[lo:lo + 512]):
                near = np.argsort(d, axis=1, kind="stable")
                gap = np.take_along_axis(d, near, 1)
                gap -= gap[:, :1].copy()
                most = int((gap <= self.slack).sum(1).max())
                ranked.append(near[:, :most]), gaps.append(gap[:, :most])
            total = gaps[0][:, :, None] + gaps[1][:, None, :]
            cell = ranked[0][:, :, None] * k + ranked[1][:, None, :]
            for t, c in zip(total.reshape(len(total), -1), cell.reshape(len(cell), -1), strict=True):
                inside = np.flatnonzero(t <= self.slack)
                out.append(c[inside[np.argsort(t[inside], kind="stable")]])
        return out


def _centroids(points: np.ndarray, k: int, iterations: int, rng) -> np.ndarray:
    """k-means; an empty cluster takes a random point."""
    centre = points[rng.choice(len(points), k, replace=len(points) < k)].copy()
    for _ in range(iterations):
        own = ((centre * centre).sum(1)[None, :] - 2 * points @ centre.T).argmin(1)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, own, points)
        empty = count == 0
        centre = np.where(empty[:, None], points[rng.choice(len(points), k)], total / np.maximum(count, 1)[:, None])
    return centre


def _partners(unit: np.ndarray, cosine: float, rng) -> np.ndarray:
    """For each row a vector at ``cosine`` from it: a third of them differ in
    both halves, a third mostly in either one."""
    noise = rng.normal(size=unit.shape)
    half, third = unit.shape[1] // 2, len(unit) // 3
    noise[:third, :half] *= 0.05
    noise[third:2 * third, half:] *= 0.05
    noise -= (noise * unit).sum(1, keepdims=True) * unit
    size = np.linalg.norm(noise, axis=1, keepdims=True)
    return cosine * unit + np.sqrt(1 - cosine * cosine) * noise / np.where(size > 0, size, 1)


def fit_grid(sample: np.ndarray, rows: int, params: GridParams) -> Grid:
    """Codebooks for a table of ``rows`` classes from unit vectors of it."""
    rng = np.random.default_rng(params.seed)
    dim = sample.shape[1]
    order = rng.permutation(dim)
    k = int(np.clip(np.ceil(np.sqrt(rows / params.cell_rows)), params.least_k, params.most_k))
    mixed, cut = sample[:, order], (dim + 1) // 2
    grid = Grid(order, [_centroids(p, k, params.iterations, rng) for p in (mixed[:, :cut], mixed[:, cut:])])
    x = sample[rng.permutation(len(sample))[:3000]]
    # Rows drawn again on a small table: the noise differs each time.
    x = x[np.arange(max(len(x), 3000)) % len(x)]
    y = np.empty_like(x)
    y[:, order] = _partners(x[:, order], params.cosine, rng)
    dx, dy = grid.distances(x), grid.distances(y)
    every, excess = np.arange(len(x)), []
    for own, other in ((dx, dy), (dy, dx)):
        excess.append(sum(d[every, e.argmin(1)] - d.min(1) for d, e in zip(own, other, strict=True)))
    grid.slack = float(np.quantile(np.minimum(*excess), params.recall)) + 1e-9
    return grid


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """List column as unit rows in double precision, padded with zeros to ``dim``."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(size), dim))
    if len(size):
        begin = np.cumsum(size) - size
        at = np.arange(len(flat)) - np.repeat(begin, size)
        out[np.repeat(np.arange(len(size)), size), at] = flat
    # Scaled first, so that neither very large nor very small components spoil the norm.
    out /= np.abs(out).max(1, keepdims=True, initial=np.finfo(float).tiny)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(real & F.exists(vector, lambda x: x != 0), F.lit(False))


def _compare(threshold: float):
    """One block of residents against one block of visitors of a cell."""

    def links(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        stored = group.column("stored").to_numpy(zero_copy_only=False)
        names = group.select(["h1", "h2", "id", "w", "home"]).to_pandas()
        vectors = group.column("v").combine_chunks()
        unit = _matrix(vectors, int(vectors.value_lengths().to_numpy(zero_copy_only=False).max()))
        s, q = np.flatnonzero(stored), np.flatnonzero(~stored)
        if not len(s) or not len(q):
            return pa.table({"h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()), "n": pa.array([], pa.int64()),
                             "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        h1, h2, ids, weight, home = (names[c].to_numpy() for c in ("h1", "h2", "id", "w", "home"))
        # back[u, y]: resident y visits the u-th home of the visitors.
        homes, home_no = np.unique(home[q], return_inverse=True)
        lists = group.column("visits").take(pa.array(s)).combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        cells = lists.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(homes, cells), len(homes) - 1)
        known = homes[at] == cells
        back = np.zeros((len(homes), len(s)), bool)
        back[at[known], np.repeat(np.arange(len(s)), sizes)[known]] = True
        linked = np.zeros((len(q), len(s)), bool)
        count = np.zeros(len(names), np.int64)
        for lo in range(0, len(q), 512):
            rows = q[lo:lo + 512]
            hit = unit[rows] @ unit[s].T >= threshold
            same = (h1[rows][:, None] == h1[s][None, :]) & (h2[rows][:, None] == h2[s][None, :])
            linked[lo:lo + 512] = hit | same
            hit &= ~same
            count[rows] += hit @ weight[s]
            count[s] += weight[rows] @ (hit & ~back[home_no[lo:lo + 512]])
        rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        label = ids.copy()
        part = linked[np.ix_(rows, cols)]
        top = np.int64(np.iinfo(np.int64).max)
        while True:  # least label of each side from the other, until nothing changes
            before = label.copy()
            for lo in range(0, len(rows), 512):
                m = part[lo:lo + 512]
                own = q[rows[lo:lo + 512]]
                label[own] = np.minimum(label[own], np.where(m, label[s[cols]][None, :], top).min(1, initial=top))
                label[s[cols]] = np.minimum(label[s[cols]], np.where(m, label[own][:, None], top).min(0, initial=top))
            if (label == before).all():
                break
        give = (count > 0) | (label != ids)
        return pa.table({"h1": h1[give], "h2": h2[give], "n": count[give], "a": ids[give], "b": label[give]})

    return links


def link_vectors(vectors: DataFrame, params: GridParams = GridParams(), id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """``id_col, n_links, component_id, kept`` per row of ``vectors``.

    ``n_links`` counts the other rows at a cosine of at least ``params.cosine``,
    ``component_id`` is the least id reachable over links, ``kept`` whether it is
    the row's own. A vector that is null, empty, zero or holds a null or
    non-finite component links with nothing, and so does a row with a null
    id (component null, kept). Vectors of different lengths never link. Equal
    vectors link with each other; rows with equal ids are one node of the
    components, each counted by itself in ``n_links``. Ties need no rule.
    Other columns are ignored. An empty table gives an empty result.
    """
    spark, job = vectors.sparkSession, Scratch(vectors.sparkSession)
    v = vectors[vector_col]
    rows = job.cut(vectors.select(vectors[id_col].cast("long").alias("id"), F.when(usable(v) & vectors[id_col].isNotNull(), v).alias("v"))
                   .withColumns({"h1": F.when(F.col("v").isNotNull(), F.xxhash64("v")),
                                 "h2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(7), "v"))}))
    real = rows.where("v is not null")
    classes = job.cut(real.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"), F.any_value("v").alias("v")))
    n, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    none = "h1 long, h2 long, n long, a long, b long"
    met = job.cut(_met(classes, n, dim, params, job)) if n else spark.createDataFrame([], none)
    counts = met.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    # Nodes are ids: an id with several vectors joins their classes.
    several = real.groupBy("id").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("id")
    own = real.select("id", "h1", "h2").distinct().join(several, "id").join(
        classes.select("h1", "h2", F.col("id").alias("b")), ["h1", "h2"]).select(F.col("id").alias("a"), "b")
    found = components(met.select("a", "b").where("a <> b").unionByName(own.where("a <> b")), job)
    ends = classes.select("h1", "h2", "w", "id").join(counts, ["h1", "h2"], "left").join(
        found.withColumnRenamed("node", "id"), "id", "left").select(
        "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    out = rows.select("id", "h1", "h2").join(ends, ["h1", "h2"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))


def _met(classes: DataFrame, n: int, dim: int, params: GridParams, job: Scratch) -> DataFrame:
    """Counts and labels of every block pair of every cell."""
    spark = classes.sparkSession
    share = min(1.0, params.sample / n)
    # Bounded by the parameter: a range of hashes, cut where chance gave some rows more.
    drawn = classes.where(F.pmod("h1", F.lit(1 << 20)) <= int(share * (1 << 20))).select("v").limit(params.sample)
    sample = pa.array([r["v"] for r in drawn.collect()] or [r["v"] for r in classes.select("v").limit(1).collect()], pa.list_(pa.float64()))
    shared = spark.sparkContext.broadcast(fit_grid(_matrix(sample, dim), n, params))

    def place(batches):
        grid = shared.value
        for batch in batches:
            cells = grid.visits(_matrix(batch.column("v"), dim))
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int32)
            flat = np.concatenate(cells) if cells else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c[0] for c in cells], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))],
                names=[*batch.schema.names, "home", "visits"])

    kind = dict(classes.dtypes)["v"]
    placed = job.cut(map_arrow(classes.select("h1", "h2", "id", "w", "v"), place,
                               f"h1 long, h2 long, id long, w long, v {kind}, home long, visits array<long>"))
    width = F.size("v").alias("d")
    residents = placed.select(width, F.col("home").alias("cell"), "h1", "h2", "id", "w", "home", "v", "visits", F.lit(True).alias("stored"))
    visitors = placed.select(width, F.explode("visits").alias("cell"), "h1", "h2", "id", "w", "home", "v",
                             F.lit(None).cast("array<long>").alias("visits"), F.lit(False).alias("stored"))
    held = placed.groupBy(width, F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("m"))
    asked = placed.select(width, F.explode("visits").alias("cell")).groupBy("d", "cell").agg(F.count(F.lit(1)).alias("q"))
    blocks = lambda c: F.ceil(F.col(c) / params.block).cast("int")
    sizes = held.join(asked, ["d", "cell"]).select("d", "cell", blocks("m").alias("sb"), blocks("q").alias("qb"))
    either = residents.unionByName(visitors).join(sizes, ["d", "cell"])
    deal = lambda c: F.pmod("h1", F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    dealt = either.select(
        "d", "cell", "h1", "h2", "id", "w", "home", "v", "visits", "stored", "qb",
        F.explode(F.when(F.col("stored"), F.array(deal("sb"))).otherwise(every("sb"))).alias("i")).select(
        "d", "cell", "i", F.explode(F.when(F.col("stored"), every("qb")).otherwise(F.array(F.pmod(F.col("h2"), F.col("qb")).cast("int")))).alias("j"),
        "h1", "h2", "id", "w", "home", "v", "visits", "stored")
    return dealt.groupBy("d", "cell", "i", "j").applyInArrow(_compare(params.cosine), "h1 long, h2 long, n long, a long, b long")
