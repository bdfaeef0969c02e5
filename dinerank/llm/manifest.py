"""Merkle manifest of a table: a root over all rows, and a proof for each.

Leaves are hashed in Spark expressions and numbered per group in the order of
their ids. Blocks of ``8 ** HEIGHT`` consecutive leaves are aligned subtrees: a
task builds one and stores it as an array in van Emde Boas order, a tree cut at
half its height, the top first, then every bottom tree, each laid out the same
way. ``address`` computes a node's place, for construction and for reading
siblings alike. The roots of the blocks are the leaves of the next level, which
is blocked and stored in the same way, until one node is left per group; the
groups' roots then form the last tree.

Proofs go the other way: the path above a block's root (a short string) is joined
to the block, which reads the siblings below it from its stored tree and hands
each of its leaves the whole path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dinerank.llm.common import map_arrow
from dinerank.session import Scratch

ARITY = 8
#: Levels below the root of a stored subtree: 4,096 leaves at most.
HEIGHT = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


# ------------------------------------------------------------------- layout

def nodes_in(levels: int) -> int:
    """Nodes of a complete tree of ``levels`` levels."""
    return (ARITY ** levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places, in a stored tree of ``levels`` levels, of the nodes ``index`` (from the left) at ``depth``."""
    if levels == 1:
        return np.zeros(len(index), np.int64)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    width = ARITY ** (depth - top)
    under, within = index // width, index % width
    return nodes_in(top) + under * nodes_in(levels - top) + address(levels - top, depth - top, within)


@cache
def _whole_level(levels: int, depth: int) -> np.ndarray:
    return address(levels, depth, np.arange(ARITY ** depth))


def levels_of(leaves: int) -> int:
    """Levels of the tree over so many leaves, its leaves and root included."""
    return 1 if leaves <= 1 else 1 + levels_of(-(-leaves // ARITY))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def build(leaves: list[str], levels: int) -> bytes:
    """The stored tree over hex digests; places without a node are zero."""
    tree = np.zeros((nodes_in(levels), 32), np.uint8)
    level = leaves
    for depth in range(levels - 1, -1, -1):
        tree[address(levels, depth, np.arange(len(level)))] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, 32)
        if depth:
            level = [digest("".join(level[i:i + ARITY])) for i in range(0, len(level), ARITY)]
    return tree.tobytes()


def steps(tree: bytes, leaves: int, levels: int) -> list[tuple[str, int]]:
    """Per depth from the leaves up to below the root: the level's digests as one hex text, and its length."""
    nodes = np.frombuffer(tree, np.uint8).reshape(-1, 32)
    out, n = [], leaves
    for depth in range(levels - 1, 0, -1):
        out.append((nodes[_whole_level(levels, depth)[:n]].tobytes().hex(), n))
        n = -(-n // ARITY)
    return out


def paths(tree: bytes, leaves: int, levels: int, above: str) -> Iterator[str]:
    """For each leaf its path: ``before_after`` per level, comma-joined, the siblings
    to the left and right as hex text, and behind them those ``above`` the tree."""
    found = steps(tree, leaves, levels)
    for i in range(leaves):
        parts, at = [], i
        for text, n in found:
            lo, hi = at - at % ARITY, min(at - at % ARITY + ARITY, n)
            parts.append(f"{text[64 * lo:64 * at]}_{text[64 * at + 64:64 * hi]}")
            at //= ARITY
        if above:
            parts.append(above)
        yield ",".join(parts)


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and its path give."""
    for part in path.split(",") if path else ():
        before, _, after = part.partition("_")
        leaf = digest(before + leaf + after)
    return leaf


# -------------------------------------------------------------------- leaves

def leaf_of(columns: list[Column]) -> Column:
    """Hex digest of the fields, each ``-`` if null, else byte count, ``:``, value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in columns]).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(rows: DataFrame, job: Scratch) -> DataFrame:
    """``rows(g, id, leaf, other)`` with equal rows as one: its first rank in the
    group by (id, leaf), ``start``, its count ``c``, and the group's ``total``.

    Rows are dealt by ranges of the order, a range is one task's window, and the
    ranges' counts, not their rows, are summed from the left.
    """
    once = rows.groupBy("g", "id", "leaf", "other").agg(F.count(F.lit(1)).alias("c"))
    order = [F.col("g").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf").asc()]
    dealt = job.cut(once.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    same = lambda *extra: Window.partitionBy("g", *extra)
    sums = dealt.groupBy("g", "part").agg(F.sum("c").alias("n"))
    before = F.coalesce(F.sum("n").over(same().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("g").alias("_g"), F.col("part").alias("_part"), before.alias("_before"), F.sum("n").over(same()).alias("total"))
    within = F.sum("c").over(same("part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.withColumn("_in", F.coalesce(within, F.lit(0))).join(
        sums, F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_part")))
    return placed.select("g", "id", "leaf", "other", "c", (F.col("_before") + F.col("_in")).alias("start"), "total")


# -------------------------------------------------------------------- blocks

BLOCK = "g string, block long, total long, n int, levels int, tree binary, root string, ids array<long>, others array<string>"


def _built(height: int) -> Callable[[pa.Table], pa.Table]:
    """The stored tree of one block; a run of equal rows is written out here, within the block."""
    span = ARITY ** height

    def one(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["start"])
        lo = rows[0]["block"] * span
        leaves, ids, others = [], [], []
        for r in rows:
            times = min(r["start"] + r["c"], lo + span) - max(r["start"], lo)
            leaves += [r["leaf"]] * times
            ids += [r["id"]] * times
            others += [r["other"]] * times
        # A group of several blocks has them climb to the same height; one block alone stops at a single node.
        total = rows[0]["total"]
        levels = height + 1 if total > span else levels_of(total)
        tree = build(leaves, levels)
        return pa.table({"g": pa.array([rows[0]["g"]], pa.string()), "block": [rows[0]["block"]], "total": [total], "n": pa.array([len(leaves)], pa.int32()),
                         "levels": pa.array([levels], pa.int32()), "tree": [tree], "root": [tree[:32].hex()],
                         "ids": pa.array([ids], pa.list_(pa.int64())), "others": pa.array([others], pa.list_(pa.string()))})

    return one


def _blocks(nodes: DataFrame, job: Scratch, height: int) -> DataFrame:
    """Stored subtrees over ``nodes(g, id, leaf, other, c, start, total)``."""
    span = ARITY ** height
    first, last = F.floor(F.col("start") / span), F.floor((F.col("start") + F.col("c") - 1) / span)
    placed = nodes.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    # The group key may be null; grouping keeps nulls as one key.
    return job.cut(placed.groupBy("g", "block").applyInArrow(_built(height), BLOCK))


def forest(nodes: DataFrame, job: Scratch, height: int) -> list[DataFrame]:
    """Block tables from the leaves up, until every group has one node left."""
    span = ARITY ** height
    found = [_blocks(nodes, job, height)]
    while not (more := found[-1].where(F.col("total") > span)).isEmpty():
        found.append(_blocks(more.select(
            "g", F.lit(None).cast("long").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("other"),
            F.lit(1).cast("long").alias("c"), F.col("block").alias("start"), F.ceil(F.col("total") / span).cast("long").alias("total")), job, height))
    return found


def _down(found: list[DataFrame], ends: DataFrame, job: Scratch, height: int) -> DataFrame:
    """The leaf blocks with ``above``: the path from their root to the top.
    ``ends(_g, _end)`` has the path above each group's own root."""
    span = ARITY ** height
    above = None
    for level in range(len(found) - 1, -1, -1):
        blocks = found[level].join(ends, F.col("g").eqNullSafe(F.col("_g"))).drop("_g")
        if above is None:
            blocks = blocks.withColumn("above", F.col("_end"))
        else:
            blocks = blocks.join(above, F.col("g").eqNullSafe(F.col("_ag")) & (F.col("block") == F.col("_at")), "left").withColumn(
                "above", F.when(F.col("total") > span, F.col("_path")).otherwise(F.col("_end"))).drop("_ag", "_at", "_path")
        blocks = blocks.drop("_end")
        if not level:
            return blocks
        above = job.cut(_node_paths(blocks, span))
    return blocks


def _node_paths(blocks: DataFrame, span: int) -> DataFrame:
    """``_ag, _at, _path``: the path above every leaf of the blocks, the leaves numbered in their group."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = list(paths(r["tree"], r["n"], r["levels"], r["above"]))
                at = np.arange(r["n"]) + r["block"] * span
                yield pa.RecordBatch.from_arrays([pa.array([r["g"]] * r["n"], pa.string()), pa.array(at, pa.int64()), pa.array(own, pa.string())],
                                                 names=["_ag", "_at", "_path"])

    return map_arrow(blocks.select("g", "block", "n", "levels", "tree", "above"), every, "_ag string, _at long, _path string")


OUT = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path string"


def _proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every leaf of every block with its proof, checked from the leaf that was read later."""
    for batch in batches:
        for r in batch.to_pylist():
            nodes = np.frombuffer(r["tree"], np.uint8).reshape(-1, 32)
            leaves = [row.tobytes().hex() for row in nodes[_whole_level(r["levels"], r["levels"] - 1)[:r["n"]]]]
            own = list(paths(r["tree"], r["n"], r["levels"], r["above"]))
            folded = [fold(o or leaf, p) for leaf, o, p in zip(leaves, r["others"], own, strict=True)]
            proof = [digest(p.replace("_", "").replace(",", "")) for p in own]
            n = r["n"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["ids"], pa.int64()), pa.array(leaves), pa.array([r["subroot"]] * n), pa.array([r["top"]] * n), pa.array(proof),
                 pa.array(folded), pa.array([f == r["top"] for f in folded]), pa.array(own)],
                names=[f.split()[0] for f in OUT.split(", ")])


def manifest(docs: DataFrame, tampered: Column, changed: dict[str, Column], id_col: str = "doc_id", group_col: str = "lang",
             fields: list[str] | None = None, height: int = HEIGHT) -> DataFrame:
    """Per row: id, leaf, subroot (of its group), root, proof_sha256, folded_root,
    verified, and the proof itself as ``path`` (see :func:`paths`).

    The proof is checked with the leaf of the row as it is, or, where
    ``tampered`` holds, as ``changed`` (column name to new value) makes it. Null
    fields have their own mark, null groups come first, null ids come before
    all others of their group. Rows of equal ids stand in the order of their
    leaves; equal rows are leaves of their own, next to each other. Empty and long
    texts need no rule; other columns are ignored. An empty table gives no rows.
    """
    job = Scratch(docs.sparkSession)
    names = fields or FIELDS
    leaf = leaf_of([docs[c] for c in names])
    other = leaf_of([changed.get(c, docs[c]) for c in names])
    rows = docs.select(docs[group_col].cast("string").alias("g"), docs[id_col].cast("long").alias("id"), leaf.alias("leaf"),
                       F.when(F.coalesce(tampered, F.lit(False)), other).alias("other"))
    found = forest(ranked(rows, job), job, height)
    tops = [f.where(F.col("total") <= ARITY ** height).select("g", F.col("root").alias("subroot")) for f in found]
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    # The last tree: one group, its leaves the subroots in the order of the groups.
    of_groups = ranked(subroots.select(F.lit("").alias("g"), F.lit(None).cast("long").alias("id"), "subroot", F.col("g").alias("name")).select(
        "g", "id", F.struct("name", "subroot").alias("leaf"), F.lit(None).cast("string").alias("other")), job)
    last = job.cut(of_groups.withColumns({"name": F.col("leaf.name"), "leaf": F.col("leaf.subroot")}))
    trees = forest(last.drop("name"), job, height)
    top = trees[-1].where(F.col("total") <= ARITY ** height).select(F.col("root").alias("top"))
    no_path = docs.sparkSession.createDataFrame([("", "")], "_g string, _end string")
    leaf_blocks = _down(trees, no_path, job, height)
    ends = _node_paths(leaf_blocks, ARITY ** height)
    ends = last.join(ends, F.col("start") == F.col("_at")).select(F.col("name").alias("_g"), F.col("_path").alias("_end"), F.col("leaf").alias("subroot"))
    ends = job.cut(ends.crossJoin(F.broadcast(top)))  # one row
    blocks = _down(found, ends.select("_g", "_end"), job, height)
    blocks = blocks.join(ends.select("_g", "subroot", "top"), F.col("g").eqNullSafe(F.col("_g")))
    out = map_arrow(blocks.select("n", "levels", "tree", "ids", "others", "above", "subroot", "top"), _proven, OUT)
    return out.withColumnRenamed("id", id_col)


def manifest_sql(levels: int = 10) -> str:
    """The manifest of ``documents`` as DuckDB SQL, for groups of up to 8 ** levels rows."""
    crc = ("xor(list_reduce(list_prepend(4294967295::bigint, list_transform(str_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint)), "
           "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
           "lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)")
    part = lambda c: f"coalesce(octet_length(encode(({c})::varchar))::varchar || ':' || ({c})::varchar, '-')"
    leaf = lambda t: "sha256(" + " || ".join(part(t if c == "text" else c) for c in FIELDS) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    run = "partition by g, i // 8 order by i rows between"

    def tower(name: str, first: str) -> list[str]:
        """CTEs of the levels over ``first`` (g, i, h, n) and of the siblings in each."""
        out = [f"{name}0 as ({first})"]
        for k in range(levels):
            out.append(f"{name}s{k} as (select g, i, n, coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as before, "
                       f"coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as after from {name}{k})")
            out.append(f"{name}{k + 1} as (select g, i // 8 as i, case when max(n) = 1 then max(h) else sha256(string_agg(h, '' order by i)) end as h, "
                       f"(max(n) + 7) // 8 as n from {name}{k} group by g, i // 8)")
        return out

    def climb(name: str, first: str) -> list[str]:
        """CTEs that follow each row of ``first`` (id, g, i, proof, folded, ...) up the levels."""
        out = [f"{name}c0 as ({first})"]
        for k in range(levels):
            out.append(f"{name}c{k + 1} as (select c.* replace (c.i // 8 as i, c.proof || s.before || s.after as proof, "
                       f"case when s.n = 1 then c.folded else sha256(s.before || c.folded || s.after) end as folded) "
                       f"from {name}c{k} c join {name}s{k} s on c.g = s.g and c.i = s.i)")
        return out

    ctes = [
        f"read as (select doc_id, coalesce('v' || lang, 'n') as g, {leaf('text')} as leaf, "
        f"case when {crc} % 3 = 0 then {leaf(lower)} else {leaf('text')} end as other from documents)",
        "placed as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as n from read)",
        *tower("l", "select g, i, leaf as h, n from placed"),
        *tower("t", f"select 'top' as g, row_number() over (order by g) - 1 as i, h, count(*) over () as n, g as lang from l{levels}"),
        *climb("l", "select doc_id, leaf, g, i, '' as proof, other as folded from placed"),
        *climb("t", f"select c.doc_id, c.leaf, t.h as subroot, t.g, t.i, c.proof, c.folded from lc{levels} c join t0 t on t.lang = c.g"),
    ]
    return "with " + ",\n".join(ctes) + f"""
select c.doc_id, c.leaf, c.subroot, r.h as root, sha256(c.proof) as proof_sha256, c.folded as folded_root, c.folded = r.h as verified
from tc{levels} c, t{levels} r"""
