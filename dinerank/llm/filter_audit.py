"""Audit of five filters in every order, by contractions of a contingency tensor.

Spark reduces all documents to one row per part and failure pattern: which
of the filters A to E a text fails, five bits. Per part the counts (of documents,
of good and of toxic ones) are a 2x2x2x2x2 tensor with axes pass and fail.
Each step of each order is a product of one selector per axis, pass, fail or
all, and one einsum over the selectors gives every figure of the report.

A filter's answer never depends on the order: E asks whether a smaller id has
the same text anywhere in the table, removed or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dinerank.llm.common import map_arrow

FILTERS = "ABCDE"
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


@dataclass(frozen=True)
class AuditParams:
    least_words: int = 50
    #: Percent of the words that must be different ones.
    least_distinct: int = 65
    #: Percent of the characters that may be capitals.
    most_capitals: int = 5
    marks: str = "[#$%&*|]"


def text_failures(text: Column, params: AuditParams = AuditParams()) -> list[Column]:
    """The failure conditions A to D of a text without nulls, as booleans."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return [
        n < params.least_words,
        100 * F.size(F.array_distinct(words)) < params.least_distinct * n,
        100 * capitals > params.most_capitals * F.length(text),
        text.rlike(params.marks),
    ]


def patterns(docs: DataFrame, labels: DataFrame, params: AuditParams = AuditParams(), id_col: str = "doc_id",
             text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, pattern, n, good, toxic``: documents per part and failure pattern
    (bit k is set where filter k fails).

    Rows are summed per (text hash, id, part) first, so repeated rows are one
    row from there on, and the first of equal texts is found by a minimum per
    hash; it is joined on (hash, id), a key no group of copies can make hot.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    read = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("t"))
    bits = sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(text_failures(F.col("t"), params))), F.lit(0))
    rows = read.select("id", "part", F.unhex(F.md5(F.col("t").cast("binary"))).alias("h"), bits.alias("bits"))
    rows = rows.groupBy("id", "part", "h", "bits").agg(F.count(F.lit(1)).alias("n"))
    # Null ids come neither before nor after any other.
    first = rows.where("id is not null").groupBy("h").agg(F.min("id").alias("id")).withColumn("_first", F.lit(True))
    marks = labels.groupBy(labels[id_col].cast("long").alias("id")).agg(
        F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("_toxic"))
    joined = rows.join(first, ["h", "id"], "left").join(marks, "id", "left")
    repeats = F.when(F.col("id").isNotNull() & F.col("_first").isNull(), F.lit(16)).otherwise(F.lit(0))
    some = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0)))
    return joined.groupBy("part", (F.col("bits") + repeats).alias("pattern")).agg(
        F.sum("n").alias("n"), some("_good").alias("good"), some("_toxic").alias("toxic"))


def selectors() -> tuple[list[str], np.ndarray]:
    """Orders, and for each order and step the selectors of ``kept``, ``removed``,
    of all that fail the step's filter, and of those that fail it alone:
    shape (orders, 5, 4, 5 axes, 2)."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    passes, fails, every = (1, 0), (0, 1), (1, 1)
    out = np.empty((len(orders), 5, 4, 5, 2), np.int64)
    for o, order in enumerate(orders):
        for step, name in enumerate(order):
            for axis, other in enumerate(FILTERS):
                place = order.index(other)
                out[o, step, 0, axis] = passes if place <= step else every
                out[o, step, 1, axis] = fails if other == name else passes if place < step else every
                out[o, step, 2, axis] = fails if other == name else every
                out[o, step, 3, axis] = fails if other == name else passes
    return orders, out


def contract(tensors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """``tensors`` (any, 2, 2, 2, 2, 2) contracted with each row of selectors
    (..., 5, 2): shape (any, ...)."""
    flat = chosen.reshape(-1, 5, 2)
    out = np.einsum("nabcde,za,zb,zc,zd,ze->nz", tensors, *(flat[:, k] for k in range(5)), optimize=True)
    return out.reshape(len(tensors), *chosen.shape[:-2])


def report(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Figures of one part by name, each of shape (120 orders, 5 steps), from
    ``counts`` (3, 32): documents, good and toxic ones per pattern."""
    orders, chosen = selectors()
    # Bit k of the pattern is axis k: the last axis of the plain reshape is bit 0.
    tensors = counts.reshape(3, 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1)
    kept, removed, failing, alone = np.moveaxis(contract(tensors[:1], chosen)[0], 2, 0)
    lost = contract(tensors[1:], chosen[:, :, 1])
    total = np.zeros(5, np.int64)
    which = np.array([[FILTERS.index(c) for c in o] for o in orders])
    np.add.at(total, which, removed)
    return {"kept": kept, "removed": removed, "redundant": failing - removed, "unique_fails": alone,
            "good_lost": lost[0], "toxic_lost": lost[1], "shapley": total[which]}


def audit(docs: DataFrame, labels: DataFrame, params: AuditParams = AuditParams(), id_col: str = "doc_id",
          text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step (see ``SCHEMA``).

    A null text is the empty one, which fails A only (and E, if a smaller id
    has it too); a null part counts as ''. A repeated row is counted each
    time and is no copy of itself: only a smaller id makes a text fail E; a row
    without an id passes E and makes no other fail. Labels of one id are taken
    together: 1 if any is. Whole texts are read, whatever their length; other
    columns are ignored. An empty table has no parts and gives no row.
    """
    seen = patterns(docs, labels, params, id_col, text_col, part_col)
    per_part = seen.groupBy("part").agg(F.collect_list(F.struct("pattern", "n", "good", "toxic")).alias("cells"))  # 32 at most

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, _ = selectors()
        order, step = [o for o in orders for _ in range(5)], np.tile(np.arange(1, 6, dtype=np.int32), len(orders))
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                counts = np.zeros((3, 32), np.int64)
                for c in cells:
                    counts[:, c["pattern"]] += (c["n"], c["good"], c["toxic"])
                figures = report(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(order)), pa.array(order), pa.array(step), *(pa.array(f.reshape(-1)) for f in figures.values())],
                    names=["part", "filter_order", "step", *figures])

    return map_arrow(per_part, steps, SCHEMA)


def audit_sql() -> str:
    """The audit as DuckDB SQL over ``documents`` and ``labels``."""
    return f"""
with read as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
marked as (
  select doc_id, part, len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) as c,
         regexp_matches(t, '[#$%&*|]') as d,
         coalesce(doc_id > min(doc_id) over (partition by t), false) as e
  from read),
flags as (
  select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic
  from labels group by doc_id),
cells as (
  select part, a, b, c, d, e, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
  from marked left join flags using (doc_id) group by all),
tagged as (
  select part, n, good, toxic, case when a then 'A' else '' end || case when b then 'B' else '' end || case when c then 'C' else '' end
         || case when d then 'D' else '' end || case when e then 'E' else '' end as fails
  from cells),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (
  select p.l || q.l || r.l || s.l || u.l as filter_order
  from letters p, letters q, letters r, letters s, letters u
  where len(list_distinct([p.l, q.l, r.l, s.l, u.l])) = 5),
steps as (
  select filter_order, step, substr(filter_order, step, 1) as own, substr(filter_order, 1, step - 1) as earlier
  from (select filter_order, unnest(range(1, 6)) as step from orders)),
met as (
  select part, filter_order, step, own, n, good, toxic, fails,
         contains(fails, own) as hit, translate(fails, earlier, '') = fails as here
  from tagged, steps),
summed as (
  select part, filter_order, step, own,
         coalesce(sum(n) filter (where here and not hit), 0)::bigint as kept,
         coalesce(sum(n) filter (where here and hit), 0)::bigint as removed,
         coalesce(sum(n) filter (where hit and not here), 0)::bigint as redundant,
         coalesce(sum(n) filter (where fails = own), 0)::bigint as unique_fails,
         coalesce(sum(good) filter (where here and hit), 0)::bigint as good_lost,
         coalesce(sum(toxic) filter (where here and hit), 0)::bigint as toxic_lost
  from met group by all)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, own))::bigint as shapley
from summed
"""
