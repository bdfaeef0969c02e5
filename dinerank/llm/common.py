"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dinerank.session import Scratch, byte_size, ship_package

#: Bytes of text worked on at once inside a task; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(df[text], F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size_of: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``size_of`` bytes of text
    (one row at least). Nulls are read as empty texts by the callers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(size.astype(np.int64)) // size_of
        cuts = np.flatnonzero(np.diff(block, prepend=block[0])).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def strings(column: pa.Array) -> pa.Array:
    """A text column as plain strings without nulls.

    A slice is copied first: casting a sliced ``string`` column gives offsets
    that do not start at 0, which string kernels then read from the wrong place.
    """
    return pc.fill_null(pa.concat_arrays([column]).cast(pa.large_string()), "")


def list_offsets(parts: pa.Array) -> np.ndarray:
    """Offsets of a (possibly sliced) list array, from 0."""
    off = parts.offsets.to_numpy().astype(np.int64)
    return off - off[0]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] per i; empty segments give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=values.dtype), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def give_back() -> None:
    """Hand unused memory of this process back to the system. Python workers live
    on between tasks, and what one stage needed at most would stay with them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of an Arrow batch between an executor and its Python workers. It is held
#: on both sides; the default of 64 MB a task is a good part of a small executor.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers, which give back
    their memory after each task. A session that allows larger Arrow batches
    than BATCH_BYTES is set to that size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    if byte_size(conf.get(_BATCH_SETTING)) > BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def scratch(df: DataFrame) -> Scratch:
    return Scratch(df.sparkSession)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (xor-shift and multiply) that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def gapless(df: DataFrame, group: list[str], order: list[Column], salt_of: Column, out: str, rows: int,
            rows_per_task: int = 20_000) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in column ``out``.

    A group may hold any share of the rows, so no task sees a whole group:
    rows are numbered within (group, salt), and each salt starts where the
    counts of the smaller salts end. ``rows`` (the table's row count) sets
    the number of salts; ``salt_of`` must be a function of the row.
    """
    from pyspark.sql import Window

    salts = max(1, -(-rows // rows_per_task))
    df = df.withColumn("_salt", F.pmod(salt_of, F.lit(salts)).cast("int"))
    key = [*group, "_salt"]
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).select(
        *key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return (df.withColumn("_i", within).join(starts, key)
            .withColumn(out, (F.col("_start") + F.col("_i")).cast("long")).drop("_salt", "_i", "_start"))


#: Bits of the tables of :func:`listed`.
LIST_BITS = 1 << 22


def listed(df: DataFrame, ids: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``df`` with the boolean ``out``: true for every row whose ``keys`` are in
    ``ids`` (and for a few others), so false rows can skip a join with ``ids``.

    A bit table over key hashes is broadcast: LIST_BITS / 32 rows at most,
    however many ids there are. With very many ids it excludes little, which
    costs time and never rows.
    """
    bit = lambda d: F.pmod(F.xxhash64(*[d[k] for k in keys]), F.lit(LIST_BITS))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(32)).cast("int"))
    words = ids.select(bit(ids).alias("_b")).groupBy(F.shiftright("_b", 5).alias("_word")).agg(
        F.bit_or(one(F.col("_b"))).alias("_bits"))
    own = bit(df)
    return df.join(F.broadcast(words), F.shiftright(own, 5) == F.col("_word"), "left").select(
        *[df[c] for c in df.columns], F.coalesce(F.col("_bits").bitwiseAND(one(own)) != 0, F.lit(False)).alias(out))
