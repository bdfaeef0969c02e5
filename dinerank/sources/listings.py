"""Listing table I/O: raw scan, canonical scan with guards, versioned publish
with a manifest, build-if-missing.

Publishing writes a new version directory, checks the row count observed
during that same write, and only then commits it: a numbered record, created
only if there is none of that number, names the directory. Records are never
changed. Readers take the last complete record, so they see a whole table or
the one before it, and of two publishers one gets a number and the other the
next, or a conflict if it insists on the state it started from.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dinerank.functions.text import ustrip
from dinerank.operators.ingest import position, with_row_index
from dinerank.schemas import LISTING, RAW_COLUMNS, check_raw_columns
from dinerank.session import small_splits

COMMITS = "_commits"
MANIFEST = "_manifest.json"
VALUES = "_values"


class PublishConflict(RuntimeError):
    """Another version was committed since the one a publisher started from."""


# ----------------------------------------------------------- Hadoop FS helpers

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that nobody reads yet."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a new file; False, and nothing changed, where there is one already."""
    from py4j.protocol import Py4JJavaError

    fs, p = _fs(spark, path)
    jvm, data = spark.sparkContext._jvm, bytearray(text.encode("utf-8"))
    try:
        if fs.getUri().getScheme() == "file":  # Hadoop's local files look first and create then
            fs.mkdirs(p.getParent())
            nio = jvm.java.nio.file
            options = spark.sparkContext._gateway.new_array(nio.OpenOption, 2)
            options[0], options[1] = nio.StandardOpenOption.CREATE_NEW, nio.StandardOpenOption.WRITE
            nio.Files.write(nio.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)), data, options)
            return True
        out = fs.create(p, False)
        try:
            out.write(data)
        finally:
            out.close()
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    stream = fs.open(p)
    try:
        return str(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


# ------------------------------------------------------------------- sources

def parquet_positions(df: DataFrame, name: str = "row_index") -> DataFrame:
    """``df``, a scan of Parquet files, with the position of every row: its index in
    its file, which the reader makes itself, after the rows of all files before (by
    path). However splits are dealt or retried, a row keeps its position. The files'
    row counts come from a scan without columns, that is from the footers."""
    counts = df.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    offsets = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    at = df.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
    # A row per file is sent to the rows; dealt by file, a task would get all rows of one.
    return (at.join(F.broadcast(offsets), "_file").withColumn(name, F.col("_offset") + F.col("_at"))
            .select(*[F.col(f"`{c}`") for c in df.columns], name))


def scan_raw(spark: SparkSession, path: str, fmt: str = "parquet", split: str | None = None, multiline: bool = True) -> DataFrame:
    """Raw listing rows: the known columns as strings (null where the source
    lacks an optional one) and ``row_index``, the row's position.

    The source's own schema is read, CSV columns by their header names, so
    required columns that are missing are noticed; ``split`` is a
    sub-directory (e.g. 'train'). A CSV file whose quoted values hold line breaks
    can only be read by one task; with ``multiline=False`` none does, and the
    file is split by byte ranges.
    """
    full = f"{path.rstrip('/')}/{split}" if split else path
    reader = spark.read
    if fmt == "csv":
        reader = reader.options(header="true", multiLine=str(multiline).lower(), escape='"')
    df = reader.format(fmt).load(full)
    check_raw_columns(df)
    if "row_index" not in df.columns and fmt == "parquet":
        df = parquet_positions(df)
    elif "row_index" not in df.columns:
        df = with_row_index(df.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")}),
                            origin=["_file", "_start"])
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast("string").alias(c) for c in RAW_COLUMNS],
                     position(F.col("row_index")).alias("row_index"))


def commits(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    """``(number, version directory)`` of every complete commit, oldest first. A
    record whose publisher died before its end is none."""
    folder = f"{base.rstrip('/')}/{COMMITS}"
    if not path_exists(spark, folder):
        return []
    out = []
    for number in _numbers(spark, base):
        try:
            record = json.loads(read_text(spark, f"{folder}/{number:020d}"))
        except ValueError:
            continue
        out.append((number, record["version"]))
    return out


def _numbers(spark: SparkSession, base: str) -> list[int]:
    """Numbers of all records, complete or not."""
    fs, p = _fs(spark, f"{base.rstrip('/')}/{COMMITS}")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []


def current_version(spark: SparkSession, base: str, number: int | None = None) -> str:
    """Directory of the last commit, or of commit ``number`` (``base`` itself
    for plain tables); a number that is not there -> ``ValueError``."""
    found = commits(spark, base)
    if number is not None:
        found = [c for c in found if c[0] == number]
        if not found:
            raise ValueError(f"{base} has no version {number}")
    return f"{base.rstrip('/')}/{found[-1][1]}" if found else base


def scan_listings(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """Canonical listings of the last commit, or of commit ``number``; no such
    folder -> ``FileNotFoundError``; nothing published in it, or a table without
    rows -> ``ValueError``. The result stays with the version it found."""
    if not path_exists(spark, base):
        raise FileNotFoundError(f"no listing table at {base}: ingest into it first")
    df = spark.read.schema(LISTING).parquet(current_version(spark, base, number))
    if df.isEmpty():
        raise ValueError(f"the listing table at {base} holds no rows")
    return df


def lookup_by_ids(listings: DataFrame, ids: DataFrame, id_col: str = "id", pos_col: str = "pos") -> DataFrame:
    """The listings named by ``ids(pos, id, ...)`` in the order of ``pos``: a repeated id
    gives its listing again, an unknown one gives nothing."""
    keep = [c for c in ids.columns if c != id_col]
    rest = [c for c in listings.columns if c != "id" and c not in keep]
    wanted = ids.withColumnRenamed(id_col, "id") if id_col != "id" else ids
    return wanted.join(listings.select("id", *rest), "id").select(*keep, "id", *rest).orderBy(pos_col)


def count_values(listings: DataFrame) -> DataFrame:
    """``kind, value, band, n``: how many listings have each ``city``, ``area`` and
    ``cuisine`` (``band`` null), and each ``place``, that is a location with its band.

    Cities and areas are stripped and not empty; a tag that a listing has twice
    counts once. Rows are counted as they are first, places by themselves and tag
    lists by themselves (either scan reads its own columns), so that only different
    ones are taken apart.
    """
    def entry(kind: str, value, band=None):
        band = F.lit(None).cast("string") if band is None else band
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"), band.alias("band"))

    places = listings.groupBy(F.col("metadata.city").alias("city"), F.col("metadata.locality").alias("locality"), "location", "budget_band").agg(
        F.count(F.lit(1)).alias("n"))
    tags = listings.groupBy("cuisines").agg(F.count(F.lit(1)).alias("n"))
    of_places = F.array(entry("city", ustrip(F.col("city"))), entry("area", ustrip(F.col("locality"))), entry("place", F.col("location"), F.col("budget_band")))
    of_tags = F.transform(F.array_distinct("cuisines"), lambda c: entry("cuisine", c))
    return (
        places.select(F.explode(of_places).alias("e"), "n").unionByName(tags.select(F.explode(of_tags).alias("e"), "n")).select("e.*", "n")
        .where(F.col("value").isNotNull() & (~F.col("kind").isin("city", "area") | (F.col("value") != "")))
        .groupBy("kind", "value", "band").agg(F.sum("n").alias("n"))
    )


def scan_values(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """The counted values (:func:`count_values`) of the last commit, or of commit
    ``number``, as ``publish`` stored them; counted anew for a version without them."""
    version = current_version(spark, base, number)
    if path_exists(spark, f"{version}/{VALUES}"):
        return spark.read.schema("kind string, value string, band string, n bigint").parquet(f"{version}/{VALUES}")
    return count_values(scan_listings(spark, base, number))


def reload_listings(spark: SparkSession, base: str) -> DataFrame:
    """Re-read the published table after a new version was swapped in
    (drops cached file listings of the old version first)."""
    spark.catalog.refreshByPath(current_version(spark, base))
    return scan_listings(spark, base)


def sanitize_nan(df: DataFrame) -> DataFrame:
    """Floating NaN -> NULL in every top-level and struct-nested double field."""
    def fix(col, dtype):
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return F.when(F.isnan(col), F.lit(None).cast(dtype)).otherwise(col)
        if isinstance(dtype, T.StructType):
            out = col
            for f in dtype.fields:
                if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.StructType)):
                    out = out.withField(f.name, fix(col[f.name], f.dataType))
            return F.when(col.isNull(), col).otherwise(out)
        return col
    return df.select(*[fix(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


# --------------------------------------------------------------------- sinks

def publish(df: DataFrame, base: str, version: str | None = None, num_files: int | None = None,
            expected: int | None = None) -> dict:
    """Write ``df`` as a new version under ``base`` with its manifest, then commit
    it. A version without rows is removed and refused. Returns the manifest.

    By default the version takes the next free number, whatever was committed
    meanwhile. With ``expected`` (the number of the commit it was derived from, 0
    for none) it takes ``expected + 1`` or is removed again with ``PublishConflict``.

    Rows are sorted by ``(budget_band, location)`` inside each file, so row
    groups can be skipped; with ``num_files`` they are dealt into that many
    files by ranges of the same columns. Row groups also carry a Bloom filter of
    their ids. The version's counted values, which the vocabularies are read from,
    are stored beside it, before the commit.
    """
    spark = df.sparkSession
    version = version or datetime.now(timezone.utc).strftime("v%Y%m%dT%H%M%S%f") + "-" + uuid.uuid4().hex[:6]
    target = f"{base.rstrip('/')}/{version}"
    obs = Observation("publish")
    order = [c for c in ("budget_band", "location", "id") if c in df.columns]
    if num_files:
        df = df.repartitionByRange(num_files, *order) if order else df.repartition(num_files)
    if order:
        df = df.sortWithinPartitions(*order)
    # Counted last: dealing by ranges reads its input once more to sample it.
    writer = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
    if "id" in df.columns:
        writer = writer.options(**{"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled": "true"})
    with small_splits(spark):  # a task sorts all it reads
        writer.parquet(target)
    rows = int(obs.get["rows"])
    if rows == 0:
        fs, p = _fs(spark, target)
        fs.delete(p, True)
        raise ValueError(f"nothing to publish at {base}: the ingest left no rows")
    if {"location", "budget_band", "cuisines", "metadata"} <= set(df.columns):
        count_values(spark.read.schema(df.schema).parquet(target)).write.parquet(f"{target}/{VALUES}")
    manifest = {
        "row_count": rows,
        "ingested_at": datetime.now(timezone.utc).isoformat(),
        "output_path": target,
    }
    write_text(spark, f"{target}/{MANIFEST}", json.dumps(manifest, indent=2))
    record = json.dumps({"version": version, "row_count": rows})
    while True:
        last = max(_numbers(spark, base), default=0)
        number = last + 1 if expected is None else expected + 1
        if number > last and create_text(spark, f"{base.rstrip('/')}/{COMMITS}/{number:020d}", record):
            return manifest
        if expected is not None:
            fs, p = _fs(spark, target)
            fs.delete(p, True)
            raise PublishConflict(f"{base} has moved on since version {expected}")


def retire(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Remove all but the last ``keep`` versions (readers of older ones must be
    done) and return their directories. Records go first, so that no commit names a directory that is gone."""
    if keep < 1:
        raise ValueError("keep: must be at least 1")
    found = commits(spark, base)
    old, kept = found[:-keep], {v for _, v in found[-keep:]}
    for number, _ in old:
        fs, p = _fs(spark, f"{base.rstrip('/')}/{COMMITS}/{number:020d}")
        fs.delete(p, False)
    gone = sorted({v for _, v in old} - kept)
    for version in gone:
        fs, p = _fs(spark, f"{base.rstrip('/')}/{version}")
        fs.delete(p, True)
    return gone


def read_manifest(spark: SparkSession, base: str) -> dict:
    """The manifest of the published version."""
    return json.loads(read_text(spark, f"{current_version(spark, base).rstrip('/')}/{MANIFEST}"))


def ensure_listings(spark: SparkSession, base: str, build=None, allow_build: bool = True) -> str:
    """Return ``base`` when a published table exists; otherwise run ``build()``
    (which must publish there) when allowed, else raise."""
    if commits(spark, base):
        return base
    if not allow_build or build is None:
        raise FileNotFoundError(f"{base} has no published listings and building them is not allowed")
    manifest = build()
    if not manifest or int(manifest.get("row_count", 0)) <= 0 or not commits(spark, base):
        raise RuntimeError(f"the build for {base} ended without publishing any listing")
    return base
