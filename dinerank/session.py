"""SparkSession helpers: sensible defaults and a reliable lineage cut."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app_name: str = "dinerank",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one with AQE and skew handling on.

    On a cluster the session already exists (spark-submit) and is returned
    as is; only a fresh local session gets these settings.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DINERANK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_base(spark: SparkSession) -> str:
    """The folder for intermediate tables, shared by driver and executors.

    ``spark.checkpoint.dir`` of the session, else the directory already set on
    the context. Only a local session without either gets a temporary folder
    (one machine, so every task sees it); a cluster without one is refused,
    because executors would each write to their own disk.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="dinerank-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Intermediate tables of one job, in a folder of its own.

    ``cut`` writes a frame there and returns a scan of the written table. As a
    context manager it deletes the folder on exit; otherwise the folder goes
    when the application ends (the returned lazy plans still read it). Jobs
    never share a folder, so one job's end leaves another's tables alone.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{checkpoint_base(spark)}/dinerank-{uuid.uuid4().hex}"
        self._made = False

    def _folder(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def table_path(self, name: str | None = None) -> str:
        if not self._made:
            p, fs = self._folder()
            fs.mkdirs(p)
            fs.deleteOnExit(p)
            self._made = True
        return f"{self.path}/{name or uuid.uuid4().hex}"

    def cut(self, df: DataFrame, rows_per_file: int = 0) -> DataFrame:
        """Write ``df`` once as Parquet and return a scan of the table. With
        ``rows_per_file`` no file, hence no row group, holds more rows than that.

        Survives executor loss (shared storage, not executor memory), cuts
        the lineage and gives the planner real statistics.
        ``DataFrame.checkpoint`` would evaluate the plan twice.
        """
        path = self.table_path()
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        if self._made:
            p, fs = self._folder()
            fs.delete(p, True)
            self._made = False

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def cut_lineage(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """One written intermediate table outside any job scope (see Scratch)."""
    return Scratch(df.sparkSession).cut(df, rows_per_file)


NO_LIMIT = 1 << 62


def byte_size(size: str) -> int:
    """A byte size as Spark settings write it (``67108864b``, ``8m``); less than 1 means no limit."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", size.lower()).groups()
    n = int(number) << 10 * " kmgtp".index(unit or " ")
    return n if n > 0 else NO_LIMIT


#: Bytes of files that a task reads where it has to sort what it read, rows in memory
#: taking ten times as much and more; and rows of a file written to be read so.
SPLIT_BYTES, SPLIT_ROWS = 32 << 20, 500_000
_SPLIT_SETTING = "spark.sql.files.maxPartitionBytes"
_splits_lock = threading.Lock()
_splits_before: dict = {}


@contextlib.contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Scans that start inside read at most SPLIT_BYTES a task (or one row group, which
    is never cut). The session's own setting, if larger, is back when the last of the
    jobs inside at the same time has left."""
    key = id(spark._jsparkSession)
    with _splits_lock:
        inside, before = _splits_before.get(key, (0, spark.conf.get(_SPLIT_SETTING)))
        _splits_before[key] = inside + 1, before
        if byte_size(before) > SPLIT_BYTES:
            spark.conf.set(_SPLIT_SETTING, str(SPLIT_BYTES))
    try:
        yield
    finally:
        with _splits_lock:
            inside, before = _splits_before.pop(key)
            if inside > 1:
                _splits_before[key] = inside - 1, before
            else:
                spark.conf.set(_SPLIT_SETTING, before)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``dinerank`` importable on the executors' Python workers.

    Equivalent to ``spark-submit --py-files``: zips the package once per
    SparkContext and adds it with ``addPyFile`` (served by the driver). Only
    the Python worker steps (the scorer) need it.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="dinerank-pyfiles-"), "dinerank.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
