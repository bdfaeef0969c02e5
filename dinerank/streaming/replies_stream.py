"""Requests and the late replies of an outside scorer, joined as streams.

Prompts leave for a scorer of which only the replies come back, some late and
some never. Requests and replies are two streams with event times; a stateful
join holds a request until a reply stands within its time limit or until the
streams' clock has passed the limit. A request without a reply in time gets a
null reply, and so the rating fallback.

The state holds the requests and replies of one time limit only, keyed by
request, so it is bounded by the arrival rate and spread over all tasks. A
batch that reads a whole backlog holds all of that, so the state lies in
RocksDB on the executors' disks, not in their heaps.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dinerank.params import DEFAULT, Params
from dinerank.schemas import REPLY, REQUEST
from dinerank.session import Scratch

ASKED = T.StructType([*REQUEST.fields, T.StructField("asked_at", T.TimestampType())])
REPLIED = T.StructType([*REPLY.fields, T.StructField("replied_at", T.TimestampType())])

_POLICY = "spark.sql.streaming.multipleWatermarkPolicy"
_STATE = "spark.sql.streaming.stateStore"
#: The state store of a session that names none; the memory is that of all an executor's stores together. A join's
#: partition has one store (format 3), not four: each sets 4 MB of disk aside, however little it holds.
_STORE = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


@contextlib.contextmanager
def _query_settings(spark: SparkSession) -> Iterator[None]:
    """Settings that a query started inside keeps; the session has its own again afterwards."""
    named = f"{_STATE}.providerClass" in spark.conf.getAll
    settings = {_POLICY: "max"} | ({} if named else _STORE)
    before = {k: v for k, v in spark.conf.getAll.items() if k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in settings:
            spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


def replies_in_time(asked: DataFrame, replied: DataFrame, time_limit: str = "10 minutes", lateness: str = "1 minute") -> DataFrame:
    """``request_id, asked_at, request, raw``: one row per request asked, with its
    first reply within ``time_limit``, or a null ``raw``.

    ``asked`` has the columns of a request and ``asked_at``, ``replied`` those of a
    reply and ``replied_at``; both are streams, or both tables (the same rows
    result). A reply counts from ``asked_at`` to ``asked_at + time_limit``, both
    included; of several the earliest with a text, then the least text. Replies
    nobody asked for, and those without a time, count for nothing; so does a
    request without a time. A request that is read twice with one time is
    answered once. As streams, rows more than ``lateness`` behind the newest
    event read so far may be too late to be counted, requests included: choose
    it above the delay with which files are seen.
    """
    request = F.struct(*[F.col(f.name) for f in REQUEST.fields])
    left = asked.where("request_id is not null and asked_at is not null").select(
        F.col("request_id").alias("_asked"), "asked_at", request.alias("request")).withWatermark("asked_at", lateness)
    right = replied.where("request_id is not null and replied_at is not null").select(
        F.col("request_id").alias("_replied"), "raw", "replied_at").withWatermark("replied_at", lateness)
    limit = F.expr(f"interval {time_limit}")
    within = (F.col("_asked") == F.col("_replied")) & (F.col("replied_at") >= F.col("asked_at")) & (
        F.col("replied_at") <= F.col("asked_at") + limit)
    order = F.struct(F.col("raw").isNull(), F.col("replied_at"), F.col("raw"))
    return left.join(right, within, "left").groupBy("asked_at", F.col("_asked").alias("request_id")).agg(
        F.min("request").alias("request"), F.min_by("raw", order).alias("raw")).select("request_id", "asked_at", "request", "raw")


def answer_reply_stream(spark: SparkSession, listings_base: str, requests_dir: str, replies_dir: str, output_dir: str,
                        checkpoint_location: str, time_limit: str = "10 minutes", lateness: str = "1 minute",
                        params: Params = DEFAULT, available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Answer requests (files of ASKED rows) with the replies (files of REPLIED
    rows) that come in time; returns the running query.

    Either stream moves the clock on: the newest time read in any of them, less
    ``lateness``. A request whose limit the clock has not passed is held in the
    state, and answered by a later batch, or by a later run from the same
    checkpoint. Output as of :func:`~dinerank.streaming.requests_stream.answer_request_stream`:
    one folder per micro-batch, replaced when the batch is run again.
    """
    from dinerank.plans.recommend import recommend
    from dinerank.sources.listings import scan_listings

    def read(schema: T.StructType, path: str) -> DataFrame:
        reader = spark.readStream.schema(schema)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
        return reader.parquet(path)

    def answer(batch: DataFrame, epoch_id: int) -> None:
        with Scratch(spark) as scratch:
            decided = scratch.cut(batch)  # the join's state is read once, whatever follows
            listings = scan_listings(spark, listings_base)
            if decided.isEmpty():  # the clock has passed no request's limit: nothing is asked of the listings
                listings = listings.where(F.lit(False))
            recs, responses = recommend(listings, decided.select("request.*"), decided.select("request_id", "raw"), params=params, scratch=scratch)
            recs.write.mode("overwrite").parquet(f"{output_dir}/recommendations/epoch={epoch_id}")
            responses.write.mode("overwrite").parquet(f"{output_dir}/responses/epoch={epoch_id}")

    decided = replies_in_time(read(ASKED, requests_dir), read(REPLIED, replies_dir), time_limit, lateness)
    writer = decided.writeStream.outputMode("append").foreachBatch(answer).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    with _query_settings(spark):
        return writer.start()
