"""Late replies joined with their requests, as streams and as tables."""

import tempfile
from datetime import datetime, timedelta

from conftest import make_requests
from pyspark.sql import functions as F

from dinerank.sources import listings as io
from dinerank.streaming.replies_stream import ASKED, REPLIED, answer_reply_stream, replies_in_time
from dinerank.streaming.requests_stream import read_answers

T0 = datetime(2024, 1, 1, 12)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def asked(spark, rows):
    return spark.createDataFrame([(i, "bangalore", "medium", "indian", 0.0, None, 5, t) for i, t in rows], ASKED)


def test_the_first_reply_in_time_counts(spark):
    requests = asked(spark, [(1, at(0)), (2, at(0)), (3, at(0)), (4, at(0)), (5, at(0)), (5, at(0)), (6, None), (7, at(0))])
    replies = spark.createDataFrame([
        (1, "late", at(11)), (1, "first", at(3)), (1, "second", at(4)), (2, "edge", at(10)), (3, "too late", at(10.1)),
        (3, "too early", at(-1)), (5, None, at(1)), (5, "b", at(2)), (5, "a", at(2)), (6, "x", at(1)), (7, "no time", None), (9, "nobody asked", at(1))], REPLIED)
    got = {r["request_id"]: r["raw"] for r in replies_in_time(requests, replies).collect()}
    assert got == {1: "first", 2: "edge", 3: None, 4: None, 5: "a", 7: None}
    assert replies_in_time(requests.limit(0), replies).collect() == []
    assert all(r["raw"] is None for r in replies_in_time(requests, replies.limit(0)).collect())


def test_streamed_replies_equal_the_table_join_over_several_runs(spark, scenario_listings):
    root = tempfile.mkdtemp()
    io.publish(scenario_listings, f"{root}/listings")
    rows = [(k, at(k)) for k in range(8)]
    ids = [r["id"] for r in scenario_listings.where(F.col("location").contains("angalore")).select("id").collect()]
    doc = '{"summary": "s", "recommendations": [{"restaurant_id": "%s", "rank": 1, "explanation": "good"}]}' % ids[0]
    # Even ones reply after 2 minutes, two after 15, the rest never.
    replies = [(k, doc, at(k + 2)) for k in range(0, 8, 2)] + [(1, doc, at(16)), (3, doc, at(18))]
    run = lambda: answer_reply_stream(
        spark, f"{root}/listings", f"{root}/requests", f"{root}/replies", f"{root}/out", f"{root}/ckpt").awaitTermination()
    policy = spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy")
    asked(spark, rows[:4]).coalesce(1).write.parquet(f"{root}/requests")
    spark.createDataFrame(replies[:2], REPLIED).coalesce(1).write.parquet(f"{root}/replies")
    run()
    asked(spark, rows[4:]).coalesce(1).write.mode("append").parquet(f"{root}/requests")
    spark.createDataFrame(replies[2:4], REPLIED).coalesce(1).write.mode("append").parquet(f"{root}/replies")
    run()
    spark.createDataFrame([*replies[4:], (-1, None, at(600))], REPLIED).coalesce(1).write.mode("append").parquet(f"{root}/replies")
    run()
    status = [(r["request_id"], r["status"]) for r in read_answers(spark, f"{root}/out", "responses").collect()]
    table = replies_in_time(asked(spark, rows), spark.createDataFrame(replies, REPLIED)).collect()
    assert sorted(status) == [(r["request_id"], "success" if r["raw"] else "fallback") for r in sorted(table)]
    assert sum(s == "success" for _, s in status) == 4
    assert spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy") == policy


def test_unanswered_requests_wait_for_the_clock(spark, scenario_listings):
    root = tempfile.mkdtemp()
    io.publish(scenario_listings, f"{root}/listings")
    make_requests(spark, [{"location": "bangalore", "budget": "medium", "cuisine": "indian", "min_rating": 0.0}]).withColumn(
        "asked_at", F.lit(at(0))).select(*ASKED.names).write.parquet(f"{root}/requests")
    spark.createDataFrame([(-1, None, at(5))], REPLIED).write.parquet(f"{root}/replies")
    args = (spark, f"{root}/listings", f"{root}/requests", f"{root}/replies", f"{root}/out", f"{root}/ckpt")
    answer_reply_stream(*args).awaitTermination()
    assert read_answers(spark, f"{root}/out", "responses").count() == 0
    spark.createDataFrame([(-1, None, at(30))], REPLIED).write.mode("append").parquet(f"{root}/replies")
    answer_reply_stream(*args).awaitTermination()
    assert [r["status"] for r in read_answers(spark, f"{root}/out", "responses").collect()] == ["fallback"]
