"""Raw scan, substring join, rejected requests, scorer limits and labels."""

import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from conftest import make_requests, raw_df, raw_row
from dinerank.operators import display, match, merge, score, vocab
from dinerank.operators.ingest import ingest, with_row_index
from dinerank.plans.recommend import main, recommend
from dinerank.schemas import RAW_COLUMNS
from dinerank.session import Scratch
from dinerank.sources import listings as io
from dinerank.streaming.requests_stream import answer_request_stream


def _csv(path, header, rows):
    os.makedirs(path)
    with open(f"{path}/a.csv", "w", encoding="utf-8") as f:
        for r in [header, *rows]:
            f.write(",".join('"' + str(x) + '"' for x in r) + "\n")


def test_csv_is_bound_by_header_and_gets_positions(spark):
    root = tempfile.mkdtemp()
    header = list(reversed(RAW_COLUMNS))
    rows = [[raw_row(i, name="Same", rate="4.5/5")[c] or "" for c in header] for i in (0, 0)]
    _csv(f"{root}/raw", header, rows)
    out = ingest(io.scan_raw(spark, f"{root}/raw", "csv")).collect()
    assert len(out) == 2 and {r["rating"] for r in out} == {4.5}
    assert len({r["id"] for r in out}) == 2
    assert sorted(r["metadata"]["source_row_index"] for r in out) == [0, 1]


def test_missing_required_columns_are_noticed_at_the_scan(spark):
    root = tempfile.mkdtemp()
    raw_df(spark, [raw_row(0)]).drop("rate", "cuisines").write.parquet(f"{root}/raw")
    with pytest.raises(ValueError, match="cuisines, rate"):
        io.scan_raw(spark, f"{root}/raw")


def test_positions_follow_files_and_rows(spark):
    root = tempfile.mkdtemp()
    df = raw_df(spark, [raw_row(i, name=f"P{i}") for i in range(50)]).drop("row_index")
    df.coalesce(1).sortWithinPartitions(F.length("name"), "name").write.parquet(f"{root}/raw/a")
    got = io.scan_raw(spark, f"{root}/raw/a").orderBy("row_index").select("name", "row_index").collect()
    assert [r["row_index"] for r in got] == list(range(50))
    assert [r["name"] for r in got] == [f"P{i}" for i in range(50)]
    free = with_row_index(spark.range(0, 20, 1, 5).select(F.col("id").cast("string").alias("x")))
    assert [(r["x"], r["row_index"]) for r in free.orderBy("row_index").collect()] == [(str(i), i) for i in range(20)]


def test_a_null_position_is_an_error(spark):
    df = raw_df(spark, [raw_row(0)]).withColumn("row_index", F.lit(None).cast("long"))
    with pytest.raises(Exception, match="null row_index"):
        ingest(df).collect()


def test_substring_pairs_with_a_shared_prefix(spark):
    n = 300
    q = spark.range(n).select(F.concat(F.lit("bangalore sector "), F.col("id").cast("string")).alias("q"))
    t = q.withColumnRenamed("q", "t")
    pairs = match.substring_pairs(q, "q", t, "t")
    want = {(f"bangalore sector {a}", f"bangalore sector {b}") for a in range(n) for b in range(n) if str(b).startswith(str(a))}
    assert {(r["q"], r["t"]) for r in pairs.collect()} == want
    plan = pairs._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    short = spark.createDataFrame([("",), ("b",), ("ba",), ("zz",), ("zzzz",)], "q string")
    got = {(r["q"], r["t"]) for r in match.substring_pairs(short, "q", spark.createDataFrame([("bax",), ("z",), ("",)], "t string"), "t").collect()}
    assert got == {("", "bax"), ("", "z"), ("", ""), ("b", "bax"), ("ba", "bax")}


def test_every_request_is_answered(spark, scenario_listings):
    req = make_requests(spark, [
        {"location": "bangalore", "budget": "medium", "cuisine": "indian", "min_rating": 0.0, "top_k": 2},
        {"location": " ", "budget": "medium", "cuisine": "indian", "min_rating": 0.0},
        {"location": "bangalore", "budget": "cheap", "cuisine": "indian", "min_rating": 0.0},
    ])
    _, responses = recommend(scenario_listings, req)
    got = {r["request_id"]: (r["status"], r["message"]) for r in responses.collect()}
    assert got[0][0] == "fallback"
    assert got[1] == ("rejected", "location: must not be empty")
    assert got[2] == ("rejected", "budget: must be one of low, medium, high")


def test_the_stream_refuses_an_unpublished_table(spark):
    root = tempfile.mkdtemp()
    os.makedirs(f"{root}/listings")
    make_requests(spark, [{"location": "x", "budget": "low", "cuisine": "y", "min_rating": 0.0}]).write.parquet(f"{root}/requests")
    q = answer_request_stream(spark, f"{root}/listings", f"{root}/requests", f"{root}/out", f"{root}/ckpt")
    with pytest.raises(Exception, match="holds no rows"):
        q.awaitTermination()
    assert not os.path.exists(f"{root}/out/responses")


def test_building_a_plan_writes_nothing(spark, scenario_listings):
    req = make_requests(spark, [{"location": "bangalore", "budget": "medium", "cuisine": "indian", "min_rating": 0.0}])
    scratch = Scratch(spark)
    match.batch_match(scenario_listings, req)
    match.select_candidates(scenario_listings, req)
    match.count_cuisine_matches(scenario_listings, req)
    assert not scratch._made


def _prompts(spark, n):
    return spark.range(n).select(F.col("id").alias("request_id"), F.array(
        F.struct(F.lit("user").alias("role"), F.lit('{"allowed_ids":["a"]}').alias("content"))).alias("messages"))


def test_scorer_tasks_timeout_and_calls(spark):
    log = tempfile.mkdtemp()

    def counting(messages):
        import os
        import uuid

        from pyspark import TaskContext

        open(f"{log}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}", "w").close()
        return "{}"

    out = score.score_prompts(_prompts(spark, 40).coalesce(1), counting, partitions=8).collect()
    calls = os.listdir(log)
    assert len(out) == 40 and len(calls) == 40 and len({c.split("-")[0] for c in calls}) == 8

    def slow(messages):
        import time

        time.sleep(5)

    began = time.time()
    row = score.score_prompts(_prompts(spark, 1), slow, max_retries=1, timeout_seconds=0.2, partitions=1).first()
    assert row["raw"] is None and row["error"].startswith("TimeoutError") and row["attempts"] == 2
    assert time.time() - began < 20


def test_labels_are_literal(spark):
    rows = spark.createDataFrame([("low", 1234567.0), ("medium", 0.5), ("high", None), (None, 1500.0)], "band string, cost double")
    got = rows.select(display.budget_chip(F.col("band")), display.budget_label(F.col("band")), display.cost_label(F.col("cost"))).collect()
    assert [tuple(r) for r in got] == [
        ("Low Budget", "low", "₹1,234,567 for two"), ("Medium Budget", "medium", "₹0 for two"),
        ("High Budget", "high", "N/A"), ("Unknown budget", "unknown", "₹1,500 for two")]
    assert merge.FALLBACK_SUMMARY == "Showing top %s rated matches for %s in %s within a %s budget."
    assert merge.GENERIC_EXPLANATION == "Highly rated option in %s serving %s, matching your %s budget and minimum rating of %s."


def test_lookup_keeps_order_and_repeats(spark, scenario_listings):
    ids = [r["id"] for r in scenario_listings.select("id").limit(2).collect()]
    wanted = spark.createDataFrame([(0, ids[1]), (1, "unknown"), (2, ids[0]), (3, ids[1])], "pos int, id string")
    assert [r["id"] for r in io.lookup_by_ids(scenario_listings, wanted).collect()] == [ids[1], ids[0], ids[1]]


def test_publish_refuses_and_removes_an_empty_version(spark, scenario_listings):
    root = tempfile.mkdtemp()
    with pytest.raises(ValueError):
        io.publish(scenario_listings.limit(0), f"{root}/t")
    assert not os.path.exists(f"{root}/t") or not [f for f in os.listdir(f"{root}/t") if not f.startswith(".")]
    io.publish(scenario_listings, f"{root}/t", num_files=2)
    version = io.current_version(spark, f"{root}/t")
    assert os.path.exists(f"{version}/{io.MANIFEST}")
    assert io.read_manifest(spark, f"{root}/t")["row_count"] == scenario_listings.count()
    assert vocab.cuisine_picker_at(spark, f"{root}/none").count() == len(vocab.FALLBACK_CUISINES)
    assert vocab.cuisine_picker_at(spark, f"{root}/t").count() > 0


def test_prompt_command_and_settings(spark, scenario_listings):
    root = tempfile.mkdtemp()
    io.publish(scenario_listings, f"{root}/t")
    make_requests(spark, [{"location": "bangalore", "budget": "medium", "cuisine": "indian", "min_rating": 0.0,
                           "top_k": 2}]).write.parquet(f"{root}/requests")
    common = ["--listings", f"{root}/t", "--requests", f"{root}/requests"]
    assert main(["prompts", *common, "--output", f"{root}/p", "--max-candidates", "1"]) == 0
    assert len(spark.read.parquet(f"{root}/p").first()["allowed_ids"]) == 1
    assert main(["prompts", *common, "--output", f"{root}/q", "--max-candidates", "0"]) == 1


def test_merge_follows_top_k(spark):
    cands = spark.range(40).select(
        F.lit(1).cast("long").alias("request_id"), (F.col("id") + 1).alias("pos"), F.col("id").cast("string").alias("id"),
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit("l").alias("location"), F.array(F.lit("c")).alias("cuisines"),
        F.lit(4.0).alias("rating"), F.lit(1.0).alias("estimated_cost"), F.lit("low").alias("budget_band"), F.lit(1).cast("long").alias("votes"))
    req = spark.createDataFrame([(1, "c", "low", 0.0, 35)], "request_id long, cuisine string, budget string, min_rating double, top_k int")
    assert merge.merge_recommendations(None, cands, req).count() == 35
    assert merge.merge_recommendations(None, cands, req, max_top_k=20).count() == 20
