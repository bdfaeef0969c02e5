"""The spark-submit entry points and the streaming request path."""

import os
import tempfile

from conftest import make_requests, raw_df, raw_row
from dinerank.plans.recommend import main
from dinerank.session import Scratch, checkpoint_base
from dinerank.sources import listings as io
from dinerank.streaming.requests_stream import answer_request_stream, read_answers


def test_ingest_and_recommend_cli(spark):
    root = tempfile.mkdtemp()
    raw_df(spark, [raw_row(i, name=f"P{i}", rate=f"{3 + i % 3}.0/5") for i in range(6)]).write.parquet(f"{root}/raw")
    assert main(["ingest", "--raw", f"{root}/raw", "--output", f"{root}/listings"]) == 0
    assert io.read_manifest(spark, f"{root}/listings")["row_count"] == 6
    make_requests(spark, [{"location": "koramangala", "budget": "medium", "cuisine": "north", "min_rating": 0.0,
                           "top_k": 2}]).write.parquet(f"{root}/requests")
    assert main(["recommend", "--listings", f"{root}/listings", "--requests", f"{root}/requests",
                 "--output", f"{root}/out"]) == 0
    recs = spark.read.parquet(f"{root}/out/recommendations").orderBy("rank").collect()
    assert [r["rank"] for r in recs] == [1, 2] and recs[0]["rating"] == 5.0
    assert spark.read.parquet(f"{root}/out/responses").first()["status"] == "fallback"
    # the job removed the intermediate tables it wrote, and only those
    base = checkpoint_base(spark)
    kept = Scratch(spark).cut(spark.range(3))
    before = set(os.listdir(base.removeprefix("file:")))
    assert main(["recommend", "--listings", f"{root}/listings", "--requests", f"{root}/requests",
                 "--output", f"{root}/out2"]) == 0
    assert set(os.listdir(base.removeprefix("file:"))) == before
    assert kept.count() == 3
    # a failing job reports exit code 1 instead of raising
    assert main(["ingest", "--raw", f"{root}/missing", "--output", f"{root}/x"]) == 1


def test_request_stream(spark, scenario_listings):
    root = tempfile.mkdtemp()
    io.publish(scenario_listings, f"{root}/listings")
    req = make_requests(spark, [
        {"location": "bangalore", "budget": "medium", "cuisine": "indian", "min_rating": 0.0, "top_k": 2},
        {"location": "tokyo", "budget": "medium", "cuisine": "indian", "min_rating": 0.0},
    ])
    req.write.parquet(f"{root}/requests/part1")
    q = answer_request_stream(spark, f"{root}/listings", f"{root}/requests/part1", f"{root}/out", f"{root}/ckpt")
    q.awaitTermination()
    recs = read_answers(spark, f"{root}/out").orderBy("rank").collect()
    assert [r["name"] for r in recs] == ["Spice Elephant", "Mughlai Magic"]
    statuses = {r["request_id"]: r["status"] for r in read_answers(spark, f"{root}/out", "responses").collect()}
    assert statuses == {0: "fallback", 1: "empty"}
    assert os.path.isdir(f"{root}/ckpt")


def test_scratch_folders_are_separate_and_the_base_does_not_grow(spark):
    base = checkpoint_base(spark)
    with Scratch(spark) as first:
        a = first.cut(spark.range(2))
        second = Scratch(spark)
        b = second.cut(spark.range(3))
        assert a.count() == 2
    assert b.count() == 3  # the first job's end left the second's table
    second.close()
    for _ in range(300):
        assert checkpoint_base(spark) == base
        Scratch(spark).table_path()
    with Scratch(spark) as again:
        assert again.cut(spark.range(1)).count() == 1


def test_a_cluster_without_a_shared_folder_is_refused():
    import pytest

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError):
        checkpoint_base(Session())
