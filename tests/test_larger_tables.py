"""Findings of round 3 on tables of 1 and 6 GB: what a publishing task sorts, in which order all pairs are written."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from conftest import make_requests
from dinerank import session
from dinerank.operators import match
from dinerank.sources import listings as io

SETTING = "spark.sql.files.maxPartitionBytes"


def test_a_publishing_task_sorts_no_more_than_a_split(spark, scenario_listings, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "SPLIT_BYTES", 1 << 20)
    before = spark.conf.get(SETTING)
    many = scenario_listings.crossJoin(spark.range(0, 320, 1, 1).withColumnRenamed("id", "k")).withColumn(
        "id", F.concat("id", F.lit("-"), "k")).drop("k").coalesce(1)
    cut = session.cut_lineage(many, 100)
    io.publish(cut, str(tmp_path))
    files = io.scan_listings(spark, str(tmp_path)).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert max(r["n"] for r in files) <= 100 and sum(r["n"] for r in files) == many.count()
    got = io.scan_listings(spark, str(tmp_path))
    assert sorted(got.collect(), key=lambda r: r["id"]) == sorted(many.collect(), key=lambda r: r["id"])
    assert spark.conf.get(SETTING) == before


def test_small_splits_leave_the_sessions_setting(spark):
    before = spark.conf.get(SETTING)
    try:
        with session.small_splits(spark), session.small_splits(spark):
            assert session.byte_size(spark.conf.get(SETTING)) == session.SPLIT_BYTES
        assert spark.conf.get(SETTING) == before
        spark.conf.set(SETTING, "2m")
        with session.small_splits(spark):
            assert spark.conf.get(SETTING) == "2m"
        assert spark.conf.get(SETTING) == "2m"
    finally:
        spark.conf.set(SETTING, before)


def _rated(spark, scenario_listings, ratings):
    rows = scenario_listings.where("name = 'Jalsa'").drop("rating", "id")
    own = spark.createDataFrame([(f"l{k}", r) for k, r in enumerate(ratings)], "id string, rating double")
    return rows.crossJoin(own).select(*scenario_listings.columns)


def test_all_pairs_at_odd_ratings(spark, scenario_listings):
    ratings = [None, float("nan"), -0.5, 0.0, 0.1, 0.3, 0.1 + 0.2, 2.3, 2.9, 4.35, 4.999999, 5.0, 5.5, 7.0, 4.0, 4.0]
    asked = [0.0, 0.3, 0.1 + 0.2, 2.3, 2.25, 4.35, 4.4, 5.0, 5.0, 4.0, 0.05]
    lst = _rated(spark, scenario_listings, ratings)
    req = make_requests(spark, [{"location": "bangalore", "budget": "medium", "cuisine": "mughlai", "min_rating": m} for m in asked])
    got = sorted(tuple(r) for r in match.batch_match(lst, req.unionByName(req.limit(1))).collect())
    wanted = [(i, f"l{k}") for i, m in [*enumerate(asked), (0, asked[0])] for k, r in enumerate(ratings) if r is not None and (r != r or r >= m)]
    assert got == sorted(wanted)


def test_the_pairs_of_a_listing_follow_each_other(spark, scenario_listings):
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    rng = random.Random(5)
    lst = _rated(spark, scenario_listings, [rng.randrange(51) / 10 for _ in range(300)])
    req = make_requests(spark, [{"location": "bangalore", "budget": "medium", "cuisine": "mughlai", "min_rating": k % 10 / 2} for k in range(40)])
    try:
        spark.conf.set(threshold, "-1")  # as on tables too large to broadcast
        pairs = match.batch_match(lst, req).join(F.broadcast(lst.select(F.col("id").alias("listing_id"), "rating")), "listing_id").collect()
    finally:
        spark.conf.set(threshold, before)
    for k in ("listing_id", "rating"):
        runs = sum(a[k] != b[k] for a, b in zip(pairs, pairs[1:], strict=False)) + 1
        assert runs == len({r[k] for r in pairs}), k
