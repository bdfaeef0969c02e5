"""Findings of round 4 on tables of 1 and 6 GB: the disk that all pairs take."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import make_requests
from dinerank.operators import match
from dinerank.session import Scratch
from dinerank.sources import fixtures as fx

THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


@pytest.fixture
def no_broadcasts(spark):
    before = spark.conf.get(THRESHOLD)
    spark.conf.set(THRESHOLD, "-1")
    yield
    spark.conf.set(THRESHOLD, before)


def _many(spark, scenario_listings, ratings):
    """Every listing of the scenario with each rating; ids come twice, one is null."""
    own = spark.createDataFrame([(k, r) for k, r in enumerate(ratings)], "_k int, _r double")
    rows = scenario_listings.crossJoin(own).withColumns({
        "id": F.when(F.col("_k") != 3, F.concat("id", F.lit("-"), (F.col("_k") / 2).cast("int"))), "rating": F.col("_r")})
    return rows.select(*scenario_listings.columns)


def _asked(spark, n):
    places, foods = ["bangalore", "delhi", "central", "new", "nowhere"], ["indian", "mughlai", "chinese", "e", "x"]
    rows = [{"location": places[k % 5], "cuisine": foods[k // 5 % 5], "budget": ("low", "medium", "high")[k % 3],
             "min_rating": (0.0, 2.25, 4.0, 0.1 + 0.2, 5.0, 7.0)[k % 6]} for k in range(n)]
    return make_requests(spark, rows).withColumn("request_id", F.when(F.col("request_id") != 10, F.col("request_id")))


def _pairs(df):
    return Counter(tuple(r) for r in df.collect())


def _brute(lst, req):
    valid = [r for r in match.valid_requests(req).collect()]
    return Counter(
        (r["request_id"], x["id"]) for r in valid for x in lst.collect()
        if x["rating"] is not None and x["budget_band"] == r["budget"] and r["loc_q"] in x["location"]
        and any(r["cui_q"] in c for c in x["cuisines"]) and (x["rating"] != x["rating"] or x["rating"] >= r["min_rating"]))


def test_all_pairs_in_every_plan(spark, scenario_listings, monkeypatch):
    monkeypatch.setattr(match, "_RUN", 3)
    monkeypatch.setattr(match, "_BLOCK", 2)
    monkeypatch.setattr(match, "_TILE", 20)
    lst = _many(spark, scenario_listings, [None, float("nan"), -0.5, 0.0, 0.3, 2.25, 4.0, 4.0, 4.0, 5.0, 5.5]).cache()
    req = _asked(spark, 90).unionByName(_asked(spark, 7)).cache()
    wanted = _brute(lst, req)
    assert sum(wanted.values()) > 200 and any(a is None for a, _ in wanted) and any(b is None for _, b in wanted)
    assert _pairs(match.batch_match(lst, req)) == wanted
    with Scratch(spark) as scratch:
        sent = match.batch_match(lst, req, scratch=scratch)
        assert "SortMergeJoin" not in sent._jdf.queryExecution().executedPlan().toString()
        assert _pairs(sent) == wanted
    monkeypatch.setattr(match, "_SENT_BYTES", 0)
    with Scratch(spark) as scratch:
        merged = match.batch_match(lst, req, scratch=scratch)
        assert "SortMergeJoin" in merged._jdf.queryExecution().executedPlan().toString()
        assert _pairs(merged) == wanted
        assert _pairs(match.batch_match(lst.limit(0), req, scratch=scratch)) == Counter()


def test_a_session_without_broadcasts_merges(spark, scenario_listings, no_broadcasts):
    req = _asked(spark, 30)
    with Scratch(spark) as scratch:
        merged = match.batch_match(scenario_listings, req, scratch=scratch)
        assert "BroadcastHashJoin" not in merged._jdf.queryExecution().executedPlan().toString()
        assert _pairs(merged) == _brute(scenario_listings, req)


def test_written_pairs_take_a_fraction_of_a_byte(spark, scenario_listings, tmp_path):
    rng = random.Random(3)
    lst = _many(spark, scenario_listings, [rng.randrange(51) / 10 for _ in range(1500)]).withColumn(
        "id", F.substring(F.sha2(F.concat("name", F.monotonically_increasing_id()), 256), 1, 16))
    lst.write.parquet(f"{tmp_path}/lst")
    req = make_requests(spark, [{"location": "bangalore", "budget": "medium", "cuisine": ("indian", "chinese")[k % 2],
                                 "min_rating": k % 10 / 2} for k in range(400)])
    with Scratch(spark) as scratch:
        match.batch_match(spark.read.parquet(f"{tmp_path}/lst"), req, scratch=scratch).write.parquet(f"{tmp_path}/out")
    pairs = spark.read.parquet(f"{tmp_path}/out").count()
    written = sum(p.stat().st_size for p in Path(f"{tmp_path}/out").glob("*.parquet"))
    assert pairs > 500_000 and written < 0.4 * pairs


def test_raw_listings_take_one_shuffle_of_the_line_items(spark, tmp_path, no_broadcasts):
    d = str(tmp_path)
    spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (1, 2, 4.0), (2, 1, 5.0), (None, 1, 6.0), (2, None, 7.0), (9, 1, 8.0)],
                          "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(1, "a", "B1", "T1", 40), (2, "b", "B2", "T2", 35)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(1, "s1", 0), (2, "s2", 0)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{d}/supplier.parquet")
    spark.createDataFrame([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{d}/nation.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(f"{d}/region.parquet")
    rows = fx.raw_listings(spark, d)
    assert sorted((r["row_index"], r["votes"]) for r in rows.collect()) == [(1_000_001, "5"), (1_000_002, "4"), (2_000_001, "5")]
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("HashAggregate") == 2
    qty = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_partkey", "l_suppkey").count()
    joined = fx.raw_listings(spark, d).select("row_index")
    dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(l_partkey")
    assert dealt(joined) == 1 and dealt(qty) == 1
