"""Filter scenario (ten listings, cap 3), request validation, batch
properties and equality of the coalesced plan with a brute-force plan."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import make_requests
from dinerank.operators import match
from dinerank.params import Params
from dinerank.session import Scratch

CAP3 = Params(max_candidates=3)


def run(spark, listings, **req):
    base = {"location": "bangalore", "budget": "medium", "cuisine": "indian", "min_rating": 0.0}
    base.update(req)
    cands, stats = match.select_candidates(listings, make_requests(spark, [base]), CAP3)
    names = [r["name"] for r in cands.orderBy("pos").collect()]
    st = stats.first()
    return names, st


def test_city_substring(spark, scenario_listings):
    names, st = run(spark, scenario_listings)
    assert names and not st["is_empty"]
    assert "Delhi Darbar" not in names


def test_unknown_location_is_empty(spark, scenario_listings):
    names, st = run(spark, scenario_listings, location="tokyo")
    assert names == [] and st["is_empty"] and st["total_before_cap"] == 0


def test_budget_band(spark, scenario_listings):
    names, _ = run(spark, scenario_listings, budget="low")
    assert "Budget Bites" in names


def test_unknown_band_never_matches(spark, scenario_listings):
    names, st = run(spark, scenario_listings, cuisine="cafe")
    assert st["is_empty"]


def test_partial_cuisine_case_insensitive(spark, scenario_listings):
    names, _ = run(spark, scenario_listings, cuisine="Indian")
    assert names


def test_italian(spark, scenario_listings):
    names, st = run(spark, scenario_listings, budget="high", cuisine="italian")
    assert names == ["Premium Palace"]


def test_min_rating(spark, scenario_listings):
    names, _ = run(spark, scenario_listings, budget="low", min_rating=4.0)
    assert "Low Rated Spot" not in names and "Budget Bites" in names


def test_cap_and_sort(spark, scenario_listings):
    names, st = run(spark, scenario_listings)
    assert len(names) == 3
    assert names[0] == "Spice Elephant"
    assert st["total_before_cap"] == 5 and st["was_capped"] and st["candidate_count"] == 3


def test_single_candidate_not_capped(spark, scenario_listings):
    names, st = run(spark, scenario_listings, budget="high", cuisine="italian", min_rating=4.0)
    assert len(names) == 1 and st["total_before_cap"] == 1 and not st["was_capped"]


def test_total_counts_before_dedup(spark):
    from conftest import raw_df, raw_row
    from dinerank.operators.ingest import ingest

    rows = [raw_row(0, name="Twin"), raw_row(1, name=" twin ", rate="4.5/5"), raw_row(2, name="Other")]
    lst = ingest(raw_df(spark, rows))
    cands, stats = match.select_candidates(lst, make_requests(spark, [
        {"location": "koramangala", "budget": "medium", "cuisine": "north", "min_rating": 0.0}]))
    assert stats.first()["total_before_cap"] == 3
    got = [(r["name"], r["rating"]) for r in cands.orderBy("pos").collect()]
    assert got == [("twin", 4.5), ("Other", 4.0)]
    assert stats.first()["was_capped"]  # dedup alone shrank the list


def test_literal_substring_not_like(spark, scenario_listings):
    names, st = run(spark, scenario_listings, location="b_ngalore")
    assert st["is_empty"]


def test_validation_reasons(spark):
    reqs = make_requests(spark, [
        {"location": "  ", "budget": "low", "cuisine": "x", "min_rating": 1.0},
        {"location": "a", "budget": "Low", "cuisine": "x", "min_rating": 1.0},
        {"location": "a", "budget": "low", "cuisine": " ", "min_rating": 1.0},
        {"location": "a", "budget": "low", "cuisine": "x", "min_rating": 5.5},
        {"location": "a", "budget": "low", "cuisine": "x", "min_rating": float("nan")},
        {"location": "a", "budget": "low", "cuisine": "x", "min_rating": 1.0, "top_k": 21},
        {"location": "a", "budget": "low", "cuisine": "x", "min_rating": 1.0, "top_k": None},
        {"location": "  ", "budget": "bad", "cuisine": "", "min_rating": 9.0, "top_k": 0},
    ])
    got = [r["reject_reason"] for r in match.validate_requests(reqs).orderBy("request_id").collect()]
    assert got == [match.REJECT_LOCATION, match.REJECT_BUDGET, match.REJECT_CUISINE, match.REJECT_MIN_RATING,
                   match.REJECT_MIN_RATING, match.REJECT_TOP_K, None, match.REJECT_LOCATION]
    v = match.valid_requests(reqs).first()
    assert v["top_k"] == 5 and v["additional_preferences"] is None


def test_substring_pairs_exact(spark):
    qs = spark.createDataFrame([(q,) for q in ["a", "ab", "abc", "bcd", "zz", "", "x%"]], "q string")
    ts = spark.createDataFrame([(t,) for t in ["abcd", "xab", "b", "", "x%y"]], "t string")
    got = {(r["q"], r["t"]) for r in match.substring_pairs(qs, "q", ts, "t").collect()}
    want = {(q, t) for q in ["a", "ab", "abc", "bcd", "zz", "", "x%"] for t in ["abcd", "xab", "b", "", "x%y"] if q in t}
    assert got == want


def brute_force(listings, requests, cap):
    """Per-request theta join + two windows: the plain plan."""
    req = match.valid_requests(requests)
    lst = match.listing_columns(listings)
    m = req.select("request_id", "loc_q", "budget", "cui_q", "min_rating").join(
        lst,
        F.contains(lst.location, F.col("loc_q")) & (lst.budget_band == F.col("budget"))
        & match.cuisine_match(F.col("cui_q")) & (lst.rating >= F.col("min_rating")),
    )
    d = match.dedup_by_name(m, ["request_id"])
    return match.cap_by_quality(d, ["request_id"], cap)


def test_coalesced_plan_equals_brute_force(spark):
    from dinerank.operators.ingest import ingest
    from dinerank.sources import fixtures as fx

    sf = "/root/testdata/sf0.001"
    lst = ingest(fx.raw_listings(spark, sf)).cache()
    req = fx.requests(spark, sf)
    for cap in (1, 30):
        cands, stats = match.select_candidates(lst, req, Params(max_candidates=cap))
        got = sorted(tuple(r) for r in cands.select("request_id", "pos", "id").collect())
        want = sorted(tuple(r) for r in brute_force(lst, req, cap).select("request_id", "pos", "id").collect())
        assert got == want and len(got) > 0
    # batch over all requests = union of single-request runs
    ids = [r[0] for r in match.valid_requests(req).select("request_id").orderBy("request_id").limit(5).collect()]
    for rid in ids:
        one = match.select_candidates(lst, req.where(F.col("request_id") == rid))[0]
        a = sorted(tuple(r) for r in one.select("pos", "id").collect())
        b = sorted(tuple(r) for r in cands.where(F.col("request_id") == rid).select("pos", "id").collect())
        assert a == b


def test_properties_on_fixture(spark):
    from dinerank.operators.ingest import ingest
    from dinerank.sources import fixtures as fx

    sf = "/root/testdata/sf0.001"
    lst = ingest(fx.raw_listings(spark, sf))
    req = fx.requests(spark, sf)
    cands, stats = match.select_candidates(lst, req)
    # positions are 1..n per request, names unique per request
    w = Window.partitionBy("request_id")
    chk = cands.withColumn("n", F.count("*").over(w)).withColumn("mx", F.max("pos").over(w)).withColumn(
        "names", F.size(F.collect_set(F.lower(F.trim("name"))).over(w)))
    bad = chk.where((F.col("n") != F.col("mx")) | (F.col("names") != F.col("n"))).count()
    assert bad == 0
    # candidates are a subset of the batch matches; counts agree with stats
    pairs = match.batch_match(lst, req)
    assert cands.select("request_id", F.col("id").alias("listing_id")).subtract(pairs).count() == 0
    per_req = cands.groupBy("request_id").count()
    j = stats.join(per_req, "request_id", "left").where(F.coalesce("count", F.lit(0)) != F.col("candidate_count"))
    assert j.count() == 0
    # repartitioning the inputs does not change the answer
    c2, _ = match.select_candidates(lst.repartition(3), req.repartition(5))
    assert c2.select("request_id", "pos", "id").exceptAll(cands.select("request_id", "pos", "id")).count() == 0


def test_dedup_agg_equals_window(spark):
    from dinerank.operators.ingest import ingest
    from dinerank.sources import fixtures as fx

    lst = match.listing_columns(ingest(fx.raw_listings(spark, "/root/testdata/sf0.001")))
    a = match.dedup_by_name(lst).select("id")
    b = match.dedup_by_name_agg(lst).select("id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_written_intermediates_do_not_change_results(spark):
    from dinerank.operators.ingest import ingest
    from dinerank.sources import fixtures as fx

    sf = "/root/testdata/sf0.001"
    lst = ingest(fx.raw_listings(spark, sf)).cache()
    req = fx.requests(spark, sf)
    a, _ = match.select_candidates(lst, req)  # lazy
    b, _ = match.select_candidates(lst, req, scratch=Scratch(spark))
    cols = ["request_id", "pos", "id"]
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0
    assert b.select(*cols).exceptAll(a.select(*cols)).count() == 0


def test_dedup_is_idempotent_and_cap_is_subset(spark):
    from dinerank.operators.ingest import ingest
    from dinerank.sources import fixtures as fx

    canonical = ingest(fx.raw_listings(spark, "/root/testdata/sf0.001"))
    lst = match.listing_columns(canonical)
    once = match.dedup_by_name(lst)
    twice = match.dedup_by_name(once)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    top = match.top_listings(canonical, 5)
    assert top.select("id").subtract(once.select("id")).count() == 0
    assert [r["pos"] for r in top.orderBy("pos").collect()] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("cap", [1, 3, 30, 100])
def test_depth_bounds_lose_no_candidate(spark, cap):
    """Many names per key, repeated, blank and tied: the bounded plan equals the plain one."""
    import random

    r = random.Random(cap)
    rows = [(f"id{i}", r.choice(["", " ", "Zed", *[f"Name {k}" for k in range(150)], *[f" name {k} " for k in range(40)]]), r.choice(["koramangala", "btm"]), r.choice([["indian"], ["indian", "north indian"], ["thai"], [], None]),
             r.choice([None, 0.0, 3.1, 4.0, 4.1, 4.9]), 500.0, r.choice(["low", "high", None]), r.choice([None, 0, 1, 7, 900])) for i in range(2500)]
    listings = spark.createDataFrame(rows, "id string, name string, location string, cuisines array<string>, rating double, estimated_cost double, "
                                           "budget_band string, votes long").withColumn("metadata", F.struct("votes")).drop("votes")
    requests = make_requests(spark, [{"location": loc, "budget": b, "cuisine": c, "min_rating": m}
                                     for loc in ("koramangala", "m") for b in ("low", "high") for c in ("indian", "north", "thai", "none") for m in (0.0, 4.0)])
    got, stats = match.select_candidates(listings, requests, Params(max_candidates=cap))
    pick = ["request_id", "pos", "id"]
    want = brute_force(listings, requests, cap)
    assert sorted(map(tuple, got.select(pick).collect())) == sorted(map(tuple, want.select(pick).collect()))
    assert {x["request_id"]: x["candidate_count"] for x in stats.collect() if x["candidate_count"]} == {
        x["request_id"]: x["count"] for x in want.groupBy("request_id").count().collect()}
