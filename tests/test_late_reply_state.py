"""Findings of round 4 on tables of 6 GB: what late replies and the listings beneath them take."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import make_requests
from dinerank.sources import listings as io
from dinerank.streaming import replies_stream as stream

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
T0 = datetime(2024, 1, 1, 12)


def _streams(spark, scenario_listings, root):
    io.publish(scenario_listings, f"{root}/listings")
    make_requests(spark, [{"location": "bangalore", "budget": "medium", "cuisine": "indian", "min_rating": 0.0}] * 3).withColumn(
        "asked_at", F.lit(T0)).select(*stream.ASKED.names).write.parquet(f"{root}/requests")
    spark.createDataFrame([(1, None, T0 + timedelta(minutes=60))], stream.REPLIED).write.parquet(f"{root}/replies")
    stream.answer_reply_stream(
        spark, *(f"{root}/{x}" for x in ("listings", "requests", "replies", "out", "ckpt"))).awaitTermination()


def test_the_state_of_late_replies_lies_on_disk(spark, scenario_listings, tmp_path):
    own = lambda: {k: v for k, v in spark.conf.getAll.items() if "streaming" in k}
    before = own()
    _streams(spark, scenario_listings, tmp_path / "a")
    assert own() == before
    assert [*(tmp_path / "a/ckpt/state").rglob("*.zip")] and not [*(tmp_path / "a/ckpt/state").rglob("*.delta")]
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:  # a session that names a store keeps it
        _streams(spark, scenario_listings, tmp_path / "b")
    finally:
        spark.conf.unset(PROVIDER)
    assert [*(tmp_path / "b/ckpt/state").rglob("*.delta")] and not [*(tmp_path / "b/ckpt/state").rglob("*.zip")]


def test_a_batch_that_decides_nothing_reads_no_listings(spark, scenario_listings, tmp_path, monkeypatch):
    from dinerank.plans import recommend as plan

    seen, real = [], plan.recommend

    def watched(listings, requests, *rest, **named):
        seen.append((requests.count(), listings.count()))
        return real(listings, requests, *rest, **named)

    monkeypatch.setattr(plan, "recommend", watched)
    _streams(spark, scenario_listings, tmp_path)
    assert sorted(seen) == [(0, 0), (3, scenario_listings.count())]
    for kind in ("recommendations", "responses"):
        assert len([*(tmp_path / "out" / kind).glob("epoch=*")]) == 2
    assert spark.read.parquet(f"{tmp_path}/out/responses").count() == 3


def test_values_are_counted_from_different_places_and_tag_lists(spark, scenario_listings):
    odd = F.struct(*[F.lit(v).cast("string").alias(k) for k, v in (("locality", " Here "), ("city", " "))])
    lst = scenario_listings.select("location", "budget_band", "cuisines", F.struct("metadata.locality", "metadata.city").alias("metadata"))
    rows = lst.unionByName(lst).unionByName(lst.select(
        F.lit("x").alias("location"), "budget_band", F.array(F.lit("a"), F.lit("a"), F.lit("b")).alias("cuisines"), odd.alias("metadata"))).unionByName(
        lst.limit(2).select(F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("budget_band"),
                            F.lit(None).cast("array<string>").alias("cuisines"), F.lit(None).cast(lst.schema["metadata"].dataType).alias("metadata")))
    wanted = Counter()
    for r in rows.collect():
        m = r["metadata"]
        wanted.update(("place", r["location"], r["budget_band"]) for _ in [0] if r["location"] is not None)
        wanted.update((k, m[c].strip(), None) for k, c in (("city", "city"), ("area", "locality")) if m and m[c] and m[c].strip())
        wanted.update(("cuisine", c, None) for c in set(r["cuisines"] or []))
    counted = io.count_values(rows)
    assert {(r["kind"], r["value"], r["band"]): r["n"] for r in counted.collect()} == wanted
    assert counted.schema["n"].dataType.simpleString() == "bigint"
