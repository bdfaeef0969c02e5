"""Plans over written tables whose rows are far larger than their files: a table
that grows with the requests is never a broadcast, and no step has a fixed number of tasks."""

import pytest
from conftest import make_requests

from dinerank.operators import match, merge, prompts as pr, replies as rp, score
from dinerank.session import Scratch
from dinerank.sources import fixtures as fx


@pytest.fixture(scope="module")
def asked(spark, scenario_listings):
    """Written candidates and the valid requests, of few bytes."""
    req = make_requests(spark, [dict(location="bangalore", budget="medium", cuisine="indian", min_rating=4.0) for _ in range(8)])
    scratch = Scratch(spark)
    req = scratch.cut(req)
    yield scratch.cut(match.select_candidates(scenario_listings, req)[0]), match.valid_requests(req)
    scratch.close()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unknown_ids_are_dropped_without_a_broadcast(asked):
    cands, _ = asked
    df = rp.drop_unknown_ids(fx.reply_items(cands), cands)
    assert "Broadcast" not in plan(df)
    assert df.where("listing_id = 'zzz'").isEmpty() and not df.isEmpty()


def test_merge_has_no_broadcast(asked):
    cands, valid = asked
    items = rp.sanitize_items(fx.reply_items(cands), cands)
    df = merge.merge_recommendations(items, cands, valid)
    assert "Broadcast" not in plan(df)
    assert "Broadcast" not in plan(merge.merge_recommendations(None, cands, valid))
    assert {r.source for r in df.select("source").collect()} == {"reply", "backfill"}


def test_prompts_and_journal_have_no_broadcast(asked, tmp_path):
    cands, valid = asked
    p = pr.build_prompts(cands, valid)
    assert "Broadcast" not in plan(p) and p.count() == 8
    scored = score.score_with_journal(p, str(tmp_path / "journal"), waves=1)
    assert "Broadcast" not in plan(scored) and scored.count() == 8


def test_top_candidates_per_request_have_no_broadcast(spark, monkeypatch, asked):
    from dinerank.plans import catalog

    monkeypatch.setattr(catalog, "candidates", lambda *_: asked[0])
    monkeypatch.setattr(catalog, "valid", lambda *_: asked[1])
    df = catalog.q_recommend_topk(spark, "")
    assert "Broadcast" not in plan(df)
    assert df.groupBy("request_id").count().select("count").distinct().count() == 1
    assert "Broadcast" not in plan(catalog.q_fallback_summary(spark, ""))


def test_raw_source_has_as_many_files_as_its_rows_need(spark, monkeypatch):
    import glob

    from conftest import raw_df, raw_row
    from dinerank.plans import catalog

    rows = raw_df(spark, [raw_row(i) for i in range(200)])
    monkeypatch.setattr(catalog, "raw", lambda *_: rows)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        path = catalog._raw_source(spark, "")
    finally:
        spark.conf.set(name, before)
    files = glob.glob(f"{path.removeprefix('file:')}/train/part-*.parquet")
    assert len(files) == int(spark.conf.get("spark.sql.shuffle.partitions"))  # was 4, whatever the input


def test_positions_do_not_deal_rows_by_file(spark):
    from conftest import raw_df, raw_row
    from dinerank.sources import listings as io

    scratch = Scratch(spark)
    path = scratch.table_path()
    raw_df(spark, [raw_row(i, name=f"n{i:03d}") for i in range(50)]).drop("row_index").coalesce(1).write.parquet(path)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")  # as for a table of many files
    try:
        df = io.scan_raw(spark, path)
        assert "SortMergeJoin" not in plan(df)
        assert [(r.name, r.row_index) for r in df.orderBy("row_index").collect()] == [(f"n{i:03d}", i) for i in range(50)]
    finally:
        spark.conf.set(name, before)
        scratch.close()
