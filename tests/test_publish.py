"""Versioned publishing: commits, conflicts, pinned readers, retirement."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import raw_df, raw_row

from dinerank.operators.ingest import ingest
from dinerank.sources import listings as io


@pytest.fixture(scope="module")
def table(spark):
    return ingest(raw_df(spark, [raw_row(i) for i in range(10)])).cache()


def test_a_reader_in_between_keeps_its_version(spark, table, tmp_path):
    base = str(tmp_path / "t")
    io.publish(table, base)
    reader = io.scan_listings(spark, base)
    before = reader.count()
    io.publish(table.limit(2), base)
    assert reader.count() == before and io.scan_listings(spark, base).count() == 2
    assert io.scan_listings(spark, base, number=1).count() == before
    assert io.read_manifest(spark, base)["row_count"] == 2
    with pytest.raises(ValueError):
        io.scan_listings(spark, base, number=9)


def test_two_publishers_both_get_a_number_of_their_own(spark, table, tmp_path):
    base = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: io.publish(table.limit(k), base), [1, 2, 3, 4]))
    found = io.commits(spark, base)
    assert [n for n, _ in found] == [1, 2, 3, 4] and len({v for _, v in found}) == 4


def test_of_two_publishers_from_one_state_only_one_wins(spark, table, tmp_path):
    base = str(tmp_path / "t")
    io.publish(table, base)

    def attempt(k):
        try:
            return io.publish(table.limit(k), base, version=f"try{k}", expected=1)["row_count"]
        except io.PublishConflict:
            return None

    with ThreadPoolExecutor(3) as pool:
        won = [r for r in pool.map(attempt, [1, 2, 3]) if r is not None]
    assert len(won) == 1 and io.scan_listings(spark, base).count() == won[0]
    left = [k for k in (1, 2, 3) if io.path_exists(spark, f"{base}/try{k}")]
    assert left == won  # the losers' files are gone


def test_an_unfinished_record_is_no_commit(spark, table, tmp_path):
    base = str(tmp_path / "t")
    io.publish(table, base)
    assert io.create_text(spark, f"{base}/{io.COMMITS}/{2:020d}", '{"version": "v')
    assert not io.create_text(spark, f"{base}/{io.COMMITS}/{2:020d}", "{}")
    assert io.scan_listings(spark, base).count() == table.count()
    io.publish(table.limit(3), base)
    assert [n for n, _ in io.commits(spark, base)] == [1, 3] and io.scan_listings(spark, base).count() == 3


def test_old_versions_are_retired(spark, table, tmp_path):
    base = str(tmp_path / "t")
    for k in (1, 2, 3):
        io.publish(table.limit(k), base, version=f"v{k}")
    assert io.retire(spark, base, keep=2) == ["v1"]
    assert not io.path_exists(spark, f"{base}/v1") and [n for n, _ in io.commits(spark, base)] == [2, 3]
    assert io.scan_listings(spark, base).count() == 3
    assert io.retire(spark, base, keep=2) == []
    with pytest.raises(ValueError):
        io.retire(spark, base, keep=0)


def test_rejected_publish_leaves_the_table(spark, table, tmp_path):
    base = str(tmp_path / "t")
    io.publish(table, base)
    with pytest.raises(ValueError):
        io.publish(table.limit(0), base)
    assert [n for n, _ in io.commits(spark, base)] == [1]
