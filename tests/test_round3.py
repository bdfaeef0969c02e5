"""Generated row positions, stored values, pruned reads, the reply journal and lenient JSON."""

import json
import os
import tempfile

import pytest
from conftest import make_requests, raw_df, raw_row
from pyspark.sql import functions as F

from dinerank.operators import match, replies as rp, score, vocab
from dinerank.operators.ingest import ingest
from dinerank.plans.recommend import main, named_scorer
from dinerank.sources import listings as io
from dinerank.sources import pruned


def scan_rows(df):
    """Rows that the Parquet scan of a plan without shuffles gave out (whole row groups)."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    return sum(int(leaves.apply(i).metrics().apply("numOutputRows").value()) for i in range(leaves.size()))


# ------------------------------------------------------------ row positions

def test_positions_over_files_splits_and_row_groups(spark):
    root = tempfile.mkdtemp()
    raw = raw_df(spark, [raw_row(i, name=f"P{i:04d}") for i in range(600)])
    for part, (low, high) in enumerate(((0, 250), (250, 251), (251, 600))):
        rows = raw.where((F.col("row_index") >= low) & (F.col("row_index") < high)).orderBy("row_index").drop("row_index")
        rows.coalesce(1).write.mode("append").option("parquet.block.size", "1024").parquet(f"{root}/raw/part={part}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = io.scan_raw(spark, f"{root}/raw")
        assert spark.read.parquet(f"{root}/raw").rdd.getNumPartitions() > 3
        got = found.select("name", "row_index").orderBy("row_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["name"], r["row_index"]) for r in got] == [(f"P{i:04d}", i) for i in range(600)]


def test_positions_count_rows_from_footers_only(spark):
    root = tempfile.mkdtemp()
    raw_df(spark, [raw_row(i) for i in range(3)]).drop("row_index").write.parquet(f"{root}/raw")
    plan = io.scan_raw(spark, f"{root}/raw")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "monotonically_increasing_id" not in physical and "ReadSchema: struct<>" in physical
    empty = raw_df(spark, [raw_row(0)]).drop("row_index").limit(0)
    empty.write.parquet(f"{root}/empty")
    assert io.scan_raw(spark, f"{root}/empty").count() == 0


def test_single_line_csv_is_split(spark):
    root = tempfile.mkdtemp()
    raw_df(spark, [raw_row(i, name=f"P{i:04d}") for i in range(400)]).orderBy("name").drop("row_index").coalesce(1).write.csv(
        f"{root}/raw", header=True)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = io.scan_raw(spark, f"{root}/raw", "csv", multiline=False).orderBy("row_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["name"], r["row_index"]) for r in got] == [(f"P{i:04d}", i) for i in range(400)]


# ------------------------------------------------------------ stored values

@pytest.fixture(scope="module")
def many(spark):
    areas = ["Koramangala", "Indiranagar", "Domlur", "Hebbal", "Hosur"]
    return ingest(raw_df(spark, [
        raw_row(i, location=areas[i % 5], address=f"{i}, Road, {areas[i % 5]}, Bangalore", cuisines="Thai, Thai, Cafe" if i % 2 else None,
                **{"approx_cost(for two people)": str([300, 800, 2000][i % 3])}) for i in range(300)])).cache()


def test_stored_values_serve_the_vocabularies(spark, many):
    base = tempfile.mkdtemp() + "/t"
    io.publish(many, base)
    values = io.scan_values(spark, base)
    for kind, direct in (("city", vocab.distinct_cities), ("area", vocab.distinct_areas), ("cuisine", vocab.distinct_cuisines)):
        assert vocab.vocabulary(values, kind, kind).collect() == direct(many).collect()
    assert {r["value"]: r["n"] for r in values.where("kind = 'cuisine'").collect()} == {"thai": 150, "cafe": 150}
    assert values.where("kind = 'place'").agg(F.sum("n")).first()[0] == 300
    assert sorted(vocab.area_picker_at(spark, base).collect()) == sorted(vocab.area_picker(many).collect())
    assert sorted(vocab.cuisine_picker_at(spark, base).collect()) == sorted(vocab.cuisine_picker(many).collect())
    plan = vocab.area_picker_at(spark, base)._jdf.queryExecution().executedPlan().toString()
    assert io.VALUES in plan and "metadata" not in plan


def test_values_follow_their_version(spark, many):
    base = tempfile.mkdtemp() + "/t"
    io.publish(many.where("location like '%hebbal%'"), base)
    io.publish(many.where("location like '%domlur%'"), base)
    assert [r["area"] for r in vocab.vocabulary(io.scan_values(spark, base), "area", "area").collect()] == ["Domlur"]
    assert [r["area"] for r in vocab.vocabulary(io.scan_values(spark, base, 1), "area", "area").collect()] == ["Hebbal"]
    plain = tempfile.mkdtemp() + "/plain"  # a table that nobody published
    many.write.parquet(plain)
    assert sorted(io.scan_values(spark, plain).collect(), key=str) == sorted(io.count_values(many).collect(), key=str)


# ------------------------------------------------------------- pruned reads

@pytest.fixture(scope="module")
def small_groups(spark, many):
    """A published table of several row groups a file."""
    base = tempfile.mkdtemp() + "/t"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    settings = {"parquet.block.size": "4096", "parquet.page.size.row.check.min": "10", "parquet.block.size.row.check.min": "10",
                "parquet.block.size.row.check.max": "20"}
    for k, v in settings.items():
        conf.set(k, v)
    try:
        io.publish(many, base, num_files=2)
    finally:
        for k in settings:
            conf.unset(k)
    return base


def test_lookup_skips_row_groups(spark, many, small_groups):
    ids = [r["id"] for r in many.select("id").orderBy("id").collect()]
    wanted = spark.createDataFrame([(0, ids[7]), (1, "unknown"), (2, ids[3]), (3, ids[7]), (4, None)], "pos int, id string")
    assert [r["id"] for r in pruned.lookup_published(spark, small_groups, wanted).collect()] == [ids[7], ids[3], ids[7]]
    table = io.scan_listings(spark, small_groups)
    one = table.where(pruned.any_of([F.col("id") == ids[7]])).select("id")
    none = table.where(pruned.any_of([F.col("id") == "unknown"])).select("id")
    assert scan_rows(table.select("id")) == 300
    assert 0 < scan_rows(one) < 150 and scan_rows(none) < 150
    every = spark.createDataFrame(list(enumerate(ids)), "pos int, id string")  # more than a filter names
    assert len(ids) > pruned.NAMED
    assert [r["id"] for r in pruned.lookup_published(spark, small_groups, every).collect()] == ids
    assert pruned.lookup_published(spark, small_groups, every.limit(0)).count() == 0


def test_requests_read_what_they_can_match(spark, many, small_groups, monkeypatch):
    req = make_requests(spark, [
        {"location": "hebbal", "budget": "low", "cuisine": "thai", "min_rating": 0.0},
        {"location": "HOSUR", "budget": "high", "cuisine": "cafe", "min_rating": 0.0},
        {"location": "nowhere", "budget": "high", "cuisine": "cafe", "min_rating": 0.0},
        {"location": " ", "budget": "medium", "cuisine": "cafe", "min_rating": 0.0}])
    found = pruned.scan_matching(spark, small_groups, req)
    assert scan_rows(found.select("id")) < 300
    assert 0 < found.count() < 100
    want = sorted(match.select_candidates(many, req)[0].collect(), key=str)
    assert want and sorted(match.select_candidates(found, req)[0].collect(), key=str) == want
    assert sorted(match.batch_match(found, req).collect()) == sorted(match.batch_match(many, req).collect())
    assert pruned.scan_matching(spark, small_groups, req.where("request_id = 2")).count() == 0
    monkeypatch.setattr(pruned, "NAMED", 1)
    assert pruned.scan_matching(spark, small_groups, req).count() == 300


# ------------------------------------------------------------ reply journal

def prompts(spark, n, texts):
    return spark.range(n).select(F.col("id").alias("request_id"), F.array(F.struct(
        F.lit("user").alias("role"), F.concat(F.lit("p"), (F.col("id") % texts).cast("string")).alias("content"))).alias("messages"))


def logging_scorer(log, fail_at=None):
    def ask(messages):
        import os
        import uuid

        text = messages[0]["content"]
        if fail_at and len(os.listdir(log)) >= fail_at:
            os._exit(1)  # the worker dies, and with it the task
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write(text)
        return "reply to " + text
    return ask


def asked(log):
    return sorted(open(f"{log}/{f}").read() for f in os.listdir(log))


def test_equal_prompts_are_asked_once_and_never_again(spark):
    log, journal = tempfile.mkdtemp(), tempfile.mkdtemp() + "/journal"
    first = score.score_with_journal(prompts(spark, 40, 10), journal, logging_scorer(log), waves=3).collect()
    assert asked(log) == sorted(f"p{i}" for i in range(10))
    assert sorted((r["request_id"], r["raw"]) for r in first) == [(i, f"reply to p{i % 10}") for i in range(40)]
    again = score.score_with_journal(prompts(spark, 40, 12), journal, logging_scorer(log), waves=3).collect()
    assert asked(log) == sorted(f"p{i}" for i in range(12))
    assert {r["raw"] for r in again if r["attempts"] == 0} == {f"reply to p{i}" for i in range(10)}
    assert score.score_with_journal(prompts(spark, 0, 1), journal, logging_scorer(log), waves=3).count() == 0


def test_a_job_that_died_asks_only_the_rest(spark):
    log, journal = tempfile.mkdtemp(), tempfile.mkdtemp() + "/journal"
    with pytest.raises(Exception):
        score.score_with_journal(prompts(spark, 40, 40), journal, logging_scorer(log, fail_at=20), in_flight=1, waves=8)
    kept = score.read_journal(spark, journal).count()
    assert 0 < kept <= 20
    before = len(asked(log))
    out = score.score_with_journal(prompts(spark, 40, 40), journal, logging_scorer(log), in_flight=1, waves=8).collect()
    assert sorted(r["raw"] for r in out) == sorted(f"reply to p{i}" for i in range(40))
    assert len(asked(log)) == before + 40 - kept


def test_failed_prompts_are_asked_again(spark):
    log, journal = tempfile.mkdtemp(), tempfile.mkdtemp() + "/journal"

    def failing(messages):
        raise RuntimeError("no")

    out = score.score_with_journal(prompts(spark, 3, 3), journal, failing, waves=1).collect()
    assert [(r["raw"], r["attempts"]) for r in out] == [(None, 2)] * 3 and all("no" in r["error"] for r in out)
    out = score.score_with_journal(prompts(spark, 3, 3), journal, logging_scorer(log), waves=1).collect()
    assert len(out) == 3 and all(r["raw"] for r in out)
    with pytest.raises(ValueError):
        score.score_with_journal(prompts(spark, 3, 3), journal, waves=0)


def test_the_job_takes_a_scorer_by_name(spark, scenario_listings):
    root = tempfile.mkdtemp()
    io.publish(scenario_listings, f"{root}/t")
    make_requests(spark, [{"location": "bangalore", "budget": "medium", "cuisine": "indian", "min_rating": 0.0}]).write.parquet(f"{root}/q")
    assert main(["recommend", "--listings", f"{root}/t", "--requests", f"{root}/q", "--output", f"{root}/o",
                 "--scorer", "dinerank.operators.score:offline_scorer", "--journal", f"{root}/j"]) == 0
    assert spark.read.parquet(f"{root}/o/responses").first()["status"] == "success"
    assert score.read_journal(spark, f"{root}/j").count() == 1
    with pytest.raises(ValueError):
        named_scorer("dinerank.operators.score")


# -------------------------------------------------------------- lenient JSON

@pytest.mark.parametrize("raw", [
    '{"recommendations": [{"restaurant_id": "a", "rank": 5, "rank": 1}], "summary": "x", "summary": "y"}',
    '{"recommendations": 3, "recommendations": [{"restaurant_id": "z", "restaurant_id": "a", "rank": 1, "score": NaN}], "summary": "y"}',
    'so: {"summary": "y", "confidence": -Infinity, "recommendations": [{"restaurant_id": "a", "rank": 1, "d": [Infinity, NaN]}]} bye',
])
def test_last_key_and_number_literals(spark, raw):
    row = rp.parse_replies(spark.createDataFrame([(1, raw)], "request_id long, raw string")).first()
    assert (row["valid"], row["summary"], [(i["restaurant_id"], i["rank"]) for i in row["items"]]) == (True, "y", [("a", 1)])
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"


@pytest.mark.parametrize("raw", [
    '{"recommendations": [{"restaurant_id": "a", "rank": NaN}]}', '{"summary": NaN, "recommendations": []}',
    '{"recommendations": NaN}', '{"recommendations": [{"restaurant_id": Infinity, "rank": 1}]}', "NaN", '{"a": xNaN}', '{"a": -NaN}',
    '{"recommendations": [{"restaurant_id": "a", "rank": 1, "explanation": -Infinity}]}', '{"a": NaN.5}', '{"a": nan}',
])
def test_number_literals_stay_refused_where_checked(spark, raw):
    assert not rp.parse_replies(spark.createDataFrame([(1, raw)], "request_id long, raw string")).first()["valid"]


def test_literals_inside_strings_are_text(spark):
    words = 'NaN, "Infinity": [NaN] \\ -Infinity'
    raw = json.dumps({"summary": words, "recommendations": [{"restaurant_id": "NaN", "rank": 1, "explanation": ": NaN,"}], "x": float("nan")})
    row = rp.parse_replies(spark.createDataFrame([(1, raw)], "request_id long, raw string")).first()
    assert row["valid"] and row["summary"] == words and row["items"][0]["restaurant_id"] == "NaN" and row["items"][0]["explanation"] == ": NaN,"
    long = '{"x": NaN, "summary": "' + 'a\\"b ' * 60000 + '", "recommendations": []}'
    assert rp.parse_replies(spark.createDataFrame([(1, long)], "request_id long, raw string")).first()["valid"]
