"""Golden vectors for the ingest expressions."""

import pytest
from pyspark.sql import functions as F

from dinerank.functions import (
    budget_band, clean_string, extract_city, parse_cost, parse_cuisines, parse_rating, parse_votes,
    searchable_location, stable_id, title_case, ustrip,
)


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("4.1/5", 4.1), ("NEW", 0.0), ("-", 0.0), (None, 0.0), ("abc", 0.0), ("6.0", 5.0),
    ("-1", 1.0), ("3.9 /5", 3.9), ("  ", 0.0), ("n/a", 0.0),
])
def test_rating(spark, text, expected):
    assert one(spark, parse_rating, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("800", 800.0), ("1,200", 1200.0), ("₹1,200 for two", 1200.0), ("300-500", 500.0),
    ("500 to 300", 500.0), ("700 / 900", 700.0), ("-", None), ("NA", None), (None, None),
    ("0", 0.0), ("Total 300 and 500", 500.0), ("  ", None),
])
def test_cost(spark, text, expected):
    assert one(spark, parse_cost, text) == expected


@pytest.mark.parametrize("cost,expected", [
    (None, None), (0.0, "low"), (500.0, "low"), (501.0, "medium"), (1500.0, "medium"), (1501.0, "high"),
])
def test_band(spark, cost, expected):
    assert one(spark, budget_band, cost, "double") == expected


@pytest.mark.parametrize("text,expected", [
    (" Italian, chinese , ", ["italian", "chinese"]), ("", []), (None, []), (",,", []),
    ("Cafe, Cafe", ["cafe", "cafe"]),
])
def test_cuisines(spark, text, expected):
    assert one(spark, parse_cuisines, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("775", 775), (" 12 ", 12), ("4.7", None), ("1,234", None), ("", None), ("1_000", 1000), (None, None),
])
def test_votes(spark, text, expected):
    assert one(spark, parse_votes, text) == expected


@pytest.mark.parametrize("address,expected", [
    ("a, b ,  ,", "b"), ("942, 21st Main Road, Bengaluru", "Bangalore"), ("x, delhi", "Delhi"),
    ("", ""), ("New Delhi", "New Delhi"), ("x, BTM Bangalore", "Bangalore"), ("x, Pune", "Pune"),
])
def test_city(spark, address, expected):
    assert one(spark, extract_city, address) == expected


def test_searchable_location(spark):
    df = spark.createDataFrame(
        [("Koramangala", "Bangalore", "addr"), ("", "", "Some Address"), ("", "Delhi", "x")],
        "loc string, city string, addr string")
    out = [r[0] for r in df.select(searchable_location(F.col("loc"), F.col("city"), F.col("addr"))).collect()]
    assert out == ["koramangala, bangalore", "some address", "delhi"]


def test_stable_id(spark):
    df = spark.createDataFrame([("Jalsa", "942, 21st Main Road, 2nd Stage, Banashankari, Bangalore", 0)],
                               "n string, a string, i long")
    assert df.select(stable_id(F.col("n"), F.col("a"), F.col("i"))).first()[0] == "af031520d9c75a6d"


def test_unicode_strip_matches_python(spark):
    samples = ["  x 　", "​x ", "\t\n y\x1c", "  ", " z ", None]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = [r[0] for r in df.select(ustrip(F.col("s"))).collect()]
    assert got == [s.strip() if s is not None else None for s in samples]
    got = [r[0] for r in df.select(clean_string(F.col("s"))).collect()]
    assert got == [(s.strip() or None) if s is not None else None for s in samples]


@pytest.mark.parametrize("text", ["north indian", "cafe's north-indian", "brand#13", "3rd street", "", "ÉCOLE du café"])
def test_title_case_matches_python(spark, text):
    assert one(spark, title_case, text) == text.title()


def test_each_parsed_value_is_computed_once(spark):
    df = spark.createDataFrame([("300-500",)], "v string")
    for parse, step in ((parse_cost, "regexp_extract_all("), (parse_rating, "regexp_extract("), (extract_city, "split("), (parse_votes, "trim(")):
        assert df.select(parse(F.col("v")).alias("r"))._jdf.queryExecution().optimizedPlan().toString().count(step) == 1, parse
