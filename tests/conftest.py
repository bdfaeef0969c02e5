import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dinerank.schemas import RAW_COLUMNS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .appName("dinerank-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="dinerank-test-ckpt-"))
    yield s


def raw_row(i, **over):
    """A raw listing row (all strings) with sensible defaults."""
    row = {c: None for c in RAW_COLUMNS}
    row.update({
        "url": f"https://example.invalid/r{i}",
        "address": "12, 1st Main Road, Koramangala, Bangalore",
        "name": f"Place {i}",
        "online_order": "Yes",
        "book_table": "No",
        "rate": "4.0/5",
        "votes": "100",
        "location": "Koramangala",
        "rest_type": "Casual Dining",
        "cuisines": "North Indian",
        "approx_cost(for two people)": "800",
    })
    row.update(over)
    row["row_index"] = i
    return row


def raw_df(spark, rows):
    from dinerank.schemas import RAW_LISTING

    return spark.createDataFrame([tuple(r[f.name] for f in RAW_LISTING.fields) for r in rows], RAW_LISTING)


# The ten-listing filter scenario (cap 3, bands 500 / 1500).
SCENARIO = [
    ("Jalsa", "4.1/5", "775", "North Indian, Mughlai, Chinese", "800", "Bangalore"),
    ("Spice Elephant", "4.5/5", "900", "Chinese, North Indian, Thai", "800", "Bangalore"),
    ("Mughlai Magic", "4.3/5", "500", "North Indian, Mughlai", "900", "Bangalore"),
    ("Indian Spice Hub", "4.2/5", "650", "North Indian", "700", "Bangalore"),
    ("Curry Corner", "4.0/5", "400", "North Indian, Chinese", "600", "Bangalore"),
    ("Budget Bites", "4.8/5", "50", "North Indian", "300", "Bangalore"),
    ("Premium Palace", "4.9/5", "1200", "Italian, Continental", "2000", "Bangalore"),
    ("Low Rated Spot", "3.2/5", "200", "North Indian", "400", "Bangalore"),
    ("Delhi Darbar", "4.5/5", "600", "North Indian, Mughlai", "400", "New Delhi"),
    ("Unknown Cost Cafe", "4.0/5", "100", "Cafe", "-", "Bangalore"),
]


@pytest.fixture(scope="session")
def scenario_listings(spark):
    from dinerank.operators.ingest import ingest

    rows = [
        raw_row(i, name=n, rate=r, votes=v, cuisines=c, **{"approx_cost(for two people)": cost},
                address=f"{i + 1}, Some Road, Central, {city}", location="Central")
        for i, (n, r, v, c, cost, city) in enumerate(SCENARIO)
    ]
    return ingest(raw_df(spark, rows)).cache()


def make_requests(spark, rows):
    from dinerank.schemas import REQUEST

    full = []
    for i, r in enumerate(rows):
        d = {"request_id": i, "additional_preferences": None, "top_k": 5}
        d.update(r)
        full.append(tuple(d.get(f.name) for f in REQUEST.fields))
    return spark.createDataFrame(full, REQUEST)
