"""Explicit schemas: raw listing, canonical listing, request, reply."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw listing columns as published by the source dataset (fixed names).
RAW_COLUMNS = [
    "url", "address", "name", "online_order", "book_table", "rate", "votes",
    "phone", "location", "rest_type", "dish_liked", "cuisines",
    "approx_cost(for two people)", "reviews_list", "menu_item",
    "listed_in(type)", "listed_in(city)",
]
# Columns the normaliser cannot work without (fixed set).
REQUIRED_RAW_COLUMNS = frozenset(
    {"name", "address", "cuisines", "approx_cost(for two people)", "rate", "location"}
)
COST_COLUMN = "approx_cost(for two people)"

RAW_LISTING = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS]
    + [T.StructField("row_index", T.LongType(), False)]
)

METADATA = T.StructType([
    T.StructField("locality", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("votes", T.LongType()),
    T.StructField("rest_type", T.StringType()),
    T.StructField("online_order", T.StringType()),
    T.StructField("book_table", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("source_row_index", T.LongType()),
])

LISTING = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("location", T.StringType(), False),
    T.StructField("cuisines", T.ArrayType(T.StringType(), False), False),
    T.StructField("rating", T.DoubleType(), False),
    T.StructField("estimated_cost", T.DoubleType(), True),
    T.StructField("budget_band", T.StringType(), True),
    T.StructField("metadata", METADATA, True),
])

REQUEST = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("location", T.StringType()),
    T.StructField("budget", T.StringType()),
    T.StructField("cuisine", T.StringType()),
    T.StructField("min_rating", T.DoubleType()),
    T.StructField("additional_preferences", T.StringType()),
    T.StructField("top_k", T.IntegerType()),
])

REPLY = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("raw", T.StringType()),
])

BUDGET_LEVELS = ("low", "medium", "high")


def missing_columns(columns, required=REQUIRED_RAW_COLUMNS) -> list[str]:
    """Sorted list of required columns absent from ``columns``."""
    return sorted(set(required) - set(columns))


def check_raw_columns(df) -> None:
    """Fail before any action when required raw columns are missing."""
    missing = missing_columns(df.columns)
    if missing:
        raise ValueError(f"raw listings lack {', '.join(missing)}; the source has {', '.join(sorted(df.columns)) or 'no column'}")
